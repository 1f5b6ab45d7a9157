"""Per-sample statistics and the reports drawn from them. Each is one partial and final aggregation over the reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from readloom.functions.columns import PHRED_OFFSET, percent
from readloom.functions.quality import quality_measures
from readloom.plans.sheet import Sheet

MEASURES = ("r1_qc_30", "r2_qc_30", "r3_qc_30", "r1_bases", "r2_bases", "r3_bases", "r1_qc", "r2_qc", "r3_qc", "all_reads")


def mismatch_columns(most: int) -> list[str]:
    return [f"{k}-mismatches" for k in range(most + 1)]


def read_statistics(assigned: DataFrame, barcode_length: int, most: int, mate_qual: str | None = None) -> DataFrame:
    """assigned: row_ix, mm, qual, and the mate's quality if there is one. One row for each row_ix with reads: MEASURES and
    the mismatch counts. r3 is the barcode; without a mate, the rest of the barcode read counts as r1."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    rows = assigned.select("row_ix", "mm", quality_measures("qual", barcode_length).alias("own"), size("qual").alias("bases"), *([quality_measures(mate_qual).alias("mate"), size(mate_qual).alias("mate_bases")] if mate_qual else []))
    tail = F.least(F.lit(barcode_length), "bases")
    own = (F.col("own.rest_sum"), F.col("own.rest_q30"), F.col("bases") - tail)
    mate = (F.col("mate.rest_sum"), F.col("mate.rest_q30"), F.col("mate_bases")) if mate_qual else own
    none = (F.lit(0), F.lit(0), F.lit(0))
    aggs = []
    for prefix, (total, high, bases) in (("r1", mate), ("r2", own if mate_qual else none), ("r3", (F.col("own.tail_sum"), F.col("own.tail_q30"), tail))):
        aggs += [F.sum(high).alias(f"{prefix}_qc_30"), F.sum(bases).cast("long").alias(f"{prefix}_bases"), F.sum(total - PHRED_OFFSET * bases).alias(f"{prefix}_qc")]
    counts = [F.count_if(F.col("mm") == k).alias(c) for k, c in enumerate(mismatch_columns(most))]
    return rows.groupBy("row_ix").agg(*aggs, F.count("*").alias("all_reads"), *counts).select("row_ix", *MEASURES, *mismatch_columns(most))


def per_sample(stats: DataFrame, samples: DataFrame, hide_empty_pseudo: bool = True) -> DataFrame:
    """samples (Sheet.frame()) with their statistics, 0 where there are no reads; pseudo-samples without reads go."""
    joined = F.broadcast(samples).join(stats, "row_ix", "left") if samples is not None else stats
    filled = joined.fillna(0, subset=[c for c in stats.columns if c != "row_ix"])
    return filled.filter((F.col("role") == "sample") | (F.col("all_reads") > 0)) if hide_empty_pseudo else filled


def _ordered(rows: DataFrame, key: str, unique_ids: bool) -> DataFrame:
    return rows.orderBy(F.desc(key), "row_ix") if unique_ids else rows.orderBy("row_ix")


def info_report(sample_rows: DataFrame, most: int, unique_ids: bool = True, project: str | None = None) -> DataFrame:
    """sample and the reads by mismatches; the most reads first, in sheet order if sample ids repeat."""
    rows = sample_rows if project is None else sample_rows.filter(F.col("job_number") == project)
    return _ordered(rows, "all_reads", unique_ids).select(F.col("sample_id").alias("sample"), *[F.col(f"`{c}`") for c in mismatch_columns(most)])


def general_samples(sample_rows: DataFrame, unique_ids: bool = True, project: str | None = None) -> DataFrame:
    rows = sample_rows if project is None else sample_rows.filter(F.col("job_number") == project)
    return _ordered(rows, "all_reads", unique_ids).select(
        F.col("sample_id").alias("Sample ID"), (F.col("all_reads") / 1e6).alias("M Clusters"), ((F.col("r1_qc_30") + F.col("r2_qc_30")) / 1e6).alias("Mb Yield ≥ Q30"),
        *[percent(f"r{i}_qc_30", f"r{i}_bases").alias(f"% R{i} Yield ≥ Q30") for i in (1, 2, 3)], percent(F.col("`0-mismatches`"), "all_reads").alias("% Perfect Index"),
    )


def general_lane(sample_rows: DataFrame, run_lane: str, project: str | None = None) -> DataFrame:
    """One row over all samples. Shares of nothing are null here and NaN in the text report; perfect reads are counted
    among real samples only, by role, whatever the labels are."""
    rows = sample_rows if project is None else sample_rows.filter(F.col("job_number") == project)
    real = F.col("role") == "sample"
    sums = rows.agg(
        F.sum(F.col("r1_bases") + F.col("r2_bases")).alias("bases"), F.sum("all_reads").alias("reads"), F.sum(F.col("r1_qc_30") + F.col("r2_qc_30")).alias("q30"),
        F.sum(F.col("r1_qc") + F.col("r2_qc")).alias("qc"), F.sum(F.when(real, F.col("`0-mismatches`"))).alias("perfect"), F.sum(F.when(real, F.col("all_reads"))).alias("assigned"),
    )
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return sums.select(
        F.lit(run_lane).alias("Run ID-Lane"), (F.col("bases") / 1e6).alias("Mb Total Yield"), (F.col("reads") / 1e6).alias("M Total Clusters"), (share("q30", "bases") * 100).alias("% bases ≥ Q30"),
        share("qc", "bases").alias("Mean Quality"), (share("perfect", "assigned") * 100).alias("% Perfect Index"),
    )


def lane_totals(sample_rows: DataFrame) -> DataFrame:
    """Samples, projects and the whole run in one pass: grouping sets over (job_number, row_ix)."""
    sums = [F.sum(c).alias(c) for c in MEASURES]
    return sample_rows.rollup("job_number", "row_ix").agg(F.grouping_id().alias("level"), *sums)


def sample_statistics(sample_rows: DataFrame, most: int) -> DataFrame:
    return sample_rows.orderBy("row_ix").select("job_number", "sample_id", *MEASURES, *[F.col(f"`{c}`") for c in mismatch_columns(most)])


def barcode_counts(assigned: DataFrame, sheet: Sheet, which: str = "undetermined", limit: int = 0) -> DataFrame:
    """barcode and count of undetermined or ambiguous reads, both downwards; limit 0 stands for all."""
    row = len(sheet.samples) + (which == "ambiguous")
    counts = assigned.filter(F.col("row_ix") == row).groupBy("barcode").agg(F.count("*").alias("count"))
    ordered = counts.orderBy(F.desc("count"), F.desc("barcode"))
    return ordered.limit(limit) if limit else ordered


def merge_reports(reports: list[DataFrame]) -> DataFrame:
    """Sums of several lanes' sample statistics by job_number and sample_id; mismatch columns that a lane lacks count 0."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    values = [c for c in out.columns if c not in ("job_number", "sample_id")]
    values.sort(key=lambda c: (MEASURES.index(c) if c in MEASURES else len(MEASURES), int(c.split("-")[0]) if c.endswith("-mismatches") else 0))
    return out.groupBy("job_number", "sample_id").agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in values])
