"""Assigns reads to samples. There is no shuffle: each template adds broadcast equi-joins with its index neighbourhoods
(of a checked size) and the rest is expressions on the read's own row.

For a read and a template, the candidates of an index are the nearest sheet indexes within m substitutions; with two
indexes, the hits are the samples among the pairs of candidates whose summed distance is at most m (or 2 m per index).
By default, the first template with hits decides; in a comprehensive scan, the smallest distance over all templates.
One hit is an assignment, several are ambiguous, none is undetermined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from readloom.functions.columns import READ_LETTERS, barcode_slice, hamming_fixed, index_slice
from readloom.operators.neighbors import nearest_rows, neighborhood_rows, neighborhood_size
from readloom.plans.session import local_frame
from readloom.plans.sheet import Entry, Sheet
from readloom.plans.template import Part

#: Larger neighbourhoods aren't built: reads are then compared with each index in expressions.
NEIGHBORHOOD_LIMIT = 1_000_000
#: Up to so many rows, the driver builds them.
LOCAL_LIMIT = 50_000


@dataclass(frozen=True)
class MatchOptions:
    mismatches: int = 1
    per_index: bool = False
    comprehensive: bool = False
    neighborhood_limit: int = NEIGHBORHOOD_LIMIT

    @property
    def most(self) -> int:
        return self.mismatches * (2 if self.per_index else 1)


def _index_rows(entry: Entry, which: int) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for pair, row in entry.pairs.items():
        out.setdefault(pair[which], []).append(row)
    return out


def _with_candidates(reads: DataFrame, observed: Column, rows: dict[str, list[int]], part: Part, options: MatchOptions, prefix: str) -> DataFrame:
    """Adds {prefix}_mm and {prefix}_rows: the distance and the samples of the nearest indexes; null if none is near."""
    spark, m = reads.sparkSession, options.mismatches
    size = neighborhood_size([part.length] * len(rows), m)
    if size <= options.neighborhood_limit:
        if size <= LOCAL_LIMIT:
            near = local_frame(spark, nearest_rows(rows, m), "variant string, mm int, rows array<int>")
        else:
            near = neighborhood_rows(spark.createDataFrame(sorted(rows.items()), "idx string, rows array<int>"), m)
        near = near.select(F.col("variant").alias(f"{prefix}_variant"), F.col("mm").alias(f"{prefix}_mm"), F.col("rows").alias(f"{prefix}_rows"))
        joined = reads.withColumn(f"{prefix}_seen", observed).join(F.broadcast(near), F.col(f"{prefix}_seen") == F.col(f"{prefix}_variant"), "left")
        return joined.drop(f"{prefix}_variant", f"{prefix}_seen")
    options_ = F.array(*[F.struct(F.lit(i).alias("idx"), F.array(*[F.lit(r) for r in r_]).alias("rows")) for i, r_ in sorted(rows.items())])
    known = observed.rlike(f"^[{READ_LETTERS}]*$")
    far = F.transform(options_, lambda x: F.struct(hamming_fixed(observed, x["idx"], part.length).alias("mm"), x["rows"].alias("rows")))
    least = F.array_min(F.transform(F.col(f"{prefix}_all"), lambda x: x["mm"]))
    best = F.flatten(F.transform(F.filter(F.col(f"{prefix}_all"), lambda x: x["mm"] == F.col(f"{prefix}_mm")), lambda x: x["rows"]))
    out = reads.withColumn(f"{prefix}_all", F.when(known, far)).withColumn(f"{prefix}_mm", F.when(least <= m, least))
    return out.withColumn(f"{prefix}_rows", F.when(F.col(f"{prefix}_mm").isNotNull(), best)).drop(f"{prefix}_all")


def assign(reads: DataFrame, sheet: Sheet, options: MatchOptions = MatchOptions()) -> DataFrame:
    """reads: seq (of the barcode read, the barcode last) and any other columns. Adds row_ix (of Sheet.frame()), mm,
    template_rank (null if unassigned), barcode (as observed: i7[+i5]; of unassigned reads of several templates, all of
    it) and umi ('' without).

    Reads shorter than the barcode, null reads and lower-case bases match nothing.
    """
    length, n = sheet.barcode_length, len(sheet.samples)
    out = reads.withColumn("_bc", F.when(F.length("seq") >= length, barcode_slice("seq", length)))
    tried, names = [], []
    for e in sheet.catalogue:
        p, t = f"_t{e.rank}", e.template
        i7 = index_slice("_bc", length, t.i7.length, t.i7.offset)
        out = _with_candidates(out, i7, _index_rows(e, 0), t.i7, options, f"{p}a")
        names += [f"{p}a_mm", f"{p}a_rows"]
        text, hits, score = i7, F.col(f"{p}a_rows"), F.col(f"{p}a_mm")
        if e.dual:
            i5 = index_slice("_bc", length, t.i5.length, t.i5.offset)
            out = _with_candidates(out, i5, _index_rows(e, 1), t.i5, options, f"{p}b")
            names += [f"{p}b_mm", f"{p}b_rows"]
            text, score = F.concat(i7, F.lit("+"), i5), score + F.col(f"{p}b_mm")
            hits = F.when(score <= options.most, F.array_intersect(hits, F.col(f"{p}b_rows")))
        um = index_slice("_bc", length, t.um.length, t.um.offset) if t.um else F.lit("")
        hit = F.struct(score.alias("mm"), F.lit(e.rank).alias("rank"), hits.alias("rows"), text.alias("barcode"), um.alias("umi"))
        tried.append((F.when(F.size(hits) > 0, hit), text))
    if options.comprehensive:
        all_hits = F.array_compact(F.array(*[h for h, _ in tried]))
        out = out.withColumn("_hits", all_hits).withColumn("_best", F.array_min(F.transform("_hits", lambda h: F.struct(h["mm"], h["rank"]))))
        level = F.filter("_hits", lambda h: h["mm"] == F.col("_best.mm"))
        out = out.withColumn("_level", level).withColumn("_hit", F.get("_level", F.lit(0))).withColumn("_n", F.aggregate("_level", F.lit(0), lambda a, h: a + F.size(h["rows"])))
        names += ["_hits", "_best", "_level"]
    else:
        out = out.withColumn("_hit", F.coalesce(*[h for h, _ in tried])).withColumn("_n", F.when(F.col("_hit").isNotNull(), F.size("_hit.rows")).otherwise(0))
    one = F.col("_n") == 1
    unassigned = tried[0][1] if len(tried) == 1 else F.col("_bc")
    return out.withColumns({
        "row_ix": F.when(one, F.get("_hit.rows", F.lit(0))).when(F.col("_n") > 1, n + 1).otherwise(n), "mm": F.when(one, F.col("_hit.mm")).otherwise(0),
        "template_rank": F.when(one, F.col("_hit.rank")), "barcode": F.coalesce(F.when(one, F.col("_hit.barcode")).otherwise(unassigned), "seq"), "umi": F.when(one, F.col("_hit.umi")).otherwise(""),
    }).drop("_bc", "_hit", "_n", *names)


def mostly_unassigned(assigned: DataFrame, sheet: Sheet, percent: int = 75, least: int = 5000) -> bool:
    """Whether more than percent of at least `least` reads match no sample, as when the template is wrong."""
    n, lost = assigned.agg(F.count("*"), F.count_if(F.col("row_ix") >= len(sheet.samples))).first()
    return n >= least and lost * 100 > percent * n
