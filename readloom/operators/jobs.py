"""The four jobs: demultiplex, detect templates, merge reports, reformat."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.functions import columns as C
from readloom.operators import detect, match, reformat as reformatting, stats
from readloom.plans.sheet import AMBIGUOUS, MISSING, UNDETERMINED, Sheet, build_sheet, load_sheet
from readloom.sources import runinfo, store, writers
from readloom.sources.fastq import read_fastq, read_pairs


@dataclass
class Options:
    """Defaults are the command line's."""

    mismatches: int = 1
    per_index: bool = False
    comprehensive: bool = False
    template: str | None = None
    i7_rc: bool = False
    i5_rc: bool = False
    illumina: bool = True
    mgi: bool = True
    mgi_full_header: bool = False
    keep_barcode: bool = False
    validate: bool = False
    ignore_undetermined: bool = True
    undetermined_label: str = UNDETERMINED
    ambiguous_label: str = AMBIGUOUS
    report_level: int = 2
    report_limit: int = 20
    compression_level: int = 1
    force: bool = False
    info: runinfo.RunInfo = field(default_factory=runinfo.RunInfo)


def default_output() -> str:
    return f"readloom_{datetime.now():%Y%m%dT%H%M%S}"


def problem_of(mgi: bool = True, paired: bool = False) -> F.Column:
    """What is wrong with a read's or its mate's content, or with their headers; null if nothing is."""
    sides = [("", C.read_violation("header", "seq", "qual"))] + ([("mate ", C.read_violation("r1_header", "r1_seq", "r1_qual"))] if paired else [])
    problem = F.coalesce(*[F.concat(F.lit(n), v) for n, v in sides])
    if paired and mgi:
        same = C.trimmed("header", 1) == C.trimmed("r1_header", 1)
        problem = F.coalesce(problem, F.when(~same, F.lit("mates have different headers")))
    return problem


def validated(reads: DataFrame, mgi: bool = True, paired: bool = False) -> DataFrame:
    """Reads that raise an error where their content, or their mates' headers, are not right."""
    problem = problem_of(mgi, paired)
    return reads.withColumn("header", F.when(problem.isNull(), F.col("header")).otherwise(F.raise_error(F.concat(F.lit("read is not valid: "), problem)).cast("string")))


def file_names(sheet: Sheet, o: Options, mate: int) -> dict[int, str]:
    """The file of each row of the sheet's frame."""
    n, numbers = len(sheet.samples), sheet.sample_numbers()
    labels = {**{s.row: s.sample_id for s in sheet.samples}, n: o.undetermined_label, n + 1: o.ambiguous_label}
    return {r: writers.illumina_file(x, numbers.get(x) if r < n else None, o.info.lane, mate) if o.illumina else writers.mgi_file(x, o.info.lane, mate) for r, x in labels.items()}


def report_names(sheet: Sheet, o: Options) -> list[str]:
    stem = f"{o.info.flowcell}.{o.info.lane}.readloom"
    prefixes = ["" if p == MISSING else f"{p}_" for p in sheet.projects()]
    kinds = ["sample_stats"] + [f"{w}_barcode{x}" for w in ("undetermined", "ambiguous") for x in ("", ".complete")]
    return [f"{p}{stem}.{k}" for p in prefixes for k in ("info", "general")] + [f"{stem}.{k}" for k in kinds]


def output_records(assigned: DataFrame, sheet: Sheet, o: Options, paired: bool) -> DataFrame:
    """out_file, read_id, header, seq, qual of all files. Unassigned reads stay as they were; samples whose barcode reads
    hold the barcode only have no second file."""
    n, length = len(sheet.samples), sheet.barcode_length
    named = lambda mate: F.create_map(*[x for row, name in file_names(sheet, o, mate).items() for x in (F.lit(row), F.lit(name))])[F.col("row_ix")]
    real = F.col("row_ix") < n
    tail = 0 if o.keep_barcode else length

    def rewritten(header: str, mate) -> F.Column:
        if o.illumina:
            prefix = C.illumina_prefix(o.info.instrument, o.info.run, o.info.flowcell)
            new = C.illumina_header("header", prefix, F.col("barcode"), F.col("umi"), mate)
        elif o.mgi_full_header:
            new = C.mgi_full_header(header, F.col("barcode"), F.col("umi"))
        else:
            new = F.col(header)
        return F.when(real, new).otherwise(F.col(header))

    cut = lambda c: F.when(real, C.trimmed(c, tail)).otherwise(F.col(c))
    own = assigned.select(named(2 if paired else 1).alias("out_file"), "read_id", rewritten("header", None).alias("header"), cut("seq").alias("seq"), cut("qual").alias("qual"), "row_ix")
    own = own.filter((F.col("row_ix") >= n) | (F.length("seq") > 0)).drop("row_ix")
    if not paired:
        return own
    mates = assigned.select(named(1).alias("out_file"), "read_id", rewritten("r1_header", F.right("r1_header", F.lit(1))).alias("header"), F.col("r1_seq").alias("seq"), F.col("r1_qual").alias("qual"))
    return own.unionAll(mates)


def write_reports(assigned: DataFrame, sheet: Sheet, folder: str, o: Options, mate_qual: str | None) -> list[str]:
    """Level 0: info; 1: and general and sample_stats; 2: and barcodes. Each project has its own info and general."""
    spark, most = assigned.sparkSession, o.mismatches * (2 if o.per_index else 1)
    measured = stats.read_statistics(assigned, sheet.barcode_length, most, mate_qual).persist()
    rows = stats.per_sample(measured, sheet.frame(spark, o.undetermined_label, o.ambiguous_label))
    stem = f"{o.info.flowcell}.{o.info.lane}.readloom"
    out = []
    for project, members in sheet.projects().items():
        prefix, chosen = ("", None) if project == MISSING else (f"{project}_", project)
        if chosen is not None and not members:
            continue
        out.append(writers.write_text(folder, f"{prefix}{stem}.info", writers.tsv(stats.info_report(rows, most, sheet.unique_ids, chosen))))
        if o.report_level > 0:
            lane = stats.general_lane(rows, f"{o.info.flowcell}-{o.info.lane}", chosen)
            out.append(writers.write_text(folder, f"{prefix}{stem}.general", writers.general_text(lane, stats.general_samples(rows, sheet.unique_ids, chosen))))
    if o.report_level > 0:
        out.append(writers.write_text(folder, f"{stem}.sample_stats", writers.tsv(stats.sample_statistics(rows, most))))
    if o.report_level > 1:
        for which in ("undetermined", "ambiguous"):
            counts = stats.barcode_counts(assigned, sheet, which).persist(StorageLevel.DISK_ONLY)  # for both files
            text = writers.tsv(counts.limit(o.report_limit), header=False)
            if text:
                out.append(writers.write_text(folder, f"{stem}.{which}_barcode", text))
                out.append(writers.write_lines(counts, folder, f"{stem}.{which}_barcode.complete"))
            counts.unpersist()
    measured.unpersist()
    return out


def demultiplex(spark: SparkSession, sheet_path: str, read1: str = "", read2: str = "", folder: str = "", output: str | None = None, reports: str | None = None, o: Options | None = None, info_file: str | None = None) -> DataFrame:
    """Assigns the reads of one lane, writes files and reports, and returns the assigned reads. One scan of the input feeds
    the files and the statistics; it is kept on disk, until the caller unpersists what is returned."""
    o = o or Options()
    if folder:
        read1, read2 = runinfo.find_reads(folder)
    barcode_path, mate_path = runinfo.roles(read1, read2)
    sheet = build_sheet(load_sheet(spark, sheet_path), o.template, o.i7_rc, o.i5_rc)
    info = runinfo.find_info_file(info_file, barcode_path)
    if info:
        instrument, run = runinfo.parse_info(store.read_text(info).splitlines())
        o.info.instrument, o.info.run = o.info.instrument or instrument, o.info.run or run
    if o.mgi:
        first = read_fastq(spark, barcode_path, 1).first()
        flowcell, lane = runinfo.flowcell_and_lane(first.header)
        o.info.flowcell, o.info.lane = o.info.flowcell or flowcell, o.info.lane or runinfo.lane_of_file(barcode_path) or lane
    else:
        o.info.flowcell, o.info.lane = o.info.flowcell or f"{datetime.now():%Y%m%d%H%M%S}", o.info.lane or "L01"
    o.info.checked(o.illumina, o.mgi)
    reads = read_pairs(spark, barcode_path, mate_path) if mate_path else read_fastq(spark, barcode_path)
    if o.validate:
        reads = validated(reads, o.mgi, bool(mate_path))
    assigned = match.assign(reads, sheet, match.MatchOptions(o.mismatches, o.per_index, o.comprehensive)).persist(StorageLevel.DISK_ONLY)
    if not o.ignore_undetermined and match.mostly_unassigned(assigned, sheet):
        raise ValueError("most reads match no sample; check the template, or ignore undetermined reads")
    output = writers.prepare_folder(output or default_output(), o.force)
    reports = reports or output
    store.make_folder(reports)
    writers.clean_outputs(output, [x for mate in (1, 2) for x in file_names(sheet, o, mate).values()])
    writers.clean_outputs(reports, report_names(sheet, o))
    records = output_records(assigned, sheet, o, bool(mate_path))
    writers.write_fastq(records, output, ["read_id"], level=o.compression_level)
    write_reports(assigned, sheet, reports, o, "r1_qual" if mate_path else None)
    return assigned


def detect_template(spark: SparkSession, sheet_path: str, read1: str = "", read2: str = "", folder: str = "", prefix: str = "detected", barcode_length: int = 0, popular: bool = False, umi: bool = True, testing_reads: int = 5000, max_umi: int = 10) -> tuple[str, str]:
    """Writes <prefix>_template.tsv and <prefix>_details.tsv and returns their paths."""
    if folder:
        read1, read2 = runinfo.find_reads(folder)
    barcode_path, mate_path = runinfo.roles(read1, read2)
    samples = load_sheet(spark, sheet_path)
    reads = read_fastq(spark, barcode_path, testing_reads).select("seq").persist()  # so many reads are few
    own = len(reads.first().seq)
    mate = len(read_fastq(spark, mate_path, 1).first().seq) if mate_path else own
    length = detect.barcode_length_of(barcode_length, own, mate, samples, max_umi)
    sheet_rows, details = detect.detected_sheet(reads, samples, length, popular, umi)
    reads.unpersist()
    lines = lambda head, rows: "\t".join(head) + "\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows)
    folder_, stem = os.path.split(prefix if "://" in prefix else os.path.abspath(prefix))
    return (
        writers.write_text(folder_, f"{stem}_template.tsv", lines(("sample_id", "i7", "i5", "job_number", "template", "i7_rc", "i5_rc"), sheet_rows)),
        writers.write_text(folder_, f"{stem}_details.tsv", lines(("sample_id", "i7", "i5", "all-matches"), details)),
    )


def read_statistics_report(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.select("job_number", "sample_id", *[F.col(f"`{c}`").cast("long").alias(c) for c in raw.columns if c not in ("job_number", "sample_id")])


def merge_reports(spark: SparkSession, paths: list[str], output: str, lane: str = "all", prefix: str | None = None) -> DataFrame:
    """Sums the sample_stats files of several lanes and writes info, general and sample_stats over all of them."""
    merged = stats.merge_reports([read_statistics_report(spark, p) for p in paths])
    most = sum(c.endswith("-mismatches") for c in merged.columns) - 1
    pseudo = {UNDETERMINED.lower(): "undetermined", AMBIGUOUS.lower(): "ambiguous"}
    role = F.coalesce(F.create_map(*[F.lit(x) for kv in pseudo.items() for x in kv])[F.lower("sample_id")], F.lit("sample"))
    last = F.when(role == "sample", 0).otherwise(1)
    ordered = merged.withColumn("role", role).orderBy(last, "sample_id", "job_number").collect()  # as many rows as samples
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ordered)], "row_ix int, " + ", ".join(f"`{c}` {'string' if c in ('job_number', 'sample_id', 'role') else 'long'}" for c in [*merged.columns, "role"]))
    stem = f"{prefix or os.path.basename(paths[0]).split('.')[0]}.{lane}.readloom"
    store.make_folder(output)
    writers.write_text(output, f"{stem}.info", writers.tsv(stats.info_report(rows, most)))
    writers.write_text(output, f"{stem}.general", writers.general_text(stats.general_lane(rows, f"{stem.split('.')[0]}-{lane}"), stats.general_samples(rows)))
    writers.write_text(output, f"{stem}.sample_stats", writers.tsv(stats.sample_statistics(rows, most)))
    return rows


def reformat(spark: SparkSession, read1: str, read2: str = "", output: str | None = None, reports: str | None = None, umi_length: int = 0, sample_index: int = 1, barcode: str | None = None, sample_label: str | None = None, lane: str = "", illumina: bool = True, validate: bool = False, report_level: int = 2, force: bool = False, level: int = 1) -> DataFrame:
    """Rewrites the headers of one sample's reads, moves its UMI there, and reports its statistics."""
    if sample_index < 1:
        raise ValueError("sample_index begins at 1")
    own, mate = runinfo.roles(read1, read2)
    if not sample_label or not lane:
        _, file_lane, label = reformatting.sample_of_file(own)
        sample_label, lane = sample_label or label, lane or file_lane
    reads = read_pairs(spark, own, mate) if mate else read_fastq(spark, own)
    if validate:
        reads = validated(reads, False, bool(mate))
    done = reformatting.reformat_reads(reads, umi_length, barcode or None).persist(StorageLevel.DISK_ONLY)
    output = writers.prepare_folder(output or default_output(), force)
    if illumina:
        name = lambda m: writers.illumina_file(sample_label, sample_index, lane, m)
        records = done.select(F.lit(name(2 if mate else 1)).alias("out_file"), "read_id", F.col("new_header").alias("header"), F.col("new_seq").alias("seq"), F.col("new_qual").alias("qual"))
        if mate:
            header = F.when(F.instr("r1_header", " ") > 0, C.split_header("r1_header", F.col("umi"))).otherwise(C.raw_header("r1_header", F.col("umi"), F.lit(barcode) if barcode else None))
            records = records.unionAll(done.select(F.lit(name(1)).alias("out_file"), "read_id", header.alias("header"), F.col("r1_seq").alias("seq"), F.col("r1_qual").alias("qual")))
        writers.write_fastq(records, output, ["read_id"], level=level)
    if report_level > 0:
        most = reformatting.MOST_MISMATCHES
        measured = stats.read_statistics(done.withColumn("row_ix", F.lit(0)), umi_length, most, "r1_qual" if mate else None)
        one = spark.createDataFrame([(0, sample_label, MISSING, "sample")], "row_ix int, sample_id string, job_number string, role string")
        row = stats.sample_statistics(stats.per_sample(measured, one), most)
        values = row.first()
        seen = [k for k in range(most + 1) if values[f"{k}-mismatches"]]
        kept = [c for c in row.columns if not c.endswith("-mismatches") or int(c.split("-")[0]) <= max(seen, default=0)]
        store.make_folder(reports or output)
        writers.write_text(reports or output, f"{sample_label}.readloom.sample_stats", writers.tsv(row.select(*[F.col(f"`{c}`") for c in kept])))
    return done
