"""python -m readloom.cli demultiplex | template | report | reformat"""

from __future__ import annotations

import argparse

from readloom.operators import jobs
from readloom.plans.session import session, ship
from readloom.sources.runinfo import RunInfo

# fixed values: options that tune native buffers and threads; accepted, and left to Spark's configuration
TUNING = ("writing-buffer-size", "compression-buffer-size", "memory", "threads", "reader-threads", "writer-threads", "log")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readloom", description="Read demultiplexing and quality reports on Spark.")
    top.add_argument("--cores", default="*")
    top.add_argument("--log-level", default="WARN")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *, inputs: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        if inputs:
            p.add_argument("--read1", default="")
            p.add_argument("--read2", default="")
            p.add_argument("--info-file")
        return p

    def outputs(p: argparse.ArgumentParser) -> None:
        p.add_argument("--output")
        p.add_argument("--reports")
        for name in ("disable-illumina", "force", "validate"):
            p.add_argument(f"--{name}", action="store_true")
        for name in ("lane", "instrument", "run"):
            p.add_argument(f"--{name}", default="")
        p.add_argument("--report-level", type=int, default=2, choices=(0, 1, 2))
        p.add_argument("--compression-level", type=int, default=1)
        for name in TUNING:
            p.add_argument(f"--{name}", help=argparse.SUPPRESS)

    d = command("demultiplex", "assign reads to samples")
    outputs(d)
    d.add_argument("--input", default="")
    d.add_argument("--sample-sheet", required=True)
    d.add_argument("--mismatches", type=int, default=1)
    d.add_argument("--template")
    for name in ("i7-rc", "i5-rc", "keep-barcode", "comprehensive-scan", "ignore-undetermined", "mgi-full-header", "per-index-error", "not-mgi"):
        d.add_argument(f"--{name}", action="store_true")
    d.add_argument("--undetermined-label", default=jobs.UNDETERMINED)
    d.add_argument("--ambiguous-label", default=jobs.AMBIGUOUS)
    d.add_argument("--report-limit", type=int, default=20)
    t = command("template", "detect the samples' templates")
    t.add_argument("--input", default="")
    t.add_argument("--sample-sheet", required=True)
    t.add_argument("--output", default="detected")
    t.add_argument("--barcode-length", type=int, default=0)
    t.add_argument("--popular-template", action="store_true")
    t.add_argument("--no-umi", action="store_true")
    t.add_argument("--testing-reads", type=int, default=5000)
    t.add_argument("--max-umi-len", type=int, default=10)
    for p in (d, t):
        p.add_argument("--in-r1-file-suf", default="_read_1.fq.gz")
        p.add_argument("--in-r2-file-suf", default="_read_2.fq.gz")
    r = command("report", "merge the statistics of several lanes", inputs=False)
    r.add_argument("--qc-report", action="append", required=True)
    r.add_argument("--output", default=".")
    r.add_argument("--lane", default="all")
    r.add_argument("--prefix")
    f = command("reformat", "rewrite the headers of split reads")
    outputs(f)
    f.add_argument("--umi-length", type=int, default=0)
    f.add_argument("--sample-index", type=int, default=1)
    f.add_argument("--barcode")
    f.add_argument("--sample-label")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session(a.cores)
    spark.sparkContext.setLogLevel(a.log_level)
    ship(spark)
    if a.command in ("demultiplex", "template") and a.input:
        a.read1, a.read2 = jobs.runinfo.find_reads(a.input, a.in_r1_file_suf, a.in_r2_file_suf)
    if a.command == "demultiplex":
        o = jobs.Options(
            a.mismatches, a.per_index_error, a.comprehensive_scan, a.template, a.i7_rc, a.i5_rc, not a.disable_illumina, not a.not_mgi, a.mgi_full_header, a.keep_barcode, a.validate,
            a.ignore_undetermined, a.undetermined_label, a.ambiguous_label, a.report_level, a.report_limit, a.compression_level, a.force, RunInfo("", a.lane, a.instrument, a.run),
        )
        jobs.demultiplex(spark, a.sample_sheet, a.read1, a.read2, "", a.output, a.reports, o, a.info_file)
    elif a.command == "template":
        jobs.detect_template(spark, a.sample_sheet, a.read1, a.read2, "", a.output, a.barcode_length, a.popular_template, not a.no_umi, a.testing_reads, a.max_umi_len)
    elif a.command == "report":
        jobs.merge_reports(spark, a.qc_report, a.output, a.lane, a.prefix)
    else:
        jobs.reformat(spark, a.read1, a.read2, a.output, a.reports, a.umi_length, a.sample_index, a.barcode, a.sample_label, a.lane, not a.disable_illumina, a.validate, a.report_level, a.force, a.compression_level)


if __name__ == "__main__":
    main()
