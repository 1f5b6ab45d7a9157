"""Runs the headline queries on $BENCH_SF_DIR with $BENCH_CPUS cores and prints one JSON line. Each query is run once to
warm up and then timed; its result is written to Spark's noop sink. The job from gzip to gzip is timed apart, once."""

from __future__ import annotations

import glob
import json
import os
import shutil
import sys
import tempfile
import time

os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))

from readloom import queries as Q  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from readloom.operators import jobs, match, stats  # noqa: E402
from readloom.plans.session import session  # noqa: E402
from readloom.sources.fastq import write_fastq_table  # noqa: E402
from readloom.sources.runinfo import RunInfo  # noqa: E402

#: One read for each row of lineitem.
SOURCE = {"source": "lineitem", "read_id": "l_orderkey * 8 + l_linenumber"}


def headline(spark, sf_dir, folder, cpus):
    """The reads are written as Parquet first, as they would lie in a lake: deriving them from lineitem isn't timed."""
    for name, layouts in (("dual", Q.DUAL), ("mixed", Q.MIXED)):
        Q.reads(spark, sf_dir, layouts, **SOURCE).repartition(4 * cpus).write.parquet(f"{folder}/{name}")

    def assigned(name="dual", layouts=Q.DUAL, **o):
        return lambda: match.assign(spark.read.parquet(f"{folder}/{name}"), Q.sheet(spark, sf_dir, layouts), match.MatchOptions(**o))

    def undetermined():
        return stats.barcode_counts(assigned()(), Q.sheet(spark, sf_dir), "undetermined", 20)

    def statistics():
        s = Q.sheet(spark, sf_dir)
        measured = stats.read_statistics(assigned()(), s.barcode_length, 1, "r1_qual")
        return stats.sample_statistics(stats.per_sample(measured, s.frame(spark)), 1)

    return {
        "match_dual_m1": assigned(), "match_dual_m2": assigned(mismatches=2), "match_mixed_comprehensive": assigned("mixed", Q.MIXED, comprehensive=True),
        "sample_stats": statistics, "undetermined_top20": undetermined,
        "template_detect": lambda: Q.QUERIES["template_best"](spark, sf_dir),
    }


def gzip_job(spark, sf_dir, folder, cpus):
    """The whole job on one lane: gzip FASTQ in, pairs, files by sample and all reports out."""
    reads = Q.reads(spark, sf_dir, Q.DUAL, **SOURCE).coalesce(1).sortWithinPartitions("read_id").persist()
    for mate, columns in ((1, ("r1_header", "r1_seq", "r1_qual")), (2, ("header", "seq", "qual"))):
        write_fastq_table(reads.toDF(*reads.columns).select(*[F.col(c).alias(n) for c, n in zip(columns, ("header", "seq", "qual"))]), f"{folder}/gz{mate}")
        os.replace(glob.glob(f"{folder}/gz{mate}/*.gz")[0], f"{folder}/FC01_L01_read_{mate}.fq.gz")
    reads.unpersist()
    sheet = Q.sheet(spark, sf_dir)
    with open(f"{folder}/sheet.tsv", "w", encoding="utf-8") as f:
        f.write("sample_id\ti7\ti5\ttemplate\tjob_number\n" + "".join(f"{x.sample_id}\t{x.i7}\t{x.i5}\t{x.template}\t{x.job_number}\n" for x in sheet.samples))
    o = jobs.Options(info=RunInfo(**Q.OPTIONS))
    began = time.perf_counter()
    jobs.demultiplex(spark, f"{folder}/sheet.tsv", f"{folder}/FC01_L01_read_1.fq.gz", f"{folder}/FC01_L01_read_2.fq.gz", output=f"{folder}/out", o=o).unpersist()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    reads = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    folder = tempfile.mkdtemp(prefix="readloom-bench-")
    for name, query in headline(spark, sf_dir, folder, cpus).items():
        for _ in range(2):
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    job = gzip_job(spark, sf_dir, folder, cpus)
    shutil.rmtree(folder, ignore_errors=True)
    total = round(sum(seconds.values()), 3)
    line = {"metric": "headline_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "reads": reads, "cores": cpus, "reads_per_second": {k: round(reads / v) for k, v in seconds.items() if k != "template_detect"}, "input": "parquet", "jobs": {"demultiplex_gzip_pairs": job}}
    print(json.dumps(line))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
