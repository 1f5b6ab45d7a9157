"""Gzip FASTQ: records from Spark's text reader, so any file system that Spark knows will do.

A gzip file is one split whose lines come in order, so records are framed within the task, without a shuffle.
"""

from __future__ import annotations

import gzip
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "file string, read_id long, header string, seq string, plus string, qual string"


class FastqError(ValueError):
    pass


def _frame(limit: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "read_id", "header", "seq", "plus", "qual"]
    file, rest, number = None, [], 0

    def records(lines: list[str]) -> pa.RecordBatch:
        n = len(lines) // 4
        if lines[2][:1] != "+":
            raise FastqError(f"{file}: record {number} has no + line")
        columns = [pa.array([file] * n), pa.array(range(number, number + n), pa.int64()), *(pa.array(lines[k : 4 * n : 4], pa.string()) for k in range(4))]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        files, values = batch.column("file").to_pylist(), batch.column("value").to_pylist()
        begin = 0
        while begin < len(files):
            if files[begin] != file:
                if rest:
                    raise FastqError(f"{file}: the last record is not whole")
                file, number = files[begin], 0
            end = begin
            while end < len(files) and files[end] == file:
                end += 1
            lines = rest + values[begin:end]
            whole = len(lines) - len(lines) % 4
            rest, begin = lines[whole:], end
            if whole and (limit is None or number < limit):
                out = records(lines[:whole])
                yield out if limit is None else out.slice(0, limit - number)
            number += whole // 4
    if rest:
        raise FastqError(f"{file}: the last record is not whole")


def files_of(spark: SparkSession, path: str | list[str]) -> list[tuple[str, str]]:
    """The files that a path or a list of paths stands for, and their names in the column file; nothing of them is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return sorted((r.path, r.file) for r in found.select("path", F.col("_metadata.file_path").alias("file")).collect())


def read_fastq(spark: SparkSession, path: str | list[str], first: int | None = None) -> DataFrame:
    """file, read_id (the record's number in its file), header, seq, plus, qual of gzip FASTQ files, several members
    included. first: only so many records of each file; reading stops there."""
    def lines(of: str | list[str]) -> DataFrame:
        return spark.read.option("pathGlobFilter", "*.gz").text(of).select(F.col("_metadata.file_path").alias("file"), "value")

    if first is None:
        return lines(path).mapInArrow(lambda it: _frame(None, it), SCHEMA)
    heads = [lines(p).limit(4 * first) for p in ([path] if isinstance(path, str) and path.endswith(".gz") else [p for p, _ in files_of(spark, path)])]
    out = heads[0]
    for h in heads[1:]:
        out = out.unionAll(h)
    return out.mapInArrow(lambda it: _frame(first, it), SCHEMA)


def paired(barcode_reads: DataFrame, mates: DataFrame, keys: list[str]) -> DataFrame:
    """The n-th record of each mate with the n-th barcode read, as r1_header, r1_seq, r1_qual; an error where one is
    missing."""
    mate = mates.select(*keys, *[F.col(c).alias(f"r1_{c}") for c in ("header", "seq", "qual")])
    both = barcode_reads.join(mate, keys, "full_outer")
    whole = F.col("header").isNotNull() & F.col("r1_header").isNotNull()
    return both.withColumn("header", F.when(whole, F.col("header")).otherwise(F.raise_error(F.lit("the files have different numbers of reads")).cast("string")))


def read_pairs(spark: SparkSession, barcode_path: str, mate_path: str, first: int | None = None) -> DataFrame:
    """One file, or one lane, of pairs; files are paired in the order of their names."""
    def numbered(path: str) -> DataFrame:
        df = read_fastq(spark, path, first)
        if path.endswith(".gz"):
            return df.withColumn("pair", F.lit(0))
        ranks = F.create_map(*[x for i, (_, f) in enumerate(files_of(spark, path)) for x in (F.lit(f), F.lit(i))])
        return df.withColumn("pair", ranks[F.col("file")])

    return paired(numbered(barcode_path), numbered(mate_path), ["pair", "read_id"])


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which goes when the driver ends. Where that is unset, a local one in local
    mode, and elsewhere an error: executors would not see each other's files."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="readloom-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def write_fastq_table(reads: DataFrame, path: str) -> None:
    """reads (header, seq, qual) as gzip FASTQ files in path, one for each partition."""
    record = F.concat_ws("\n", "header", "seq", F.lit("+"), "qual")
    reads.select(record.alias("value")).write.option("compression", "gzip").text(path)


def gzip_member(records: list[tuple[str, str, str]], level: int = 1) -> bytes:
    return gzip.compress("".join(f"{h}\n{s}\n+\n{q}\n" for h, s, q in records).encode(), level)
