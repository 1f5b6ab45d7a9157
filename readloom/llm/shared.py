"""Where intermediate tables go, how large inputs are, and how texts are cut into bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local one is set in local mode,
    and elsewhere an error is raised, as executors would not see each other's files."""
    ctx = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or ctx.getConf().get("spark.checkpoint.dir")
    set_already = ctx._jsc.sc().getCheckpointDir()
    if not at and set_already.isDefined():
        at = set_already.get()
    if not at:
        if not ctx.master.startswith("local") or ctx.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="readloom-")
    if not set_already.isDefined():
        ctx.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage and survives lost executors. The
    files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/readloom/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df; for file scans this is the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 4 << 20) -> Iterator[pa.Table]:
    """Cuts rows into slices of about limit text bytes (a longer single text makes a slice of its own)."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    if not table.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(table.column(column)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield table.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    yield table.slice(begin)
    pa.default_memory_pool().release_unused()  # else a worker keeps the most that any batch took


def sample_slices(texts: list[str], limit: int = 1 << 18) -> Iterator[pa.ChunkedArray]:
    """Texts on the driver, in slices of about limit bytes, so that training holds few values for each byte at once."""
    for part in text_slices(pa.table({"text": pa.array(texts, pa.string())}), "text", limit):
        yield part.column("text")
