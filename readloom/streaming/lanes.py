"""Structured Streaming over arriving reads. Matching keeps no state; each micro-batch's statistics are written under its
batch id, so a batch that is run again replaces its own, and totals are sums over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.operators import match, stats
from readloom.plans.sheet import Sheet


def assigned_stream(reads: DataFrame, sheet: Sheet, options: match.MatchOptions = match.MatchOptions()) -> DataFrame:
    """The streaming form of match.assign(): broadcast joins with static tables."""
    return match.assign(reads, sheet, options)


def start_statistics(reads: DataFrame, sheet: Sheet, path: str, checkpoint: str, options: match.MatchOptions = match.MatchOptions(), mate_qual: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Writes the per-sample statistics of each micro-batch to path/batch=<id>."""
    def put(batch: DataFrame, batch_id: int) -> None:
        done = match.assign(batch, sheet, options)
        stats.read_statistics(done, sheet.barcode_length, options.most, mate_qual).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return reads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """The statistics over all batches so far, as read_statistics() would give them."""
    all_batches = spark.read.parquet(path).drop("batch")
    values = [c for c in all_batches.columns if c != "row_ix"]
    return all_batches.groupBy("row_ix").agg(*[F.sum(f"`{c}`").alias(c) for c in values])


def arrivals(events: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Reads by arrival window and sample, for monitoring: events has ts and row_ix; later rows than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "row_ix").agg(F.count("*").alias("n"))
