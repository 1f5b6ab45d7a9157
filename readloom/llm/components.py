"""Connected components of an edge table, by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from readloom.llm.shared import written

HUB, SALTS = 64, 64


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame, key: str, other: str) -> DataFrame:
    """rows (key, other) with m, the least other of the row's key. A key with more than HUB rows is joined by salts, the
    others by themselves, so no hub is one task's."""
    least = rows.groupBy(key).agg(F.min(other).alias("m"), F.count("*").alias("n"))
    hubs = least.filter(F.col("n") > HUB).select(key, "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(hubs, [key, "salt"], "left")
    few = salted.filter("m is null").select(key, other).join(least.filter(F.col("n") <= HUB).select(key, "m"), key)
    return salted.filter("m is not null").select(key, other, "m").unionAll(few.select(key, other, "m"))


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long; order and repeats don't matter). Returns node and root, its component's smallest node, for all
    nodes but the roots. Each round's edges are written to the shared folder."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    e = written(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select("b", "a"))
        low = F.least("u", "m")
        large = _with_least(both, "u", "v").filter((F.col("v") > F.col("u")) & (low < F.col("v"))).select(low.alias("a"), F.col("v").alias("b")).distinct()
        large = written(large, "large")
        small = _with_least(large, "b", "a").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        e = written(small.unionAll(large.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct(), "edges")
        before, state = state, _state(e)
        if before == state:
            break
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
