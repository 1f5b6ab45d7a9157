"""The neighbourhood of indexes: every sequence within m substitutions, with the nearest indexes and their distance.

It turns the approximate join of reads and samples into an equi-join.
"""

from __future__ import annotations

from itertools import combinations, product
from math import comb

from pyspark.sql import DataFrame, functions as F

from readloom.functions.columns import READ_LETTERS


def neighborhood_size(lengths: list[int], m: int) -> int:
    """An upper bound of the rows of neighborhood()."""
    return sum(comb(n, k) * (len(READ_LETTERS) - 1) ** k for n in lengths for k in range(min(m, n) + 1))


def variants(indexes: DataFrame, m: int) -> DataFrame:
    """indexes: idx (string) and any columns. Adds variant and mm, for all variants over READ_LETTERS with at most m
    substitutions; each variant of an index comes once, with its distance."""
    carried = [c for c in indexes.columns if c != "idx"]
    letters = F.array(*[F.lit(c) for c in READ_LETTERS])
    level = indexes.distinct().select("idx", *carried, F.col("idx").alias("variant"), F.lit(0).alias("mm"), F.lit(0).alias("at"))
    out = level
    for k in range(1, m + 1):  # substitutions at rising places, so no variant comes twice
        at = level.filter(F.length("idx") > F.col("at")).withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.length("idx"))))
        put = at.withColumn("letter", F.explode(letters)).filter(F.substring("variant", F.col("at"), F.lit(1)) != F.col("letter"))
        variant = F.concat(F.substring("variant", F.lit(1), F.col("at") - 1), "letter", F.substring("variant", F.col("at") + 1, F.length("variant")))
        level = put.select("idx", *carried, variant.alias("variant"), F.lit(k).alias("mm"), "at")
        out = out.unionAll(level)
    return out.drop("at")


def neighborhood(indexes: DataFrame, m: int) -> DataFrame:
    """variant, mm, idx: only the nearest indexes of each variant, all of them if several are equally near."""
    all_variants = variants(indexes.select("idx"), m)
    nearest = all_variants.groupBy("variant").agg(F.min("mm").alias("mm"))
    return all_variants.join(nearest, ["variant", "mm"]).select("variant", "mm", "idx")


def neighborhood_rows(indexes: DataFrame, m: int) -> DataFrame:
    """indexes: idx, rows (array of sample rows). One row for each variant: variant, mm and the rows of its nearest
    indexes."""
    found = variants(indexes, m).groupBy("variant", "mm").agg(F.array_distinct(F.flatten(F.collect_list("rows"))).alias("rows"))
    return found.groupBy("variant").agg(F.min(F.struct("mm", "rows")).alias("x")).select("variant", "x.mm", "x.rows")


def nearest_rows(rows: dict[str, list[int]], m: int) -> list[tuple[str, int, list[int]]]:
    """What neighborhood_rows() gives, built on the driver: for sheets of usual size this takes milliseconds, where a job
    takes a second."""
    found: dict[str, tuple[int, list[int]]] = {}
    for k in range(m + 1):
        for idx, own in sorted(rows.items()):
            for places in combinations(range(len(idx)), k):
                for letters in product(*[READ_LETTERS.replace(idx[p], "") for p in places]):
                    v = list(idx)
                    for p, c in zip(places, letters):
                        v[p] = c
                    mm, held = found.setdefault("".join(v), (k, []))
                    if mm == k:
                        held += own
    return [(v, mm, held) for v, (mm, held) in found.items()]
