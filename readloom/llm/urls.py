"""URL rules by hash prefixes, in DataFrame operations only.

Each distinct URL is expanded into host-suffix and path-prefix expressions, for the label counts and path lengths that the
rules have. Their SHA-256 digests' first 32 bits are equi-joined with the rules'; full digests confirm; the longest
confirmed rule decides. Spark broadcasts the rules if they are below its threshold and shuffles both sides otherwise.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

SHORT = 8  # hex digits of a digest that are joined on


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*+", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without :// or for null."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*+([^?#]*+)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """rules: host, path, verdict. Returns key, host, path, rule (its host and path together, else null) and verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's. The longest fitting rule wins (then
    the longer host; of equal rules with different verdicts, block wins over allow). Rules with a null or empty host or a
    null path or verdict are void. A null or malformed URL has an empty host and path and gets the default; repeated rows
    are judged each; other columns are ignored.
    """
    valid = rules.select("host", "path", "verdict").filter("host <> '' and path is not null and verdict is not null")
    valid = valid.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    shape = valid.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    valid = valid.withColumn("digest", _digest(F.col("host"), F.col("path"))).withColumn("short", F.substring("digest", 1, SHORT))

    seen = pages.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    suffixes = F.filter(F.transform(F.array(*[F.lit(n) for n in sorted(shape.labels)]).cast("array<int>"), lambda n: F.when(n <= F.size("parts"), F.array_join(F.slice("parts", F.size("parts") - n + 1, n), "."))), lambda x: x.isNotNull())
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in sorted(shape.lengths)]).cast("array<int>"), lambda n: F.when(n <= F.length("path"), F.substring(F.col("path"), F.lit(1), n))), lambda x: x.isNotNull())
    exprs = seen.withColumn("parts", F.split("host", r"\.")).select("url", F.explode(suffixes).alias("suffix"), "path").select("url", "suffix", F.explode(prefixes).alias("prefix"))
    exprs = exprs.withColumn("digest", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("digest", 1, SHORT))
    hits = exprs.alias("e").join(valid.alias("r"), F.col("e.short") == F.col("r.short")).filter(F.col("e.digest") == F.col("r.digest"))
    rank = F.struct(F.length(F.col("r.host")) + F.length(F.col("r.path")), F.length(F.col("r.host")))
    best = hits.groupBy("url").agg(F.max_by(F.struct(F.concat("r.host", "r.path").alias("rule"), F.col("r.verdict").alias("verdict")), rank).alias("best"))
    out = pages.select(F.col(key).alias(key), F.col(url).alias("url")).join(best, "url", "left")
    return out.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
