"""The queries of this subpackage: each applies its operator to a whole table and derives the returned columns from the
operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The default vocabulary; every operator that needs one takes its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.chat import masked_text, parsed_turns, turn_windows

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(r"SELECT -7L AS conv_id, turn, role, '\\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    windows = turn_windows(turns.unionAll(planted))
    parsed = F.slice(parsed_turns(F.col("formatted")), F.col("n_context") + 1, F.col("n_turns"))
    back = windows.select("conv_id", "window_start", F.length("formatted").alias("chars"), masked_text(F.col("formatted"), F.col("loss")).alias("masked"), parsed.alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conv_id", F.struct("window_start", "chars", "masked", F.size("turns").alias("n"), said.alias("said")).alias("w"))
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    joined = {c: F.array_join(F.col(f"w.{c}"), "") for c in ("said", "masked")}
    total = {c: F.aggregate(f"w.{c}", F.lit(0).cast("long"), lambda a, x: a + x) for c in ("n", "chars")}
    return whole.select(
        "conv_id", total["n"].alias("n_turns"), F.sha2(joined["said"], 256).alias("turns_sha256"), F.length(joined["masked"]).cast("long").alias("loss_chars"),
        F.sha2(joined["masked"], 256).alias("loss_sha256"), total["chars"].alias("formatted_chars"),
    )


#: host, path and verdict of each rule.
URL_RULES = "SELECT * FROM VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block') AS r(host, path, verdict)"


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.urls import judge

    return judge(_table(spark, sf_dir, "pages"), spark.sql(URL_RULES))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.secret_scan import KINDS, scan

    found = scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.expr(f"filter(spans, s -> s.base and s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_large")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.substring import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.neardup import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.labelled import label_share, labelled_sample
    from readloom.llm.toxicity import score, train

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = train(labelled_sample(docs, labels, "toxic", where=~held_out), label_share(labels, "toxic", ~held_out))
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.labelled import labelled_sample
    from readloom.llm.quality import resample

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return resample(docs, labelled_sample(docs, labels, "quality"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.labelled import labelled_sample
    from readloom.llm.line_rules import judge, train

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = judge(docs, train(labelled_sample(docs, labels, "quality")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.decontam import find_items

    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_chat": op2_chat,
    "op3_url_filter": op3_url_filter,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_substring": op6_substring,
    "op7_neardup": op7_neardup,
    "op8_quality": op8_quality,
    "op9_line_rules": op9_line_rules,
    "op10_decontamination": op10_decontamination,
}


