"""A bounded sample of labelled texts, for training on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PER_CLASS = 3000  # documents of each class
MAX_CHARS = 20_000  # longer documents aren't trained on


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, where=None) -> list[tuple[str, int]]:
    """(text, 0 or 1) of at most per_class documents of each class, the first by a hash of doc_id, without repeated texts.

    At most 2 * per_class * max_chars characters reach the driver: of rows that share a doc_id, in labels or in docs, the
    smallest label and the smallest text count. Rows with a null id or label or without text are left out; where: a further
    condition on labels.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null")
    rows = rows if where is None else rows.filter(where)
    rows = rows.filter(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = None
    for value in (0, 1):
        part = rows.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter((F.length("text") > 0) & (F.length("text") <= max_chars))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).collect()
    out = {}
    for r in sorted(found):
        out.setdefault(r.text, r.label)
    return list(out.items())


def label_share(labels: DataFrame, label: str, where=None) -> float | None:
    """The share of 1 among all labelled rows."""
    rows = labels if where is None else labels.filter(where)
    return rows.filter(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
