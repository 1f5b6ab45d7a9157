"""Importance resampling: documents are drawn by how much likelier a target's n-gram model makes them than the raw one's.

Three kinds of n-grams are hashed into BUCKETS each: words, word pairs and byte triples. A pair's hash is that of the
difference of its words' hashes, so that all immediate repeats share a bucket. The raw model counts all documents, by
partial sums on the executors; the target model counts the good documents of a bounded labelled sample. A document's log
weight is SCALE times the mean, over the kinds, of the mean log ratio of its n-grams. Gumbel noise from its doc_id is
added, and the k largest sums are drawn: a sample without replacement with these weights.

k is a parameter; by default it is the number of documents whose weight is at least the cut that best parts good and bad
documents of the sample. The k-th largest sum is found by counting in ever finer bins, not by sorting in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from readloom.llm.shared import sample_slices, text_slices, written
from readloom.llm.words import Words, mix, words_of

BUCKETS = 1 << 14
KINDS = 3
SCALE = 200.0
SEED = 17
BINS = 1024
FEW = 10_000  # candidates for the k-th place that may reach the driver

_SHIFT = np.uint64(64 - 14)


def grams(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: the buckets of its n-grams and the texts that they are in."""
    h, text_of = w.hashes(), w.text_of
    pair = text_of[1:] == text_of[:-1]
    b = w.buf.astype(np.uint64)
    triple = b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16) if len(b) > 2 else np.zeros(0, np.uint64)
    own = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
    inside = own[2:] == own[:-2] if len(b) > 2 else np.zeros(0, bool)
    return [
        ((h >> _SHIFT).astype(np.int32), text_of),
        ((mix(h[1:] - h[:-1]) >> _SHIFT).astype(np.int32)[pair], text_of[1:][pair]),
        ((mix(triple + np.uint64(1)) >> _SHIFT).astype(np.int32)[inside], own[2:][inside] if len(b) > 2 else own[:0]),
    ]


def counts_of(texts: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.bincount(bucket, minlength=BUCKETS) for bucket, _ in grams(words_of(texts))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((KINDS, BUCKETS), np.int64)
    for batch in batches:
        for rows in text_slices(batch, "text", 2 << 20):
            total += counts_of(rows.column("text"))
    flat = total.ravel()
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["bucket", "n"])


def raw_counts(rows: DataFrame) -> np.ndarray:
    """n-gram counts over all rows: at most KINDS * BUCKETS sums reach the driver."""
    sums = rows.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(KINDS * BUCKETS)
    out[[r.bucket for r in sums]] = [r.n for r in sums]
    return out.reshape(KINDS, BUCKETS)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The log ratio of both models for each bucket; raw's share of a bucket is added to target as one count for each
    hundred, so that buckets that target hasn't seen aren't impossible."""
    p = (raw + 1) / (raw + 1).sum(1, keepdims=True)
    prior = np.maximum(target.sum(1, keepdims=True), 1) / 100
    q = (target + prior * p) / (target + prior * p).sum(1, keepdims=True)
    return np.log(q / p)


def weights_of(texts: pa.ChunkedArray, ratios: np.ndarray) -> np.ndarray:
    n = len(texts)
    total = np.zeros(n)
    for kind, (bucket, text) in enumerate(grams(words_of(texts))):
        many = np.bincount(text, minlength=n)
        total += np.bincount(text, ratios[kind][bucket], n) / np.maximum(1, many)
    return SCALE * total / KINDS


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut between the sample's weights with the fewest errors, where losing a good document counts threefold."""
    order = np.argsort(weights)
    y = good[order].astype(float)
    errors = np.concatenate([[(1 - y).sum()], (1 - y).sum() - np.cumsum(1 - y) + 3 * np.cumsum(y)])
    at = int(errors.argmin())
    w = weights[order]
    return float(w[0] - 1 if at == 0 else w[-1] + 1 if at == len(w) else (w[at - 1] + w[at]) / 2)


def _weigh(ratios: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(weights_of(rows.column("text"), ratios))], ["doc_id", "log_weight"])


def kth_largest(rows: DataFrame, k: int) -> tuple[float, int] | None:
    """The sum and doc_id at place k of rows (key, doc_id) ordered by key downwards and doc_id upwards. Each pass over the
    rows brings at most BINS counts or FEW rows to the driver."""
    low, high, n = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while n > FEW and low < high:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        bins = {r.bin: r for r in rows.filter(F.col("key").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for b in sorted(bins, reverse=True):
            if k <= bins[b].n:
                break
            k -= bins[b].n
        if n == bins[b].n and (low, high) == (bins[b].low, bins[b].high):
            break
        low, high, n = bins[b].low, bins[b].high, bins[b].n
    rest = rows.filter(F.col("key").between(low, high))
    if n <= FEW:
        found = sorted((-r.key, r.doc_id) for r in rest.select("key", "doc_id").collect())[k - 1]
        return -found[0], found[1]
    at = rest.filter(F.col("key") == high)  # one key many times: the k-th doc_id, by the same means
    found = kth_largest(at.select((-F.col("doc_id")).cast("double").alias("key"), "doc_id"), k)
    return high, found[1]


class Draw:
    """The models and the k-th place of a sample drawn from docs; see resample() for the parameters."""

    def __init__(self, docs: DataFrame, sample: list[tuple[str, int]], k: int | None = None, seed: int = SEED, doc_id: str = "doc_id", text: str = "text"):
        self.seed = seed
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        good = [t for t, y in sample if y]
        target = sum((counts_of(part) for part in sample_slices(good)), np.zeros((KINDS, BUCKETS)))
        self.ratios = ratios = log_ratios(target, raw_counts(rows)) if good else np.zeros((KINDS, BUCKETS))
        weighed = rows.mapInArrow(lambda it: _weigh(ratios, it), "doc_id long, log_weight double")
        self.keyed = written(weighed.withColumn("key", F.col("log_weight") + self.noise(F.col("doc_id"))), "weights")
        if k is None:
            y = np.array([y for _, y in sample], bool)
            cut = best_cut(np.concatenate([weights_of(part, ratios) for part in sample_slices([t for t, _ in sample])]), y) if y.any() and not y.all() else -np.inf
            k = self.keyed.filter(F.col("log_weight") >= float(cut)).count()
        self.last = kth_largest(self.keyed.select("key", _order(F.col("doc_id")).alias("doc_id")), k) or (np.inf, -1 << 63)

    def noise(self, doc_id):
        """Gumbel noise that depends on the id alone."""
        unit = (F.shiftrightunsigned(F.xxhash64(_order(doc_id), F.lit(self.seed)), 11) + 0.5) / float(1 << 53)
        return -F.log(-F.log(unit))


def _order(doc_id):
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def resample(docs: DataFrame, sample: list[tuple[str, int]], k: int | None = None, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, log_weight, key (log_weight with noise), and kept: whether the document is among the k drawn.

    sample: (text, 1 if good). Null and empty texts have no n-grams and weight 0 on the log scale. Equal keys are told apart
    by doc_id; rows that share a doc_id share the noise, and all those at the k-th place are kept. Null ids count as the
    smallest. Other columns are left out.
    """
    drawn = Draw(docs, sample, k, seed, doc_id, text)
    key, at = float(drawn.last[0]), drawn.last[1]
    return drawn.keyed.withColumn("kept", (F.col("key") > key) | ((F.col("key") == key) & (_order(F.col("doc_id")) <= at)))


def _keep(ratios: np.ndarray, last: tuple[float, int], names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch, "text", 2 << 20):
            *own, noise, order = rows.columns
            key = weights_of(rows.column("text"), ratios) + noise.to_numpy()
            kept = (key > last[0]) | ((key == last[0]) & (order.to_numpy() <= last[1]))
            yield from pa.table(own, names).filter(pa.array(kept)).to_batches()


def drawn_documents(docs: DataFrame, sample: list[tuple[str, int]], k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that resample() keeps, unchanged. Texts are weighed once more instead
    of being shuffled to their verdicts."""
    drawn = Draw(docs, sample, k, seed)
    ratios, last, names = drawn.ratios, drawn.last, docs.columns
    more = docs.select("*", drawn.noise(F.col("doc_id")).alias("gumbel noise of the draw"), _order(F.col("doc_id")).alias("order of the draw"))
    return more.mapInArrow(lambda it: _keep(ratios, last, names, it), docs.schema)
