"""Removal of repeated passages by difference-cover anchors.

Texts are dealt into chunks by document. The residues COVER modulo PERIOD are a difference cover: for any two places there
is a shift below PERIOD that takes both to covered places. So any two equal windows of WINDOW words have equal anchors
(WINDOW - PERIOD + 1 words) at covered places of both. Only windows with an anchor that occurs more than once can repeat.

1. Each chunk sends the distinct hashes of its anchors, by hash bucket; each bucket answers with a bit for each hash.
2. Each chunk extends the repeated anchors to the windows around them and sends these windows' 96-bit hashes, each once,
   with the smallest document that has it; each bucket answers with a bit: whether a smaller document has it.
3. Each chunk removes the words under windows that start earlier elsewhere or in itself.

A hash is sent once for each chunk, however many documents of the chunk hold it, so no frequent passage is gathered in
one task; buckets and chunks are bounded by bytes. Three passes read the same exchange of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from readloom.llm.shared import input_bytes, text_slices
from readloom.llm.words import Words, words_of

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
CHUNK_BYTES = (1 << 20, 8 << 20)  # of input files, at least and at most
MIN_CHUNKS = 256
#: A bucket serves so many chunks, up to MANY_BUCKETS; then it serves so many bytes of input, as a row for each chunk and
#: bucket would hold too little.
CHUNKS_PER_BUCKET = 4
MANY_BUCKETS, BUCKET_BYTES = 4096, 256 << 20

_SENT = "kind int, chunk int, bucket int, payload binary"


class Chunk:
    """The words of a chunk's documents, by document and text, with the hashes that all passes derive alike."""

    def __init__(self, docs: pa.Table):
        self.docs = docs.take(pa.compute.sort_indices(docs, [("doc_id", "ascending"), ("text", "ascending")]))
        self.doc_id = self.docs.column("doc_id").to_numpy()
        anchors, places, hashes, counts = [], [], [], []
        begin = 0
        for part in text_slices(self.docs, "text", 2 << 20):
            w = words_of(part.column("text"))
            h = w.hashes()
            hashes.append(h)
            counts.append(w.counts)
            n = WINDOW - PERIOD + 1
            at = np.arange(len(h)) - np.repeat(w.first[:-1], w.counts)
            use = np.isin(at % PERIOD, COVER) & w.whole(n) & np.repeat(w.counts >= WINDOW, w.counts)
            anchors.append(w.grams(n, h)[use])
            places.append(np.flatnonzero(use) + begin)
            begin += len(h)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.anchors, self.places, self.hashes = join(anchors, np.uint64), join(places, np.int64), join(hashes, np.uint64)
        self.counts = join(counts, np.int64)
        self.distinct, self.which = np.unique(self.anchors, return_inverse=True)
        self.local = np.bincount(self.which, minlength=len(self.distinct)) > 1

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The starts of windows around repeated anchors, and their two 64-bit hashes. repeated: by distinct anchor."""
        total = len(self.hashes)
        near = np.zeros(total + 1, np.int32)
        found = self.places[repeated[self.which]]
        first = np.cumsum(self.counts) - self.counts
        low = np.maximum(found - (PERIOD - 1), np.repeat(first, self.counts)[found] if total else 0)
        np.add.at(near, low, 1)
        np.add.at(near, found + 1, -1)
        last = np.repeat(np.cumsum(self.counts), self.counts)
        starts = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (np.arange(total) + WINDOW <= last))
        one = Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(1, np.int64))
        return starts, one.grams(WINDOW, self.hashes, 0)[starts], one.grams(WINDOW, self.hashes, 1)[starts] >> np.uint64(32)


def _sent(kind: int, chunk: int, bucket: np.ndarray, payload: np.ndarray) -> pa.Table:
    """One row for each bucket; payload is sorted by bucket and has one row of bytes for each hash."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    edges = np.concatenate([[0], cuts, [len(bucket)]])
    edges = edges if len(bucket) else edges[:1]
    n = len(edges) - 1
    width = payload.shape[1]
    raw = np.ascontiguousarray(payload).tobytes()
    blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(raw)])
    same = lambda x: pa.array(np.full(n, x, np.int32))
    return pa.table([same(kind), same(chunk), pa.array(bucket[edges[:-1]].astype(np.int32)), blobs], ["kind", "chunk", "bucket", "payload"])


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # rises with the hash


def _bits(answers: pa.Table, kind: int, bucket: np.ndarray) -> np.ndarray:
    """The answers of kind for hashes that lie in bucket, in the order in which they were sent."""
    out = np.zeros(len(bucket), bool)
    rows = answers.filter(pa.compute.equal(answers.column("kind"), kind))
    for b, blob in zip(rows.column("bucket").to_pylist(), rows.column("payload").to_pylist()):
        begin, end = np.searchsorted(bucket, [b, b + 1])
        out[begin:end] = np.unpackbits(np.frombuffer(blob, np.uint8), count=end - begin).astype(bool)
    return out


class Remover:
    """The functions of all passes, for a number of buckets."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def send_anchors(self, docs: pa.Table) -> pa.Table:
        c = Chunk(docs)
        payload = np.concatenate([c.distinct.view(np.uint8).reshape(-1, 8), c.local.astype(np.uint8)[:, None]], 1)
        return _sent(1, docs.column("chunk")[0].as_py(), _bucket_of(c.distinct, self.buckets), payload)

    @staticmethod
    def answer_anchors(sent: pa.Table) -> pa.Table:
        sent = sent.combine_chunks()
        blobs = [np.frombuffer(x, np.uint8).reshape(-1, 9) for x in sent.column("payload").to_pylist()]
        sizes = np.array([len(x) for x in blobs])
        rows = np.concatenate(blobs)
        _, which, counts = np.unique(np.ascontiguousarray(rows[:, :8]).view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        return _answered(sent, (counts[which] > 1) | (rows[:, 8] > 0), sizes)

    def _own(self, docs: pa.Table, answers: pa.Table):
        c = Chunk(docs)
        starts, high, low = c.windows(_bits(answers, 1, _bucket_of(c.distinct, self.buckets)))
        order = np.lexsort((starts, low, high))  # equal windows meet, the earliest first
        high, low = high[order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        return c, starts[order], high, low, new

    def send_windows(self, key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary())], ["kind", "chunk", "bucket", "payload"])
        c, starts, high, low, new = self._own(docs, answers)
        of = np.repeat(np.arange(len(c.counts)), c.counts)[starts[new]]
        parts = [high[new].view(np.uint8).reshape(-1, 8), low[new].astype(np.uint32).view(np.uint8).reshape(-1, 4), c.doc_id[of].view(np.uint8).reshape(-1, 8)]
        return _sent(2, key[0].as_py(), _bucket_of(high[new], self.buckets), np.concatenate(parts, 1))

    @staticmethod
    def answer_windows(sent: pa.Table) -> pa.Table:
        sent = sent.combine_chunks()
        blobs = [np.frombuffer(x, np.uint8).reshape(-1, 20) for x in sent.column("payload").to_pylist()]
        sizes = np.array([len(x) for x in blobs])
        rows = np.concatenate(blobs)
        high, low, doc = (np.ascontiguousarray(rows[:, a:b]).view(t).ravel() for a, b, t in ((0, 8, np.uint64), (8, 12, np.uint32), (12, 20, np.int64)))
        order = np.lexsort((doc, low, high))
        again = np.zeros(len(order), bool)
        again[1:] = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        out = np.zeros(len(order), bool)
        out[order] = again
        return _answered(sent, out, sizes)

    def remove(self, key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["row", "n_words", "n_removed", "kept_text"]
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names).rename_columns(["doc_id", *names[1:]])
        c, starts, high, _, new = self._own(docs, answers)
        gone = ~new
        gone[new] = _bits(answers, 2, _bucket_of(high[new], self.buckets))
        cover = np.zeros(len(c.hashes) + 1, np.int32)
        np.add.at(cover, starts[gone], 1)
        np.add.at(cover, starts[gone] + WINDOW, -1)
        drop = np.cumsum(cover[:-1]) > 0
        texts, removed, at = [], [], 0
        for part in text_slices(c.docs, "text", 2 << 20):
            w = words_of(part.column("text"))
            d = drop[at : at + len(w.starts)]
            at += len(d)
            texts += joined_words(w, ~d)
            removed.append(np.bincount(w.text_of, d, len(w.counts)).astype(np.int64))
        return pa.table([pa.array(c.doc_id), pa.array(c.counts.astype(np.int64)), pa.array(np.concatenate(removed)), pa.array(texts, pa.string())], ["doc_id", *names[1:]])


def joined_words(w: Words, keep: np.ndarray) -> list[str]:
    """The kept words of each text, joined by one space."""
    buf = np.concatenate([w.buf, np.zeros(1, np.uint8)])
    out = []
    for i in range(len(w.counts)):
        a, b = w.first[i], w.first[i + 1]
        k = keep[a:b]
        if not k.any():
            out.append("")
            continue
        lo, hi = w.offsets[i], w.offsets[i + 1]
        piece = buf[lo : hi + 1].copy()
        ends = w.ends[a:b][k] - lo
        piece[ends] = 0x20
        mask = np.zeros(len(piece) + 1, np.int8)
        mask[ends + 1] = -1  # the byte behind a word is kept for the space
        mask[w.starts[a:b][k] - lo] += 1
        out.append(piece[np.cumsum(mask[:-1]) > 0][:-1].tobytes().decode("utf-8"))
    return out


def _answered(sent: pa.Table, bits: np.ndarray, sizes: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    blobs = [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
    return sent.set_column(3, "payload", pa.array(blobs, pa.binary()))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words that stay, joined by one space).

    A word goes if it lies in a window of WINDOW words whose word sequence also starts in a document with a smaller doc_id
    or earlier in its own; all windows are those of the input. Null and empty texts have no words. Rows that share a doc_id
    count as one document's parts, by text; a null doc_id counts as the smallest. Other
    columns are left out.
    """
    size = input_bytes(docs)
    chunk_bytes = min(max(size // 1024, CHUNK_BYTES[0]), CHUNK_BYTES[1])
    chunks = max(MIN_CHUNKS, -(-size // chunk_bytes)) if size < 1 << 60 else 1 << 16
    f = Remover(max(1, min(chunks // CHUNKS_PER_BUCKET, MANY_BUCKETS), size // BUCKET_BYTES if size < 1 << 60 else 0))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("chunk"), key.alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    by_chunk = rows.groupBy("chunk")
    repeated = by_chunk.applyInArrow(lambda d: f.send_anchors(d), _SENT).groupBy("bucket").applyInArrow(Remover.answer_anchors, _SENT)
    windows = by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(lambda k, d, a: f.send_windows(k, d, a), _SENT)
    earlier = windows.groupBy("bucket").applyInArrow(Remover.answer_windows, _SENT)
    answers = repeated.unionAll(earlier)
    out = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(lambda k, d, a: f.remove(k, d, a), "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")))
