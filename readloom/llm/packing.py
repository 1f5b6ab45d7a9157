"""Concatenate and cut: documents, in table order, become one stream of tokens that is cut into windows of seq_len.

Pass 1 encodes each document once and writes its ids with its place within its partition. The partitions' totals, summed
up, give each partition's place in the stream. Pass 2 cuts every document at the windows' edges, each for itself. No
tokens are shuffled; only windows that cross partitions are put together from boundary records, at most two a partition.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from readloom.llm.shared import text_slices, written

SEQ_LEN = 2048
END_ID = 1
CACHED_PIECES = 300_000
#: Partition totals are broadcast up to so many partitions (16 bytes each).
BROADCAST_PARTITIONS = 2_000_000

#: Runs of so many characters are left to the tokenizers library, as tiktoken's regular expressions take stack by length.
LONG_RUN = 4096

_TWO_SPACES = regex.compile(r"\s\s")
_LONG_SPACE = regex.compile(rf"\s{{{LONG_RUN}}}")
_LONE_SPACE = regex.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=1)
def encoder(path: str):
    """text -> its ids as little-endian 16-bit or 32-bit bytes, and their width.

    path: a byte-level BPE tokenizer file of the tokenizers library. The ids are that library's, with the file's added tokens
    found in the text. The vocabulary is handed to tiktoken, which gives the same ids several times as fast; only what holds
    a run of LONG_RUN characters is encoded by the library itself. Where no two white-space characters meet, a space begins a
    piece of the pre-tokenizer's, so pieces between spaces are encoded apart and kept.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    if any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens must be found in the text as they are")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    width = np.dtype("<u2") if max([*ranks.values(), *added.values()]) < 1 << 16 else np.dtype("<u4")
    longest: list = []

    def slowly(text: str) -> bytes:
        if not longest:
            import tokenizers

            longest.append(tokenizers.Tokenizer.from_file(path))
        return np.array(longest[0].encode(text, add_special_tokens=False).ids, width).tobytes()

    def encode(text: str) -> bytes:
        if len(text) < LONG_RUN or not _LONG_SPACE.search(text) and max(map(len, text.split()), default=LONG_RUN) < LONG_RUN:
            return np.array(bpe.encode_ordinary(text), width).tobytes()
        parts = _LONE_SPACE.split(text)
        return slowly(text) if len(parts) == 1 else b"".join(map(encode, parts))

    class Pieces(dict):
        def __missing__(self, piece: str) -> bytes:
            ids = encode(piece)
            if len(self) < CACHED_PIECES and len(piece) < 40:
                self[piece] = ids
            return ids

    known = Pieces()

    def plain(text: str) -> bytes:
        if _TWO_SPACES.search(text):
            return encode(text)
        head, *rest = text.split(" ")
        return encode(head) + b"".join(map(known.__getitem__, [" " + x for x in rest]))

    codes = {t: np.array([i], width).tobytes() for t, i in added.items() if t}
    if not codes:
        return plain, width
    split = regex.compile("(" + "|".join(map(regex.escape, sorted(codes, key=len, reverse=True))) + ")").split

    def whole(text: str) -> bytes:
        if not any(t in text for t in codes):
            return plain(text)
        return b"".join(codes[x] if i % 2 else plain(x) for i, x in enumerate(split(text)))

    return whole, width


def _encode(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, width = encoder(path)
    part, at = TaskContext.get().partitionId(), 0
    end = np.array([end_id], width).tobytes()
    for batch in batches:
        for rows in text_slices(batch, "text"):
            ids = [encode(x or "") + end for x in rows.column("text").to_pylist()]
            sizes = np.array([len(x) // width.itemsize for x in ids], np.int64)
            ends = at + np.cumsum(sizes)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(ends - sizes), rows.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(sizes), pa.array(ids, pa.binary())], ["part", "place", "doc_id", "doc_tokens", "ids"])
            at = int(ends[-1])


def _cut(path: str, seq_len: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = encoder(path)[1]
    for batch in batches:
        place, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "doc_tokens"))
        doc_ids, blobs = batch.column("doc_id"), batch.column("ids")
        low, high = place // seq_len, (place + sizes - 1) // seq_len
        pieces = (high - low + 1).astype(np.int64)
        begin = 0
        while begin < len(sizes):  # a bounded number of tokens at once
            stop = max(begin + 1, int(np.searchsorted(np.cumsum(sizes[begin:]), 2_000_000, "right")) + begin)
            s = slice(begin, stop)
            of = np.repeat(np.arange(begin, stop), pieces[s])
            number = np.arange(len(of)) - np.repeat(np.cumsum(pieces[s]) - pieces[s], pieces[s])
            seq = low[of] + number
            first = np.maximum(seq * seq_len, place[of])
            last = np.minimum((seq + 1) * seq_len, place[of] + sizes[of])
            tokens = np.concatenate([np.frombuffer(blobs[i].as_buffer(), width) for i in range(begin, stop)]).astype("<u4")
            edges = np.concatenate([[0], np.cumsum(last - first)]) * 4
            if edges[-1] < 1 << 31:
                packed = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(tokens)])
            else:
                raw = tokens.tobytes()
                packed = pa.array([raw[a:b] for a, b in zip(edges[:-1], edges[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(of)), pa.array(first - place[of]), pa.array(last - first), pa.array(sizes[of]), pa.array(seq), pa.array(first - seq * seq_len), packed], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tokens"])
            begin = stop


def pack(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, start (the document's ids before the piece), length, doc_tokens (its ids with
    end_id), sequence_id, offset (the piece's place there) and tokens (little-endian unsigned 32-bit ids).

    Every sequence but the last is full, so only the last needs padding. A null text counts as empty: its one token is
    end_id. A null doc_id stays null; repeated rows are packed each, and there are no ties; other columns are left out,
    whatever their names. An empty table gives no pieces. Texts longer than a sequence span several; runs of any length,
    white space too, are encoded. The order is that of the table's partitions.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "part int, place long, doc_id long, doc_tokens long, ids binary"
    encoded = written(rows.mapInArrow(lambda it: _encode(tokenizer, end_id, it), schema), "packing")
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    parts = encoded.agg(F.max("part")).first()[0] or 0
    if parts < BROADCAST_PARTITIONS:
        bases = F.broadcast(bases)
    placed = encoded.join(bases, "part").select((F.col("place") + F.col("base")).alias("place"), "doc_id", "doc_tokens", "ids")
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tokens binary"
    return placed.mapInArrow(lambda it: _cut(tokenizer, seq_len, it), schema)


def sequences(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """sequence_id, tokens (joined, little-endian unsigned 32-bit ids), n_tokens, padded_tokens, and pieces (doc_id, start,
    length, offset), by offset: full windows of one piece pass through, the rest meet by sequence.

    padded_tokens: n_tokens where that is a power of two, else seq_len. At most seq_len pieces meet in a group.
    """
    p = F.struct("offset", "doc_id", "start", "length", "tokens")
    full = pieces.filter(F.col("length") == seq_len).select("sequence_id", F.array(p).alias("p"))
    boundary = pieces.filter(F.col("length") < seq_len).groupBy("sequence_id").agg(F.sort_array(F.collect_list(p)).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["tokens"]))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    out = full.unionAll(boundary).select("sequence_id", joined.alias("tokens"), n.alias("n_tokens"), F.transform("p", lambda x: x.dropFields("tokens")).alias("pieces"))
    power = F.bit_count("n_tokens") == 1
    return out.withColumn("padded_tokens", F.when(power, F.col("n_tokens")).otherwise(F.lit(seq_len).cast("long")))
