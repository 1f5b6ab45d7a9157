"""Benchmark items inside documents: size-partitioned MinHash containment, verified on exact shingle sets.

Items are partitioned by the size of their shingle sets, in powers of two. Each partition has a share of the space of mixed
hashes: the whole space for sizes up to SKETCH, half of it for sizes up to twice that, and so on. An item's sketch is what of
its set lies in its partition's share, at least half of SKETCH (else it goes to the partition below); a document's signature
for a partition is what of its set lies there. The share of the sketch that is in the signature estimates how much of the
item the document contains, whatever the document's length. The least number of hits is set for each size and sketch such
that an item that is contained as asked falls below it less than once in a million times. Candidates are then verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from readloom.llm.neardup import PERCENT, shingle_sets
from readloom.llm.shared import text_slices, written
from readloom.llm.words import mix

SKETCH = 32
MISS = 1e-6
_SALT = np.uint64(0xC0FFEE)
#: Items are sent to the executors in blocks of about so many characters; each block takes one pass over the documents.
BLOCK_CHARS = 16 << 20


@lru_cache(maxsize=4096)
def least_hits(size: int, sketch: int, percent: int) -> int:
    """The largest number of sketch hits that an item of size shingles, with percent of them in a document, reaches with
    probability 1 - MISS at least; the sketch is a random choice of the shingles."""
    inside = -(-size * percent // 100)
    chosen = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    total, below = chosen(size, sketch), 0.0
    for hits in range(max(0, sketch - (size - inside)), sketch + 1):
        below += math.exp(chosen(inside, hits) + chosen(size - inside, sketch - hits) - total)
        if below > MISS:
            return max(1, hits)
    return sketch


def partition_of(size: int, sketch: int = SKETCH) -> int:
    """How often the space is halved for items of size shingles."""
    return max(0, -(-size // sketch) - 1).bit_length()


class Partition:
    """The sketches of items whose partition halves the space `halved` times."""

    def __init__(self, halved: int, members: np.ndarray, sketches: list[np.ndarray]):
        self.limit = np.uint64((1 << 64 >> halved) - 1)
        hashes, owner = np.concatenate(sketches), np.repeat(members, [len(s) for s in sketches])
        order = np.lexsort((owner, hashes))
        self.owner = owner[order]
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(order))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes << np.uint64(halved)) >> np.uint64(44)] = True
        self.halved = np.uint64(halved)

    def hits(self, mixed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and items, once for each element of a document's signature that is in an item's sketch."""
        signature = mixed <= self.limit
        mixed, doc = mixed[signature], doc[signature]
        maybe = self.seen[(mixed << self.halved) >> np.uint64(44)]
        mixed, doc = mixed[maybe], doc[maybe]
        at = np.minimum(np.searchsorted(self.hashes, mixed), len(self.hashes) - 1)
        hit = self.hashes[at] == mixed
        at, doc = at[hit], doc[hit]
        many = self.first[at + 1] - self.first[at]
        begin = np.repeat(self.first[at] - (np.cumsum(many) - many), many)
        return np.repeat(doc, many), self.owner[begin + np.arange(len(begin))]


class Index:
    """The partitions of a block of items, and the items' full sets."""

    def __init__(self, items: list[tuple[int, str]], percent: int, sketch: int = SKETCH):
        sets = shingle_sets(pa.array([t for _, t in items], pa.string()))
        used = [i for i, s in enumerate(sets) if len(s)]
        self.ids = np.array([items[i][0] for i in used], np.int64)
        self.sets = [sets[i] for i in used]
        self.percent = percent
        self.least = np.zeros(len(used), np.int64)
        members: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, s in enumerate(self.sets):
            mixed, halved = mix(s ^ _SALT), partition_of(len(s), sketch)
            while (own := mixed[mixed <= np.uint64((1 << 64 >> halved) - 1)]).size < min(len(s), sketch // 2):
                halved -= 1
            self.least[i] = least_hits(len(s), len(own), percent)
            members.setdefault(halved, []).append((i, own))
        self.partitions = [Partition(h, np.array([i for i, _ in m], np.int64), [own for _, own in m]) for h, m in sorted(members.items())]

    def contained(self, sets: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(place of the document in sets, item_id, shared shingles, the item's shingles)"""
        if not self.partitions or not sets:
            return []
        mixed = mix(np.concatenate(sets) ^ _SALT)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        out = []
        for p in self.partitions:
            docs, items = p.hits(mixed, doc)
            pairs, hits = np.unique(docs * len(self.ids) + items, return_counts=True)
            for pair in pairs[hits >= self.least[pairs % len(self.ids)]].tolist():
                d, i = divmod(pair, len(self.ids))
                shared = len(np.intersect1d(self.sets[i], sets[d], assume_unique=True))
                if 100 * shared >= self.percent * len(self.sets[i]):
                    out.append((d, int(self.ids[i]), shared, len(self.sets[i])))
        return sorted(out)


def _search(index: Index, keep: list[str] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch, "text"):
            found = index.contained(shingle_sets(rows.column("text")))
            if keep is not None:
                clean = np.ones(rows.num_rows, bool)
                clean[[d for d, *_ in found]] = False
                yield from rows.filter(pa.array(clean)).select(keep).to_batches()
            elif found:
                at, items, shared, sizes = (np.array(x, np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks().take(pa.array(at)), pa.array(items), pa.array(shared), pa.array(sizes)], ["doc_id", "item_id", "n_shared", "n_item"])


class _Blocks:
    """The items' indexes, one block after the other. Where there are several, each block's result is written before the
    next one is built, so the driver and executors hold the characters of one block at a time."""

    def __init__(self, items: DataFrame, percent: int, block_chars: int):
        rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        self.rows, self.percent = rows.filter("item_id is not null and text is not null").distinct(), percent
        self.n = -(-(self.rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) or 1

    def index(self, block: int) -> Index:
        part = self.rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)) == block).collect()
        return Index(sorted((r.item_id, r.text) for r in part), self.percent)

    def searched(self, docs: DataFrame, block: int, keep: list[str] | None, schema) -> DataFrame:
        index = self.index(block)
        out = docs.mapInArrow(lambda it: _search(index, keep, it), schema)
        return out if self.n == 1 else written(out, "items")


def find_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, block_chars: int = BLOCK_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_item: the documents that contain at least percent of an item's distinct shingles of five
    lower-cased words (of a shorter text, its word sequence, which only an equal text has).

    items: item_id, text. Null and empty texts contain nothing and items without words are in nothing; texts of any length
    are searched whole. Items are told apart by id and text, so a repeated item counts once; repeated documents are reported
    each, and there are no ties, as all items are reported. A null doc_id stays null. Empty tables give no rows. Other
    columns, whatever their names, are left out.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = _Blocks(items, percent, block_chars)
    parts = [blocks.searched(rows, b, None, "doc_id long, item_id long, n_shared long, n_item long") for b in range(blocks.n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without those that find_items() reports, row by row: of rows that share a doc_id, or have none, only those whose
    own text contains an item go. Null, empty and very long texts, repeated rows and empty tables are as there; all columns
    stay. With several blocks of items, what is left is written after each."""
    blocks = _Blocks(items, percent, block_chars)
    out = docs
    for b in range(blocks.n):
        out = blocks.searched(out, b, docs.columns, docs.schema)
    return out
