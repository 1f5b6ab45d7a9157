"""Words of texts as NumPy arrays: a word is a run of bytes other than space and tab to carriage return, in UTF-8.

All passes work on blocks of bytes, so memory stays in proportion to the block and not to the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 18  # bytes whose 64-bit terms are held at once; more than _LONG
_LONG = 1 << 16  # longer words are hashed one by one

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _random.integers(1, 2**64, 256, dtype=np.uint64)
_LETTER[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_GRAM = _random.integers(0, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(BLOCK + _LONG + 1, b, np.uint64)
            t[0] = 1
            _powers.append(np.cumprod(t, dtype=np.uint64))
    return _powers[0], _powers[1]


@dataclass
class Words:
    """buf: the bytes of all texts; offsets: where each text begins, with the end; starts, ends: of the words, in buf;
    first: index of each text's first word, with the number of words at the end."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, then mixed."""
        up, down = _tables()
        out = np.empty(len(self.starts), np.uint64)
        sizes = self.ends - self.starts
        i = 0
        while i < len(out):
            at = self.starts[i]
            j = int(np.searchsorted(self.ends, at + BLOCK, "right"))
            long = np.flatnonzero(sizes[i:j] > _LONG)
            if j == i or len(long):
                j = i + int(long[0]) if len(long) else i
                if j == i:
                    out[i] = xxhash.xxh64_intdigest(self.buf[at : self.ends[i]].tobytes())
                    i += 1
                    continue
            part = self.buf[at : self.ends[j - 1]]
            terms = _LETTER[part] * up[: len(part)]
            begins = self.starts[i:j] - at
            out[i:j] = mix(np.add.reduceat(terms, begins) * down[begins] + sizes[i:j].astype(np.uint64))
            i = j
        return out

    def grams(self, n: int, hashes: np.ndarray | None = None, row: int = 0) -> np.ndarray:
        """A hash of the n words from each word on; only those at whole() mean anything."""
        w = self.hashes() if hashes is None else hashes
        m = max(0, len(w) - n + 1)
        total = np.zeros(len(w), np.uint64)
        for k in range(n):
            total[:m] += w[k : k + m] * _GRAM[row, k]
        return mix(total)

    def whole(self, n: int) -> np.ndarray:
        """Whether n words from each word on lie in its text."""
        last = np.repeat(self.first[1:], self.counts)
        return np.arange(len(self.starts)) + n <= last


def words_of(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """Null texts have no words. lower: A to Z are lower-cased first."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        buf = _LOWER[buf]
    edge = np.ones(len(buf) + 1, bool)  # whether a word can't go on over the place before each byte
    edge[1:-1] = _SPACE[buf[:-1]] if len(buf) else False
    edge[offsets] = True
    solid = ~_SPACE[buf]
    starts = np.flatnonzero(solid & edge[:-1])
    edge[:-1] = ~solid
    edge[offsets] = True
    ends = np.flatnonzero(solid & edge[1:]) + 1
    return Words(buf, offsets, starts, ends, np.searchsorted(starts, offsets))
