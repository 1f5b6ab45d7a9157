"""Quality rules on lines: a linear-chain conditional random field labels each line content or boilerplate, by Viterbi
decoding; the share of words in content lines decides whether a document is kept.

Lines are described by a few shares (symbols, capitals, bars, digits, repeated words, ...). The field is trained on a
bounded sample of labelled documents: lines of good documents are content; of bad ones, those that the model so far takes
for boilerplate (at first all), so that a good line in a bad document isn't learnt as boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from readloom.llm.shared import sample_slices, text_slices
from readloom.llm.words import mix, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT = 3  # words of the windows whose repeats count
FEATURES = 10
STEPS, ROUNDS = 150, 3


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars.encode())] = 1
    return out


_SYMBOL, _BAR, _MARK = _table("#*$%&|<>"), _table("|"), _table("!")
_UPPER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_LETTER = ((np.arange(256) < 0x80) | (np.arange(256) >= 0xC0)).astype(np.int32)  # first bytes of characters
_STOP = _table(".!?:;")


@dataclass
class Lines:
    """Base figures of each text, and of each of its lines with a word: features, words, and where its text's lines begin."""

    base: dict[str, np.ndarray]
    features: np.ndarray
    words: np.ndarray
    first: np.ndarray


def lines_of(texts: pa.ChunkedArray) -> Lines:
    w = words_of(texts)
    n, text_of = len(w.counts), w.text_of
    hashes = w.hashes()
    total = lambda table: np.concatenate([[0], np.cumsum(table[w.buf], dtype=np.int64)])
    characters, symbols = total(_LETTER), total(_SYMBOL)
    by_text = lambda values: np.bincount(text_of, values, n).astype(np.int64)

    whole = w.whole(REPEAT)
    grams = mix(w.grams(REPEAT, hashes) ^ mix(text_of.astype(np.uint64) + np.uint64(1)))[whole]
    _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
    covered = np.zeros(len(hashes) + REPEAT + 1, np.int32)
    again = np.flatnonzero(whole)[counts[which] > 1]
    for k in range(REPEAT):
        covered[again + k] = 1
    covered = covered[: len(hashes)]

    breaks = np.flatnonzero(w.buf == 10)
    line_start = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
    line_of = np.searchsorted(line_start, w.starts, "right") - 1
    used, words = np.unique(line_of, return_counts=True)  # lines with a word
    begin = line_start[used]
    text = np.searchsorted(w.offsets, begin, "right") - 1
    limit = w.offsets[text + 1]
    after = np.append(line_start, len(w.buf))[used + 1]
    end = np.where((after <= limit) & (after > begin) & (np.append(w.buf, 0)[np.maximum(after - 1, 0)] == 10), after - 1, np.minimum(after, limit))
    data, seen, dup, last = w.buf.tobytes(), set(), np.zeros(len(used), bool), -1
    for i, (a, b, t) in enumerate(zip(begin.tolist(), end.tolist(), text.tolist())):
        if t != last:
            seen, last = set(), t
        line = data[a:b]
        if line in seen:
            dup[i] = True
        seen.add(line)

    place = np.searchsorted(used, line_of)
    in_line = lambda values: np.bincount(place, values, len(used))
    _, once = np.unique(mix(hashes ^ mix(line_of.astype(np.uint64))), return_index=True)
    new = np.zeros(len(hashes))
    new[once] = 1
    size = np.maximum(1, end - begin)
    share = lambda table: (total(table)[end] - total(table)[begin]) / size
    tail = w.buf[np.minimum(np.maximum(end - 1, 0), max(0, len(w.buf) - 1))] if len(w.buf) else np.zeros(0, np.uint8)
    features = np.stack([
        np.ones(len(used)), np.minimum(1, 4 * share(_SYMBOL)), np.minimum(1, 2 * share(_UPPER)), np.minimum(1, 8 * share(_BAR)), np.minimum(1, 8 * share(_MARK)),
        np.minimum(1, 2 * share(_DIGIT)), in_line(covered) / words, 1 - in_line(new) / words, dup.astype(float), 1.0 - _STOP[tail],
    ], 1) if len(used) else np.zeros((0, FEATURES))
    base = {
        "n_words": w.counts.astype(np.int64), "word_chars": by_text(characters[w.ends] - characters[w.starts]), "n_symbols": np.diff(symbols[w.offsets]),
        "n_dup_lines": np.bincount(text, dup, n).astype(np.int64), "n_repeat_words": by_text(covered),
    }
    return Lines(base, features, words, np.searchsorted(text, np.arange(n + 1)))


def _joined(parts: list[Lines]) -> Lines:
    begins = np.cumsum([0, *(len(p.words) for p in parts)])
    first = np.concatenate([*(p.first[:-1] + b for p, b in zip(parts, begins)), begins[-1:]])
    return Lines({}, np.concatenate([p.features for p in parts]), np.concatenate([p.words for p in parts]), first)


@dataclass
class Field:
    """emission: FEATURES x 2 and transition: 2 x 2 scores; label 1 is content. least: the share of words in content lines
    from which a document is kept."""

    emission: np.ndarray
    transition: np.ndarray
    least: float = 0.5

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of all lines: Viterbi steps go over the places of all texts' lines at once."""
        scores = features @ self.emission
        out = np.zeros(len(scores), np.int8)
        order = np.argsort(-np.diff(first), kind="stable")
        sizes = np.diff(first)[order]
        begin = first[:-1][order]
        if not len(sizes) or not sizes[0]:
            return out
        back = np.zeros((len(scores), 2), np.int8)
        n = int(np.searchsorted(-sizes, 0))
        best = scores[begin[:n]].copy()
        for t in range(1, int(sizes[0])):
            n = int(np.searchsorted(-sizes, -t))
            via = best[:n, :, None] + self.transition
            back[begin[:n] + t] = via.argmax(1)
            best[:n] = via.max(1) + scores[begin[:n] + t]
        n = int(np.searchsorted(-sizes, 0))
        out[begin[:n] + sizes[:n] - 1] = best[:n].argmax(1)
        for t in range(int(sizes[0]) - 1, 0, -1):
            n = int(np.searchsorted(-sizes, -t))
            here = begin[:n] + t
            out[here - 1] = back[here, out[here]]
        return out

    def gradient(self, features: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean log likelihood of labels y, by forward and backward sums."""
        scores = features @ self.emission
        order = np.argsort(-np.diff(first), kind="stable")
        sizes, begin = np.diff(first)[order], first[:-1][order]
        live = lambda t: int(np.searchsorted(-sizes, -t))
        forward, backward = scores.copy(), np.zeros_like(scores)
        add = lambda x, axis: np.logaddexp(x.take(0, axis), x.take(1, axis))
        top = int(sizes[0]) if len(sizes) else 0
        for t in range(1, top):
            at = begin[: live(t)] + t
            forward[at] += add(forward[at - 1][:, :, None] + self.transition, 1)
        for t in range(top - 1, 0, -1):
            at = begin[: live(t)] + t
            backward[at - 1] = add(self.transition + (scores[at] + backward[at])[:, None, :], 2)
        both = forward + backward
        norm = add(both, 1)
        marginal = np.exp(both - norm[:, None])
        inner = np.ones(len(scores), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        at = np.flatnonzero(inner)
        pair = np.exp(forward[at - 1][:, :, None] + self.transition + (scores[at] + backward[at])[:, None, :] - norm[at][:, None, None])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1], y[at]), 1)
        n = max(1, len(scores))
        return features.T @ (np.eye(2)[y] - marginal) / n, (seen - pair.sum(0)) / n


def _content_share(labels: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 for a text without words."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    all_words = np.bincount(text, words, len(first) - 1)
    return np.where(all_words > 0, np.bincount(text, words * labels, len(first) - 1) / np.maximum(1, all_words), 1.0)


def train(sample: list[tuple[str, int]], steps: int = STEPS, rounds: int = ROUNDS) -> Field:
    """sample: (text, 1 if good). Without documents of both classes, all lines are content."""
    good = np.array([y for _, y in sample], np.int8)
    field = Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    if not len(good) or good.min() == good.max():
        field.emission[0, 1] = 1.0
        return field
    found = _joined([lines_of(part) for part in sample_slices([t for t, _ in sample])])
    of = np.repeat(good, np.diff(found.first)).astype(np.int64)
    y = of.copy()
    for _ in range(rounds):
        m, v = [np.zeros((FEATURES, 2)), np.zeros((2, 2))], [np.zeros((FEATURES, 2)), np.zeros((2, 2))]
        for step in range(1, steps + 1):  # Adam
            for k, (g, p) in enumerate(zip(field.gradient(found.features, found.first, y), (field.emission, field.transition))):
                g = g - 1e-4 * p
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                p += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        labels = field.decode(found.features, found.first)
        y = np.where(of == 1, 1, labels).astype(np.int64)
    share = _content_share(field.decode(found.features, found.first), found.words, found.first)
    cuts = np.linspace(0.05, 0.95, 19)
    field.least = float(cuts[np.argmax([(share[good == 0] < c).mean() - 3 * (share[good == 1] < c).mean() for c in cuts])])
    return field


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_content_lines long, content_share double"


def _judge(field: Field, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch, "text"):
            found = lines_of(rows.column("text"))
            labels = field.decode(found.features, found.first)
            lines = np.diff(found.first)
            content = np.diff(np.concatenate([[0], np.cumsum(labels, dtype=np.int64)])[found.first])
            arrays = [rows.column("doc_id").combine_chunks(), *(pa.array(x) for x in found.base.values()), pa.array(lines.astype(np.int64)), pa.array(content), pa.array(_content_share(labels, found.words, found.first))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *found.base, "n_lines", "n_content_lines", "content_share"])


def judge(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_content_lines (lines with a word),
    content_share, base_failed and kept, for every whole text.

    A null text counts as empty: it has no words, so base_failed. Repeated rows are judged each; other columns are left out.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(lambda it: _judge(field, it), _SCHEMA)
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= field.least))
