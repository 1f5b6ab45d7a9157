"""Toxicity by compression distance: how much shorter windows get with a toxic dictionary than with an ordinary one.

Zstandard's trainer makes both dictionaries: the ordinary one of windows of ordinary training text, the toxic one of the
windows that tell toxic training documents apart. (Trained on all their windows it hardly differs from the ordinary one, as
only about one word in a hundred does.) Those are the windows around a word beginning, or around a sequence of two or three
words, that is nearly absent elsewhere and in more toxic documents than chance explains for any of all that were looked at.
The toxic dictionary is used together with the ordinary one, so what both classes have costs the same with either. Where the
toxic one still shortens ordinary windows, as its words share endings with ordinary ones, the words that cause it train a
second part of the ordinary one.

Texts are cut into overlapping windows of WINDOW_WORDS words, and each is compressed with both. A window counts if it saves
at least a threshold. The threshold, how telling each saving is, and the weights of the sum, mean and maximum of what counts
are calibrated on training documents that the dictionaries weren't trained on.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

from readloom.llm.shared import text_slices
from readloom.llm.words import mix, words_of

WINDOW_WORDS, STRIDE = 8, 6
ORDINARY_BYTES, OWN_BYTES = 16 << 10, 8 << 10  # of the ordinary dictionary's first part; of its second and the toxic one
ORDINARY_WINDOWS = 30_000  # that the ordinary dictionary is trained on, at most
ORDINARY_TRAINER, OWN_TRAINER = {"k": 50, "d": 8}, {"k": 24, "d": 6}  # bytes of the trainer's segments, and of what it counts
CALIBRATED = 4  # one training document of so many calibrates
#: How many features may pass for telling by chance, among all that are looked at.
CHANCE = 0.05
MIN_DOCUMENTS = 5  # with different surroundings, for a feature
MAX_RATIO = 0.05  # of a feature's share of ordinary documents to its share of toxic ones
BEGINNING = (3, 14)  # letters
SEQUENCES = (2, 3)  # words
SAVINGS = 16  # cells of saved bytes; larger savings share the last
MIN_TELLING = 3.0  # how much more frequent in toxic text savings from the threshold on are

_SPLIT = re.compile(rb"[\x20\x09-\x0D]+")


def _words(text: str) -> list[bytes]:
    return [w for w in _SPLIT.split(text.lower().encode()) if w]


def windows_of(words: list[bytes], n: int = WINDOW_WORDS, stride: int = STRIDE) -> list[bytes]:
    """Windows of n words, stride words apart; the last ones may be shorter. Every stretch of n - stride + 1 words lies in one."""
    return [b" %b " % b" ".join(words[i : i + n]) for i in range(0, max(1, len(words) - n + stride), stride)] if words else []


def _by_chance(a: int, b: int, share: float) -> float:
    """The probability that of a + b documents a or more are toxic, if each is with probability share."""
    n, log = a + b, lambda k: math.lgamma(k + 1)
    return sum(math.exp(log(n) - log(k) - log(n - k) + k * math.log(share) + (n - k) * math.log1p(-share)) for k in range(a, n + 1))


def _telling(toxic: list[int], ordinary: list[int], contexts: list[int], share: float, tried: int) -> np.ndarray:
    """Which features tell toxic documents apart, by the documents and the different surroundings that have them. Documents
    count as one where the surroundings are the same, so what near copies share doesn't pass for telling."""
    chance: dict[tuple[int, int], bool] = {}
    out = np.zeros(len(toxic), bool)
    for i, (a, b, c) in enumerate(zip(toxic, ordinary, contexts)):
        n = min(a, c)
        if n < MIN_DOCUMENTS or b * share > MAX_RATIO * n * (1 - share):
            continue
        if (n, b) not in chance:
            chance[n, b] = tried * _by_chance(n, b, share) <= CHANCE
        out[i] = chance[n, b]
    return out


def _documents(feature: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each of n features: how many different values of come with it."""
    pairs = np.unique(feature.astype(np.int64) * (int(of.max(initial=0)) + 1) + of)
    return np.bincount(pairs // (int(of.max(initial=0)) + 1), minlength=n)


def _telling_words(toxic: list[list[str]], ordinary: list[list[str]], share: float) -> set[str]:
    """The words that begin with a telling beginning."""
    ids: dict[str, int] = {}
    places = [[ids.setdefault(w, len(ids)) for w in words] for words in [*toxic, *ordinary]]
    text = np.repeat(np.arange(len(places)), [len(p) for p in places])
    word = np.array([i for p in places for i in p], np.int64)
    known, n_toxic = list(ids), int(np.searchsorted(text, len(toxic)))
    around = np.unique(np.concatenate([[-1], word[:-1]])[:n_toxic] * len(known) + np.append(word[1:], -1)[:n_toxic], return_inverse=True)[1]
    tried, looked = 0, []
    for n in range(BEGINNING[0], BEGINNING[1] + 1):
        seen: dict[str, int] = {"": 0}
        first = np.array([seen.setdefault(w[:n], len(seen)) if len(w) >= n else 0 for w in known], np.int64)
        at = first[word]
        a, b = (_documents(at[s], text[s], len(seen)) for s in (slice(0, n_toxic), slice(n_toxic, None)))
        a[0] = 0
        tried += int((a >= MIN_DOCUMENTS).sum())
        maybe = np.flatnonzero((a >= MIN_DOCUMENTS) & (b * share <= MAX_RATIO * a * (1 - share)))
        use = np.flatnonzero(np.isin(at[:n_toxic], maybe))
        looked.append((first, maybe, a[maybe], b[maybe], _documents(at[use], around[use], len(seen))[maybe]))
    out = np.zeros(len(known), bool)
    for first, maybe, a, b, seen in looked:
        good = maybe[_telling(a.tolist(), b.tolist(), seen.tolist(), share, tried)]
        out |= np.isin(first, good)
    return {w for w, good in zip(known, out.tolist()) if good}


def _telling_sequences(n: int, toxic: list[str], ordinary: list[str], share: float) -> list[set[int]]:
    """For each toxic text: the places of the words at which a telling sequence of n words begins."""
    t, o = words_of(pa.array(toxic, pa.string())), words_of(pa.array(ordinary, pa.string()))
    grams = lambda w: (w.grams(n)[w.whole(n)], w.text_of[w.whole(n)])
    (g, text), (other, other_text) = grams(t), grams(o)
    known, which = np.unique(g, return_inverse=True)
    a = _documents(which, text, len(known))
    at = np.minimum(np.searchsorted(known, other), max(0, len(known) - 1))
    same = known[at] == other if len(known) else np.zeros(len(other), bool)
    b = _documents(at[same], other_text[same], len(known))
    h = np.concatenate([np.zeros(1, np.uint64), t.hashes(), np.zeros(n + 1, np.uint64)])
    place = np.flatnonzero(t.whole(n))
    around = mix(h[place]) ^ h[place + n + 1]  # the words before and behind
    seen = _documents(which, np.unique(around, return_inverse=True)[1], len(known))
    good = _telling(a.tolist(), b.tolist(), seen.tolist(), share, max(1, int((a >= MIN_DOCUMENTS).sum())))
    out: list[set[int]] = [set() for _ in toxic]
    hit = good[which] if len(which) else np.zeros(0, bool)
    for i, p in zip(text[hit].tolist(), (place - t.first[text])[hit].tolist()):
        out[i].add(p)
    return out


def telling_windows(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The words of toxic texts that lie under telling features, as windows of words that follow one another."""
    share = len(toxic) / max(1, len(toxic) + len(ordinary))
    toxic, ordinary = ([t.lower() for t in x] for x in (toxic, ordinary))
    split = [[w.decode() for w in _words(t)] for t in toxic]
    words = _telling_words(split, [[w.decode() for w in _words(t)] for t in ordinary], share)
    covered = [{i for i, w in enumerate(x) if w in words} for x in split]
    for n in SEQUENCES:
        for c, places in zip(covered, _telling_sequences(n, toxic, ordinary, share)):
            c.update(p + k for p in places for k in range(n))
    out = []
    for words, c in zip(split, covered):
        run: list[str] = []
        for i in sorted(c):
            if run and i - 1 not in c:
                out.append(run)
                run = []
            run = [*run, words[i]]
        out += [run] if run else []
    return [f" {' '.join(r)} ".encode() for r in out]


def trained(size: int, windows: list[bytes], trainer: dict) -> bytes:
    """A dictionary by zstandard's trainer; the windows themselves where they are too few for it."""
    try:
        return zstd.train_dictionary(size, windows, **trainer).as_bytes()
    except zstd.ZstdError:
        return b"".join(windows)[-size:]


@dataclass
class Model:
    """evidence: for each number of bytes below SAVINGS, the log of how much more frequent savings from it on are in toxic
    text; 0 below the threshold."""

    ordinary: bytes
    toxic: bytes
    evidence: list[float] = field(default_factory=lambda: [0.0] * SAVINGS)
    weights: list[float] = field(default_factory=lambda: [0.0] * 5)

    def saving(self):
        """window -> the bytes that it saves with the toxic dictionary."""
        params = zstd.ZstdCompressionParameters(compression_level=3, window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=4, strategy=zstd.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False)
        both = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = zstd.ZstdCompressionDict(content.rjust(8, b"-"), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            both.append(zstd.ZstdCompressor(dict_data=d, compression_params=params).compress)
        plain, other = both
        return lambda window: len(plain(window)) - len(other(window))

    def savings(self):
        """words -> the bytes that each window saves."""
        saving = self.saving()
        return lambda words: list(map(saving, windows_of(words)))

    def features(self, saved: list[int]) -> list[float]:
        told = [self.evidence[min(d, SAVINGS - 1)] for d in saved if d > 0]
        n, total = len(saved), sum(told)
        return [1.0, math.log1p(total), math.log1p(n), total / max(1, n), max(told, default=0.0)]

    def score(self, saved: list[int]) -> float:
        z = sum(x * w for x, w in zip(self.features(saved), self.weights))
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def _causes(saving, words: list[bytes]) -> Iterator[bytes]:
    """The words without which their window saves less."""
    for i in range(0, len(words), WINDOW_WORDS):
        part = words[i : i + WINDOW_WORDS]
        saved = saving(b" %b " % b" ".join(part))
        if saved > 0:
            yield from (b" %b " % w for k, w in enumerate(part) if saving(b" %b " % b" ".join(part[:k] + part[k + 1 :])) < saved)


def _evidence(saved: list[list[int]], y: np.ndarray) -> list[float]:
    counts = np.stack([np.bincount(np.clip([d for s, v in zip(saved, y) if v == c for d in s], 0, SAVINGS - 1).astype(int), minlength=SAVINGS) for c in (0, 1)])
    above = counts[:, ::-1].cumsum(1)[:, ::-1] + 0.5
    told = np.log((above[1] / counts[1].sum()) / (above[0] / counts[0].sum()))
    told[0] = 0.0
    told = np.maximum.accumulate(np.maximum(told, 0.0))  # a larger saving tells no less
    return np.where(told >= math.log(MIN_TELLING), told, 0.0).tolist()


def train(sample: list[tuple[str, int]], share_of_toxic: float | None = None) -> Model:
    """sample: (text, 1 if toxic), in an order that doesn't depend on the labels. share_of_toxic: among all labelled rows, if
    the sample's is another; scores are set right for it. Without texts of both classes, or anything that tells them apart,
    every score is the share of class 1."""
    share = sum(y for _, y in sample) / max(1, len(sample))
    place = Counter()
    fit: dict[int, list[str]] = {0: [], 1: []}
    kept = []
    for t, y in sample:  # a fixed part of each class calibrates
        place[y] += 1
        if place[y] % CALIBRATED:
            fit[int(y)].append(t)
        else:
            kept.append((t, y))
    telling = telling_windows(fit[1], fit[0]) if fit[0] and fit[1] else []
    usual = [w for t in fit[0] for w in windows_of(_words(t), stride=WINDOW_WORDS)]
    usual = usual[:: -(-len(usual) // ORDINARY_WINDOWS) or 1]
    model = Model(trained(ORDINARY_BYTES, usual, ORDINARY_TRAINER), trained(OWN_BYTES, telling, OWN_TRAINER))
    saving = model.saving()
    causes = [w for t in fit[0] for w in _causes(saving, _words(t))]
    model.ordinary = trained(OWN_BYTES, causes, OWN_TRAINER) + model.ordinary
    y = np.array([y for _, y in kept], float)
    if not telling or not 0 < y.sum() < len(y):
        model.weights = [float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0, 0.0, 0.0, 0.0]
        return model
    savings = model.savings()
    saved = [savings(_words(t)) for t, _ in kept]
    model.evidence = _evidence(saved, y)
    x = np.array([model.features(s) for s in saved])
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of a logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
        w += np.clip(step, -3, 3)
    if share_of_toxic and share_of_toxic < 1:
        w[0] += np.log(share_of_toxic / (1 - share_of_toxic)) - np.log(y.mean() / (1 - y.mean()))
    model.weights = [float(v) for v in w]
    return model


def _score(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    savings = model.savings()
    for batch in batches:
        for rows in text_slices(batch, "text"):
            scores = [float(model.score(savings(_words(t or "")))) for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(scores, pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, however long. A null or empty text has no windows and gets the score
    of none; so do texts of white space. Repeated rows are scored each, and equal texts alike; a null doc_id stays null; an
    empty table gives no rows; other columns, whatever their names, are left out."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(model, it), "doc_id long, score double")
