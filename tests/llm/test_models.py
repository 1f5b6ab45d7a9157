"""Toxicity, quality resampling, line rules: held-out accuracy on made-up labels, and exact base figures."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from readloom.llm import labelled, line_rules, quality, queries as Q, toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, score string, key int"
ODD = [(900, None), (901, ""), (902, " \n "), (903, "x" * 50_000), (904, "é\U0001f600 ñ")]


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)


def toxic_rows(rng, n):
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        w = prose(rng, rng.randrange(40, 200)).split()
        for _ in range(rng.randrange(2, 6) * y):
            w.insert(rng.randrange(len(w)), rng.choice(["grumble", "zounds", "blighter", "varlet"]))
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity(spark):
    rng = random.Random(5)
    rows = toxic_rows(rng, 700)
    model = toxicity.train([(t, y) for _, t, y in rows[:500]])
    got = {r.doc_id: r.score for r in toxicity.score(documents(spark, [(i, t) for i, t, _ in rows[500:]] + ODD), model).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows[500:]]
    assert np.mean(right) > 0.95 and len(got) == 205 and all(0 <= s <= 1 for s in got.values())
    assert got[900] == got[901] == got[902] < 0.5
    assert got[900] == model.score([]) and len(model.toxic) <= toxicity.OWN_BYTES and len(model.ordinary) <= toxicity.ORDINARY_BYTES + toxicity.OWN_BYTES


def test_toxic_phrases_of_ordinary_words(spark):
    """Every word is as frequent in ordinary texts; only their sequence is toxic."""
    rng = random.Random(12)
    phrases = ["go jump off there", "nobody ever wanted you", "your kind must leave"]
    words = sorted({w for p in phrases for w in p.split()})

    def text(y):
        w = prose(rng, rng.randrange(60, 150)).split()
        for _ in range(rng.randrange(2, 5)):
            if y:
                w.insert(rng.randrange(len(w)), rng.choice(phrases))
            else:
                for x in rng.sample(words, 4):
                    w.insert(rng.randrange(len(w)), x)
        return " ".join(w), y

    sample, held = ([text(i % 3 == 0) for i in range(n)] for n in (900, 300))
    model = toxicity.train([(t, int(y)) for t, y in sample])
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(documents(spark, [(i, t) for i, (t, _) in enumerate(held)]), model).collect()}
    assert np.mean([got[i] == y for i, (_, y) in enumerate(held)]) > 0.9


def test_toxicity_scores_by_brute_force(spark):
    """Windows are cut and compressed by plain means; with a saving's evidence and the weights they give the same score."""
    rng = random.Random(13)
    model = toxicity.train([(t, y) for _, t, y in toxic_rows(rng, 400)])
    rows = [(i, t) for i, t, _ in toxic_rows(rng, 40)] + ODD + [(905, "one two"), (906, " ".join(f"w{k}" for k in range(9))), (None, "a null id")]
    got = {r.doc_id: r.score for r in toxicity.score(documents(spark, rows), model).collect()}
    params = zstandard.ZstdCompressionParameters(compression_level=3, window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=4, strategy=zstandard.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(window))

    for i, t in rows:
        w = WORD.findall((t or "").lower())
        starts = [k for k in range(0, len(w), 6) if k == 0 or k + 2 < len(w)]
        windows = [f" {' '.join(w[k : k + 8])} ".encode() for k in starts]
        saved = [size(x, model.ordinary) - size(x, model.toxic + model.ordinary) for x in windows]
        told = [model.evidence[min(max(d, 0), 15)] for d in saved]
        x = [1, np.log1p(sum(told)), np.log1p(len(told)), sum(told) / max(1, len(told)), max(told, default=0)]
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))) < 1e-12, i


def test_toxicity_of_repeats_and_nothing(spark):
    model = toxicity.train([(t, y) for _, t, y in toxic_rows(random.Random(14), 300)])
    text = "you varlet " + prose(random.Random(15), 60)
    got = toxicity.score(documents(spark, [(1, text), (1, text), (2, text * 500), (None, text)]), model)
    assert got.columns == ["doc_id", "score"] and len({r.score for r in got.collect() if r.doc_id != 2}) == 1 and got.count() == 4
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_rare_and_minority_toxic_words():
    """A tenth of the toxic texts is in another language, with words that a third of those, 3 % of all, have."""
    rng = random.Random(6)

    def text(y, other):
        w = prose(rng, rng.randrange(40, 80)).split()
        w = [x.replace("e", "ü").replace("o", "ä") + "sz" for x in w] if other else w
        for x in rng.sample(["gazfick", "bolondvar", "hülyemag"], 1) if other else rng.sample(["grumble", "zounds", "blighter"], 2):
            for _ in range(2 * y):
                w.insert(rng.randrange(len(w)), x)
        return " ".join(w), y

    model = toxicity.train([text(y, i % 10 == 0) for y in (0, 1) for i in range(900)])
    savings = model.savings()
    for other in (False, True):
        scores = [(model.score(savings(toxicity._words(t))) >= 0.5, y) for t, y in (text(y, other) for y in (0, 1) for _ in range(100))]
        assert np.mean([p == y for p, y in scores]) > 0.95, other


def test_toxicity_without_classes(spark):
    for sample, least, most in (([], 0, 1), ([("a b c d e", 1)], 0.5, 1), ([("a b c d e", 0)], 0, 0.5)):
        s = toxicity.score(documents(spark, [(1, "anything")]), toxicity.train(sample)).first().score
        assert least <= s <= most


def junk(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return " | ".join(prose(rng, 1)[:-1] for _ in range(n))
    return " ".join([prose(rng, 1)[:-1]] * n) if kind == 1 else " ".join(w + "%%%" for w in prose(rng, n).split())


def quality_rows(rng, n):
    return [(i, prose(rng, rng.randrange(60, 150)) + "\n" + prose(rng, 60) if y else prose(rng, 5) + "\n" + junk(rng, rng.randrange(60, 150)), y) for i in range(n) for y in [int(rng.random() < 0.7)]]


def test_quality(spark):
    rng = random.Random(6)
    rows = quality_rows(rng, 600)
    docs = documents(spark, [(i, t) for i, t, _ in rows] + ODD)
    sample = [(t, y) for _, t, y in rows[:300]]
    got = {r.doc_id: r for r in quality.resample(docs, sample).collect()}
    assert np.mean([got[i].kept == bool(y) for i, _, y in rows]) > 0.97 and len(got) == 605
    assert got[900].log_weight == got[901].log_weight == 0
    top = {r.doc_id for r in quality.resample(docs, sample, k=50).collect() if r.kept}
    assert top == {r.doc_id for r in sorted(got.values(), key=lambda r: (-r.key, r.doc_id))[:50]}
    kept = quality.drawn_documents(docs, sample)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_gumbel_draws_follow_weights(spark):
    """Without models, all weights are equal: each half is drawn about equally often."""
    got = quality.resample(documents(spark, [(i, "same") for i in range(2000)]), [], k=1000).collect()
    kept = [r.doc_id for r in got if r.kept]
    assert len(kept) == 1000 and 400 < sum(i < 1000 for i in kept) < 600


@pytest.mark.parametrize("keys", [list(range(100)), [1.0] * 100, [0.0] * 60 + [5.0] * 40, [float(k % 7) for k in range(100)]])
def test_kth_largest(spark, keys, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 5)
    monkeypatch.setattr(quality, "BINS", 4)
    rows = spark.createDataFrame([(float(k), i) for i, k in enumerate(keys)], "key double, doc_id long")
    order = sorted((-float(k), i) for i, k in enumerate(keys))
    for k in (1, 3, 50, 100, 150):
        expected = order[min(k, 100) - 1]
        assert quality.kth_largest(rows, k) == (-expected[0], expected[1])
    assert quality.kth_largest(rows, 0) is None and quality.kth_largest(rows.filter("key > 1e9"), 3) is None


def test_quality_of_nothing(spark):
    assert quality.resample(documents(spark, []), [("a", 1), ("b", 0)]).count() == 0


# --- line rules ---


def base_figures(t):
    w = WORD.findall(t)
    grams = list(zip(w, w[1:], w[2:]))
    counts, covered, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_base_figures():
    rng = random.Random(7)
    texts = ["", "\n\n", "a", "a\0b c", "\0", "a\na\n a\na", "x y z x y z\nx y z", "é# ñ|\r\né# ñ|", "q\n"] + ["".join(rng.choice(["a ", "b\n", "c", "#", "\n", "é ", "\x0b"]) for _ in range(60)) for _ in range(200)]
    got = line_rules.lines_of(pa.chunked_array([pa.array(texts)])).base
    assert list(zip(*(got[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [base_figures(t) for t in texts]


def test_viterbi_and_gradient():
    rng = np.random.default_rng(8)
    sizes = [0, 1, 4, 3, 0, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(size=(sum(sizes), line_rules.FEATURES))
    field = line_rules.Field(rng.normal(size=(line_rules.FEATURES, 2)), rng.normal(size=(2, 2)))

    def score(a, b, labels):
        s = (x[a:b] @ field.emission)[range(b - a), labels].sum()
        return s + sum(field.transition[p, q] for p, q in zip(labels, labels[1:]))

    best = field.decode(x, first)
    y = rng.integers(0, 2, sum(sizes))

    def likelihood():
        total = 0.0
        for a, b in zip(first, first[1:]):
            if a < b:
                every = [[k >> i & 1 for i in range(b - a)] for k in range(1 << (b - a))]
                total += score(a, b, list(y[a:b])) - np.log(sum(np.exp(score(a, b, q)) for q in every))
        return total / sum(sizes)

    for a, b in zip(first, first[1:]):
        if a < b:
            assert list(best[a:b]) == max(([k >> i & 1 for i in range(b - a)] for k in range(1 << (b - a))), key=lambda q: score(a, b, q))
    emission, transition = field.gradient(x, first, y)
    for table, g in ((field.emission, emission), (field.transition, transition)):
        for at in [(0, 0), (1, 1)]:
            before = likelihood()
            table[at] += 1e-5
            assert abs((likelihood() - before) / 1e-5 - g[at]) < 1e-3
            table[at] -= 1e-5


def test_line_rules(spark):
    rng = random.Random(9)
    rows = quality_rows(rng, 500)
    field = line_rules.train([(t, y) for _, t, y in rows[:300]], steps=60, rounds=2)
    got = {r.doc_id: r for r in line_rules.judge(documents(spark, [(i, t) for i, t, _ in rows] + ODD), field).collect()}
    judged = [(got[i].kept, y) for i, _, y in rows[300:] if not got[i].base_failed]
    assert np.mean([k == bool(y) for k, y in judged]) > 0.95 and len(got) == 505
    for i, t, _ in rows:
        n, _, _, _, again = base_figures(t)
        assert got[i].base_failed == (n < 50 or 100 * again > 50 * n) and not (got[i].kept and got[i].base_failed)
    assert got[900].base_failed and got[900].n_words == 0 and not got[900].kept
    assert line_rules.judge(documents(spark, []), line_rules.train([])).count() == 0


def plain_features(t):
    """Each line with a word: its words and features, by their definitions."""
    counts, out, seen = Counter(), [], set()
    w = WORD.findall(t)
    counts.update(zip(w, w[1:], w[2:]))
    again = [any(0 <= i and counts[tuple(w[i : i + 3])] > 1 for i in (k - 2, k - 1, k) if i + 3 <= len(w)) for k in range(len(w))]
    at = 0
    for line in t.split("\n"):
        words = WORD.findall(line)
        if words:
            size, n = len(line.encode()), len(words)
            share = lambda chars, k: min(1, k * sum(c in chars for c in line) / size)  # noqa: B023, E731
            upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
            x = [1, share("#*$%&|<>", 4), share(upper, 2), share("|", 8), share("!", 8), share(digits, 2), sum(again[at : at + n]) / n, 1 - len(set(words)) / n, line in seen, line[-1] not in ".!?:;"]
            out.append((n, np.array(x, float)))
        seen.add(line)
        at += len(words)
    return out


def plain_share(field, t):
    """The share of words in lines that the best of all label sequences, by plain Viterbi, has as content."""
    lines = plain_features(t)
    if not lines:
        return 1.0
    best = [(list(lines[0][1] @ field.emission)[k], [k]) for k in (0, 1)]
    for _, x in lines[1:]:
        s = x @ field.emission
        best = [max(((best[p][0] + field.transition[p, k] + s[k], [*best[p][1], k]) for p in (0, 1)), key=lambda b: b[0]) for k in (0, 1)]
    labels = max(best, key=lambda b: b[0])[1]
    return sum(n for (n, _), y in zip(lines, labels) if y) / sum(n for n, _ in lines)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_line_rules_query(spark):
    """All columns of the query on its whole table: base figures by their definitions, verdicts by plain Viterbi."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    field = line_rules.train(labelled.labelled_sample(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"), "quality"))
    got = Q.op9_line_rules(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        figures = base_figures(texts[r.doc_id])
        failed = figures[0] < 50 or 100 * figures[4] > 50 * figures[0]
        share = plain_share(field, texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*figures, failed)
        assert abs(r.content_share - share) < 1e-9 and r.kept == (not failed and share >= field.least)


def test_labelled_sample(spark):
    docs = documents(spark, [(i, f"text {i % 50}") for i in range(100)] + ODD)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(900, 1), (901, 1), (903, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = labelled.labelled_sample(docs, labels, "toxic", per_class=20, where=F.col("doc_id") < 90)
    assert 0 < len(got) <= 40 and all(int(t.split()[1]) % 2 == y for t, y in got) and len({t for t, _ in got}) == len(got)
    repeated = documents(spark, [(1, f"copy {k}") for k in range(500)] + [(2, "b")])
    got = labelled.labelled_sample(repeated, spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, toxic int"), "toxic")
    assert sorted(got) == [("b", 0), ("copy 0", 1)]
