"""Packing, repeated passages, near duplicates, decontamination: against brute force on small fixtures."""

import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

from readloom.llm import components, decontam, neardup, packing, queries as Q, substring, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, block int, place long, tokens string"


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, 2, "clash") for i, t in rows], DOCS).repartition(parts)


ODD = [(100, None), (101, ""), (102, " \n\t "), (103, "one two"), (104, "é\x0bè\U0001f600 x\x1cy \xa0z"), (105, "w" * 100_000 + " end"), (106, "a " * 30_000)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("aBÀé\U0001f600 \n\t\x0b\x1c\xa0")), max_size=30)), max_size=8))
def test_words(texts):
    w = words.words_of(pa.array(texts, pa.string()))
    found = [[w.buf[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert found == [WORD.findall(t or "") for t in texts]
    flat = [x for ws in found for x in ws]
    assert len(set(w.hashes().tolist())) == len(set(flat))
    sliced = words.words_of(pa.array(["zz", *texts], pa.string()).slice(1))
    assert (sliced.hashes() == w.hashes()).all()


def test_word_hashes_do_not_depend_on_blocks():
    texts = ["abc " * 400_000, "x" * 70_000 + " abc", "abc"]
    w = words.words_of(pa.array(texts))
    h = w.hashes()
    assert len(set(h[:400_000].tolist())) == 1 and h[-1] == h[0] == h[-2]
    assert words.words_of(pa.array([texts[1]])).hashes()[0] == h[400_000]


# --- packing ---


@pytest.fixture(scope="module")
def tokens():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(Q.tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def test_packing(spark, tokens):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "Éa", "don't", "12 3", " x", "\n\n", "<|endoftext|>"]) for _ in range(rng.randrange(400)))) for i in range(60)] + ODD[:6] + [(None, "no id")]
    pieces = packing.pack(documents(spark, rows), Q.tokenizer_path(), 64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = struct.unpack(f"<{r.length}I", r.tokens)
        by_doc[r.doc_id].append((r.start, ids, r.doc_tokens))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, text in rows:
        expected = tokens(text)
        joined = [x for _, ids, _ in sorted(by_doc[i]) for x in ids]
        assert joined == expected and all(n == len(expected) for _, _, n in by_doc[i])
    assert sorted(by_seq) == list(range(len(by_seq)))
    for seq, parts in by_seq.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 64 or seq == max(by_seq))


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x <|endoftext", "\x1c" * 5000, " " * 3_000_000, "\n" * 3_000_000, "a" * 3_000_000, "x " + "\n" * 1_000_000 + "y  z" + " " * 5000 + "é", "one two " * 3 + "ab" * 3000 + " three\t\tfour", "é" * 5000 + "  <|endoftext|>" + "1" * 5000, "=" * 300_000 + "\u3000" * 5000 + "x"])
def test_encoder_is_the_tokenizer(tokens, text):
    encode, width = packing.encoder(Q.tokenizer_path())
    assert np.frombuffer(encode(text), width).tolist() == tokens(text)[:-1]


def test_encoder_with_long_runs(tokens):
    """What the library encodes is cut where tiktoken's pieces begin."""
    encode, width = packing.encoder(Q.tokenizer_path())

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from(list("aé1 \n\t\u3000'.s\x1c\xa0\U0001f600")), max_size=60))
    def check(text):
        text = text + "b" * 5000 + text + " " * 5000 + text
        assert np.frombuffer(encode(text), width).tolist() == tokens(text)[:-1]

    check()


def test_packing_query(spark, tokens, tmp_path):
    """The query's pieces against the tokenizer as it is loaded, with long runs and strings of added tokens."""
    texts = ["a<|endoftext|>b", "\n" * 1_200_000, " " * 700_000 + "x", None, "", "plain words " * 500, "<|endoftext|>", "plain words " * 500]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "tokens": ["clash"] * len(texts)}), f"{tmp_path}/documents.parquet")
    parts = defaultdict(list)
    by_seq = defaultdict(list)
    for r in Q.op1_packing(spark, str(tmp_path)).collect():
        parts[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids, at = tokens(text), 0
        for r in sorted(parts[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert sum(n for p in by_seq.values() for _, n in p) > 2047 * (len(by_seq) - 1)


def test_sequences(spark):
    rows = [(i, "word " * i) for i in range(30)]
    pieces = packing.pack(documents(spark, rows), Q.tokenizer_path(), 32)
    got = sorted(packing.sequences(pieces, 32).collect())
    joined = b"".join(p.tokens for p in sorted(pieces.collect(), key=lambda p: (p.sequence_id, p.offset)))
    assert b"".join(s.tokens for s in got) == joined and all(s.n_tokens == 32 == s.padded_tokens for s in got[:-1])
    assert sum(len(s.pieces) for s in got) == pieces.count()


def test_packing_nothing(spark):
    assert packing.pack(documents(spark, []), Q.tokenizer_path()).count() == 0


# --- repeated passages ---


def kept_words(rows, n=substring.WINDOW):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(1 << 63), r[1] or "")):
        w = WORD.findall(text or "")
        gone = set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            gone.update(range(k, k + n)) if key in seen else seen.add(key)
        out.setdefault(i, []).append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_cover():
    for d in range(substring.PERIOD):
        assert any((a - b) % substring.PERIOD == d for a in substring.COVER for b in substring.COVER)


@pytest.mark.parametrize("seed", range(4))
def test_substring(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3 if seed == 3 else 300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(5))]
        rows.append((i * 3 + 1000, rng.choice([" ", "\n", "  "]).join(x for p in parts for x in p)))
    rows += ODD + [(5000, rows[5][1]), (5001, rows[5][1]), (-5, rows[6][1])]
    got = substring.remove_repeats(documents(spark, rows)).collect()
    assert {r.doc_id: [(r.n_words, r.n_removed, r.kept_text)] for r in got} == kept_words(rows) and len(got) == len(rows)


def test_substring_ties_and_nothing(spark):
    text = " ".join(f"t{k}" for k in range(40))
    rows = [(7, text), (7, text), (None, text)]
    got = sorted((r.n_words, r.n_removed) for r in substring.remove_repeats(documents(spark, rows)).collect())
    assert got == [(40, 0), (40, 40), (40, 40)]
    assert substring.remove_repeats(documents(spark, [])).count() == 0


# --- near duplicates ---


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def edited(rng, text, share):
    w = text.split(" ")
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("copies,share", [(3, 0.02), (40, 0.02), (60, 0.045)])
def test_near_duplicates(spark, copies, share):
    rng = random.Random(copies)
    rows = []
    for base in range(8):
        text = " ".join(f"b{rng.randrange(500)}" for _ in range(rng.randrange(20, 120)))
        rows += [(rng.randrange(10**6), edited(rng, text, share * rng.random() * 2) if k else text.upper()) for k in range(copies)]
    rows += ODD + [(300, "A b"), (301, "a B"), (302, "a b c"), (303, rows[0][1])]
    got = neardup.near_duplicates(documents(spark, rows)).collect()
    expected = linked(rows)
    assert {r.doc_id: r.component_id for r in got} == expected and len(got) == len(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}


def test_near_duplicates_of_repeated_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(5, a), (5, b), (3, a), (9, b), (None, a), (6, None)]
    got = neardup.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (3, 3), (5, 3), (5, 3), (6, 6), (9, 3)]
    kept = neardup.without_near_duplicates(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 6]
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    assert neardup.without_near_duplicates(documents(spark, [])).count() == 0
    rows = [(7, "x " * 9), (7, "a lone text of an id that has two"), (7, None), (8, None), (9, "")]
    for parts in (1, 3):
        kept = neardup.without_near_duplicates(documents(spark, rows, parts)).collect()
        assert sorted((r.doc_id, r.text or "") for r in kept) == [(7, ""), (8, ""), (9, "")] and all(r.tokens == "clash" for r in kept)


def test_estimate():
    assert neardup.estimated_similarity(128) == 1 and abs(neardup.estimated_similarity(32)) < 1e-9


def test_components(spark):
    edges = [(1000 + k, 5000) for k in range(300)] + [(5000, 4000)] + [(2000, 2001 + k) for k in range(200)]  # hubs with large and small ids
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{1000 + k: 1000 for k in range(1, 300)}, 5000: 1000, 4000: 1000, **{2001 + k: 2000 for k in range(200)}}
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (103, 101), (7, 7), (101, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 31)}, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination ---


@pytest.mark.parametrize("block", [10**9, 500])
def test_decontamination(spark, block):
    rng = random.Random(3)
    items = [(k, " ".join(f"q{rng.randrange(200)}" for _ in range(n))) for k, n in enumerate([2, 4, 5, 6, 9, 20, 40, 80, 300])] + [(50, None), (51, " ")]
    rows = []
    for i in range(120):
        inside = edited(rng, rng.choice(items)[1] or "", rng.choice([0, 0.03, 0.06, 0.1]))
        rows.append((i, (" ".join(f"d{rng.randrange(300)}" for _ in range(rng.choice([0, 30, 3000]))) + " " + inside.upper()).strip()))
    rows += ODD + [(0, items[7][1])]
    table = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    expected = []
    for i, t in rows:
        s = shingles(t)
        for k, x in items:
            q = shingles(x)
            if q and 100 * len(q & s) >= 75 * len(q):
                expected.append((i, k, len(q & s), len(q)))
    got = [tuple(r) for r in decontam.find_items(documents(spark, rows), table, block_chars=block).collect()]
    assert sorted(got) == sorted(expected) and expected
    clean = decontam.remove_contaminated(documents(spark, rows), table, block_chars=block)
    assert len(clean.collect()) == len([1 for i, t in rows if not any(100 * len(shingles(x) & shingles(t)) >= 75 * len(shingles(x)) for _, x in items if shingles(x))])
    assert decontam.find_items(documents(spark, rows), table.filter("item_id = 50")).count() == 0


def test_least_hits():
    assert decontam.least_hits(20, 20, 75) == 15
    assert 5 <= decontam.least_hits(1000, 32, 75) <= 14


def test_item_partitions():
    """Sizes decide the share of the hash space, the sketch's size and the least hits; every contained item is a candidate."""
    assert [decontam.partition_of(n) for n in (1, 32, 33, 64, 65, 128, 129, 1000)] == [0, 0, 1, 1, 2, 2, 3, 5]
    rng = random.Random(8)
    items = [(k, " ".join(f"i{rng.randrange(10**6)}" for _ in range(n))) for k, n in enumerate([5, 30, 36, 37, 60, 70, 100, 200, 500, 900, 2000] * 3)]
    index = decontam.Index(items, 75)
    assert [int(p.halved) for p in index.partitions] == sorted({int(p.halved) for p in index.partitions}) and len(index.partitions) >= 5
    sizes = {int(p.halved): [sum(p.owner == i) for i in set(p.owner.tolist())] for p in index.partitions}
    assert all(max(s) <= 64 for s in sizes.values()) and all(min(s) >= 16 for h, s in sizes.items() if h)
    documents = [" ".join([*(f"d{rng.randrange(10**6)}" for _ in range(rng.randrange(3000))), t, "end"]) for _, t in items]
    found = index.contained(neardup.shingle_sets(pa.array(documents)))
    assert [(d, i) for d, i, _, _ in found] == [(k, k) for k in range(len(items))]


def test_digest_of_pieces():
    assert zlib.crc32(struct.pack("<2I", 7, 1)) == zlib.crc32(b"\x07\0\0\0\x01\0\0\0")


def test_near_duplicates_refuses_low_percent(spark):
    for find in (neardup.near_duplicates, neardup.without_near_duplicates):
        with pytest.raises(ValueError, match="percent"):
            find(documents(spark, [(1, "a b c d e f")]), percent=50)
