"""Each stage of the pipeline against a brute-force version, on the whole smallest table."""

import os
import struct
from collections import defaultdict

import pytest

import corpus_pipeline as P
from readloom.llm import queries as Q, secret_scan as S
from test_documents import linked, shingles

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    stage = dict(P.STAGES)

    kept = P.written(stage["quality"](spark, docs, DATA), "quality")
    assert kept.columns == columns
    chosen = {r.doc_id for r in Q.op8_quality(spark, DATA).collect() if r.kept}
    before, now = rows_of(docs), rows_of(kept)
    assert set(now) == chosen and all(now[i] == before[i] for i in now)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    assert sum(r.doc_id in now for r in labels if r.quality) >= 0.97 * sum(r.quality for r in labels)
    assert sum(r.doc_id in now for r in labels if not r.quality) <= 0.2 * sum(1 - r.quality for r in labels)

    single = P.written(stage["near_duplicates"](spark, kept, DATA), "near")
    assert single.columns == columns
    roots = linked([(i, r.text) for i, r in now.items()])
    before, now = now, rows_of(single)
    assert set(now) == {i for i, root in roots.items() if i == root} and all(now[i] == before[i] for i in now)

    clean = P.written(stage["decontamination"](spark, single, DATA), "clean")
    assert clean.columns == columns
    items = [s for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if (s := shingles(r.text))]
    before, now = now, rows_of(clean)
    assert set(now) == {i for i, r in before.items() if not any(100 * len(q & shingles(r.text)) >= 75 * len(q) for q in items)} and all(now[i] == before[i] for i in now)

    masked = P.written(stage["secrets"](spark, clean, DATA), "masked")
    assert masked.columns == columns
    before, now = now, rows_of(masked)
    for i, r in before.items():
        spans = [(a, b) for _, a, b in S.scan_text(r.text)[1]]
        text = S.redacted(r.text, spans, "[SECRET]") if spans else r.text
        assert now[i] == r.__class__(**{**r.asDict(), "text": text, "n_chars": len(text)})
    assert set(now) == set(before)

    t = tokenizers.Tokenizer.from_file(Q.tokenizer_path())
    parts = defaultdict(list)
    for r in stage["packing"](spark, masked, DATA).collect():
        parts[r.doc_id].append((r.start, struct.unpack(f"<{r.length}I", r.tokens)))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in parts.items()} == {i: t.encode(r.text, add_special_tokens=False).ids + [1] for i, r in now.items()}
    assert {r.doc_id for r in P.run(spark, DATA).collect()} == set(now)
