from collections import Counter

from hypothesis import HealthCheck, given, settings, strategies as st

from readloom.operators import match, neighbors
from readloom.plans.sheet import Sample, SheetError, build_sheet


def far(a, b):
    return sum(x != y for x, y in zip(a, b)) if all(c in "ACGTN" for c in a) else 99


def brute(seq, sheet, o):
    """row, mm by distances to all indexes, template by template."""
    n = len(sheet.samples)
    tried = []
    for e in sheet.catalogue:
        cut = lambda p: seq[len(seq) - p.offset : len(seq) - p.offset + p.length]
        t = e.template
        near = []
        for part, which in ((t.i7, 0), (t.i5, 1))[: 1 + e.dual]:
            d = {pair[which]: far(cut(part), pair[which]) for pair in e.pairs}
            least = min(d.values())
            near.append(([i for i in d if d[i] == least], least) if least <= o.mismatches else ([], 0))
        score = sum(x for _, x in near)
        hits = [row for (i7, i5), row in e.pairs.items() if i7 in near[0][0] and (not e.dual or i5 in near[1][0])]
        if hits and (not e.dual or score <= o.most):
            tried.append((score, e.rank, hits))
    if o.comprehensive:
        tried = [x for x in tried if x[0] == min(s for s, _, _ in tried)]
    else:
        tried = tried[:1]
    hits = [h for _, _, hs in tried for h in hs]
    return (hits[0], tried[0][0]) if len(hits) == 1 else (n + 1 if hits else n, 0)


words = st.text("ACGT", min_size=3, max_size=3)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(words, words, st.sampled_from(["i73:um1:i53", "i53:um1:i73", "i73:--4"])), min_size=1, max_size=8), st.integers(0, 2), st.booleans(), st.booleans(), st.booleans(), st.randoms(use_true_random=False))
def test_matches_brute_force(spark, rows, m, per_index, comprehensive, direct, rnd):
    try:
        sheet = build_sheet([Sample(i, f"s{i}", a, b, t) for i, (a, b, t) in enumerate(rows)])
    except SheetError:
        return
    o = match.MatchOptions(m, per_index, comprehensive, 0 if direct else 1_000_000)
    seqs = ["".join(rnd.choice("ACGTN") for _ in range(7)) for _ in range(60)] + ["AC", "acgtacg", "ACGTXCG"]
    seqs += [f"{a}A{b}" for a, b, _ in rows]
    got = match.assign(spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string"), sheet, o).collect()
    n = len(sheet.samples)
    for r in got:
        expected = brute(r.seq, sheet, o) if len(r.seq) >= 7 else (n, 0)
        assert (r.row_ix, r.mm) == expected, (r, rows, o)


def test_text_of_barcodes(spark):
    sheet = build_sheet([Sample(0, "a", "AAAA", "CCCC", "i74:um2:i54"), Sample(1, "b", "GGGG", "TTTT", "i74:um2:i54")])
    rows = match.assign(spark.createDataFrame([("xxAAATGGCCCC",), ("ACGTGGCCCC",), (None,)], "seq string"), sheet).collect()
    assert [(r.row_ix, r.mm, r.barcode, r.umi) for r in rows] == [(0, 1, "AAAT+CCCC", "GG"), (2, 0, "ACGT+CCCC", ""), (2, 0, None, "")]


def test_ambiguous_and_guard(spark):
    sheet = build_sheet([Sample(0, "a", "AAAA", template="i74"), Sample(1, "b", "AATT", template="i74")])
    out = match.assign(spark.createDataFrame([("AAAT",), ("AAAA",), ("GGGG",), ("GGGC",)], "seq string"), sheet)
    assert [(r.row_ix, r.mm) for r in out.collect()] == [(3, 0), (0, 0), (2, 0), (2, 0)]
    assert match.mostly_unassigned(out, sheet, 70, 4) and not match.mostly_unassigned(out, sheet)


def test_matching_has_no_shuffle(spark):
    sheet = build_sheet([Sample(0, "a", "AAAA", "CCCC", "i74:i54"), Sample(1, "b", "GGGG", "TTTT", "i74:i54")])
    out = match.assign(spark.range(10).selectExpr("concat(if(id % 2 = 0, 'AAAA', 'GGGN'), 'CCCC') as seq"), sheet)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "Python" not in plan


def test_neighborhood(spark):
    found = neighbors.neighborhood(spark.createDataFrame([("AAA",), ("AAT",)], "idx string"), 1).collect()
    expected = Counter()
    letters = "ACGTN"
    for v in (a + b + c for a in letters for b in letters for c in letters):
        d = {i: far(v, i) for i in ("AAA", "AAT")}
        least = min(d.values())
        expected.update((v, least, i) for i in d if d[i] == least <= 1)
    assert Counter((r.variant, r.mm, r.idx) for r in found) == expected
    assert neighbors.neighborhood_size([8], 2) == 481


def test_neighborhoods_built_both_ways(spark):
    rows = {"ACGT": [0], "ACGA": [1, 2], "TTTT": [3]}
    for m in (0, 1, 2, 3):
        by_job = neighbors.neighborhood_rows(spark.createDataFrame(sorted(rows.items()), "idx string, rows array<int>"), m)
        assert sorted((r.variant, r.mm, sorted(r.rows)) for r in by_job.collect()) == sorted((v, k, sorted(x)) for v, k, x in neighbors.nearest_rows(rows, m))
