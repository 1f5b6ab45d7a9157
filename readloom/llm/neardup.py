"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Each document's set of 5-word shingles gives a set hash, PERMUTATIONS minima, their packed low bits and band keys.
2. Documents with equal sets form a class; only its smallest document goes on.
3. Band keys with DENSE members or more join their members to families. A family is dealt into blocks, and each pair of
   blocks is a group whose documents are all compared exactly, by their shingles; a group returns at most as many links
   as it has documents, as only components matter.
4. Other band keys have few members. Each document proposes a link to the smallest member that it meets most often; then,
   in keys whose members are still in different components, all pairs across components are proposed. Proposals that
   sizes or low bits rule out are dropped and the rest are confirmed on the full sets.

Partial sums find frequent keys; no key is gathered in one task, and no pairs of a family are ever written out as rows. A
family whose n members are alike, but not alike enough to be linked, costs n * n comparisons, spread over its groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from readloom.llm.components import components
from readloom.llm.shared import text_slices, written
from readloom.llm.words import mix, words_of

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4  # a pair at 0.75 shares no band once in 190,000 times
PERMUTATIONS = BANDS * ROWS
BITS = 2
#: Equal low bits out of PERMUTATIONS that a pair must have: 4.5 deviations below the 104 expected at 0.75.
LEAST_EQUAL = 84
FILTER_BITS = 1 << 23
DENSE = 16
BLOCK_DOCS, BLOCK_SHINGLES = 128, 500_000
PAIRS_PER_GROUP = 64
FAMILY_SALTS = 16  # a family has DENSE members at least, so its copied counts are no more rows than they
SALTS = 64  # into which a frequent key's rows are dealt before they are joined with what is known of it

_random = np.random.Generator(np.random.PCG64(7_001))
_FACTORS = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array | pa.ChunkedArray, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles of lower-cased words; of a text with fewer words, the sequence."""
    w = words_of(texts, lower=True)
    h = w.hashes()
    grams = w.grams(n, h)
    short = [None, *(w.grams(k, h) ^ np.uint64(k) for k in range(1, n))]
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(short[b - a][a : a + 1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_FEATURES = "doc_id long, n_shingles long, h1 long, h2 long, low array<long>, high array<long>, bands array<long>"


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of PERMUTATIONS bits as longs."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch, "text", 2 << 20):
            sets = shingle_sets(rows.column("text"))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            n = len(sets)
            h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            minima = np.zeros((n, PERMUTATIONS), np.uint64)
            if len(full):
                all_hashes = np.concatenate(sets)
                starts = (np.cumsum(sizes) - sizes)[full]
                h1[full] = np.add.reduceat(mix(all_hashes), starts)
                h2[full] = np.bitwise_xor.reduceat(mix(all_hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
                for k in range(PERMUTATIONS):
                    minima[full, k] = np.minimum.reduceat(all_hashes * _FACTORS[k], starts)
            minima = mix(minima)
            low, high = (_packed(((minima >> np.uint64(s)) & np.uint64(1)).astype(np.uint8)) for s in (0, 1))
            bands = mix((minima.reshape(n, BANDS, ROWS) * _BAND).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists(low), lists(high), lists(bands)], ["doc_id", "n_shingles", "h1", "h2", "low", "high", "bands"])


def equal_bits(low: str, high: str, low2: str, high2: str):
    """In how many places the packed low bits of two documents agree."""
    words = [f"bit_count(({low}[{i}] ^ {low2}[{i}]) | ({high}[{i}] ^ {high2}[{i}]))" for i in range(PERMUTATIONS // 64)]
    return F.expr(f"{PERMUTATIONS} - ({' + '.join(words)})")


def estimated_similarity(equal):
    """Corrected for values whose low bits agree by chance."""
    by_chance = 0.5**BITS
    return (equal / PERMUTATIONS - by_chance) / (1 - by_chance)


def _confirm(percent: int, members: pa.Table, centre: pa.Table) -> pa.Table:
    kept = []
    if members.num_rows and centre.num_rows:
        owns, at = shingle_sets(centre.column("own")), 0
        for part in text_slices(members, "text", 2 << 20):
            for s in shingle_sets(part.column("text")):
                shared = [(own, len(np.intersect1d(own, s, assume_unique=True))) for own in owns]
                if any(n and 100 * n >= percent * (len(own) + len(s) - n) for own, n in shared):
                    kept.append(at)
                at += 1
    rows = members.take(pa.array(kept, pa.int64())) if members.num_rows else members
    return rows.select(["u", "v"]).rename_columns(["a", "b"])


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs with the columns of both members (_u, _v), those that sizes and low bits don't rule out."""
    sizes = F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent
    return pairs.filter(sizes & (equal_bits("low_u", "high_u", "low_v", "high_v") >= LEAST_EQUAL))


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ids, and some more: by a filter of FILTER_BITS bits, which is broadcast."""
    place = lambda d: d.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("place"))
    bits = place(ids).groupBy(F.floor(F.col("place") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bits"))
    at = F.col("place") % 32768
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = place(rows).withColumn("bucket", F.floor(F.col("place") / 32768)).join(F.broadcast(bits), "bucket")
    return joined.filter(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0).select(*rows.columns)


def _linked_blocks(percent: int, docs: pa.Table) -> pa.Table:
    """A forest of the links between the documents of two blocks, or within one. Every pair is compared exactly."""
    ids, left = docs.column("doc_id").to_numpy(), docs.column("left").to_numpy(zero_copy_only=False)
    sets = [x for part in text_slices(docs, "text", 2 << 20) for x in shingle_sets(part.column("text"))]
    rows, columns = np.flatnonzero(left), np.flatnonzero(~left)
    columns = columns if len(columns) else rows
    rows = [r for r in rows if len(sets[r])]
    columns = np.array([c for c in columns if len(sets[c])], np.int64)
    parent = list(range(len(sets)))
    edges: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(rows) and len(columns):
        sizes = np.array([len(x) for x in sets], np.int64)
        known, which = np.unique(np.concatenate(sets), return_inverse=True)
        places = np.split(which, np.cumsum(sizes)[:-1])
        flat = np.concatenate([places[c] for c in columns])
        starts = np.cumsum(sizes[columns]) - sizes[columns]
        mark = np.zeros(len(known), np.int32)
        for r in rows:
            mark[places[r]] = 1
            shared = np.add.reduceat(mark[flat], starts)
            mark[places[r]] = 0
            for c in columns[100 * shared >= percent * (sizes[r] + sizes[columns] - shared)].tolist():
                a, b = root(int(r)), root(c)
                if a != b:
                    parent[b] = a
                    edges.append((int(r), c))
    a, b = (ids[[e[k] for e in edges]] if edges else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table([pa.array(a), pa.array(b)], ["a", "b"])


def _family_links(keys: DataFrame, sizes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """keys: band, rep. The links within families of dense band keys, as edges a, b."""
    dense = keys.groupBy("band").agg(F.min("rep").alias("u"), F.count("*").alias("n")).filter(F.col("n") >= DENSE).select("band", "u")
    families = components(keys.join(dense, "band").filter("rep > u").select(F.col("u").alias("a"), F.col("rep").alias("b")))
    families = families.unionAll(families.select(F.col("root").alias("node"), "root").distinct())
    members = families.withColumnRenamed("node", "rep").join(sizes, "rep")
    counts = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(FAMILY_SALTS)).cast("int"))  # a family may be large
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(FAMILY_SALTS - 1))))
    members = written(salted.join(counts, ["root", "salt"]).select(F.col("rep").alias("doc_id"), "root", "blocks", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block")).distinct(), "families")
    found = written(_among(texts, members.select("doc_id")).join(members, "doc_id"), "texts")
    dealt = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    dealt = dealt.select("root", *pair, (F.col("block") <= F.col("other")).alias("left"), "doc_id", "text")
    return dealt.groupBy("root", "i", "j").applyInArrow(lambda d: _linked_blocks(percent, d), "a long, b long")


def _parted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (u, v), which are read twice, with the column part: a frequent u is split into parts of about PAIRS_PER_GROUP.
    And u and parts of the frequent ones."""
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS_PER_GROUP).cast("int").alias("parts"))
    many = written(many.filter("parts > 1"), "many")
    salt, salts = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(SALTS)), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = pairs.withColumn("salt", salt.cast("int")).join(many.withColumn("salt", salts), ["u", "salt"], "left")
    part = F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int")
    return salted.select("u", "v", part.alias("part")), many


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v), those whose sets are similar, as edges a, b; by parts of u."""
    pairs, _ = _parted(pairs)
    needed = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    texts = written(_among(texts, needed), "texts")
    members = pairs.join(texts.withColumnRenamed("doc_id", "v"), "v")
    centres = pairs.select("u", "part").distinct().join(texts.withColumnRenamed("doc_id", "u"), "u")
    centres = centres.select(F.col("u").alias("centre"), F.col("part").alias("of"), F.col("text").alias("own"))
    return members.groupBy("u", "part").cogroup(centres.groupBy("centre", "of")).applyInArrow(lambda m, c: _confirm(percent, m, c), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id that links reach, for a link between any two documents with
    100 * shared shingles >= percent * all their shingles.

    Null and empty texts and texts of white space have no shingles and no links. Rows that share a doc_id are one document
    with several sets: a link of any is a link of all. A row without doc_id keeps a null component_id. Other columns are
    left out. percent is PERCENT at least, as the bands and LEAST_EQUAL are set for that and would lose links below.
    """
    if percent < PERCENT:
        raise ValueError(f"percent is below {PERCENT}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    features = written(rows.mapInArrow(_features, _FEATURES), "features")
    known = features.filter("doc_id is not null and n_shingles > 0")
    first = F.min(F.struct("doc_id", "low", "high", "bands")).alias("first")
    classes = written(known.groupBy("h1", "h2", "n_shingles").agg(first, F.count("*").alias("members")), "classes")
    reps = classes.select(F.col("first.doc_id").alias("rep"), F.col("n_shingles").alias("n"), "first.low", "first.high", "first.bands")
    classes = classes.select("h1", "h2", "n_shingles", F.col("first.doc_id").alias("rep"), "members")
    several = known.groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a < b").select("doc_id")
    bridges = known.join(several, "doc_id").join(classes, ["h1", "h2", "n_shingles"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    texts = rows.filter("doc_id is not null")

    def side(frame: DataFrame, x: str) -> DataFrame:
        return frame.select(*[F.col(c).alias(c if c == "band" else x if c == "rep" else f"{c}_{x}") for c in frame.columns])

    def links_of(pairs: DataFrame) -> DataFrame | None:
        proposed = written(pairs.select("u", "v").distinct(), "pairs")
        if proposed.isEmpty():
            return None
        links = written(confirmed(proposed, texts, percent), "links")
        return None if links.isEmpty() else links

    bits = reps.drop("bands")
    keys = reps.select(F.explode("bands").alias("band"), "rep")
    dense = written(_family_links(keys, reps.select("rep", "n"), texts, percent), "links")
    edges = written(bridges.unionAll(dense), "edges")

    firsts = keys.groupBy("band").agg(F.min("rep").alias("u"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") < DENSE)).select("band", "u")
    met = keys.join(firsts, "band").filter("rep > u").groupBy(F.col("rep").alias("v"), "u").agg(F.count("*").alias("n"))
    best = met.groupBy("v").agg(F.max_by("u", F.struct("n", -F.col("u"))).alias("u"))
    best, many = _parted(written(best, "best"))  # u's bits go to each of its parts
    parts = side(bits, "u").join(many, "u", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    found = links_of(_possible(best.join(parts, ["u", "part"]).join(side(bits, "v"), "v"), percent))
    edges = edges if found is None else written(edges.unionAll(found), "edges")

    rooted = reps.join(components(edges).withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = written(rooted, "rooted")
    placed = rooted.select(F.explode("bands").alias("band"), "rep", "root")
    divided = placed.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("n")).filter((F.col("r1") < F.col("r2")) & (F.col("n") < DENSE)).select("band")
    members = placed.join(divided, "band").select("band", "rep").join(rooted, "rep")
    pairs = _possible(side(members, "u").join(side(members, "v"), "band").filter("u < v and root_u <> root_v"), percent)
    found = links_of(pairs.filter(F.col("band") == F.array_intersect("bands_u", "bands_v")[0]))
    edges = edges if found is None else written(edges.unionAll(found), "edges")
    roots = components(edges)
    reached = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").filter((F.col("members") > 1) | F.col("root").isNotNull())
    reached = written(reached.select("h1", "h2", "n_shingles", F.coalesce("root", "rep").alias("component_id")), "reached")
    linked = features.select("doc_id", "n_shingles", "h1", "h2").join(reached, ["h1", "h2", "n_shingles"], "left")
    return linked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id"))).alias("component_id"))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id. Rows without doc_id, null and empty texts stay, as
    they are linked with nothing, and texts of any length are compared whole. Of rows that share a doc_id, the one with the
    smallest text stays (then the smallest by all columns as JSON), so reruns agree. An empty table stays empty; all columns
    stay, whatever their names."""
    ids = near_duplicates(docs, percent).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(ids, "doc_id", "left_semi")
    repeated = written(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter(F.col("rows") > 1).select("doc_id"), "repeated")
    if not repeated.isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        first = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row of the smallest text")).select("row of the smallest text.*")
        kept = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionAll(first)
    return kept.select(*docs.columns).unionAll(docs.filter("doc_id is null"))
