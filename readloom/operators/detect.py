"""Detects templates: where the samples' indexes, forward or reverse-complemented, occur in the barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from readloom.functions.columns import barcode_slice
from readloom.plans.sheet import MISSING, Sample, reverse_complement
from readloom.plans.template import render_template


def occurrences(text: Column, word: Column) -> Column:
    """The 0-based places of word in text that a scan from the left finds without overlaps."""
    places = F.sequence(F.lit(1), F.length(text) - F.length(word) + 1)
    found = F.filter(places, lambda i: F.substring(text, i, F.length(word)) == word)
    start = F.array().cast("array<int>")
    apart = F.aggregate(found, start, lambda a, i: F.when((F.size(a) == 0) | (F.element_at(a, -1) + F.length(word) < i), F.array_append(a, i - 1)).otherwise(a))
    return F.when(F.length(text) >= F.length(word), apart).otherwise(start)


def index_table(samples: list[Sample]) -> list[tuple]:
    """row_ix and the two indexes of each sample in each orientation, with the flags."""
    out = []
    for s in samples:
        dual = s.i5 != MISSING
        for rc7 in (0, 1):
            for rc5 in (0, 1) if dual else (None,):
                i5 = None if rc5 is None else reverse_complement(s.i5) if rc5 else s.i5
                out.append((s.row, reverse_complement(s.i7) if rc7 else s.i7, i5, rc7, rc5))
    return out


def layout_counts(reads: DataFrame, indexes: DataFrame, barcode_length: int) -> DataFrame:
    """reads: seq. indexes: row_ix, i7, i5 (null for one index), rc7, rc5; a sheet's size, times four. Returns row_ix, layout
    (places7[:place5]_rc7:rc5) and n. Two indexes count only where they don't overlap. The first index is found by an
    equi-join of the barcode's slices, of the lengths that the indexes have; only its hits are searched for the second."""
    barcodes = reads.filter(F.length("seq") >= barcode_length).select(barcode_slice("seq", barcode_length).alias("bc"))
    lengths = sorted(r[0] for r in indexes.select(F.length("i7")).distinct().collect() if r[0] <= barcode_length)
    if not lengths:
        lengths = [barcode_length]
    places = [F.struct(F.lit(p).alias("p7"), F.lit(n).alias("n7")) for n in lengths for p in range(barcode_length - n + 1)]
    sliced = barcodes.select("bc", F.inline(F.array(*places))).withColumn("slice", F.substring("bc", F.col("p7") + 1, F.col("n7")))
    at = sliced.join(F.broadcast(indexes), F.col("slice") == F.col("i7")).filter(F.col("i5").isNull() | F.contains("bc", "i5"))
    found = F.array_contains(occurrences(F.col("bc"), F.col("i7")), F.col("p7"))  # in the generator, so it is evaluated for hits only
    places = F.when(F.col("i5").isNull(), F.array(F.lit(-1))).otherwise(occurrences(F.col("bc"), F.col("i5")))
    at = at.withColumn("p5", F.explode(F.when(found, places).otherwise(F.array().cast("array<int>"))))
    apart = (F.col("p5") < 0) | (F.col("p5") >= F.col("p7") + F.length("i7")) | (F.col("p7") >= F.col("p5") + F.length("i5"))
    dual = F.concat(F.col("p7"), F.lit(":"), F.col("p5"), F.lit("_"), F.col("rc7"), F.lit(":"), F.col("rc5"))
    layout = F.when(F.col("p5") < 0, F.concat(F.col("p7"), F.lit("_"), F.col("rc7"), F.lit(":."))).otherwise(dual)
    return at.filter(apart).groupBy("row_ix", layout.alias("layout")).agg(F.count("*").alias("n"))


def best_layouts(counts: DataFrame) -> DataFrame:
    """The most frequent layout of each sample; of equals, the first by text."""
    w = Window.partitionBy("row_ix").orderBy(F.desc("n"), "layout")
    return counts.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def popular_layout(counts: DataFrame) -> DataFrame:
    """The layout with the most matches over all samples, as one row."""
    return counts.groupBy("layout").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "layout").limit(1)


def layout_details(counts: DataFrame) -> DataFrame:
    """All layouts of each sample as 'layout (n)', the most frequent first, joined by tabs."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "layout")))
    shown = F.transform(listed, lambda x: F.concat(x["layout"], F.lit(" ("), (-x["m"]).cast("string"), F.lit(")")))
    return counts.groupBy("row_ix").agg(F.array_join(shown, "\t").alias("all_matches"))


def barcode_length_of(given: int, r2_length: int, r1_length: int, samples: list[Sample], max_umi: int) -> int:
    """The given length, or by how much the barcode read is longer; within the longest indexes plus a UMI."""
    longest = max(len(s.i7) + (len(s.i5) if s.i5 != MISSING else 0) for s in samples)
    length = given or r2_length - r1_length
    if length <= 0:
        raise ValueError("the barcode length can't be told from the reads; give it")
    return length if given else min(length, longest + max_umi)


def detected_sheet(reads: DataFrame, samples: list[Sample], barcode_length: int, popular: bool = False, umi: bool = True) -> tuple[list[tuple], list[tuple]]:
    """The rows of the template sheet (sample_id, i7, i5, job_number, template, i7_rc, i5_rc) and of the details (sample_id,
    i7, i5, all matches). There are as many as samples."""
    spark = reads.sparkSession
    indexes = spark.createDataFrame(index_table(samples), "row_ix int, i7 string, i5 string, rc7 int, rc5 int")
    counts = layout_counts(reads, indexes, barcode_length).persist()
    most = popular_layout(counts).collect()
    if not most:
        raise ValueError("no sample's indexes occur in the barcodes")
    best = {r.row_ix: r.layout for r in best_layouts(counts).collect()}
    details = {r.row_ix: r.all_matches for r in layout_details(counts).collect()}
    counts.unpersist()
    rows = []
    for s in samples:
        layout = most[0].layout if popular else best.get(s.row)
        found = render_template(layout, umi, barcode_length, len(s.i7), len(s.i5)) if layout else ("No matches with this sample", MISSING, MISSING)
        rows.append((s.sample_id, s.i7, s.i5, s.job_number, *found))
    return rows, [(s.sample_id, s.i7, s.i5, details.get(s.row, "No matches found!")) for s in samples]
