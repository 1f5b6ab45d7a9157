import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from readloom.functions import columns as C
from readloom.functions.quality import quality_measures

HEADER = "@FC01L1C001R00100000001/2"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_reverse_complement(spark):
    assert one(spark, C.reverse_complement("s"), s="AACGTN") == "NACGTT"
    assert one(spark, C.reverse_complement("s"), s="acgn") == "NCGT"
    with pytest.raises(PySparkException):
        one(spark, C.reverse_complement("s"), s="AXC")


def test_hamming(spark):
    assert one(spark, C.hamming("a", "b"), a="ACGT", b="ACCA") == 2
    assert one(spark, C.hamming("a", "b"), a="", b="") == 0
    assert one(spark, C.hamming_fixed(F.col("a"), F.col("b"), 4), a="ACGT", b="ACCA") == 2
    with pytest.raises(PySparkException):
        one(spark, C.hamming("a", "b"), a="ACG", b="AC")


def test_headers(spark):
    illumina = C.illumina_header("h", "@instrument_1:20231212:FC01:", F.lit("ACGGGCAT+GGCTAGAG"))
    assert one(spark, illumina, h=HEADER) == "@instrument_1:20231212:FC01:1:1:1:1 2:N:0:ACGGGCAT+GGCTAGAG"
    with_umi = C.illumina_header("h", "@i:r:f:", F.lit("AC"), F.lit("TTT"), F.lit("1"))
    assert one(spark, with_umi, h=HEADER) == "@i:r:f:1:1:1:1:TTT 1:N:0:AC"
    assert one(spark, C.illumina_header("h", "@p:", F.lit("B")), h="@FL9L3C012R000000/1") == "@p:3::12:0 1:N:0:B"  # an all-zero tile is empty
    assert one(spark, C.mgi_full_header("h", F.lit("ACGGGCAT+GGCTAGAG"), F.lit("ACGTACGT")), h=HEADER) == f"{HEADER} ACGTACGT 2:N:0:ACGGGCAT+GGCTAGAG"
    assert one(spark, C.with_mate(F.lit("@x:1 2:N:0:AC"), F.lit("1"))) == "@x:1 1:N:0:AC"
    assert one(spark, C.split_header("h", F.lit("TT")), h="@x:1 2:N:0:AC") == "@x:1:TT 2:N:0:AC"
    assert one(spark, C.raw_header("h", F.lit("TT"), "AC"), h=HEADER) == "@FC01L1C001R00100000001:TT 2:N:0:AC"
    assert one(spark, C.raw_header("h", None, None), h=HEADER) == "@FC01L1C001R00100000001"
    assert one(spark, F.concat_ws("|", C.flowcell_of("h"), C.lane_of("h")), h="@ALLL2C001R0010001/1") == "ALL|2"  # by the last L


@pytest.mark.parametrize("qual,tail", [("", 0), ("!I?>", 0), ("!I?>", 2), ("II", 5), ("ABCDEFG?", 3)])
def test_quality(spark, qual, tail):
    got = one(spark, quality_measures("q", tail), q=qual)
    rest, end = qual[: max(0, len(qual) - tail)], qual[max(0, len(qual) - tail) :]
    expected = [sum(map(ord, rest)), sum(ord(c) >= 63 for c in rest), sum(map(ord, end)), sum(ord(c) >= 63 for c in end)]
    assert list(got) == expected
    assert one(spark, C.quality_sum("q"), q=qual) == sum(map(ord, qual))
    assert one(spark, C.q30_count("q"), q=qual) == sum(ord(c) >= 63 for c in qual)


def test_violations(spark):
    rows = [("@h", "ACGTNacgtn", "!IIIIIIIII"), ("h", "A", "I"), ("@h", "AX", "II"), ("@h", "A", "J"), ("@h", "AC", "I"), (None, "A", "I")]
    df = spark.createDataFrame(rows, "h string, s string, q string")
    assert [r.v for r in df.select(C.read_violation("h", "s", "q").alias("v")).collect()] == [None, "header", "bases", "quality", "length", "header"]


def test_percent_of_nothing(spark):
    assert one(spark, C.percent("a", "b"), a=1, b=0) == 0.0
    assert one(spark, C.percent("a", "b"), a=1, b=4) == 25.0
