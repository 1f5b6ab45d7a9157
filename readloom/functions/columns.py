"""Sequence, quality and header expressions. Each takes and returns Columns (or column names)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

# fixed values: bases and their complements, the letters of read mismatches, and the quality scale
BASES, COMPLEMENTS = "ACGT", "TGCA"
READ_LETTERS = "ACTGN"
PHRED_OFFSET = 33
Q30_BYTE = 63
MAX_QUALITY_BYTE = 73


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    """Upper-cased; N stays; any other letter is an error."""
    s = F.upper(_col(seq))
    bad = F.raise_error(F.concat(F.lit("not a base sequence: "), s))
    return F.when(s.rlike("^[ACGTN]*$"), F.translate(F.reverse(s), BASES, COMPLEMENTS)).when(s.isNotNull(), bad)


def hamming(a: Column | str, b: Column | str) -> Column:
    """The number of places in which a and b differ; an error for different lengths."""
    a, b = _col(a), _col(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    total = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(total)).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("sequences differ in length")).cast("int"))


def hamming_fixed(a: Column, b: Column, length: int) -> Column:
    """hamming() for a known length, unrolled for code generation."""
    total = F.lit(0)
    for i in range(1, length + 1):
        total = total + F.when(F.substring(a, i, 1) != F.substring(b, i, 1), 1).otherwise(0)
    return total


def barcode_slice(seq: Column | str, length: int) -> Column:
    """The last length bases of the barcode read."""
    return F.right(_col(seq), F.lit(length))


def index_slice(barcode: Column | str, barcode_length: int, length: int, offset: int) -> Column:
    """length bases from offset before the barcode's end."""
    return F.substring(_col(barcode), barcode_length - offset + 1, length)


def trimmed(text: Column | str, tail: int) -> Column:
    """Without the last tail characters."""
    c = _col(text)
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - tail, F.lit(0)))


def quality_sum(qual: Column | str) -> Column:
    """The sum of the bytes; subtract PHRED_OFFSET per base for Phred values. It goes over the letters one by one; for
    statistics of many reads, see readloom.functions.quality."""
    c = _col(qual)
    return F.aggregate(F.transform(F.split(c, ""), F.ascii), F.lit(0).cast("long"), lambda s, x: s + x)


def q30_count(qual: Column | str) -> Column:
    """Bytes of Phred 30 and above."""
    return F.length(F.regexp_replace(_col(qual), "[^?-~]", "")).cast("long")


def read_violation(header: Column | str, seq: Column | str, qual: Column | str) -> Column:
    """What is wrong with a read: header, bases, quality, length; null if nothing is."""
    h, s, q = _col(header), _col(seq), _col(qual)
    return (
        F.when(h.isNull() | ~h.startswith("@"), "header").when(s.isNull() | ~s.rlike("^[ACGTNacgtn]*$"), "bases")
        .when(q.isNull() | ~q.rlike("^[!-I]*$"), "quality").when(F.length(s) != F.length(q), "length")
    )


# --- headers: @<flowcell>L<lane 1>C<column 3>R<row 3><tile digits>/<mate>, by the last L ---

def flowcell_of(header: Column | str) -> Column:
    return F.regexp_extract(_col(header), r"^@(.*)L(.)[^L]*$", 1)


def lane_of(header: Column | str) -> Column:
    return F.regexp_extract(_col(header), r"^@(.*)L(.)[^L]*$", 2)


def header_part(header: Column | str, part: str) -> Column:
    """lane, column, row, tile or mate."""
    return F.regexp_extract(_col(header), r"^@.*L(.)C(...)R(...)(\d*)/(.)$", ["lane", "column", "row", "tile", "mate"].index(part) + 1)


def _number(digits: Column) -> Column:
    """Without leading zeros; at least one digit stays."""
    return F.regexp_replace(digits, "^0+(?=.)", "")


def illumina_prefix(instrument: str, run: str, flowcell: str) -> str:
    if not (instrument and run and flowcell):
        raise ValueError("an Illumina header needs instrument, run and flowcell")
    return f"@{instrument}:{run}:{flowcell}:"


def illumina_header(header: Column | str, prefix: str, barcode: Column, umi: Column | None = None, mate: Column | None = None) -> Column:
    """prefix lane:tile:column:row[:umi] mate:N:0:barcode."""
    h = _col(header)
    tile = F.regexp_replace(header_part(h, "tile"), "^0+", "")
    place = F.concat_ws(":", header_part(h, "lane"), tile, _number(header_part(h, "column")), _number(header_part(h, "row")))
    tag = F.lit("") if umi is None else F.when(umi != "", F.concat(F.lit(":"), umi)).otherwise("")
    return F.concat(F.lit(prefix), place, tag, F.lit(" "), header_part(h, "mate") if mate is None else mate, F.lit(":N:0:"), barcode)


def mgi_full_header(header: Column | str, barcode: Column, umi: Column | None = None) -> Column:
    """header [umi] mate:N:0:barcode, separated by spaces."""
    h = _col(header)
    tag = F.lit("") if umi is None else F.when(umi != "", F.concat(umi, F.lit(" "))).otherwise("")
    return F.concat(h, F.lit(" "), tag, F.right(h, F.lit(1)), F.lit(":N:0:"), barcode)


def with_mate(header: Column | str, mate: Column) -> Column:
    """A barcode read's rewritten header for its mate."""
    return F.regexp_replace(_col(header), r" .(:N:0:)", F.concat(F.lit(" "), mate, F.lit("$1")))


def split_header(header: Column | str, umi: Column | None = None) -> Column:
    """A split read's header with :umi before its tail ' m:N:0:barcode'."""
    h = _col(header)
    at = F.instr(h, " ")
    tag = F.lit("") if umi is None else F.when(umi != "", F.concat(F.lit(":"), umi)).otherwise("")
    return F.concat(F.substring(h, F.lit(1), at - 1), tag, F.substring(h, at, F.length(h)))


def raw_header(header: Column | str, umi: Column | None, barcode: Column | str | None) -> Column:
    """A raw read's header: /m goes; ' m:N:0:barcode' comes if a barcode is given."""
    h = _col(header)
    tag = F.lit("") if umi is None else F.when(umi != "", F.concat(F.lit(":"), umi)).otherwise("")
    tail = F.concat(F.lit(" "), F.right(h, F.lit(1)), F.lit(":N:0:"), F.lit(barcode) if isinstance(barcode, str) else barcode) if barcode is not None else F.lit("")
    return F.concat(F.regexp_replace(h, r"/.$", ""), tag, tail)


def percent(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole; 0 where whole is 0."""
    return F.coalesce(F.try_divide(_col(part).cast("double"), _col(whole).cast("double")), F.lit(0.0)) * 100


SQL_FUNCTIONS = {
    "rev_comp": "(s STRING) RETURNS STRING RETURN translate(reverse(upper(s)), 'ACGT', 'TGCA')",
    "hamming": "(a STRING, b STRING) RETURNS INT RETURN CASE WHEN length(a) = length(b) THEN aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> IF(x = y, 0, 1)), 0, (s, x) -> s + x) END",
    "qual_sum": "(q STRING) RETURNS BIGINT RETURN aggregate(transform(split(q, ''), c -> ascii(c)), 0L, (s, x) -> s + x)",
    "q30_count": "(q STRING) RETURNS BIGINT RETURN length(regexp_replace(q, '[^?-~]', ''))",
    "illumina_header": "(h STRING, prefix STRING, barcode STRING) RETURNS STRING RETURN concat(prefix, regexp_extract(h, '^@.*L(.)C(...)R(...)([0-9]*)/(.)$', 1), ':', regexp_replace(regexp_extract(h, '^@.*L(.)C(...)R(...)([0-9]*)/(.)$', 4), '^0+', ''), ':', regexp_replace(regexp_extract(h, '^@.*L(.)C(...)R(...)([0-9]*)/(.)$', 2), '^0+(?=.)', ''), ':', regexp_replace(regexp_extract(h, '^@.*L(.)C(...)R(...)([0-9]*)/(.)$', 3), '^0+(?=.)', ''), ' ', right(h, 1), ':N:0:', barcode)",
}


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary SQL functions, inlined by Catalyst."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
