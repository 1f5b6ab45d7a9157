"""The registered queries, on reads and sample sheets that are derived from the driver's tables, and their oracles.

The derived tables are SQL text that Spark and DuckDB read alike: `nation` gives a sheet of 25 samples, `events` (or, for
volume, `lineitem`) the reads. A read's barcode is that of sample id % 25 with up to two substitutions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.functions import columns as C
from readloom.operators import detect, jobs, match, neighbors, reformat, stats
from readloom.plans.session import local_frame
from readloom.plans.sheet import MISSING, Sample, Sheet, SheetError, build_sheet, parse_sheet
from readloom.plans.template import parse_template, render_template
from readloom.sources import fastq, runinfo, store, writers
from readloom.streaming import lanes

PREFIX = C.illumina_prefix("instrument_1", "20231212", "FC01")


def _letters(terms: list[str]) -> str:
    return " || ".join(f"substr('ACGT', cast(({t}) % 4 as int) + 1, 1)" for t in terms)


def _base_index(k: str, salt: int) -> str:
    return _letters([f"{k} * {2 * j + 1} + cast(floor({k} / 4) as int) * {j + salt} + cast(floor({k} / 16) as int) * {j * j + 1} + {j * salt}" for j in range(8)])


def _index(k: str, which: int) -> str:
    """Samples 20 to 24 have the i5 of 0 to 4 and an i7 two bases from theirs, so reads between them are ambiguous."""
    near = f"case when {k} >= 20 then {k} - 20 else {k} end"
    own = f"({_base_index(f'({near})', 1 if which == 7 else 3)})"
    return f"(case when {k} >= 20 then translate(substr({own}, 1, 2), 'ACGT', 'CGTA') || substr({own}, 3) else {own} end)" if which == 7 else own


SHEET = f"select cast(n_nationkey as int) as row_ix, n_name as sample_id, cast(n_regionkey as string) as job_number, {_index('n_nationkey', 7)} as i7, {_index('n_nationkey', 5)} as i5 from nation"

#: The layouts of the mixed library: template and the samples that have it, from and to.
MIXED = (("i78:um4:i58", 0, 12), ("i58:um4:i78", 12, 20), ("i78:--12", 20, 25))
DUAL = (("i78:um4:i58", 0, 25),)
SINGLE = (("i78:--12", 0, 25),)


def _changed(text: str, place: str, letter: str) -> str:
    return f"(case when {place} < 8 then substr({text}, 1, {place}) || {letter} || substr({text}, {place} + 2) else {text} end)"


def reads_sql(layouts: tuple = DUAL, source: str = "events", read_id: str = "event_id") -> str:
    """read_id, k, header, seq, qual, and the mate's r1_header, r1_seq, r1_qual."""
    a = f"select read_id, cast(read_id % 25 as int) as k, cast((case when read_id % 40 = 7 then read_id + 3 else read_id end) % 25 as int) as k5, cast(read_id % 19 as int) as p7, cast(read_id % 23 as int) as p5 from (select {read_id} as read_id from {source}) i"
    b = f"select a.*, s.i7 as x7, t.i5 as x5 from ({a}) a join ({SHEET}) s on s.row_ix = a.k join ({SHEET}) t on t.row_ix = a.k5"
    l7, l5 = "substr('ACGTN', cast(read_id % 5 as int) + 1, 1)", "substr('TGCAN', cast(read_id % 5 as int) + 1, 1)"
    c = f"select *, {_changed('x7', 'p7', l7)} as i7, {_changed('x5', 'p5', l5)} as i5, {_letters([f'read_id * {j + 2} + {j}' for j in range(4)])} as um from ({b}) b"
    parts = {"i78": "i7", "i58": "i5", "um4": "um", "--12": "'ACGTACGTACGT'"}
    barcode = "case " + " ".join(f"when k < {hi} then {' || '.join(parts[p] for p in text.split(':'))}" for text, _, hi in layouts) + " end"
    d = f"select read_id, k, {barcode} as bc from ({c}) c"
    head = "'@FC01L1C' || lpad(cast(read_id % 12 as string), 3, '0') || 'R' || lpad(cast(read_id % 97 as string), 3, '0') || lpad(cast(read_id as string), 9, '0') || '/'"
    insert = "substr('ACGTTGCATGCCATAGACGTTGCATGCCATAGNACGTTGCATGCCATAGACG', cast(read_id % 9 as int) + 1, 40)"
    quality = lambda n, s: f"substr('FFGHI:?@5<=>IIII!+0FFGHIII?>@ABCDE5<=>IIII!+0FFGHI:?@5<=>IIII!+0IIIGHF', cast(read_id % {s} as int) + 1, {n})"
    return f"select read_id, k, {head} || '2' as header, {insert} || bc as seq, {quality(60, 10)} as qual, {head} || '1' as r1_header, substr(seq0, 1, 30) as r1_seq, {quality(30, 17)} as r1_qual from (select *, {insert} as seq0 from ({d}) d) e"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def reads(spark: SparkSession, sf_dir: str, layouts: tuple = DUAL, source: str = "events", read_id: str = "event_id") -> DataFrame:
    tables(spark, sf_dir, source, "nation")
    return spark.sql(reads_sql(layouts, source, read_id))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "nation")
    return spark.sql(SHEET)


def sheet(spark: SparkSession, sf_dir: str, layouts: tuple = DUAL) -> Sheet:
    """A sheet is bounded by the lane's samples, so it is planned on the driver."""
    rows = sorted(sheet_rows(spark, sf_dir).collect())
    template = lambda k: next(t for t, lo, hi in layouts if lo <= k < hi)
    return build_sheet([Sample(r.row_ix, r.sample_id, r.i7, r.i5, template(r.row_ix), job_number=r.job_number) for r in rows])


def assigned(spark: SparkSession, sf_dir: str, layouts: tuple = DUAL, options: match.MatchOptions = match.MatchOptions(), **source: str) -> DataFrame:
    return match.assign(reads(spark, sf_dir, layouts, **source), sheet(spark, sf_dir, layouts), options)


# --- oracles' common tables ---


def matches_sql(layouts: tuple, m: int, per_index: bool = False, comprehensive: bool = False) -> str:
    """CTEs sheet, reads and assigned (read_id, row_ix, mm, barcode, umi), by distances to all samples."""
    per_template, most = [], m * (2 if per_index else 1)
    ranked = sorted(layouts, key=lambda t: (-(t[2] - t[1]), t[0]))
    for rank, (text, lo, hi) in enumerate(ranked):
        t = parse_template(text)
        cut = lambda p: f"substr(bc, {t.length - p.offset + 1}, {p.length})"  # noqa: E731, B023
        o7, o5, um = cut(t.i7), cut(t.i5) if t.i5 else "''", cut(t.um) if t.um else "''"
        d5 = "hamming(o5, s.i5)" if t.i5 else "0"
        seen = "o7 || '+' || o5" if t.i5 else "o7"
        limit = f"d7 + d5 <= {most}" if t.i5 else "true"
        per_template.append(f"""
            select read_id, {rank} as rank, row_ix, d7 + d5 as mm, {seen} as barcode, um from (
              select *, min(d7) over (partition by read_id) as m7, min(d5) over (partition by read_id) as m5 from (
                select read_id, o7, o5, um, row_ix, hamming(o7, s.i7) as d7, {d5} as d5
                from (select read_id, {o7} as o7, {o5} as o5, {um} as um from barcodes) r, (select * from sheet where row_ix >= {lo} and row_ix < {hi}) s))
            where d7 = m7 and d5 = m5 and d7 <= {m} and d5 <= {m} and {limit}""")
    first = parse_template(ranked[0][0])
    whole = "bc" if len(layouts) > 1 else f"substr(bc, {first.length - first.i7.offset + 1}, 8)" + (f" || '+' || substr(bc, {first.length - first.i5.offset + 1}, 8)" if first.i5 else "")
    key = "mm" if comprehensive else "rank"
    return f"""sheet as ({SHEET}), reads as ({reads_sql(layouts)}), barcodes as (select read_id, right(seq, 20) as bc from reads),
        hits as ({' union all '.join(per_template)}),
        level as (select h.* from hits h join (select read_id, min({key}) as best from hits group by read_id) b on h.read_id = b.read_id and h.{key} = b.best),
        found as (select read_id, count(*) as n, min(row_ix) as row_ix, min(mm) as mm, min(barcode) as barcode, min(um) as um from level group by read_id),
        assigned as (select b.read_id, cast(case when n = 1 then row_ix when n > 1 then 26 else 25 end as int) as row_ix, cast(case when n = 1 then mm else 0 end as int) as mm,
          case when n = 1 then barcode else {whole} end as barcode, case when n = 1 then um else '' end as umi from barcodes b left join found f on b.read_id = f.read_id)"""


ALL_SAMPLES = "all_samples as (select row_ix, sample_id, job_number, 'sample' as role from sheet union all select 25, 'Undetermined', '.', 'undetermined' union all select 26, 'Ambiguous', '.', 'ambiguous')"


def stats_sql(m: int) -> str:
    """CTE per_sample: the measures of each sample, and the reads by mismatches as mm0 and up."""
    total = lambda q: f"list_sum(list_transform(string_split({q}, ''), lambda c: ascii(c) - 33))"
    high = lambda q: f"length(regexp_replace({q}, '[^?-~]', '', 'g'))"
    r2, r3 = "substr(qual, 1, 40)", "right(qual, 20)"
    sums = [f"sum({f(q)}) as r{i}_{n}" for n, f in (("qc_30", high), ("bases", lambda q: f"length({q})"), ("qc", total)) for i, q in ((1, "r1_qual"), (2, r2), (3, r3))]
    names = [f"r{i}_{n}" for n in ("qc_30", "bases", "qc") for i in (1, 2, 3)] + ["all_reads"] + [f"mm{k}" for k in range(m + 1)]
    counts = [f"count(*) filter (where mm = {k}) as mm{k}" for k in range(m + 1)]
    return f"""{ALL_SAMPLES}, per_read as (select row_ix, {', '.join(sums)}, count(*) as all_reads, {', '.join(counts)} from reads join assigned using (read_id) group by row_ix),
        per_sample as (select s.row_ix, s.sample_id, s.job_number, s.role, {', '.join(f'cast(coalesce({n}, 0) as bigint) as {n}' for n in names)}
          from all_samples s left join per_read r on s.row_ix = r.row_ix where s.role = 'sample' or all_reads > 0)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# --- expressions ---


@_query(f"with sheet as ({SHEET}) select row_ix, translate(reverse(upper(i7)), 'ACGT', 'TGCA') as i7_rc, translate(reverse(upper(i5)), 'ACGT', 'TGCA') as i5_rc from sheet")
def revcomp(spark, sf_dir):
    return sheet_rows(spark, sf_dir).select("row_ix", C.reverse_complement("i7").alias("i7_rc"), C.reverse_complement("i5").alias("i5_rc"))


@_query(f"with sheet as ({SHEET}) select a.row_ix as a, b.row_ix as b, cast(hamming(a.i7, b.i7) as int) as d7, cast(hamming(a.i5, b.i5) as int) as d5 from sheet a, sheet b where a.row_ix < b.row_ix")
def hamming_pairs(spark, sf_dir):
    s = sheet_rows(spark, sf_dir)
    a, b = s.select(F.col("row_ix").alias("a"), F.col("i7").alias("a7"), F.col("i5").alias("a5")), s.select(F.col("row_ix").alias("b"), F.col("i7").alias("b7"), F.col("i5").alias("b5"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", C.hamming("a7", "b7").alias("d7"), C.hamming_fixed(F.col("a5"), F.col("b5"), 8).alias("d5"))


def _neighborhood_oracle(m: int) -> str:
    letters = "(select unnest(['A', 'C', 'T', 'G', 'N']) as c)"
    step = lambda t: f"select distinct idx, substr(v, 1, p - 1) || c || substr(v, p + 1) as v from {t}, (select unnest(range(1, 9)) as p), {letters}"
    levels = "l0 as (select distinct i7 as idx, i7 as v from sheet)" + "".join(f", l{k} as ({step(f'l{k - 1}')})" for k in range(1, m + 1))
    return f"with sheet as ({SHEET}), {levels}, d as (select idx, v, cast(hamming(idx, v) as int) as mm from l{m}), n as (select *, min(mm) over (partition by v) as low from d) select v as variant, mm, idx from n where mm = low"


def _neighborhood(m: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return neighbors.neighborhood(sheet_rows(spark, sf_dir).select(F.col("i7").alias("idx")).distinct(), m)

    query.__name__ = f"index_neighborhood_m{m}"
    return query


for _m in (1, 2):
    _query(_neighborhood_oracle(_m))(_neighborhood(_m))


@_query("select * from (values ('i78:um4:i58', 8, 20, 8, 8, 4, 12, 20), ('i58:um4:i78', 8, 8, 8, 20, 4, 12, 20), ('i78:--12', 8, 20, 0, 0, 0, 0, 20)) t(template, i7_length, i7_offset, i5_length, i5_offset, um_length, um_offset, total)")
def parse_template_layout(spark, sf_dir):
    rows = []
    for text, _, _ in MIXED:
        t = parse_template(text)
        rows.append((text, *[x for p in (t.i7, t.i5, t.um) for x in ((p.length, p.offset) if p else (0, 0))], t.length))
    return spark.createDataFrame(rows, "template string, i7_length int, i7_offset int, i5_length int, i5_offset int, um_length int, um_offset int, total int")


@_query(f"with reads as ({reads_sql()}) select read_id, right(seq, 20) as barcode, substr(right(seq, 20), 1, 8) as i7, substr(right(seq, 20), 13, 8) as i5 from reads")
def barcode_slices(spark, sf_dir):
    bc = C.barcode_slice("seq", 20)
    return reads(spark, sf_dir).select("read_id", bc.alias("barcode"), C.index_slice(bc, 20, 8, 20).alias("i7"), C.index_slice(bc, 20, 8, 8).alias("i5"))


@_query(f"with reads as ({reads_sql()}) select read_id, substr(right(seq, 20), 9, 4) as umi from reads")
def umi_extract(spark, sf_dir):
    um = parse_template(DUAL[0][0]).um
    return reads(spark, sf_dir).select("read_id", C.index_slice(C.barcode_slice("seq", 20), 20, um.length, um.offset).alias("umi"))


@_query(f"with reads as ({reads_sql()}) select read_id, substr(seq, 1, 40) as seq, substr(qual, 1, 40) as qual from reads")
def trim_reads(spark, sf_dir):
    return reads(spark, sf_dir).select("read_id", C.trimmed("seq", 20).alias("seq"), C.trimmed("qual", 20).alias("qual"))


_PARTS = "split_part(header, 'C', 3)"  # what follows C in @FC01L1C001R001000000001/2
_ILLUMINA = f"'{PREFIX}1:' || regexp_replace(split_part(substr({_PARTS}, 8), '/', 1), '^0+', '') || ':' || cast(cast(substr({_PARTS}, 1, 3) as int) as string) || ':' || cast(cast(substr({_PARTS}, 5, 3) as int) as string)"


@_query(f"with {matches_sql(DUAL, 1)} select read_id, {_ILLUMINA} || ':' || umi || ' 2:N:0:' || barcode as header, {_ILLUMINA} || ':' || umi || ' 1:N:0:' || barcode as r1_header from reads join assigned using (read_id) where row_ix < 25")
def illumina_header(spark, sf_dir):
    a = assigned(spark, sf_dir).filter("row_ix < 25")
    new = C.illumina_header("header", PREFIX, F.col("barcode"), F.col("umi"))
    return a.select("read_id", new.alias("header"), C.illumina_header("header", PREFIX, F.col("barcode"), F.col("umi"), F.right("r1_header", F.lit(1))).alias("r1_header"))


@_query(f"with {matches_sql(DUAL, 1)} select read_id, header || ' ' || umi || ' 2:N:0:' || barcode as header from reads join assigned using (read_id) where row_ix < 25")
def mgi_full_header(spark, sf_dir):
    return assigned(spark, sf_dir).filter("row_ix < 25").select("read_id", C.mgi_full_header("header", F.col("barcode"), F.col("umi")).alias("header"))


@_query(f"with reads as ({reads_sql()}) select read_id, cast(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c))) as bigint) as qual_sum from reads")
def quality_sum(spark, sf_dir):
    return reads(spark, sf_dir).select("read_id", C.quality_sum("qual").alias("qual_sum"))


@_query(f"with reads as ({reads_sql()}) select read_id, cast(length(regexp_replace(qual, '[^?-~]', '', 'g')) as bigint) as q30 from reads")
def q30_count(spark, sf_dir):
    return reads(spark, sf_dir).select("read_id", C.q30_count("qual").alias("q30"))


@_query(f"""with reads as ({reads_sql()}), bad as (select read_id, case when read_id % 11 = 0 then substr(header, 2) else header end as h, case when read_id % 13 = 0 then seq || 'X' else seq end as s, case when read_id % 17 = 0 then qual || 'z' else qual end as q from reads)
    select case when h not like '@%' then 'header' when not regexp_full_match(s, '[ACGTNacgtn]*') then 'bases' when not regexp_full_match(q, '[!-I]*') then 'quality' when length(s) <> length(q) then 'length' end as violation, count(*) as n from bad group by 1""")
def validate_violations(spark, sf_dir):
    spoilt = reads(spark, sf_dir).selectExpr("case when read_id % 11 = 0 then substr(header, 2) else header end as h", "case when read_id % 13 = 0 then seq || 'X' else seq end as s", "case when read_id % 17 = 0 then qual || 'z' else qual end as q")
    return spoilt.groupBy(C.read_violation("h", "s", "q").alias("violation")).agg(F.count("*").alias("n"))


# --- matching ---


def _match(name: str, layouts: tuple, options: match.MatchOptions, where: str = "true"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return assigned(spark, sf_dir, layouts, options).filter(where).select("read_id", "row_ix", "mm", "barcode", "umi")

    query.__name__ = name
    _query(f"with {matches_sql(layouts, options.mismatches, options.per_index, options.comprehensive)} select read_id, row_ix, mm, barcode, umi from assigned where {where}")(query)


_match("match_single_index", SINGLE, match.MatchOptions(1))
_match("match_dual_index", DUAL, match.MatchOptions(1))
_match("match_dual_m2", DUAL, match.MatchOptions(2))
_match("match_dual_per_index", DUAL, match.MatchOptions(1, per_index=True))
_match("match_dual_m3_direct", DUAL, match.MatchOptions(3, neighborhood_limit=0))
_match("match_mixed_default", MIXED, match.MatchOptions(1))
_match("match_mixed_comprehensive", MIXED, match.MatchOptions(1, comprehensive=True))
_match("match_undetermined", DUAL, match.MatchOptions(1), "row_ix = 25")
_match("match_ambiguous", DUAL, match.MatchOptions(1, per_index=True), "row_ix = 26")

# --- reports ---

M = 1


def sample_rows(spark: SparkSession, sf_dir: str, layouts: tuple = DUAL, m: int = M, **source: str) -> DataFrame:
    s = sheet(spark, sf_dir, layouts)
    a = match.assign(reads(spark, sf_dir, layouts, **source), s, match.MatchOptions(m))
    return stats.per_sample(stats.read_statistics(a, s.barcode_length, m, "r1_qual"), s.frame(spark))


_STATS = f"with {matches_sql(DUAL, M)}, {stats_sql(M)}"


@_query(f"{_STATS} select sample_id as sample, mm0, mm1 from per_sample")
def info_report(spark, sf_dir):
    return stats.info_report(sample_rows(spark, sf_dir), M).toDF("sample", "mm0", "mm1")


@_query(f"{_STATS} select sample_id as sample, mm0, mm1 from per_sample where job_number = '2'")
def info_report_project(spark, sf_dir):
    return stats.info_report(sample_rows(spark, sf_dir), M, project="2").toDF("sample", "mm0", "mm1")


def _share(a: str, b: str) -> str:
    return f"coalesce(cast({a} as double) / nullif(cast({b} as double), 0), 0.0) * 100"


@_query(f"{_STATS} select sample_id, all_reads / 1e6 as m_clusters, (r1_qc_30 + r2_qc_30) / 1e6 as mb_q30, {_share('r1_qc_30', 'r1_bases')} as r1, {_share('r2_qc_30', 'r2_bases')} as r2, {_share('r3_qc_30', 'r3_bases')} as r3, {_share('mm0', 'all_reads')} as perfect from per_sample")
def general_sample(spark, sf_dir):
    return stats.general_samples(sample_rows(spark, sf_dir)).toDF("sample_id", "m_clusters", "mb_q30", "r1", "r2", "r3", "perfect")


@_query(f"{_STATS} select 'FC01-L01' as run_lane, sum(r1_bases + r2_bases) / 1e6 as mb_yield, sum(all_reads) / 1e6 as m_clusters, cast(sum(r1_qc_30 + r2_qc_30) as double) / cast(sum(r1_bases + r2_bases) as double) * 100 as q30, cast(sum(r1_qc + r2_qc) as double) / cast(sum(r1_bases + r2_bases) as double) as mean_quality, cast(sum(mm0) filter (where role = 'sample') as double) / cast(sum(all_reads) filter (where role = 'sample') as double) * 100 as perfect from per_sample")
def general_lane(spark, sf_dir):
    return stats.general_lane(sample_rows(spark, sf_dir), "FC01-L01").toDF("run_lane", "mb_yield", "m_clusters", "q30", "mean_quality", "perfect")


_MEASURES = ", ".join(stats.MEASURES)


@_query(f"{_STATS} select job_number, sample_id, {_MEASURES}, mm0, mm1 from per_sample")
def sample_stats(spark, sf_dir):
    return stats.sample_statistics(sample_rows(spark, sf_dir), M).toDF("job_number", "sample_id", *stats.MEASURES, "mm0", "mm1")


@_query(f"{_STATS} select coalesce(job_number, '') as job_number, coalesce(row_ix, -1) as row_ix, cast(grouping(job_number) * 2 + grouping(row_ix) as bigint) as level, {', '.join(f'cast(sum({m}) as bigint) as {m}' for m in stats.MEASURES)} from per_sample group by rollup (job_number, row_ix)")
def lane_totals(spark, sf_dir):
    return stats.lane_totals(sample_rows(spark, sf_dir)).fillna({"job_number": "", "row_ix": -1})


def _top(name: str, which: str, options: match.MatchOptions, limit: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = sheet(spark, sf_dir)
        return stats.barcode_counts(match.assign(reads(spark, sf_dir), s, options), s, which, limit).toDF("barcode", "n")

    query.__name__ = name
    row = 25 if which == "undetermined" else 26
    tail = f" order by n desc, barcode desc limit {limit}" if limit else ""
    _query(f"with {matches_sql(DUAL, options.mismatches, options.per_index)} select barcode, count(*) as n from assigned where row_ix = {row} group by barcode{tail}")(query)


_top("undetermined_top20", "undetermined", match.MatchOptions(1), 20)
_top("undetermined_complete", "undetermined", match.MatchOptions(1), 0)
_top("ambiguous_top20", "ambiguous", match.MatchOptions(1, per_index=True), 20)
_top("ambiguous_complete", "ambiguous", match.MatchOptions(1, per_index=True), 0)


@_query(f"{_STATS} select job_number, sample_id, {', '.join(f'2 * {c} as {c}' for c in stats.MEASURES)}, mm0 * 2 as mm0, mm1 as mm1 from per_sample")
def merge_lane_reports(spark, sf_dir):
    """Two lanes, of which the second has no column for one mismatch."""
    lane = stats.sample_statistics(sample_rows(spark, sf_dir), M)
    merged = stats.merge_reports([lane, lane.drop("1-mismatches")])
    return merged.toDF("job_number", "sample_id", *stats.MEASURES, "mm0", "mm1")


@_query(f"with sheet as ({SHEET}), twice as (select row_ix, substr(sample_id, 1, 1) as sample_id from sheet) select row_ix, sample_id, cast(min(row_ix) over (partition by sample_id) as int) as canonical_row from twice")
def duplicate_sample_rows(spark, sf_dir):
    s = Sheet([Sample(r.row_ix, r.sample_id[0], r.i7) for r in sorted(sheet_rows(spark, sf_dir).collect())], [])
    first = s.canonical_rows()
    return local_frame(spark, [(x.row, x.sample_id, first[x.row]) for x in s.samples], "row_ix int, sample_id string, canonical_row int")


@_query(f"with sheet as ({SHEET}), first as (select row_ix, substr(sample_id, 1, 1) as sample_id, min(row_ix) over (partition by substr(sample_id, 1, 1)) as f from sheet) select row_ix, sample_id, cast(dense_rank() over (order by f) as int) as number from first")
def sample_numbering(spark, sf_dir):
    """S-numbers of a sheet with repeated sample ids, as the writer gives them."""
    rows = sorted(sheet_rows(spark, sf_dir).collect())
    s = Sheet([Sample(r.row_ix, r.sample_id[0], r.i7) for r in rows], [])
    numbers = s.sample_numbers()
    return spark.createDataFrame([(x.row, x.sample_id, numbers[x.sample_id]) for x in s.samples], "row_ix int, sample_id string, number int")


# --- detection ---


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = [Sample(r.row_ix, r.sample_id, r.i7, r.i5) for r in sorted(sheet_rows(spark, sf_dir).collect())]
    indexes = spark.createDataFrame(detect.index_table(samples), "row_ix int, i7 string, i5 string, rc7 int, rc5 int")
    return detect.layout_counts(reads(spark, sf_dir, MIXED[:2] + (("i78:um4:i58", 20, 25),)), indexes, 20)


_rc = lambda x: f"translate(reverse({x}), 'ACGT', 'TGCA')"
_all = lambda i: f"list_filter(range(0, 13), lambda p: substr(bc, p + 1, 8) = {i})"
_apart = lambda x: f"list_filter({x}, lambda p: p = {x}[1] or p = list_min(list_filter({x}, lambda q: q >= {x}[1] + 8)))"  # noqa: E731  as a scan from the left finds them
_DETECT = f"""with sheet as ({SHEET}), reads as ({reads_sql(MIXED[:2] + (("i78:um4:i58", 20, 25),))}), barcodes as (select right(seq, 20) as bc from reads),
    forms as (select row_ix, i7, i5, 0 as rc7, 0 as rc5 from sheet union all select row_ix, {_rc('i7')}, i5, 1, 0 from sheet union all select row_ix, i7, {_rc('i5')}, 0, 1 from sheet union all select row_ix, {_rc('i7')}, {_rc('i5')}, 1, 1 from sheet),
    o as (select row_ix, rc7, rc5, {_all('i7')} as x, {_all('i5')} as y from barcodes, forms where contains(bc, i7) and contains(bc, i5)),
    p as (select row_ix, rc7, rc5, {_apart('x')} as a, {_apart('y')} as b from o),
    q as (select row_ix, rc7, rc5, p7, unnest(b) as p5 from (select row_ix, rc7, rc5, b, unnest(a) as p7 from p)),
    counts as (select row_ix, p7 || ':' || p5 || '_' || rc7 || ':' || rc5 as layout, count(*) as n from q where abs(p7 - p5) >= 8 group by 1, 2)"""


@_query(f"{_DETECT} select row_ix, layout, n from counts")
def template_detect_counts(spark, sf_dir):
    return _layouts(spark, sf_dir)


@_query(f"{_DETECT} select row_ix, layout, n from counts qualify row_number() over (partition by row_ix order by n desc, layout) = 1")
def template_best(spark, sf_dir):
    return detect.best_layouts(_layouts(spark, sf_dir))


@_query(f"{_DETECT} select layout, cast(sum(n) as bigint) as n from counts group by layout order by n desc, layout limit 1")
def template_popular(spark, sf_dir):
    return detect.popular_layout(_layouts(spark, sf_dir))


@_query(f"{_DETECT} select row_ix, string_agg(layout || ' (' || n || ')', chr(9) order by n desc, layout) as all_matches from counts group by row_ix")
def template_details(spark, sf_dir):
    return detect.layout_details(_layouts(spark, sf_dir))


@_query("select * from (values ('0:12_0:0', 'i78:um4:i58', '0', '0'), ('12:0_1:0', 'i58:um4:i78', '1', '0'), ('3_0:.', '--3:i78:um9', '0', '.')) t(layout, template, i7_rc, i5_rc)")
def template_render(spark, sf_dir):
    return spark.createDataFrame([(x, *render_template(x, True, 20, 8, 8)) for x in ("0:12_0:0", "12:0_1:0", "3_0:.")], "layout string, template string, i7_rc string, i5_rc string")


# --- reformatting and sources ---

_SPLIT = f"with {matches_sql(DUAL, 1)}, split as (select read_id, {_ILLUMINA} || ' 2:N:0:' || barcode as header, seq, qual, i7 || '+' || i5 as expected from reads join assigned using (read_id) join sheet using (row_ix))"


@_query(f"{_SPLIT} select read_id, split_part(header, ' ', 1) || ':' || right(seq, 8) || ' ' || split_part(header, ' ', 2) as new_header, substr(seq, 1, 52) as new_seq, cast(least(hamming(split_part(header, ':', 10), expected), 4) as int) as mm from split")
def reformat_mismatch(spark, sf_dir):
    """The split reads of all samples, each with its own sample's barcode."""
    own = sheet_rows(spark, sf_dir).select("row_ix", F.concat("i7", F.lit("+"), "i5").alias("expected"))
    split = assigned(spark, sf_dir).join(F.broadcast(own), "row_ix").select("read_id", C.illumina_header("header", PREFIX, F.col("barcode")).alias("header"), "seq", "qual", "expected")
    return reformat.reformat_reads(split, 8, F.col("expected")).select("read_id", "new_header", "new_seq", "mm")


@_query(f"with reads as ({reads_sql()}) select read_id, substr(header, 1, length(header) - 2) || ':' || right(seq, 4) || ' 2:N:0:ACGT+TTGG' as new_header, substr(seq, 1, 56) as new_seq, substr(qual, 1, 56) as new_qual, 0 as mm from reads")
def raw_reformat(spark, sf_dir):
    return reformat.reformat_reads(reads(spark, sf_dir), 4, "ACGT+TTGG").select("read_id", "new_header", "new_seq", "new_qual", "mm")


@_query(f"with reads as ({reads_sql()}) select read_id, header, r1_header from reads where substr(header, 1, length(header) - 1) = substr(r1_header, 1, length(r1_header) - 1)")
def paired_zip(spark, sf_dir):
    r = reads(spark, sf_dir)
    one = lambda h, s, q: r.select("read_id", F.col(h).alias("header"), F.col(s).alias("seq"), F.lit("+").alias("plus"), F.col(q).alias("qual"))
    both = fastq.paired(one("header", "seq", "qual"), one("r1_header", "r1_seq", "r1_qual"), ["read_id"])
    return both.select("read_id", "header", "r1_header")


@_query(f"with reads as ({reads_sql()}) select cast(row_number() over (order by read_id) - 1 as bigint) as read_id, header from reads qualify row_number() over (order by read_id) <= 500")
def reads_first_n(spark, sf_dir):
    """The first records of a gzip file; the source stops reading there."""
    path = fastq.scratch_dir(spark, "first")
    fastq.write_fastq_table(reads(spark, sf_dir).coalesce(1).sortWithinPartitions("read_id"), path)
    return fastq.read_fastq(spark, path, 500).select("read_id", "header")


@_query(f"with reads as ({reads_sql()}) select read_id, 'FC01' as flowcell, '1' as lane, seq, qual from reads")
def fastq_roundtrip(spark, sf_dir):
    """Writes the reads as gzip FASTQ into the shared folder and reads them back."""
    path = fastq.scratch_dir(spark, "fastq")
    fastq.write_fastq_table(reads(spark, sf_dir), path)
    back = fastq.read_fastq(spark, path)
    number = F.regexp_extract("header", r"R...(\d+)/", 1).cast("long")
    return back.select(number.alias("read_id"), C.flowcell_of("header").alias("flowcell"), C.lane_of("header").alias("lane"), "seq", "qual")


@_query("select 'V350' as instrument, '202312120815' as run")
def bioinfo_parse(spark, sf_dir):
    from readloom.sources.runinfo import parse_info

    return spark.createDataFrame([parse_info(["Machine ID,V350", "Sequence Start Date,2023-12-12", "Sequence Start Time,08:15", "Other,1"])], "instrument string, run string")


@_query(f"with reads as ({reads_sql()}) select read_id, translate(reverse(right(seq, 20)), 'ACGT', 'TGCA') as rc, cast(length(regexp_replace(qual, '[^?-~]', '', 'g')) as bigint) as q30, {_ILLUMINA} || ' 2:N:0:X' as header, cast(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c))) as bigint) as qual_sum, cast(hamming(substr(seq, 1, 20), right(seq, 20)) as int) as far from reads")
def sql_functions(spark, sf_dir):
    C.register_sql_functions(spark)
    reads(spark, sf_dir).createOrReplaceTempView("derived_reads")
    return spark.sql(f"select read_id, rev_comp(right(seq, 20)) as rc, q30_count(qual) as q30, illumina_header(header, '{PREFIX}', 'X') as header, qual_sum(qual) as qual_sum, hamming(left(seq, 20), right(seq, 20)) as far from derived_reads")


# --- jobs: files, reports, checks, streams ---

OPTIONS = {"flowcell": "FC01", "lane": "L01", "instrument": "instrument_1", "run": "20231212"}
_FILE = "case row_ix when 25 then 'Undetermined' when 26 then 'Ambiguous' else sample_id || '_S' || (row_ix + 1) end || '_L01_R{0}_001.fastq.gz'"


def _options() -> jobs.Options:
    return jobs.Options(info=runinfo.RunInfo(**OPTIONS))


@_query(f"""with {matches_sql(DUAL, 1)}, named as (select r.*, a.row_ix, a.barcode, a.umi, s.sample_id from reads r join assigned a using (read_id) left join sheet s using (row_ix)),
    own as (select read_id, {_FILE.format(2)} as out_file, case when row_ix < 25 then {_ILLUMINA} || ':' || umi || ' 2:N:0:' || barcode else header end as header, case when row_ix < 25 then substr(seq, 1, 40) else seq end as seq, case when row_ix < 25 then substr(qual, 1, 40) else qual end as qual from named),
    mates as (select read_id, {_FILE.format(1)} as out_file, case when row_ix < 25 then {_ILLUMINA} || ':' || umi || ' 1:N:0:' || barcode else r1_header end as header, r1_seq as seq, r1_qual as qual from named)
    select out_file, cast(row_number() over (partition by out_file order by read_id) - 1 as bigint) as place, header, seq, qual from (select * from own union all select * from mates)""")
def demux_files(spark, sf_dir):
    """The records of all files that the demultiplexing job writes, as they are read back."""
    s, o = sheet(spark, sf_dir), _options()
    folder = fastq.scratch_dir(spark, "demux")
    writers.write_fastq(jobs.output_records(assigned(spark, sf_dir), s, o, True), folder, ["read_id"])
    back = fastq.read_fastq(spark, folder)
    return back.select(F.url_decode(F.substring_index("file", "/", -1)).alias("out_file"), F.col("read_id").alias("place"), "header", "seq", "qual")


_plain = lambda x: f"rtrim(rtrim(printf('%.6f', {x} / 1e6), '0'), '.')"
_three = lambda x: f"coalesce(printf('%.3f', {x}), 'NaN')"
_line = lambda *x: " || chr(9) || ".join(x)
_div = lambda a, b: f"(cast({a} as double) / nullif(cast({b} as double), 0))"


def _reports_oracle() -> str:
    scopes = "select '' as prefix, row_ix, sample_id, role, all_reads, {0} from per_sample union all select job_number || '_' as prefix, row_ix, sample_id, role, all_reads, {0} from per_sample where role = 'sample'"
    measures = ", ".join([f"r{i}_{n}" for n in ("qc_30", "bases", "qc") for i in (1, 2, 3)] + ["mm0", "mm1"])
    head = lambda name, place, text: f"select distinct prefix || 'FC01.L01.readloom.{name}' as name, {place} as place, '{text}' as line from scoped"
    tab = "' || chr(9) || '"
    order = "row_number() over (partition by prefix order by all_reads desc, row_ix)"
    info = f"select prefix || 'FC01.L01.readloom.info' as name, {order} as place, {_line('sample_id', 'mm0', 'mm1')} as line from scoped"
    sums = "select prefix, sum(r1_bases + r2_bases) as bases, sum(all_reads) as n, sum(r1_qc_30 + r2_qc_30) as q30, sum(r1_qc + r2_qc) as qc, sum(mm0) filter (where role = 'sample') as perfect, sum(all_reads) filter (where role = 'sample') as assigned from scoped group by prefix"
    lane = f"select prefix || 'FC01.L01.readloom.general' as name, 2 as place, {_line(chr(39) + 'FC01-L01' + chr(39), _plain('bases'), _plain('n'), _three(_div('q30', 'bases') + ' * 100'), _three(_div('qc', 'bases')), _three(_div('perfect', 'assigned') + ' * 100'))} as line from ({sums})"
    share = lambda a, b: _three(f"coalesce({_div(a, b)}, 0.0) * 100")
    one = f"select prefix || 'FC01.L01.readloom.general' as name, 4 + {order} as place, {_line('sample_id', _plain('all_reads'), _plain('(r1_qc_30 + r2_qc_30)'), *(share(f'r{i}_qc_30', f'r{i}_bases') for i in (1, 2, 3)), share('mm0', 'all_reads'))} as line from scoped"
    table = f"select 'FC01.L01.readloom.sample_stats' as name, row_number() over (order by row_ix) as place, {_line('job_number', 'sample_id', *stats.MEASURES, 'mm0', 'mm1')} as line from per_sample"
    barcodes = "select row_ix, barcode, count(*) as n, row_number() over (partition by row_ix order by count(*) desc, barcode desc) as place from assigned where row_ix >= 25 group by row_ix, barcode"
    kind = "'FC01.L01.readloom.' || case row_ix when 25 then 'undetermined' else 'ambiguous' end || '_barcode"
    listed = [f"select {kind}{x}' as name, place - 1 as place, barcode || chr(9) || n as line from ({barcodes}) where {w}" for x, w in (("", "place <= 20"), (".complete", "true"))]
    heads = [
        head("info", 0, tab.join(("sample", "0-mismatches", "1-mismatches"))), head("general", 0, "#Lane statistics"), head("general", 3, "#sample general info"),
        head("general", 1, tab.join(("Run ID-Lane", "Mb Total Yield", "M Total Clusters", "% bases ≥ Q30", "Mean Quality", "% Perfect Index"))),
        head("general", 4, tab.join(("Sample ID", "M Clusters", "Mb Yield ≥ Q30", "% R1 Yield ≥ Q30", "% R2 Yield ≥ Q30", "% R3 Yield ≥ Q30", "% Perfect Index"))),
        f"select 'FC01.L01.readloom.sample_stats' as name, 0 as place, '{tab.join(('job_number', 'sample_id', *stats.MEASURES, '0-mismatches', '1-mismatches'))}' as line",
    ]
    parts = " union all ".join(f"({x})" for x in [*heads, info, lane, one, table, *listed])
    return f"{_STATS}, scoped as ({scopes.format(measures)}) select name, cast(place as int) as place, line from ({parts})"


@_query(_reports_oracle())
def demux_reports(spark, sf_dir):
    """The lines of all reports that the demultiplexing job writes."""
    s, folder = sheet(spark, sf_dir), fastq.scratch_dir(spark, "reports")
    store.make_folder(folder)
    jobs.write_reports(assigned(spark, sf_dir), s, folder, _options(), "r1_qual")
    texts = spark.read.text(folder, wholetext=True).select(F.url_decode(F.substring_index(F.col("_metadata.file_path"), "/", -1)).alias("name"), "value")
    return texts.select("name", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("place", "line"))


@_query("select cast(n_nationkey as int) as row_ix, ['', 'indexes twice', 'letters', 'no template', 'no i5', 'index length', 'no i7 column'][cast(n_nationkey as int) % 7 + 1] as fault, n_nationkey % 7 = 0 as accepted from nation")
def sheet_checks(spark, sf_dir):
    """Sheets of two samples, each with one fault, as the reader and the planner judge them."""
    rows = sorted(sheet_rows(spark, sf_dir).collect())
    faults = ("", "indexes twice", "letters", "no template", "no i5", "index length", "no i7 column")
    out = []
    for k, r in enumerate(rows):
        fault, other = faults[k % 7], rows[k - 1]
        columns = ["sample_id", "i7", "i5", "template"]
        cells = [[r.sample_id, r.i7, r.i5, "i78:um4:i58"], [other.sample_id, other.i7, other.i5, "i78:um4:i58"]]
        if fault == "indexes twice":
            cells[1][1:3] = cells[0][1:3]
        elif fault == "no i7 column":
            columns[1] = "i9"
        elif fault:
            at, value = {"letters": (1, "ACGTACGX"), "no template": (3, MISSING), "no i5": (2, MISSING), "index length": (1, "ACGTACG")}[fault]
            cells[1][at] = value
        try:
            build_sheet(parse_sheet(["\t".join(x) for x in (columns, *cells)]))
            accepted = True
        except SheetError:
            accepted = False
        out.append((r.row_ix, fault, accepted))
    return local_frame(spark, out, "row_ix int, fault string, accepted boolean")


@_query(f"""with reads as ({reads_sql()}), bad as (select read_id, header, r1_header, case when read_id % 11 = 0 then seq || 'X' else seq end as seq, qual, case when read_id % 13 = 0 then substr(r1_seq, 2) else r1_seq end as r1_seq, r1_qual, case when read_id % 7 = 0 then 'x' else '' end as extra from reads)
    select case when read_id % 11 = 0 then 'bases' when read_id % 13 = 0 then 'mate length' when read_id % 7 = 0 then 'mates have different headers' end as problem, count(*) as n from bad group by 1""")
def validate_errors(spark, sf_dir):
    """What the job's validation of pairs raises, counted."""
    spoilt = reads(spark, sf_dir).selectExpr("header", "if(read_id % 11 = 0, seq || 'X', seq) as seq", "qual", "if(read_id % 7 = 0, r1_header || 'x', r1_header) as r1_header", "if(read_id % 13 = 0, substr(r1_seq, 2), r1_seq) as r1_seq", "r1_qual")
    return spoilt.groupBy(jobs.problem_of(True, True).alias("problem")).agg(F.count("*").alias("n"))


def _stream(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    path = fastq.scratch_dir(spark, "arriving")
    arriving = reads(spark, sf_dir).select("read_id", *columns) if columns else spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(ts as timestamp) as ts", "cast(event_id % 25 as int) as row_ix")
    arriving.repartition(3).write.parquet(path)
    return spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 1).parquet(path)


@_query(f"{_STATS} select job_number, sample_id, {_MEASURES}, mm0, mm1 from per_sample")
def stream_sample_stats(spark, sf_dir):
    """The statistics of reads that arrive in three micro-batches, summed up."""
    s = sheet(spark, sf_dir)
    at, checkpoint = (fastq.scratch_dir(spark, x) for x in ("batches", "stream"))
    lanes.start_statistics(_stream(spark, sf_dir, "seq", "qual", "r1_qual"), s, at, checkpoint, mate_qual="r1_qual").awaitTermination()
    rows = stats.per_sample(lanes.totals(spark, at), s.frame(spark))
    return stats.sample_statistics(rows, M).toDF("job_number", "sample_id", *stats.MEASURES, "mm0", "mm1")


@_query("select strftime(time_bucket(interval '10 minutes', ts), '%Y-%m-%d %H:%M:%S') as arrived, cast(event_id % 25 as int) as row_ix, count(*) as n from events group by all")
def stream_arrivals(spark, sf_dir):
    """Reads by arrival window and sample, of a stream that has ended."""
    name = f"arrivals_{uuid.uuid4().hex}"
    counts = lanes.arrivals(_stream(spark, sf_dir), late="36500 days")
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", fastq.scratch_dir(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("arrived"), "row_ix", "n")


del _m
