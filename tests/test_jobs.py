import gzip

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from readloom import cli
from readloom.operators import jobs, stats
from readloom.plans.sheet import Sample, build_sheet
from readloom.sources.fastq import gzip_member, read_fastq, read_pairs
from readloom.sources.runinfo import RunInfo
from readloom.streaming import lanes

I7, I5 = ("ACGTACGT", "TTGGCCAA"), ("GATTACAG", "CCAATTGG")


def header(i, mate):
    return f"@FC01L1C001R002{i:08d}/{mate}"


def fixture(folder, spoil=()):
    """Ten pairs: five of sample A, three of B (one substitution), one far, one mixed."""
    r1, r2 = [], []
    for i in range(10):
        a = 0 if i < 5 else 1
        i7, i5 = I7[a], I5[a]
        if i >= 5:
            i7 = i7[:3] + "N" + i7[4:]
        if i == 8:
            i7, i5 = "NNNNNNNN", "NNNNNNNN"
        if i == 9:
            i5 = I5[0]
        insert = "ACGTACGTAC"
        r1.append((header(i, 1), "TTTTT", "IIII!"))
        r2.append((header(i, 2), insert + i7 + "GGCC" + i5, "I" * 10 + "5" * 20))
    for k, change in spoil:
        r2[k] = change(r2[k])
    folder.mkdir(exist_ok=True)
    (folder / "FC01_L01_read_1.fq.gz").write_bytes(gzip_member(r1))
    (folder / "FC01_L01_read_2.fq.gz").write_bytes(gzip_member(r2[:4]) + gzip_member(r2[4:]))  # two gzip members
    (folder / "BioInfo.csv").write_text("Machine ID,M1\nSequence Date,2023-12-12\nSequence Time,08:15\n")
    (folder / "sheet.tsv").write_text("sample_id\ti7\ti5\ttemplate\tjob_number\n" + "".join(f"{n}\t{I7[k]}\t{I5[k]}\ti78:um4:i58\t{p}\n" for k, (n, p) in enumerate((("A", "p1"), ("B", ".")))))
    return r1, r2


def lines(path):
    with gzip.open(path, "rt") as f:
        return f.read().splitlines()


def test_demultiplex(spark, tmp_path):
    fixture(tmp_path / "in")
    out = tmp_path / "out"
    jobs.demultiplex(spark, str(tmp_path / "in" / "sheet.tsv"), folder=str(tmp_path / "in"), output=str(out), o=jobs.Options(validate=True))
    names = sorted(p.name for p in out.iterdir())
    assert [n for n in names if n.endswith("gz")] == ["A_S1_L01_R1_001.fastq.gz", "A_S1_L01_R2_001.fastq.gz", "B_S2_L01_R1_001.fastq.gz", "B_S2_L01_R2_001.fastq.gz", "Undetermined_L01_R1_001.fastq.gz", "Undetermined_L01_R2_001.fastq.gz"]
    a = lines(out / "A_S1_L01_R2_001.fastq.gz")
    assert a[:4] == ["@M1:202312120815:FC01:1::1:2:GGCC 2:N:0:ACGTACGT+GATTACAG", "ACGTACGTAC", "+", "IIIIIIIIII"] and len(a) == 20
    assert [h[-12:] for h in lines(out / "A_S1_L01_R1_001.fastq.gz")[::4]] == ["CGT+GATTACAG"] * 5
    u = lines(out / "Undetermined_L01_R2_001.fastq.gz")
    assert u[0] == header(8, 2) and len(u[1]) == 30  # as they were
    assert (out / "FC01.L01.readloom.info").read_text() == "sample\t0-mismatches\t1-mismatches\nA\t5\t0\nB\t0\t3\nUndetermined\t2\t0\n"
    assert (out / "p1_FC01.L01.readloom.info").read_text() == "sample\t0-mismatches\t1-mismatches\nA\t5\t0\n"
    general = (out / "FC01.L01.readloom.general").read_text().splitlines()
    assert general[2] == "FC01-L01\t0.00015\t0.00001\t93.333\t37.333\t62.500"
    assert general[5] == "A\t0.000005\t0.00007\t80.000\t100.000\t0.000\t100.000"
    sample = (out / "FC01.L01.readloom.sample_stats").read_text().splitlines()
    assert sample[1].split("\t") == ["p1", "A", "20", "50", "0", "25", "50", "100", "800", "2000", "2000", "5", "5", "0"]
    assert (out / "FC01.L01.readloom.undetermined_barcode").read_text() == "TTGNCCAA+GATTACAG\t1\nNNNNNNNN+NNNNNNNN\t1\n"
    with pytest.raises(FileExistsError):
        jobs.demultiplex(spark, str(tmp_path / "in" / "sheet.tsv"), folder=str(tmp_path / "in"), output=str(out))


def test_force_cleans_earlier_outputs(spark, tmp_path):
    fixture(tmp_path / "in")
    out = tmp_path / "out"
    out.mkdir()
    for name in ("A_S1_L01_R1_001.fastq.gz", "Ambiguous_L01_R1_001.fastq.gz", "FC01.L01.readloom.ambiguous_barcode", "notes.txt"):
        (out / name).write_text("of an earlier run")
    jobs.demultiplex(spark, str(tmp_path / "in" / "sheet.tsv"), folder=str(tmp_path / "in"), output=out.as_uri(), o=jobs.Options(force=True))
    assert len(lines(out / "A_S1_L01_R1_001.fastq.gz")) == 20 and (out / "notes.txt").read_text() == "of an earlier run"
    assert not (out / "Ambiguous_L01_R1_001.fastq.gz").exists() and not (out / "FC01.L01.readloom.ambiguous_barcode").exists() and not (out / "_parts").exists()
    assert (out / "FC01.L01.readloom.undetermined_barcode.complete").read_text() == (out / "FC01.L01.readloom.undetermined_barcode").read_text()


def test_first_records_stop_reading(spark, tmp_path):
    """What follows the first records isn't read: here it isn't FASTQ."""
    (tmp_path / "a b.fq.gz").write_bytes(gzip_member([(f"@r{i}", "ACGT", "IIII") for i in range(9)]) + gzip.compress(b"not\nfastq\nat all\n" * 50_000))
    assert [r.header for r in read_fastq(spark, str(tmp_path / "a b.fq.gz"), 3).collect()] == ["@r0", "@r1", "@r2"]
    assert read_fastq(spark, str(tmp_path), 9).count() == 9


def test_single_end_and_formats(spark, tmp_path):
    fixture(tmp_path / "in")
    o = jobs.Options(illumina=False, mgi_full_header=True, keep_barcode=True, report_level=0, undetermined_label="U")
    jobs.demultiplex(spark, str(tmp_path / "in" / "sheet.tsv"), str(tmp_path / "in" / "FC01_L01_read_2.fq.gz"), output=str(tmp_path / "se"), o=o)
    assert sorted(p.name for p in (tmp_path / "se").iterdir() if p.name.endswith("gz")) == ["A_L01_R1.fastq.gz", "B_L01_R1.fastq.gz", "U_L01_R1.fastq.gz"]
    a = lines(tmp_path / "se" / "A_L01_R1.fastq.gz")
    assert a[0] == f"{header(0, 2)} GGCC 2:N:0:ACGTACGT+GATTACAG" and len(a[1]) == 30
    assert sorted(p.name for p in (tmp_path / "se").iterdir() if "readloom" in p.name) == ["FC01.L01.readloom.info", "p1_FC01.L01.readloom.info"]


def test_not_mgi(spark, tmp_path):
    fixture(tmp_path / "in", [(k, lambda r: ("@anything", *r[1:])) for k in range(10)])
    out = jobs.demultiplex(spark, str(tmp_path / "in" / "sheet.tsv"), str(tmp_path / "in" / "FC01_L01_read_2.fq.gz"), output=str(tmp_path / "o"), o=jobs.Options(mgi=False, illumina=False, report_level=0, info=RunInfo("F", "L01")))
    assert out.filter("row_ix = 0").count() == 5


@pytest.mark.parametrize("change", [lambda r: ("x" + r[0], *r[1:]), lambda r: (r[0], "X" + r[1][1:], r[2]), lambda r: (r[0], r[1], "z" + r[2][1:]), lambda r: ("@FC01L1C009R00200000001/2", *r[1:])])
def test_validation(spark, tmp_path, change):
    fixture(tmp_path / "in", [(6, change)])
    r = read_pairs(spark, str(tmp_path / "in" / "FC01_L01_read_2.fq.gz"), str(tmp_path / "in" / "FC01_L01_read_1.fq.gz"))
    with pytest.raises(PySparkException, match="not valid"):
        jobs.validated(r, True, True).collect()


def test_fastq_source(spark, tmp_path):
    (tmp_path / "a.fq.gz").write_bytes(b"".join(gzip_member([(f"@r{i}", "ACGT", "@III")]) for i in range(5)))
    (tmp_path / "b.fq.gz").write_bytes(gzip_member([("@s0", "A", "I")]))
    rows = sorted((r.file[-7:], r.read_id, r.header, r.qual) for r in read_fastq(spark, str(tmp_path)).collect())
    assert rows == [("a.fq.gz", i, f"@r{i}", "@III") for i in range(5)] + [("b.fq.gz", 0, "@s0", "I")]
    assert read_fastq(spark, str(tmp_path), first=2).count() == 3
    with pytest.raises(PySparkException, match="numbers of reads"):
        read_pairs(spark, str(tmp_path / "a.fq.gz"), str(tmp_path / "b.fq.gz")).collect()
    (tmp_path / "c.fq.gz").write_bytes(gzip.compress(b"@x\nACGT\n+\n"))
    with pytest.raises(PySparkException, match="not whole"):
        read_fastq(spark, str(tmp_path / "c.fq.gz")).collect()


def test_template_command(spark, tmp_path):
    fixture(tmp_path / "in")
    cli_args = ["template", "--input", str(tmp_path / "in"), "--sample-sheet", str(tmp_path / "in" / "sheet.tsv"), "--output", str(tmp_path / "det"), "--barcode-length", "20"]
    args = cli.parser().parse_args(cli_args)
    assert args.testing_reads == 5000 and not args.popular_template
    jobs.detect_template(spark, args.sample_sheet, folder=args.input, prefix=args.output, barcode_length=20)
    assert (tmp_path / "det_template.tsv").read_text().splitlines()[1:] == ["A\tACGTACGT\tGATTACAG\tp1\ti78:um4:i58\t0\t0", "B\tTTGGCCAA\tCCAATTGG\t.\tNo matches with this sample\t.\t."]
    assert (tmp_path / "det_details.tsv").read_text().splitlines()[1] == "A\tACGTACGT\tGATTACAG\t0:12_0:0 (5)\t0:12_1:0 (5)"  # this i7 is its own reverse complement
    jobs.detect_template(spark, args.sample_sheet, folder=args.input, prefix=args.output, barcode_length=20, popular=True, umi=False)
    assert (tmp_path / "det_template.tsv").read_text().splitlines()[2].split("\t")[4] == "i78:--4:i58"


def test_reformat(spark, tmp_path):
    (tmp_path / "FC01_L01_my_sample_1.fq.gz").write_bytes(gzip_member([("@M:1 1:N:0:ACGT", "AAAACC", "IIIIII"), ("@M:2 1:N:0:ACGA", "AAAAGG", "IIIIII"), ("@raw/1", "AAAATT", "IIIIII")]))
    jobs.reformat(spark, str(tmp_path / "FC01_L01_my_sample_1.fq.gz"), output=str(tmp_path / "o"), umi_length=2, barcode="ACGT", sample_index=3)
    got = lines(tmp_path / "o" / "my_sample_S3_L01_R1_001.fastq.gz")
    assert got[::4] == ["@M:1:CC 1:N:0:ACGT", "@M:2:GG 1:N:0:ACGA", "@raw:TT 1:N:0:ACGT"] and got[1] == "AAAA"
    head, row = (tmp_path / "o" / "my_sample.readloom.sample_stats").read_text().splitlines()
    assert head.endswith("all_reads\t0-mismatches\t1-mismatches") and row.endswith("3\t2\t1")
    with pytest.raises(ValueError):
        jobs.reformat(spark, "x", sample_index=0)


def test_merge_reports(spark, tmp_path):
    measures = "\t".join(stats.MEASURES)
    (tmp_path / "FC.L01.sample_stats").write_text(f"job_number\tsample_id\t{measures}\t0-mismatches\n.\tA\t" + "\t".join(["2"] * 10) + "\t2\n.\tUndetermined\t" + "\t".join(["4"] * 10) + "\t4\n")
    (tmp_path / "FC.L02.sample_stats").write_text(f"job_number\tsample_id\t{measures}\t0-mismatches\t1-mismatches\n.\tA\t" + "\t".join(["10"] * 10) + "\t7\t3\n")
    jobs.merge_reports(spark, [str(tmp_path / f"FC.L0{i}.sample_stats") for i in (1, 2)], str(tmp_path / "m"))
    assert (tmp_path / "m" / "FC.all.readloom.info").read_text() == "sample\t0-mismatches\t1-mismatches\nA\t9\t3\nUndetermined\t4\t0\n"
    assert (tmp_path / "m" / "FC.all.readloom.general").read_text().splitlines()[2].split("\t")[-1] == "75.000"  # of real samples


def test_streaming_equals_batch(spark, tmp_path):
    sheet = build_sheet([Sample(0, "a", "AAAA", template="i74"), Sample(1, "b", "GGGG", template="i74")])
    src = str(tmp_path / "src")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).selectExpr("id as read_id", "if(id % 3 = 0, 'CCAAAA', 'CCGGGN') as seq", "'IIIII!' as qual").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("read_id long, seq string, qual string").option("maxFilesPerTrigger", 1).parquet(src)
    lanes.start_statistics(stream, sheet, str(tmp_path / "st"), str(tmp_path / "cp")).awaitTermination()
    batch = stats.read_statistics(jobs.match.assign(spark.read.parquet(src), sheet), 4, 1)
    got = lanes.totals(spark, str(tmp_path / "st"))
    assert sorted(got.select(*[F.col(f"`{c}`") for c in batch.columns]).collect()) == sorted(batch.collect())


def test_cli_has_all_options():
    text = {c: p.format_help() for c, p in cli.parser()._subparsers._group_actions[0].choices.items()}
    assert set(text) == {"demultiplex", "template", "report", "reformat"}
    for option in ("--mismatches", "--per-index-error", "--comprehensive-scan", "--not-mgi", "--in-r1-file-suf", "--report-limit", "--mgi-full-header"):
        assert option in text["demultiplex"]
