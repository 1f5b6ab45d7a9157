import pytest

from readloom.plans.sheet import SheetError, build_sheet, parse_sheet, reverse_complement
from readloom.plans.template import Part, parse_template, render_template
from readloom.sources import runinfo
from readloom.sources.writers import illumina_file, mgi_file, plain, three


def test_parse_template():
    t = parse_template("i78:um8:i58")
    assert (t.i7, t.um, t.i5, t.length) == (Part(8, 24), Part(8, 16), Part(8, 8), 24)
    assert parse_template("um16:i78").i5 is None
    assert parse_template("i78:--8").i7 == Part(8, 16)
    for bad in ("", "i7", "i78:i78", "xx8", "um8", "i7-8"):
        with pytest.raises(ValueError):
            parse_template(bad)


@pytest.mark.parametrize("layout,umi,length,text,flags", [
    ("0:16_0:0", True, 24, "i78:um8:i58", ("0", "0")), ("16:0_1:0", True, 24, "i58:um8:i78", ("1", "0")), ("2:12_0:1", True, 20, "um2:i78:--2:i58", ("0", "1")),
    ("2:13_0:1", True, 21, "--2:i78:um3:i58", ("0", "1")), ("3_0:.", True, 20, "--3:i78:um9", ("0", ".")), ("0:8_0:0", True, 16, "i78:i58", ("0", "0")), ("0:16_0:0", False, 24, "i78:--8:i58", ("0", "0")),
])
def test_render_template(layout, umi, length, text, flags):
    assert render_template(layout, umi, length, 8, 8) == (text, *flags)
    assert parse_template(text).length == length


SHEET = ["short", "Sample_ID\tI7\ti5\tTemplate\tjob_number\textra", "S1\tACGTACGT\tTTTTCCCC\ti78:i58\tp1\tx", "S2\tAAAAACGT\tGGGGCCCC\ti58:i78\t.\ty", "S1\tCCCCACGT\tGGGGCCCA\ti78:i58\tp1", "\n"]


def test_sheet():
    s = build_sheet(parse_sheet(SHEET[1:]))
    assert [(x.sample_id, x.job_number, x.i7_rc) for x in s.samples] == [("S1", "p1", "."), ("S2", ".", "."), ("S1", "p1", ".")]
    assert [(e.rank, e.template.text, e.dual) for e in s.catalogue] == [(0, "i78:i58", True), (1, "i58:i78", True)]
    assert s.sample_numbers() == {"S1": 1, "S2": 2} and s.canonical_rows() == {0: 0, 1: 1, 2: 0} and not s.unique_ids
    assert s.projects() == {".": [], "p1": [0, 2]}
    assert parse_sheet([x.replace("\t", ",") for x in SHEET[1:]]) == s.samples


def test_general_template():
    s = build_sheet(parse_sheet(["sample_id,i7,i5", "a,AACCGGTT,.", "b,ACGTACGA,."]), "i78:--8", i7_rc=True)
    assert list(s.catalogue[0].pairs) == [("AACCGGTT", None), (reverse_complement("ACGTACGA"), None)]


@pytest.mark.parametrize("lines", [
    [], ["sample_id\ti7"], ["i7\ti5\tx", "ACGT\tACGT\t1"], ["sample_id\ti7", "\tACGTA"], ["sample_id\ti7", "a\tACXT"], ["sample_id\ti7", "a\tAC   "], ["sample_id\ti7\ti5", "a\tACGT\tA"],
    ["sample_id\ti7\ti7_rc", "a\tACGT\t2"],
])
def test_bad_sheets(lines):
    with pytest.raises(SheetError):
        parse_sheet(lines)


@pytest.mark.parametrize("lines,template", [
    (["sample_id,i7", "a,ACGTACGT"], None), (["sample_id,i7", "a,ACGTACGT"], "i78:i58"), (["sample_id,i7", "a,ACGTACGT", "b,ACGTACGT"], "i78"), (["sample_id,i7", "a,ACGTACG"], "i78"),
    (["sample_id,i7,template", "a,ACGTACGT,i78", "b,AAAAAAAA,i78:--1"], None),
])
def test_bad_catalogues(lines, template):
    with pytest.raises(SheetError):
        build_sheet(parse_sheet(lines), template)


def test_run_information(tmp_path):
    assert runinfo.parse_info(["Machine ID,M1", "Sequence Date,2023-12-12", "Sequence Time,08:15:00"]) == ("M1", "20231212081500")
    assert runinfo.flowcell_and_lane("@FC01L1C001R00100000001/2") == ("FC01", "L01")
    assert runinfo.lane_of_file("/x/FC01_L02_read_1.fq.gz") == "L02" and runinfo.lane_of_file("FC01_x_1.fq.gz") == ""
    with pytest.raises(ValueError):
        runinfo.RunInfo("F", "L01").checked(illumina=True, mgi=True)
    with pytest.raises(ValueError):
        runinfo.RunInfo("F", "L01", "i", "r").checked(illumina=True, mgi=False)
    with pytest.raises(FileNotFoundError):
        runinfo.find_reads(str(tmp_path))
    (tmp_path / "a_read_1.fq.gz").write_bytes(b"")
    assert runinfo.find_reads(str(tmp_path)) == (str(tmp_path / "a_read_1.fq.gz"), "")
    assert runinfo.roles("", str(tmp_path / "a_read_1.fq.gz"))[0].endswith("fq.gz")


def test_names_and_numbers():
    assert illumina_file("A", 2, "L01", 1) == "A_S2_L01_R1_001.fastq.gz" and illumina_file("Undetermined", None, "L01", 2) == "Undetermined_L01_R2_001.fastq.gz"
    assert mgi_file("A", "L01", 1) == "A_L01_R1.fastq.gz"
    assert [plain(x) for x in (2e-5, 0.0, 3.0, 0.002, 1.25)] == ["0.00002", "0", "3", "0.002", "1.25"]
    assert [three(x) for x in (62.5, None, float("nan"), 1.0005)] == ["62.500", "NaN", "NaN", "1.000"]
