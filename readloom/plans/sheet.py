"""Sample sheets: reading, checks, and the catalogue of templates. Sheets are small and live on the driver."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from readloom.plans.session import local_frame
from readloom.plans.template import Template, parse_template

# fixed values: the columns of a sample sheet
COLUMNS = ("sample_id", "i7", "i5", "template", "i7_rc", "i5_rc", "job_number")
MISSING = "."
UNDETERMINED, AMBIGUOUS = "Undetermined", "Ambiguous"
_COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


class SheetError(ValueError):
    pass


def reverse_complement(seq: str) -> str:
    s = seq.upper()
    if re.search("[^ACGTN]", s):
        raise SheetError(f"not a base sequence: {seq!r}")
    return s[::-1].translate(_COMPLEMENT)


@dataclass(frozen=True)
class Sample:
    row: int
    sample_id: str
    i7: str
    i5: str = MISSING
    template: str = MISSING
    i7_rc: str = MISSING
    i5_rc: str = MISSING
    job_number: str = MISSING


@dataclass
class Entry:
    """A template with the index pairs of its samples, as they are read: rank 0 has the most samples."""

    rank: int
    template: Template
    dual: bool
    pairs: dict[tuple[str, str | None], int] = field(default_factory=dict)


@dataclass
class Sheet:
    samples: list[Sample]
    catalogue: list[Entry]

    @property
    def barcode_length(self) -> int:
        return self.catalogue[0].template.length if self.catalogue else 0

    @property
    def unique_ids(self) -> bool:
        return len({s.sample_id for s in self.samples}) == len(self.samples)

    def sample_numbers(self) -> dict[str, int]:
        """S-numbers: the order of the distinct sample ids."""
        out: dict[str, int] = {}
        for s in self.samples:
            out.setdefault(s.sample_id, len(out) + 1)
        return out

    def canonical_rows(self) -> dict[int, int]:
        """For each row, the first row with its sample id, whose files it shares."""
        first: dict[str, int] = {}
        return {s.row: first.setdefault(s.sample_id, s.row) for s in self.samples}

    def projects(self) -> dict[str, list[int]]:
        """The rows of each job number; under '.', an empty list, which stands for all samples."""
        out: dict[str, list[int]] = {MISSING: []}
        for s in self.samples:
            if s.job_number != MISSING:
                out.setdefault(s.job_number, []).append(s.row)
        return out

    def frame(self, spark: SparkSession, undetermined: str = UNDETERMINED, ambiguous: str = AMBIGUOUS) -> DataFrame:
        """row_ix, sample_id, job_number, role (sample, undetermined, ambiguous); the pseudo-samples come last."""
        n = len(self.samples)
        rows = [(s.row, s.sample_id, s.job_number, "sample") for s in self.samples]
        rows += [(n, undetermined, MISSING, "undetermined"), (n + 1, ambiguous, MISSING, "ambiguous")]
        return local_frame(spark, rows, "row_ix int, sample_id string, job_number string, role string")


def parse_sheet(lines: Iterable[str]) -> list[Sample]:
    """The first line of five characters or more is the header: names in any case and order, by tabs or else commas. Other
    columns are ignored; missing ones and missing trailing cells read as '.'. Shorter lines are skipped."""
    rows = [line.rstrip("\r\n") for line in lines]
    rows = [r for r in rows if len(r.strip()) >= 5]
    if not rows:
        raise SheetError("the sample sheet is empty")
    separator = "\t" if "\t" in rows[0] else ","
    names = [c.strip().lower() for c in rows[0].split(separator)]
    for name in ("sample_id", "i7"):
        if name not in names:
            raise SheetError(f"the sample sheet has no column {name}")
    out = []
    for number, line in enumerate(rows[1:]):
        cells = dict(zip(names, (c.strip() for c in line.split(separator))))
        out.append(_checked(Sample(number, *(cells.get(c) or (MISSING if c != "sample_id" else "") for c in COLUMNS))))
    if not out:
        raise SheetError("the sample sheet has no samples")
    return out


def _checked(s: Sample) -> Sample:
    where = f"sample sheet row {s.row + 1}"
    if not s.sample_id:
        raise SheetError(f"{where}: sample_id is missing")
    if not re.fullmatch("[ACGT]{3,}", s.i7):
        raise SheetError(f"{where}: i7 must be three bases or more, not {s.i7!r}")
    if s.i5 != MISSING and not re.fullmatch("[ACGT]{3,}", s.i5):
        raise SheetError(f"{where}: i5 must be '.' or three bases or more, not {s.i5!r}")
    for flag in (s.i7_rc, s.i5_rc):
        if flag not in (MISSING, "0", "1"):
            raise SheetError(f"{where}: rc flags are 0, 1 or '.', not {flag!r}")
    return s


def load_sheet(spark: SparkSession, path: str) -> list[Sample]:
    """A sheet from any file system that Spark reads."""
    return parse_sheet("".join(text for _, text in spark.sparkContext.wholeTextFiles(path, 1).collect()).splitlines())


def build_sheet(samples: list[Sample], template: str | None = None, i7_rc: bool = False, i5_rc: bool = False) -> Sheet:
    """The catalogue of templates, by number of samples (ties by text). A general template replaces those of the sheet, and
    only with it do the rc arguments count."""
    if template:
        samples = [replace(s, template=template, i7_rc=str(int(i7_rc)), i5_rc=str(int(i5_rc))) for s in samples]
    for s in samples:
        if s.template == MISSING:
            raise SheetError(f"sample {s.sample_id} has no template")
    counts = Counter(s.template for s in samples)
    entries = []
    for rank, (text, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))):
        parsed = parse_template(text)
        entry = Entry(rank, parsed, parsed.i5 is not None)
        for s in samples:
            if s.template != text:
                continue
            if entry.dual and s.i5 == MISSING:
                raise SheetError(f"sample {s.sample_id} needs i5 for template {text}")
            i7 = reverse_complement(s.i7) if s.i7_rc == "1" else s.i7
            i5 = (reverse_complement(s.i5) if s.i5_rc == "1" else s.i5) if entry.dual else None
            if len(i7) != parsed.i7.length or entry.dual and len(i5) != parsed.i5.length:
                raise SheetError(f"the indexes of sample {s.sample_id} don't have the lengths of template {text}")
            if (i7, i5) in entry.pairs:
                raise SheetError(f"samples {samples[entry.pairs[i7, i5]].sample_id} and {s.sample_id} have the same indexes")
            entry.pairs[i7, i5] = s.row
        entries.append(entry)
    if len({e.template.length for e in entries}) > 1:
        raise SheetError("templates differ in their total length")
    return Sheet(samples, entries)
