"""What a run says about itself: information files, file names, first reads."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

from readloom.sources import store

# fixed values: the keys of a run information file
MACHINE, DATES, TIMES = "Machine ID,", ("Sequence Date,", "Sequence Start Date,"), ("Sequence Time,", "Sequence Start Time,")
R1_SUFFIX, R2_SUFFIX = "_read_1.fq.gz", "_read_2.fq.gz"


def parse_info(lines: Iterable[str]) -> tuple[str, str]:
    """Instrument and run id; the run is the date without dashes and the time without colons."""
    instrument = date = time = ""
    for line in lines:
        key, _, value = line.strip().partition(",")
        if key + "," == MACHINE:
            instrument = value.strip()
        elif key + "," in DATES:
            date = value.strip().replace("-", "")
        elif key + "," in TIMES:
            time = value.strip().replace(":", "")
    return instrument, date + time


def find_info_file(given: str | None, barcode_read: str) -> str | None:
    """The given file, or BioInfo.csv beside the barcode read."""
    if given:
        if not store.is_file(given):
            raise FileNotFoundError(given)
        return given
    beside = store.joined(os.path.dirname(barcode_read), "BioInfo.csv")
    return beside if store.is_file(beside) else None


def lane_of_file(path: str) -> str:
    """The second part of a name such as FC01_L01_read_2.fq.gz, if it is a lane; else ''."""
    parts = os.path.basename(path).split("_")
    return parts[1] if len(parts) > 1 and parts[1].startswith("L0") else ""


def find_reads(folder: str, r1_suffix: str = R1_SUFFIX, r2_suffix: str = R2_SUFFIX) -> tuple[str, str]:
    """The read files of a folder; the second is '' for single-end data."""
    there = store.names(folder)
    found = {s: [n for n in there if n.endswith(s)] for s in (r1_suffix, r2_suffix)}
    for suffix, names in found.items():
        if len(names) > 1:
            raise ValueError(f"{folder} has several files *{suffix}")
    paths = [store.joined(folder, names[0]) for names in found.values() if names]
    if not paths:
        raise FileNotFoundError(f"{folder} has no reads *{r1_suffix} or *{r2_suffix}")
    return paths[0], paths[1] if len(paths) > 1 else ""


def roles(read1: str, read2: str = "") -> tuple[str, str | None]:
    """The file with the barcodes and its mate: read 2 and read 1, or read 1 alone."""
    for p in filter(None, (read1, read2)):
        if not store.is_file(p):
            raise FileNotFoundError(p)
    return (read2, read1) if read2 else (read1, None)


@dataclass
class RunInfo:
    flowcell: str = ""
    lane: str = ""
    instrument: str = ""
    run: str = ""

    def checked(self, illumina: bool, mgi: bool) -> RunInfo:
        """An Illumina header needs MGI input and all four parts."""
        if illumina:
            if not mgi:
                raise ValueError("Illumina headers need MGI input; disable them for other input")
            missing = [n for n in ("flowcell", "lane", "instrument", "run") if not getattr(self, n)]
            if missing:
                raise ValueError(f"Illumina headers need {', '.join(missing)}")
        return self


def flowcell_and_lane(header: str) -> tuple[str, str]:
    """By the last L of an MGI header; the lane is written L0n."""
    m = re.match(r"^@(.*)L(.)[^L]*$", header)
    if not m:
        raise ValueError(f"{header!r} is not an MGI header")
    return m[1], f"L0{m[2]}"
