"""Rewrites the headers of reads that were split by sample before, and counts their mismatches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from readloom.functions.columns import hamming, raw_header, split_header, trimmed

MOST_MISMATCHES = 4


def header_barcode(header: Column | str) -> Column:
    """What follows the last colon of a split header."""
    return F.substring_index(F.col(header) if isinstance(header, str) else header, ":", -1)


def reformat_reads(reads: DataFrame, umi_length: int = 0, barcode: str | Column | None = None) -> DataFrame:
    """reads: header, seq, qual. Adds umi (the read's last bases), mm (to the given barcode, one for all or a column, at most
    MOST_MISMATCHES; 0 without one or for raw headers), new_header, new_seq and new_qual (without the UMI)."""
    umi = F.right(F.col("seq"), F.lit(umi_length)) if umi_length else F.lit("")
    split = F.instr("header", " ") > 0
    seen = header_barcode("header")
    own = F.lit(barcode) if isinstance(barcode, str) else barcode
    far = F.when(F.length(seen) == F.length(own), F.least(hamming(seen, own), F.lit(MOST_MISMATCHES))).otherwise(MOST_MISMATCHES) if own is not None else F.lit(0)
    return reads.withColumns({
        "umi": umi, "mm": F.when(split, far).otherwise(0), "new_header": F.when(split, split_header("header", umi)).otherwise(raw_header("header", umi, own)),
        "new_seq": trimmed("seq", umi_length), "new_qual": trimmed("qual", umi_length),
    })


def sample_of_file(path: str) -> tuple[str, str, str]:
    """flowcell, lane and sample label of a split file's name: flowcell_lane_label..._mate."""
    stem = re.sub(r"\.(fq|fastq)(\.gz)?$", "", path.replace("\\", "/").rpartition("/")[2])
    parts = stem.split("_")
    if len(parts) < 4:
        raise ValueError(f"{path!r} is not named flowcell_lane_sample_mate")
    return parts[0], parts[1], "_".join(parts[2:-1])
