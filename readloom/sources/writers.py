"""Sinks: FASTQ files by sample under exact names, and text reports.

FASTQ is written in two steps. Tasks compress their sorted share of each file as gzip members, under a name of each attempt's
own; then tasks, one for each file, join its members in order, which needs no decompression, as gzip members may follow each
other. The driver gets the members' names alone. The output folder may lie in any store of readloom.sources.store.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from readloom.plans.session import local_frame
from readloom.sources import store
from readloom.sources.fastq import gzip_member

MEMBER_READS = 20_000
PARTS = "_parts"


def illumina_file(sample: str, number: int | None, lane: str, mate: int) -> str:
    """Pseudo-samples have no number."""
    return f"{sample}_{f'S{number}_' if number else ''}{lane}_R{mate}_001.fastq.gz"


def mgi_file(sample: str, lane: str, mate: int) -> str:
    return f"{sample}_{lane}_R{mate}.fastq.gz"


def prepare_folder(path: str, force: bool = False) -> str:
    """A new folder, or, with force, an existing one."""
    if store.names(path) and not force:
        raise FileExistsError(f"{path} exists; force writes into it")
    store.make_folder(path)
    return path


def clean_outputs(folder: str, names: Iterable[str]) -> None:
    """Removes what a run may write, so that nothing of an earlier run stays beside it."""
    there = set(store.names(folder))
    for name in set(names) & there:
        store.remove_file(store.joined(folder, name))


def _members(folder: str, level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Writes a partition's share of each file; rows come file by file."""
    context = TaskContext.get()
    part, own = context.partitionId(), f"{context.partitionId():06d}-{context.taskAttemptId()}"
    done: list[tuple[str, int, str, int]] = []
    at, out, n, held = None, None, 0, []

    def flush() -> None:
        nonlocal held, n
        if held:
            out.write(gzip_member(held, level))
            n, held = n + len(held), []

    def close() -> None:
        if out is not None:
            flush()
            out.close()
            done.append((at, part, path, n))

    path = ""
    for batch in batches:
        for file, *record in zip(*(batch.column(c).to_pylist() for c in ("out_file", "header", "seq", "qual"))):
            if file != at:
                close()
                folder_ = store.joined(folder, f"{PARTS}/{file}")
                store.make_folder(folder_)
                path, at, n = store.joined(folder_, own), file, 0
                fs, key = store.located(path)
                out = fs.open_output_stream(key, compression=None)
            held.append(tuple(record))
            if len(held) >= MEMBER_READS:
                flush()
    close()
    columns = list(zip(*done)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["out_file", "part", "path", "n"])


def _join(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    attempt = TaskContext.get().taskAttemptId()
    for batch in batches:
        for name, paths in zip(batch.column("out_file").to_pylist(), batch.column("paths").to_pylist()):
            store.join_files(paths, store.joined(folder, name), store.joined(folder, f"{PARTS}/{name}-{attempt}"))
        yield batch.select(["out_file"])


def _joined(spark, folder: str, parts: list) -> None:
    """Joins parts (out_file, part, path), one task for each file."""
    files: dict[str, list] = {}
    for r in sorted(parts, key=lambda r: r.part):
        files.setdefault(r.out_file, []).append(r.path)
    if files:
        frame = local_frame(spark, sorted(files.items()), "out_file string, paths array<string>")
        frame.repartition(len(files), "out_file").mapInArrow(lambda it: _join(folder, it), "out_file string").collect()
    store.remove_folder(store.joined(folder, PARTS))


def write_fastq(records: DataFrame, folder: str, order: list[Column | str], partitions: int | None = None, level: int = 1) -> dict[str, int]:
    """records: out_file, header, seq, qual. Returns the reads of each file. Files hold their reads by order; a file of any
    size is spread over tasks by range."""
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    store.make_folder(folder)
    ranged = records.repartitionByRange(n, "out_file", *order).sortWithinPartitions("out_file", *order)
    parts = ranged.select("out_file", "header", "seq", "qual").mapInArrow(lambda it: _members(folder, level, it), "out_file string, part int, path string, n long").collect()
    counts: dict[str, int] = {}
    for r in parts:
        counts[r.out_file] = counts.get(r.out_file, 0) + r.n
    _joined(spark, folder, parts)
    return counts


def _text_parts(folder: str, name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    path = store.joined(folder, f"{PARTS}/{name}/{context.partitionId():06d}-{context.taskAttemptId()}")
    out, n = None, 0
    for batch in batches:
        if batch.num_rows and out is None:
            store.make_folder(store.joined(folder, f"{PARTS}/{name}"))
            fs, key = store.located(path)
            out = fs.open_output_stream(key, compression=None)
        for line in batch.column("line").to_pylist():
            out.write(f"{line}\n".encode())
            n += 1
    if out is not None:
        out.close()
    yield pa.RecordBatch.from_pydict({"out_file": [name] * (n > 0), "part": [context.partitionId()] * (n > 0), "path": [path] * (n > 0)}, pa.schema([("out_file", pa.string()), ("part", pa.int32()), ("path", pa.string())]))


def write_lines(rows: DataFrame, folder: str, name: str) -> str | None:
    """The rows of any number, in their order, as tab-separated lines of one file, written by tasks; no file without rows."""
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]
    parts = rows.select(F.concat_ws("\t", *shown).alias("line")).mapInArrow(lambda it: _text_parts(folder, name, it), "out_file string, part int, path string").collect()
    _joined(rows.sparkSession, folder, parts)
    return store.joined(folder, name) if parts else None


# --- text reports ---


def plain(x: float) -> str:
    """The shortest decimal form without an exponent; whole numbers without a point."""
    return str(int(x)) if x == int(x) else format(Decimal(repr(float(x))), "f")


def three(x: float | None) -> str:
    """Three decimals; NaN for a share of nothing."""
    return "NaN" if x is None or x != x else f"{x:.3f}"


def tsv(rows: DataFrame, header: bool = True) -> str:
    lines = ["\t".join(rows.columns)] if header else []
    lines += ["\t".join("" if v is None else str(v) for v in r) for r in rows.collect()]
    return "".join(x + "\n" for x in lines)


def general_text(lane: DataFrame, samples: DataFrame) -> str:
    """The lane block, then the sample block."""
    shown = lambda r, n: "\t".join([str(r[0]), *(plain(v or 0) for v in r[1:n]), *(three(v) for v in r[n:])]) + "\n"
    out = "#Lane statistics\n" + "\t".join(lane.columns) + "\n" + "".join(shown(r, 3) for r in lane.collect())
    return out + "#sample general info\n" + "\t".join(samples.columns) + "\n" + "".join(shown(r, 3) for r in samples.collect())


def write_text(folder: str, name: str, text: str) -> str:
    path = store.joined(folder, name)
    store.write_bytes(path, text.encode())
    return path
