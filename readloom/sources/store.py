"""Files outside of Spark's own readers and writers, on the driver and in tasks: local or mounted paths, and the stores that
pyarrow knows (file://, s3://, gs://, hdfs://)."""

from __future__ import annotations

import os
from functools import lru_cache

from pyarrow import fs


@lru_cache(maxsize=32)
def _store(scheme: str, host: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(f"{scheme}://{host}/")[0] if scheme else fs.LocalFileSystem()


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path there."""
    if "://" in path:
        scheme, rest = path.split("://", 1)
        host, _, key = rest.partition("/")
        return _store(scheme, host), f"/{key}" if scheme in ("file", "hdfs") else f"{host}/{key}"
    if path.startswith("file:"):
        return _store("", ""), path[5:]
    return _store("", ""), os.path.abspath(path)


def joined(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}" if folder else name


def is_file(path: str) -> bool:
    store, at = located(path)
    return store.get_file_info(at).type == fs.FileType.File


def names(folder: str) -> list[str]:
    """The names in a folder; none if it doesn't exist."""
    store, at = located(folder)
    return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)))


def make_folder(path: str) -> None:
    store, at = located(path)
    store.create_dir(at, recursive=True)


def remove_folder(path: str) -> None:
    store, at = located(path)
    if store.get_file_info(at).type == fs.FileType.Directory:
        store.delete_dir(at)


def remove_file(path: str) -> None:
    if is_file(path):
        store, at = located(path)
        store.delete_file(at)


def write_bytes(path: str, data: bytes) -> None:
    store, at = located(path)
    with store.open_output_stream(at, compression=None) as f:
        f.write(data)


def read_text(path: str) -> str:
    store, at = located(path)
    with store.open_input_stream(at, compression=None) as f:
        return f.read().decode("utf-8")


def join_files(parts: list[str], path: str, own: str) -> None:
    """Puts files together, in order; own is a name of this attempt's, beside path, which becomes path at the end."""
    store, to = located(path)
    _, at = located(own)
    with store.open_output_stream(at, compression=None) as out:
        for part in parts:
            with store.open_input_stream(located(part)[1], compression=None) as f:
                while data := f.read(1 << 22):
                    out.write(data)
    store.move(at, to)
