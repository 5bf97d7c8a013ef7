"""Files on shared storage, opened where a task runs: local paths, and URIs of any file system that Arrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from genloom.runtime import shared_dir


def located(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def parts(path: str) -> list[str]:
    """path itself, or where it is a folder its data files in order of their names."""
    system, at = located(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    files = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and f.size and f.base_name[0] not in "._")
    return [f"{path.rstrip('/')}/{n}" for n in files]


def reader(path: str):
    """A seekable binary file."""
    system, at = located(path)
    return system.open_input_file(at)


def writer(path: str):
    system, at = located(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    return system.open_output_stream(at)


def delete_folder(path: str) -> None:
    system, at = located(path)
    if system.get_file_info(at).type == fs.FileType.Directory:
        system.delete_dir(at)


def lines(path: str):
    """The lines of a text file, or of a folder's files one after the other."""
    for p in parts(path):
        with reader(p) as f:
            rest = b""
            while block := f.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from (x.decode() for x in whole)
            if rest:
                yield rest.decode()


def joined(target: str, head: bytes, pieces: list[str]) -> None:
    """target from head and the pieces' bytes, in blocks."""
    with writer(target) as out:
        out.write(head)
        for p in pieces:
            with reader(p) as f:
                while block := f.read(8 << 20):
                    out.write(block)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/genloom/files/{uuid.uuid4().hex}/{name}"
