"""Ranges of bytes of files, read inside tasks, so that one large file is many tasks and never a row of its own.

Spark's binaryFile source makes a file one row of at most 2 GiB.  Here tasks
open files themselves with Arrow's file systems (local, hdfs, s3, gs) and read
what they need.  A store that only Spark reads still works file by file:
``content`` sources take the whole file as bytes.
"""

from __future__ import annotations

import re

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


class Content:
    """A file that is in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, size: int) -> bytes:
        return self.data[at : at + size]


class File:
    """A file of a store, read by ranges; small neighbouring reads come from one block."""

    BLOCK = 1 << 16

    def __init__(self, path: str):
        system, inner = file_system(path)
        self._file = system.open_input_file(inner)
        self.size = self._file.size()
        self._at, self._kept = 0, b""

    def read(self, at: int, size: int) -> bytes:
        if size >= self.BLOCK:
            return self._file.read_at(size, at)
        if not (self._at <= at and at + size <= self._at + len(self._kept)):
            self._at, self._kept = at, self._file.read_at(min(self.BLOCK, max(0, self.size - at)), at)
        return self._kept[at - self._at : at - self._at + size]

    def close(self) -> None:
        self._file.close()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path as Spark lists it: file:/a, file:///a, /a, hdfs://..., s3://..."""
    local = re.fullmatch(r"(?:file:)?(/.*)", re.sub(r"^file:/+", "file:/", path))
    if local:
        return pafs.LocalFileSystem(), local[1]
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length) of the files of a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (files.option("pathGlobFilter", glob) if glob else files).load(path).select("path", "length")
