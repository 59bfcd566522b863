"""Lines of text files with the byte at which each begins, as a Spark data source.

``(_file, _offset, value)``: file and offset name a line whatever blocks the files are read in, so that two readings
of one folder, under any number of cores or split size, agree on every line.  A task reads the lines that begin in its block
of a file, and hands them on in Arrow batches.  Lines end at ``\\n``, ``\\r\\n`` or ``\\r``; a byte-order mark at a file's
beginning is left out.  Compressed files (.gz, .bz2, .zst) are one block, offsets are those of their content.

Folders are listed without hidden files (``_`` or ``.`` first), and ``*``, ``?`` and ``[...]`` stand for names in a path's last
part.  Paths of any file system that pyarrow opens by its URI can be read on executors and the driver alike.
"""

from __future__ import annotations

import codecs
import fnmatch
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_BYTES = 32 << 20
BATCH_LINES = 1 << 16
_SCHEMA = "_file string, _offset long, value string"
_END = re.compile(rb"\r\n|\n|\r")
_MORE = 1 << 20


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _compressed(path: str) -> bool:
    return path.endswith((".gz", ".bz2", ".zst"))


def _hidden(path: str) -> bool:
    return path.rsplit("/", 1)[-1].startswith(("_", "."))


def list_files(path: str) -> list[tuple[str, str, int]]:
    """(path as Spark names it, path in its file system, bytes) of the files at a path, by name."""
    from pyarrow import fs

    system, inner = _file_system(path)
    inner = inner.rstrip("/")
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound and any(c in inner for c in "*?["):
        folder, name = inner.rsplit("/", 1)
        every = [f for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatchcase(f.base_name, name)]
    elif info.type == fs.FileType.Directory:
        every = system.get_file_info(fs.FileSelector(inner))
    elif info.type == fs.FileType.File:
        every = [info]
    else:
        raise FileNotFoundError(path)
    prefix = path[:len(path.rstrip("/")) - len(inner)] if "://" in path else ""
    found = [(prefix + f.path, f.path, f.size) for f in every if f.type == fs.FileType.File and not _hidden(f.path)]
    return sorted(found)


class Block(InputPartition):
    def __init__(self, name: str, start: int, end: int | None) -> None:
        self.name, self.start, self.end = name, start, end


def block_lines(read, start: int, end: int | None, mark: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end); ``read(at, size)`` gives bytes of the file.  Without an
    end the file is read in pieces to its last byte."""
    at = start  # where ``data`` begins
    data = read(at - 1, 1 + _MORE) if start else read(0, max(_MORE, len(mark)))
    if start:
        before, data = data[:1], data[1:]
        if before == b"\r" and data[:1] == b"\n" or before not in (b"\r", b"\n"):
            while True:  # the line before runs into this block
                m = _END.search(data)
                if m and (m.end() < len(data) or m.group() != b"\r"):
                    break
                more = read(at + len(data), _MORE)
                if not more:
                    if not m:
                        return
                    break
                if not m:
                    at, data = at + len(data) - data.endswith(b"\r"), (b"\r" if data.endswith(b"\r") else b"") + more
                else:
                    data += more
            at, data = at + m.end(), data[m.end():]
    elif data.startswith(mark):
        at, data = len(mark), data[len(mark):]
    place = 0  # of the next line in ``data``
    searched = 0
    while end is None or at + place < end:
        m = _END.search(data, max(place, searched))
        if m is None or m.end() == len(data) and m.group() == b"\r":
            more = read(at + len(data), _MORE)
            if more:
                searched = max(0, len(data) - place - 1)
                at, data, place = at + place, data[place:] + more, 0
                continue
            if m is None:
                if place < len(data):
                    yield at + place, data[place:]
                return
        yield at + place, data[place:m.start()]
        place, searched = m.end(), 0


class LineReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"])
        self.block = max(64, int(options.get("block_bytes", BLOCK_BYTES)))
        self.encoding = codecs.lookup(options.get("encoding", "UTF-8")).name

    def partitions(self) -> list[Block]:
        out: list[Block] = []
        for path in self.paths:
            for name, _, size in list_files(path):
                if _compressed(name) or self.encoding.startswith(("utf-16", "utf-32")):
                    out.append(Block(name, 0, None))
                else:
                    out += [Block(name, at, min(size, at + self.block)) for at in range(0, size, self.block)]
        return out or [Block("", 0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, inner = _file_system(partition.name)
        if partition.end is None:
            with system.open_input_stream(inner) as stream:
                whole = stream if self.encoding.startswith("utf-8") or _compressed(partition.name) else None
                if whole is None or self.encoding.startswith(("utf-16", "utf-32")):  # read as text at once
                    content = stream.read().decode(self.encoding, "replace").removeprefix("﻿").encode()
                    yield from self._batches(partition.name, block_lines(lambda a, n: content[a:a + n], 0, None, b""), "utf-8")
                else:
                    yield from self._batches(partition.name, block_lines(lambda a, n: stream.read(n), 0, None, self._mark()), self.encoding)
            return
        with system.open_input_file(inner) as file:
            def read(at: int, size: int) -> bytes:
                file.seek(at)
                return file.read(size)

            yield from self._batches(partition.name, block_lines(read, partition.start, partition.end, self._mark()), self.encoding)

    def _mark(self) -> bytes:
        return codecs.BOM_UTF8 if self.encoding.startswith("utf-8") else b"\x00never"

    @staticmethod
    def _batches(name: str, lines: Iterator[tuple[int, bytes]], encoding: str) -> Iterator[pa.RecordBatch]:
        offsets: list[int] = []
        values: list[str] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(offsets, pa.int64()),
                                               pa.array(values, pa.string())], names=["_file", "_offset", "value"])

        size = 0
        for offset, line in lines:
            offsets.append(offset)
            values.append(line.decode(encoding, "replace"))
            size += len(line)
            if len(values) >= BATCH_LINES or size >= _MORE:
                yield batch()
                offsets, values, size = [], [], 0
        if values:
            yield batch()


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "aislekit_lines"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def read_lines(spark: SparkSession, paths: list[str], encoding: str = "UTF-8", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``_file, _offset, value`` of every line of the files at ``paths``."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library
    spark.dataSource.register(LineSource)
    return (spark.read.format(LineSource.name()).option("paths", json.dumps(paths)).option("encoding", encoding)
            .option("block_bytes", str(block_bytes)).load())
