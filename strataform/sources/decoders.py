"""Records of any file format by a pluggable decoder, as a Spark data source with byte-range splits.

A decoder says which records begin in a range of a file; every record belongs to the range it begins in, so wherever the
splits fall each is read once. Two come with the package: ``JsonLines`` and ``LengthPrefixed``. Files are opened by
``pyarrow.fs`` on the executors (local folders that all share, S3, GCS, HDFS), and a split is read as a stream of Arrow
batches, never held whole. For plain JSON lines on any Hadoop path ``sources.documents.JsonLines`` needs no Python.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a split, records of a batch.
SPLIT_BYTES, BATCH = 64 << 20, 1024
FIELDS = "file string, offset long, record string"


class RecordDecoder(Protocol):
    """``name`` tells sources apart; ``decode`` gives (offset, text) of the records of an open file, ``size`` bytes long,
    that begin in [start, end)."""

    name: str

    def decode(self, file, start: int, end: int, size: int) -> Iterator[tuple[int, str]]: ...


@dataclass(frozen=True)
class JsonLines:
    """One record a line, blank lines aside."""

    name: str = "json_lines"
    chunk: int = 1 << 16

    def decode(self, file, start: int, end: int, size: int) -> Iterator[tuple[int, str]]:
        at = max(start - 1, 0)  # a line that ends right before the range begins one in it
        file.seek(at)
        held, skipping = b"", start > 0
        while at < end:
            more = file.read(self.chunk)
            held += more
            lines = held.split(b"\n")
            last = not more
            for line in lines if last else lines[:-1]:
                if skipping:
                    skipping = False
                elif at < end and line.strip():
                    yield at, line.decode("utf-8", "replace")
                at += len(line) + 1
                if at >= end:
                    return
            held = b"" if last else lines[-1]
            if last:
                return


@dataclass(frozen=True)
class LengthPrefixed:
    """Records behind their length in four bytes, big-endian. Ranges are found by hopping from length to length, reading
    nothing in between. A length beyond the end of the file fails."""

    name: str = "length_prefixed"

    def decode(self, file, start: int, end: int, size: int) -> Iterator[tuple[int, str]]:
        at = 0
        while at < min(end, size):
            file.seek(at)
            head = file.read(4)
            n = struct.unpack(">I", head)[0] if len(head) == 4 else size
            if at + 4 + n > size:
                raise ValueError(f"a record at {at} goes beyond the end of its file")
            if at >= start:
                yield at, file.read(n).decode("utf-8", "replace")
            at += 4 + n


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int
    size: int


class _Reader(DataSourceReader):
    def __init__(self, decoder: RecordDecoder, path: str, split: int):
        self.decoder, self.path, self.split = decoder, path, split

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        files = sorted((f.path, f.size) for f in files)
        return [_Range(f, at, min(at + self.split, size), size) for f, size in files for at in range(0, size, self.split)] or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range):
        import pyarrow as pa
        from pyarrow import fs

        if not partition.size:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        names = ["file", "offset", "record"]
        with system.open_input_file(partition.file) as f:
            held: list[tuple[int, str]] = []
            for one in self.decoder.decode(f, partition.start, partition.end, partition.size):
                held.append(one)
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(held)), pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held])], names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(held)), pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held])], names)


def source_of(decoder: RecordDecoder) -> type[DataSource]:
    """The data source ``strataform_<name>`` of a decoder. Options: path, split (bytes)."""

    class Records(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"strataform_{decoder.name}"

        def schema(self) -> str:
            return FIELDS

        def reader(self, schema) -> _Reader:
            return _Reader(decoder, self.options["path"], int(self.options.get("split", SPLIT_BYTES)))

    return Records


def records(spark: SparkSession, path: str, decoder: RecordDecoder, split: int = SPLIT_BYTES) -> DataFrame:
    """(file, offset, record) of the files under a path; order by file and offset for the order they are stored in."""
    spark.dataSource.register(source_of(decoder))
    return spark.read.format(f"strataform_{decoder.name}").option("split", split).load(path)
