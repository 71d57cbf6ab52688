"""A data source of raw log messages, batch and streaming: spark.read.format("raw_log").load(folder).

A file holds one slot's messages in order, each as position (8 bytes), length (4 bytes) and data,
big-endian; its name begins with the slot's name and a dash, and files of a slot sort by name.
Every file is a partition.  A stream's offset holds the last file of each slot by name, so a slot's
files must arrive in order of their names, as a log's segments do; slots are free of each other, and
new ones may come at any time.  Folders of stores that pyarrow reads work like local ones.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "slot string, lsn long, pos long, data binary"


def write(path: str, messages: list[tuple[int, bytes]]) -> None:
    """Write a segment whole, then give it its name."""
    with open(f"{path}.tmp", "wb") as f:
        for lsn, data in messages:
            f.write(struct.pack(">QI", lsn, len(data)) + data)
    os.replace(f"{path}.tmp", path)


class Segment(InputPartition):
    def __init__(self, path: str, slot: str, number: int):
        self.path, self.slot, self.number = path, slot, number


def _store(folder: str):
    """(file system, path) of a remote folder, or None for a local one."""
    scheme, sep, rest = folder.partition("://")
    if not sep or scheme == "file":
        return None, (rest if sep else folder)
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def segments(folder: str) -> dict[str, list[str]]:
    """The file names of each slot, in order: by the number after the slot's name, or by name."""
    store, path = _store(folder)
    if store is None:
        names = os.listdir(path)
    else:
        from pyarrow import fs

        names = [f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.is_file]
    out: dict[str, list[str]] = {}
    for n in names:
        if not n.endswith(".tmp"):
            out.setdefault(n.rpartition("-")[0], []).append(n)
    return {slot: sorted(own, key=order) for slot, own in sorted(out.items())}


def order(name: str) -> tuple:
    end = name.rpartition("-")[2]
    return (0, int(end), name) if end.isdigit() else (1, 0, name)


def parts(folder: str, after: dict[str, str], upto: dict[str, str] | None) -> list[Segment]:
    """The segments behind those named in `after`, up to those in `upto`."""
    out = []
    for slot, names in segments(folder).items():
        for i, n in enumerate(names):
            if slot in after and order(n) <= order(after[slot]) or upto is not None and (slot not in upto or order(n) > order(upto[slot])):
                continue
            number = order(n)[1] if order(n)[0] == 0 else i
            out.append(Segment(f"{folder}/{n}", slot, number))
    return out


def messages(part: Segment) -> Iterator[tuple]:
    """pos orders a slot's messages across its segments."""
    store, path = _store(part.path)
    with open(path, "rb") if store is None else store.open_input_stream(path) as f:
        n = 0
        while len(head := f.read(12)) == 12:
            lsn, size = struct.unpack(">QI", head)
            data = f.read(size)
            if len(data) < size:
                raise ValueError(f"{part.path} is cut short")
            yield part.slot, lsn, (part.number << 32) + n, bytearray(data)
            n += 1
        if head:
            raise ValueError(f"{part.path} is cut short")


class Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Segment]:
        return parts(self.folder, {}, None)

    def read(self, partition: Segment) -> Iterator[tuple]:
        return messages(partition)


class Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {slot: names[-1] for slot, names in segments(self.folder).items()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return parts(self.folder, start, end)

    def read(self, partition: Segment) -> Iterator[tuple]:
        return messages(partition)

    def commit(self, end: dict) -> None:
        pass


class RawLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Batch:
        return Batch(self.options["path"])

    def streamReader(self, schema: StructType) -> Stream:
        return Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawLog)
