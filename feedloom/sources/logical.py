"""Decoder of logical-replication messages (the pgoutput format of the public protocol docs).

Input: rows of (lsn, data), the raw messages of one slot in order.  The decoder is a state machine
over a slot, so a slot is one group; slots are decoded in parallel.

Changes of a transaction are numbered from 0, each transaction on its own, also where the segments
of streamed ones interleave.  A streamed change has no position of its own until its transaction
commits; `change_events` stamps it, builds the idempotency key with the commit's position and
leaves out what was aborted or never ended.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import idempotency_key

SCHEMA = "slot string, lsn long, pos long, xid long, sub long, streamed boolean, kind string, operation string, rel_id long, schema string, table string, key string, before string, after string, unchanged array<string>, change_seq long, error string"


class DecodeError(ValueError):
    """A message that cannot be read."""


class Reader:
    def __init__(self, data: bytes):
        self.d, self.i = data, 0

    def take(self, fmt: str):
        size = struct.calcsize(">" + fmt)
        if self.i + size > len(self.d):
            raise DecodeError("message cut short")
        out = struct.unpack_from(">" + fmt, self.d, self.i)
        self.i += size
        return out[0] if len(out) == 1 else out

    def text(self) -> str:
        end = self.d.find(b"\0", self.i)
        if end < 0:
            raise DecodeError("string without end")
        out = self.d[self.i : end].decode()
        self.i = end + 1
        return out

    def raw(self, n: int) -> bytes:
        if self.i + n > len(self.d):
            raise DecodeError("message cut short")
        self.i += n
        return self.d[self.i - n : self.i]


class Decoder:
    """State of one slot: relations, the open transaction or segment, and change counters by transaction."""

    def __init__(self):
        self.relations: dict[int, tuple[str, str, list[tuple[str, bool]]]] = {}
        self.lsn, self.xid, self.streaming = 0, 0, False
        self.seq: dict[int, int] = {}

    def relation(self, r: Reader) -> None:
        oid, schema, table = r.take("I"), r.text(), r.text()
        r.take("B")
        columns = []
        for _ in range(r.take("H")):
            flags, name = r.take("B"), r.text()
            r.take("Ii")
            columns.append((name, bool(flags & 1)))
        self.relations[oid] = schema, table, columns

    def tuple_of(self, r: Reader, columns: list[tuple[str, bool]]) -> tuple[dict, list[str]]:
        values, unchanged = {}, []
        for i in range(r.take("H")):
            kind = chr(r.take("B"))
            name = columns[i][0] if i < len(columns) else f"column{i}"
            if kind == "n":
                values[name] = None
            elif kind == "u":
                unchanged.append(name)
            elif kind == "t":
                values[name] = r.raw(r.take("I")).decode()
            elif kind == "b":
                values[name] = base64.b64encode(r.raw(r.take("I"))).decode()
            else:
                raise DecodeError(f"unknown column kind {kind!r}")
        return values, unchanged

    def message(self, lsn: int, data: bytes) -> dict | None:
        """A row, or None for messages without one."""
        r = Reader(data)
        kind = chr(r.take("B"))
        if kind == "B":
            self.lsn, _, self.xid = r.take("QqI")
            self.seq[self.xid] = 0
            return None
        if kind == "C":
            self.seq.pop(self.xid, None)
            return None
        if kind == "S":
            self.xid, first = r.take("IB")
            self.streaming = True
            if first:
                self.seq[self.xid] = 0
            return None
        if kind == "E":
            self.streaming = False
            return None
        if kind in ("c", "A"):
            xid = r.take("I")
            self.streaming = False
            if kind == "c":
                self.seq.pop(xid, None)
                return {"kind": "commit", "xid": xid, "lsn": r.take("BQQq")[1]}
            sub = r.take("I")  # a part of a transaction, or itself
            if sub == xid:
                self.seq.pop(xid, None)
            return {"kind": "abort", "xid": xid, "sub": sub, "lsn": lsn}
        if kind == "R":
            if self.streaming:
                r.take("I")
            self.relation(r)
            return None
        if kind not in "IUD":
            return None  # truncate, type, origin, message
        sub = r.take("I") if self.streaming else self.xid
        oid = r.take("I")
        if oid not in self.relations:
            raise DecodeError(f"unknown relation {oid}")
        schema, table, columns = self.relations[oid]
        before = after = None
        unchanged: list[str] = []
        while r.i < len(data):
            part = chr(r.take("B"))
            if part in "KO":
                before, _ = self.tuple_of(r, columns)
            elif part == "N":
                after, unchanged = self.tuple_of(r, columns)
            else:
                raise DecodeError(f"unknown tuple {part!r}")
        image = after if after is not None else before
        if image is None:
            raise DecodeError("no tuple")
        dump = lambda d: None if d is None else json.dumps(d, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        key = {n: image.get(n) for n, is_key in columns if is_key and n in image}
        number = self.seq.get(self.xid, 0)
        self.seq[self.xid] = number + 1
        return {"kind": "change", "operation": {"I": "insert", "U": "update", "D": "delete"}[kind], "rel_id": oid, "schema": schema, "table": table, "key": dump(key), "before": dump(before), "after": dump(after), "unchanged": unchanged, "xid": self.xid, "sub": sub, "streamed": self.streaming, "lsn": None if self.streaming else self.lsn or lsn, "change_seq": number}


def decoded(messages: DataFrame) -> DataFrame:
    """Decode (slot, lsn, pos, data); `pos` orders a slot's messages.  Unreadable ones are rows of kind error."""

    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[t]) for n, t in (c.split(" ") for c in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, Decoder] = {}
        for b in batches:
            rows = []
            for m in b.to_pylist():
                try:
                    row = slots.setdefault(m["slot"], Decoder()).message(m["lsn"], m["data"] or b"")
                except (DecodeError, struct.error, UnicodeDecodeError) as e:
                    row = {"kind": "error", "error": str(e), "lsn": m["lsn"]}
                if row:
                    rows.append({"slot": m["slot"], "pos": m["pos"]} | row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return messages.select("slot", "lsn", "pos", "data").repartition("slot").sortWithinPartitions("slot", "pos").mapInArrow(run, SCHEMA)


def change_events(rows: DataFrame, source: str = "pg") -> DataFrame:
    """Changes of `decoded` rows with their transactions' positions and idempotency keys.

    Changes of aborted transactions, of aborted parts of one and of those without an end are left out.
    """
    ends = rows.where("kind in ('commit', 'abort')").select("slot", "xid", "kind", "sub", F.col("lsn").alias("__lsn"))
    commits = ends.where("kind = 'commit'").groupBy("slot", "xid").agg(F.max("__lsn").alias("__lsn"))
    gone = ends.where("kind = 'abort'").select("slot", "xid", "sub").distinct()
    whole = gone.where("sub = xid").select("slot", "xid")
    changes = rows.where("kind = 'change'")
    late = changes.where("streamed").join(whole, ["slot", "xid"], "left_anti").join(gone, ["slot", "xid", "sub"], "left_anti")
    late = late.join(commits, ["slot", "xid"]).withColumn("lsn", F.col("__lsn")).drop("__lsn")
    out = changes.where("not streamed").unionByName(late.select(changes.columns))
    c = F.col
    return out.withColumn("source", F.lit(source)).withColumn("idempotency_key", idempotency_key(c("source"), c("schema"), c("table"), c("key"), c("operation"), c("lsn"), c("change_seq")))
