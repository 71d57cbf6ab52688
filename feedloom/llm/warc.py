"""WARC archives: a writer, and a reader that salvages what damage has left.

`write_archives` writes one gzip member per record to archives in the shared folder and
returns a manifest.  A page is a `response` whose block is an HTTP head and the payload, or a
`revisit` without block.  `read_archives` reads archives back as a stream.  When a check fails
(gzip data, version line, headers, block length, digest), the reader looks for the next
gzip magic whose member opens with a WARC version line, or in plain archives for the next
version line, goes on from there, and logs the byte gap that it passed over as
quarantined.

Digests: the block digest decides where there is one, else the payload digest, taken over the
body behind an HTTP head, or over the whole block where the record has no such head.  Hex and
base32 forms of hashlib's algorithms are checked, others are passed over.

Memory is bounded at any size of record: a block over `inline` bytes goes to a file in the
shared folder while it is read, and its row has the file's name in place of the bytes.

Results in awkward cases.  A null payload counts as empty; a null uri is written as empty.  A
row with a null key is always a response.  Rows that share a key keep records of their own:
each is compared by its own payload, and of equal payloads all rows with the smallest key are
responses.  Other columns, whatever their names, take no part.  An empty table gives no
archives.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, local_path, saved, shared_dir, small_batches, write_shared

by_value(__name__)

VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
#: Bytes read at once.
STEP = 1 << 20
#: Bytes of a block that a row holds itself, and of a record's headers at most.
INLINE, HEADERS = 64 << 20, 1 << 20


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, uncompressed."""
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_id(key, digest: str) -> str:
    """The same for every attempt at a record; a record without a key gets one of its own."""
    return f"<urn:uuid:{uuid.uuid4() if key is None else uuid.uuid5(uuid.NAMESPACE_URL, f'feedloom:{key}:{digest}')}>"


def written_uri(uri: str) -> list[tuple[str, str]]:
    """The uri's headers; what a header line cannot hold is escaped, and marked as such."""
    if re.search(r"[\r\n]|^\s|\s$", uri):
        return [("WARC-Target-URI", re.sub(r"[\s%]", lambda m: quote(m[0], safe=""), uri)), ("Feedloom-Uri-Escaped", "1")]
    return [("WARC-Target-URI", uri)]


def target_uri(headers: dict[str, str]) -> str:
    """The uri that was written, from the headers that were read."""
    uri = headers.get("warc-target-uri", "")
    return unquote(uri) if "feedloom-uri-escaped" in headers else uri


def page_record(key, uri: str, payload: bytes, refers_to) -> bytes:
    """A response with its payload, or a revisit of `refers_to` without."""
    digest = hashlib.sha256(payload).hexdigest()
    head = [
        ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", "1970-01-01T00:00:00Z"), *written_uri(uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Feedloom-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if key is not None:
        head.append(("Feedloom-Key", str(key)))
    if refers_to is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        return record("response", [*head, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")], block)
    head += [("WARC-Refers-To", record_id(refers_to, digest)), ("Feedloom-Refers-To-Key", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record("revisit", head, b"")


def with_revisits(rows: DataFrame, least: int) -> DataFrame:
    """(k, u, p, refers_to) of rows (k, u, p): of equal payloads of at least `least` bytes, the smallest key where it is another one, else null.

    Only keys and digests meet; the smallest key is found by partial aggregation, and a hot
    digest's rows are thin.  Payloads are shuffled once at most, by key and digest, so that a row is
    told apart from another of the same key.
    """
    body = F.col("p").cast("binary")
    named = rows.withColumn("d", F.sha2(body, 256))
    thin = named.where(F.octet_length(body) >= least).select("k", "d").where("k is not null")
    # written first, so that a hot digest's rows can be split in the join
    first = saved(thin.groupBy("d").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    again = thin.join(first, "d").where("k > first").select("k", "d", F.col("first").alias("refers_to")).distinct()
    return named.join(again, ["k", "d"], "left").select("k", "u", "p", "refers_to")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 100, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write archives of about `archive_bytes` below `folder`; return the manifest that was saved beside them.

    Every attempt of a task writes under names of its own, and the manifest is committed
    with the job, so what a lost or repeated attempt left is never read.
    """
    small_batches(pages.sparkSession)
    own = pages.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{uri}`"), F.lit("")).alias("u"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("p"))
    rows = with_revisits(own, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = n = 0

        def close() -> pa.RecordBatch:
            nonlocal size, n
            path = f"{folder}/archives/{uuid.uuid4().hex}.warc.gz"
            write_shared(path, b"".join(parts))
            out = pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
            parts.clear()
            size = n = 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for k, u, p, r in zip(*(batch.column(c).slice(at, 200).to_pylist() for c in range(4))):
                    parts.append(member(page_record(k, u, p.encode("utf-8", "surrogatepass"), r)))
                    size += len(parts[-1])
                    n += 1
                    if size >= archive_bytes:
                        yield close()
        if parts:
            yield close()

    rows.mapInArrow(run, "path string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("path string, records long, bytes long").parquet(f"{folder}/manifest")


# ------------------------------------------------------------------ reading


class Damage(Exception):
    pass


class Ahead:
    """Bytes with look-ahead, that know their offset; `more` gives the next ones, or none."""

    def __init__(self):
        self.buf, self.pos, self.at, self.done = b"", 0, 0, False

    def fill(self, n: int) -> bool:
        """True if n bytes are at hand."""
        while len(self.buf) - self.pos < n and not self.done:
            got = self.more(n)
            self.done = not got
            self.buf, self.pos = self.buf[self.pos :] + got, 0
        return len(self.buf) - self.pos >= n

    def starts(self, what: bytes) -> bool:
        self.fill(len(what))
        return self.buf.startswith(what, self.pos)

    def find(self, what: bytes, start: int = 0) -> int:
        """How far ahead `what` is, among the bytes at hand."""
        got = self.buf.find(what, self.pos + start)
        return got - self.pos if got >= 0 else -1

    def peek(self, n: int) -> bytes:
        self.fill(n)
        return self.buf[self.pos : self.pos + n]

    def skip(self, n: int) -> None:
        self.pos += n
        self.at += n

    def take(self, n: int) -> bytes:
        """The next n bytes, or fewer at the end."""
        got = self.peek(n)
        self.skip(len(got))
        return got


class Source(Ahead):
    """A file that can go back."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def more(self, n: int) -> bytes:
        return self.f.read(max(STEP, n))

    def back(self, at: int) -> None:
        if 0 <= self.pos - (self.at - at):
            self.pos -= self.at - at
        else:
            self.f.seek(at)
            self.buf, self.pos, self.done = b"", 0, False
        self.at = at


class Inflated(Ahead):
    """The data of the gzip member at hand, a step at a time."""

    def __init__(self, src: Source):
        super().__init__()
        self.src, self.z = src, zlib.decompressobj(31)

    def more(self, n: int) -> bytes:
        while not self.z.eof:
            step = self.src.peek(min(STEP, max(1, len(self.src.buf) - self.src.pos)))
            try:
                out = self.z.decompress(step, STEP)
            except zlib.error as e:
                raise Damage("gzip") from e
            self.src.skip(len(step) - len(self.z.unconsumed_tail) - len(self.z.unused_data))
            if out:
                return out
            if not step:
                raise Damage("cut short")
        return b""


class Kept:
    """A block in memory, or beyond `inline` bytes in a file of the shared folder."""

    def __init__(self, size: int, inline: int, folder: str | None):
        self.path = self.f = None
        self.parts: list[bytes] = []
        if size > inline and folder:
            self.path = f"{folder}/{uuid.uuid4().hex}.block"
            self.f = created(self.path)

    def add(self, part: bytes) -> None:
        self.f.write(part) if self.f else self.parts.append(part)

    def close(self) -> None:
        if self.f:
            self.f.close()

    def drop(self) -> None:
        self.close()
        if self.path:
            removed(self.path)


def checks(value: str | None):
    """(hash object, whether a digest is the wanted one) of a digest header; None if there is none to check."""
    name, colon, want = (value or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    want = want.strip()
    same = lambda d: want.lower() == d.hex() or want.upper().rstrip("=") == base64.b32encode(d).decode().rstrip("=")
    return hashlib.new(name), same


def parsed(data: Ahead) -> dict[str, str]:
    """The headers of the record at hand; names in lower case, folded lines joined."""
    if not re.match(rb"WARC/\d\.\d\r\n", data.peek(10)):
        raise Damage("no version line")
    seen = 0
    while (end := data.find(b"\r\n\r\n", seen)) < 0:
        have = len(data.buf) - data.pos
        if have > HEADERS or not data.fill(have + 1):
            raise Damage("no end of headers")
        seen = max(0, have - 3)
    head: dict[str, str] = {}
    last = None
    for line in data.take(end + 4)[:-4].split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            head[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damage("bad header")
        last = k.strip().decode("utf-8", "replace").lower()
        head[last] = v.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,18}", head.get("content-length", "")):
        raise Damage("no length")
    return head


def read_record(src: Source, inline: int, folder: str | None) -> tuple[dict[str, str], bytes | None, str | None, int, int]:
    """(headers, block, file of the block, its size, where the payload starts in it) of the record at hand."""
    zipped = src.starts(MAGIC)
    if not zipped and not src.starts(b"WARC/"):
        raise Damage("no record here")
    data = Inflated(src) if zipped else src
    head = parsed(data)
    size = int(head["content-length"])
    first = data.take(min(size, STEP))
    http = head.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    body = max(0, first.find(b"\r\n\r\n") + 4) if http and b"\r\n\r\n" in first else 0
    block = checks(head.get("warc-block-digest"))
    payload = None
    # a payload in segments or in chunks has a digest that its record alone cannot show
    if not block and head.get("warc-type") in ("response", "resource", "conversion") and "warc-segment-number" not in head and not re.search(rb"(?i)\r\ntransfer-encoding:", first[:body]):
        payload = checks(head.get("warc-payload-digest"))
    kept = Kept(size, inline, folder)
    try:
        part, got, skip = first, 0, body
        while True:
            if part:
                got += len(part)
                kept.add(part)
                if block:
                    block[0].update(part)
                if payload:
                    payload[0].update(memoryview(part)[skip:])
                skip = 0
            if got == size:
                break
            part = data.take(min(size - got, STEP))
            if not part:
                raise Damage("block length")
        if data.take(4) != b"\r\n\r\n":
            raise Damage("block length")
        if zipped and data.fill(1):
            raise Damage("more than one record in a member")
        for check in (block, payload):
            if check and not check[1](check[0].digest()):
                raise Damage("digest")
        kept.close()
    except BaseException:
        kept.drop()
        raise
    return head, None if kept.path else b"".join(kept.parts), kept.path, size, body


def salvage(f, inline: int = INLINE, folder: str | None = None) -> Iterator[tuple]:
    """(kind, offset, length, headers, block, file, size, body) of each record; kind "record", or "gap" with the reason in `headers`.

    Without a `folder` every block is kept in memory.
    """
    src = Source(f)
    gap, why = None, ""
    while src.fill(1):
        start = src.at
        try:
            got = read_record(src, inline, folder)
        except Damage as e:
            if gap is None:
                gap, why = start, str(e)
            src.back(start)
            seek_next(src)
            continue
        if gap is not None:
            yield "gap", gap, start - gap, {"reason": why}, b"", None, 0, 0
            gap = None
        yield "record", start, src.at - start, *got
    if gap is not None:
        yield "gap", gap, src.at - gap, {"reason": why}, b"", None, 0, 0


def seek_next(src: Source) -> None:
    """Move beyond this byte to the next gzip magic whose member opens with a version line, or the next bare version line."""
    src.take(1)
    while True:
        while not (hits := [p for p in (src.find(MAGIC), src.find(b"WARC/1.")) if p >= 0]):
            src.skip(max(0, len(src.buf) - src.pos - 6))
            if not src.fill(len(src.buf) - src.pos + 1):
                src.skip(len(src.buf) - src.pos)
                return
        src.skip(min(hits))
        if not src.starts(MAGIC):
            return
        with contextlib.suppress(zlib.error):
            if zlib.decompressobj(31).decompress(src.peek(512), 16).startswith(b"WARC/"):
                return
        src.skip(1)


def read_archives(manifest: DataFrame, path: str = "path", inline: int = INLINE) -> DataFrame:
    """Every record and every quarantined gap of the archives named by `manifest`.

    Columns: path, kind (record or gap), offset, length, reason (of a gap), type, headers
    (map, names in lower case), block (binary; null where it is in `file`), file, size (of the
    block) and body (where the payload starts in it: behind an HTTP head, else 0).
    """
    spark = manifest.sparkSession
    folder = shared_dir(spark, "blocks")
    columns = "path string, kind string, offset long, length long, reason string, type string, headers map<string,string>, block binary, file string, size long, body long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("path", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("file", pa.string()), ("size", pa.int64()), ("body", pa.int64())])
        rows: list[tuple] = []
        held = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                with opened(p) as f:
                    for kind, offset, length, head, block, file, size, body in salvage(f, inline, folder):
                        gap = kind == "gap"
                        rows.append((p, kind, offset, length, head["reason"] if gap else None, None if gap else head.get("warc-type"), [] if gap else list(head.items()), block, file, size, body))
                        held += len(block or b"")
                        if len(rows) >= 500 or held > 16 << 20:
                            yield pack()
                            rows, held = [], 0
        if rows:
            yield pack()

    tasks = max(2 * spark.sparkContext.defaultParallelism, manifest.count() // 8)
    return manifest.select(path).repartition(tasks, path).mapInArrow(run, columns)


def payload_of(block: str = "block", body: str = "body"):
    """The payload in a record's block."""
    return F.substr(F.col(block), (F.col(body) + 1).cast("int"))


def opened(uri: str):
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def created(uri: str):
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def removed(uri: str) -> None:
    path = local_path(uri)
    if path is not None:
        os.unlink(path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.delete_file(path)


def round_trip(pages: DataFrame, what: str = "warc") -> DataFrame:
    """Write `pages` as archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, shared_dir(pages.sparkSession, what)))
