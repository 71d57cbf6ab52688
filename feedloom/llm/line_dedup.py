"""Line deduplication by a segment-partition edit join.

A line is removed when an earlier line, of its own or another document, equals it, or, from
`least` characters on, is within `edits` (default 2) insertions, deletions and substitutions.
Lines are ordered by document id (nulls first), a hash of the text, and place.  Shorter lines
take no part in the near step: at their length two edits join lines that have nothing in
common.  Empty lines stay; equal ones go from `exact` characters on, by default all.

1. Equal lines meet as hashes; all but the first occurrence are marked.
2. Every first occurrence is split into edits + 1 segments.  A line within `edits` of it holds
   one of them whole, in a window of places that the two lengths and the segment's number
   bound (multi-match-aware selection).  A key is the hash of the indexed line's length, the
   segment's number and its text.  All keys, own segments and probes, are counted in sorted
   blocks by hash range and stored as arrays in the shared folder.
3. Only keys that two or more lines have are emitted with their lines, and grouped.  In a
   group, indexed lines meet probing ones: those whose character counts are too far apart are
   passed over by array arithmetic, the others are verified by the banded bit-parallel edit
   distance.  Groups return marked lines, never pairs.  The lines of a key that more than
   `group` lines have are dealt to blocks by a hash, and every two blocks meet in a task of
   their own, so the largest task holds two blocks, however hot the key.
4. The marked lines are cut from the texts.

Null text: no lines.  A document that loses all its lines keeps an empty text.  Rows equal in
id and text count as one document, and so keep or lose the same lines.  The id may have any
type that Spark orders and Arrow carries.  Other columns pass through; of n_lines and n_removed
the operator's own replace them.  An empty table stays empty.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import by_value, saved, shared_dir, small_batches, tidy, write_shared
from .jaccard_join import COUNTED, RANGE, Shared
from .kneser_ney import blocks, merged

by_value(__name__)

EDITS, LEAST = 2, 30
#: Lines of a key that one task compares with each other.
GROUP = 4096
#: Estimated bytes of marked lines up to which they are broadcast; beyond, a shuffle join.
BROADCAST_BYTES = 24 << 20
BLOCK = 2_000_000
BINS = 24


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line of n characters; later ones may be longer by one."""
    k = edits + 1
    short, longer = n // k, n % k
    out, at = [], 0
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


class Keys:
    """Keys of lines; the places to look at depend on the length only, and are kept by it."""

    def __init__(self, edits: int):
        self.edits, self.plans = edits, {}

    def plan(self, n: int):
        """(own, probes): lists of (start, end, a number for the indexed length and the segment)."""
        if n not in self.plans:
            if len(self.plans) > 4096:
                self.plans.clear()
            t = self.edits
            own = [(at, at + size, n * 64 + i) for i, (at, size) in enumerate(segments(n, t))]
            probes = []
            for m in range(max(t + 1, n - t), n + 1):
                d = n - m
                for i, (at, size) in enumerate(segments(m, t)):
                    low = max(0, at - i, at + d - (t - i))
                    high = min(n - size, at + i, at + d + (t - i))
                    probes += [(s, s + size, m * 64 + i) for s in range(low, high + 1) if d or s != at]
            self.plans[n] = own, probes
        return self.plans[n]

    def of(self, line: str) -> tuple[list[int], list[int]]:
        own, probes = self.plan(len(line))
        h = xxhash.xxh3_64_intdigest
        raw = line.encode("utf-8", "surrogatepass")
        if len(raw) == len(line):  # places of characters are places of bytes
            return [h(raw[a:b], seed) for a, b, seed in own], [h(raw[a:b], seed) for a, b, seed in probes]
        name = lambda p: h(line[p[0] : p[1]].encode("utf-8", "surrogatepass"), p[2])
        return list(map(name, own)), list(map(name, probes))


def within(a: str, b: str, edits: int) -> bool:
    """Whether a and b are at most `edits` apart.

    What they share at both ends is set aside; the rest is compared column by column in a band
    of 2 * edits + 1 diagonals whose vertical differences are bits of two integers.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[n - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    a, b = a[i : n - j], b[i : len(b) - j]
    if not a:
        return len(b) <= edits
    # at column c, bit r stands for row c - edits + r, so the band moves down by one a column
    full = (1 << 2 * edits + 1) - 1
    plus, minus = full & ~((1 << edits) - 1), 0  # before column 1: a step of one below row 0
    place: dict[str, int] = {}
    for k, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << k
    n, m = len(a), len(b)
    low, dist = edits, 0  # the middle row's bit; the distance there, first along the main diagonal
    for c in range(1, m + 1):
        eq = place.get(b[c - 1], 0)
        shift = c - 1 - edits
        match = (eq >> shift if shift >= 0 else eq << -shift) & full
        d0 = ((((match & plus) + plus) ^ plus) | match | minus) & full
        hp = (minus | ~(d0 | plus)) & full
        hn = d0 & plus
        dist += 0 if d0 >> low & 1 else 1
        if dist > 2 * edits:  # no row of the band is nearer than dist - edits
            return False
        d0 >>= 1
        plus = (hn | ~(d0 | hp)) & full
        minus = hp & d0
        if c == n:
            break
    if m == n:
        return dist <= edits
    # the last rows of the band lie beyond a's end: go on along row n
    for c in range(n + 1, m + 1):
        eq = place.get(b[c - 1], 0)
        shift = c - 1 - edits
        match = (eq >> shift if shift >= 0 else eq << -shift) & full
        d0 = ((((match & plus) + plus) ^ plus) | match | minus) & full
        hp = (minus | ~(d0 | plus)) & full
        hn = d0 & plus
        row = low - (c - n)
        dist += (hp >> row & 1) - (hn >> row & 1)
        d0 >>= 1
        plus = (hn | ~(d0 | hp)) & full
        minus = hp & d0
    return dist <= edits


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, lines): doc orders and names documents."""
    return docs.select(doc_name(key, text).alias("doc"), F.split(F.col(text), "\n").alias("lines")).where("lines is not null")


def doc_name(key: str, text: str) -> Column:
    return F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("h"))


def repeated(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(doc, no): occurrences of equal lines of `least` characters or more, but the first."""
    each = lines_of(docs, key, text).select("doc", F.posexplode("lines").alias("no", "line")).where(F.char_length("line") >= least)
    thin = each.select("doc", "no", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"))
    # written first, so that both sides of the join are dealt anew and a hot line's rows can be split
    first = saved(thin.groupBy("a", "b").agg(F.min(F.struct("doc", "no")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    return thin.join(first, ["a", "b"]).where(~F.struct("doc", "no").eqNullSafe(F.col("first"))).select("doc", "no")


def with_marked(docs: DataFrame, marked: DataFrame, key: str, text: str, again: bool = False) -> DataFrame:
    """`docs` with `__marked`, the places of the marked lines.

    again: the result is read more than once, so it is stored where texts had to move for it.
    """
    by_doc = marked.groupBy("doc").agg(F.sort_array(F.collect_set("no")).alias("__marked"))
    size = marked.count() * 8 + by_doc.count() * 64
    by_doc = by_doc.select(F.col("doc.id").alias("__id"), F.col("doc.h").alias("__h"), "__marked")
    few = size <= BROADCAST_BYTES
    out = docs.join(F.broadcast(by_doc) if few else by_doc, F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__h")), "left").drop("__id", "__h")
    return saved(out, "marked") if again and not few else out


def candidates(rest: DataFrame, key: str, text: str, edits: int, least: int, group: int, size: int) -> DataFrame:
    """(key, pair, block, own, id, h, no, line): lines that share a key with another; `rest` as from with_marked.

    pair: the two blocks that meet, of a key that has some; block: the line's own one.  size: bytes of all texts.
    """
    spark = rest.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "segments")
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = int(max(2 * conf, size // (8 * RANGE) + 1))
    rows = rest.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.split(F.col(text), "\n").alias("lines"), F.coalesce("__marked", F.array().cast("array<int>")).alias("m")).where("lines is not null")

    def lines(batch: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, batch.num_rows, 200):
            for i, h, ls, m in zip(*(batch.column(c).slice(at, 200).to_pylist() for c in range(4))):
                skip = set(m)
                for no, line in enumerate(ls):
                    if len(line) >= least and no not in skip:
                        yield i, h, no, line

    def count(batches):
        keys, held = Keys(edits), array("Q")

        def flush():
            h, c = np.unique(np.frombuffer(held, np.uint64) >> np.uint64(64 - COUNTED), return_counts=True)
            return blocks(h, c, (((h >> np.uint64(COUNTED - 32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64), ranges)

        for batch in batches:
            for _, _, _, line in lines(batch):
                own, probes = keys.of(line)
                held.extend(set(own + probes))  # once a line
                if len(held) > BLOCK:
                    yield flush()
                    held = array("Q")
        if held:
            yield flush()

    def merge(name, table):
        v, c = merged(table)
        keep = c > 1
        r = name[0].as_py()
        write_shared(f"{folder}/{r:07d}.hash", v[keep].tobytes())
        write_shared(f"{folder}/{r:07d}.count", np.minimum(c[keep], 0xFFFFFFFF).astype(np.uint32).tobytes())
        return pa.table({"range": pa.array([r], pa.int32()), "n": pa.array([int(keep.sum())], pa.int64())})

    rows.mapInArrow(tidy(count), "range int, once binary, more binary, counts binary").groupBy("range").applyInArrow(merge, "range int, n long").write.parquet(f"{folder}/ranges")
    id_type = rest.schema[key].dataType
    schema = f"key long, pair string, block int, own boolean, id {id_type.simpleString()}, h long, no int, line string"
    arrow = pa.schema([("key", pa.int64()), ("pair", pa.string()), ("block", pa.int32()), ("own", pa.bool_()), ("id", to_arrow_type(id_type)), ("h", pa.int64()), ("no", pa.int32()), ("line", pa.string())])

    def emit(batches):
        keys, shared = Keys(edits), Shared(folder, ranges)

        def answer(held):
            flat = [(k, o, x) for x in held for o, ks in zip((True, False), keys.of(x[3])) for k in dict.fromkeys(ks)]
            keyed = np.array([f[0] for f in flat], np.uint64)
            n = shared.counts(keyed)
            out: list[tuple] = []
            for i in np.flatnonzero(n > 1).tolist():
                k, o, x = flat[i]
                signed, blocks_ = k - (1 << 64) if k >> 63 else k, -(-int(n[i]) // group)
                if blocks_ == 1:
                    out.append((signed, "", 0, o, *x))
                    continue
                own = xxhash.xxh3_64_intdigest(x[3].encode("utf-8", "surrogatepass")) % blocks_
                out += [(signed, f"{min(own, j)}-{max(own, j)}", own, o, *x) for j in range(blocks_)]
                if len(out) > 50_000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

        def pack(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        held = []
        for batch in batches:
            for x in lines(batch):
                held.append(x)
                if len(held) >= 8_000:
                    yield from answer(held)
                    held = []
        if held:
            yield from answer(held)

    return rows.mapInArrow(tidy(emit), schema)


def counts_of(line: str) -> np.ndarray:
    """How often each class of characters occurs."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(codes % BINS, minlength=BINS).astype(np.int16)


def similar(edits: int, arrow: pa.Schema):
    """For a group: the lines that have an earlier one within `edits`.  Where two blocks meet, only lines of unlike blocks are compared."""

    def run(key, table):
        rows = {}
        for block, own, i, h, no, line in zip(*(table.column(c).to_pylist() for c in ("block", "own", "id", "h", "no", "line"))):
            k = (i is not None, i, h, no)
            rows[k] = (rows[k][0] if k in rows else False) or own, line, block
        order = sorted(rows, key=lambda k: (k[0], k[1] if k[0] else 0, k[2], k[3]))
        own = np.array([rows[k][0] for k in order])
        block = np.array([rows[k][2] for k in order])
        text = [rows[k][1] for k in order]
        apart = len(set(block.tolist())) > 1
        gone: list[int] = []
        counts = np.stack([counts_of(t) for t in text]) if len(order) > 12 else None
        for y in range(1, len(order)):
            may = np.ones(y, bool) if own[y] else own[:y].copy()
            if apart:
                may &= block[:y] != block[y]
            if counts is not None:
                may[may] = np.abs(counts[:y][may] - counts[y]).sum(1) <= 2 * edits
            if any(text[x] != text[y] and within(text[x], text[y], edits) for x in np.flatnonzero(may).tolist()):
                gone.append(y)
        some = [order[y] for y in gone]
        return pa.Table.from_arrays([pa.array([s[j] for s in some], f.type) for j, f in zip((1, 2, 3), arrow)], schema=arrow)

    return run


def marked_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST, exact: int = 1, group: int = GROUP) -> DataFrame:
    """(doc, no) of every line to remove."""
    same = saved(repeated(docs, key, text, exact), "repeated")
    docs = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    found = candidates(with_marked(docs, same, key, text, again=True), key, text, edits, least, group, size)
    id_type = docs.schema[key].dataType
    arrow = pa.schema([("id", to_arrow_type(id_type)), ("h", pa.int64()), ("no", pa.int32())])
    near = found.groupBy("key", "pair").applyInArrow(similar(edits, arrow), f"id {id_type.simpleString()}, h long, no int").distinct()
    near = saved(near.select(F.struct("id", "h").alias("doc"), "no"), "similar")
    return same.unionByName(near)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST, exact: int = 1, group: int = GROUP) -> DataFrame:
    """`docs` with the marked lines cut from `text`, and n_lines, n_removed.

    exact, least: characters from which equal and nearly equal lines go; group: lines of a key
    that one task compares with each other.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = with_marked(docs.select(*[F.col(f"`{c}`") for c in names]), marked_lines(docs, key, text, edits, least, exact, group), key, text)
    lines = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col("__marked"), i)), "\n")
    cut = F.when(F.col("__marked").isNull(), F.col(text)).otherwise(kept)
    return out.select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in names], F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.when(F.col("__marked").isNull(), 0).otherwise(F.size("__marked")).alias("n_removed"))
