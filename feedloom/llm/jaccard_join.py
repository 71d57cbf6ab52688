"""Exact Jaccard join of documents on word shingles, in metric space.

Jaccard distance is a metric.  Pivots create Voronoi regions; a document is replicated to
every further region whose members it might be linked with by the triangle inequality; and
regions are joined recursively until no pivots part them.

First, candidates.  Against whole documents as pivots nearly every document lies at distance
exactly 1, where the triangle inequality tells nothing, so documents that can be linked at all
are brought together by single shingles: d(x, {s}) is 1 - 1/|x| if x has s, else 1.  Ties are
broken by one order of the shingles (rarest first, then by hash), and a document of n shingles
has the nearest n - ceil(t n) + 1 of them as its window: two linked documents share one.
Shingles of one document lead to nobody, so a document whose window holds only such is alone.

1. Shingle hashes are counted over all documents: sorted blocks per task, merged by hash
   range; those of two or more documents become sorted arrays in the shared folder.
2. Workers map these arrays, and find each document's window.  Equal sets become one node.
3. Nodes that share a window shingle form clusters (components of star edges).
4. Each cluster is joined by document pivots.  Every member is measured against some of them and
   belongs to the nearest one's region, or, at distance 1 from all, to the far one.  Regions are
   numbered, the far one first; a pair counts in its lower one, where a member of the higher one
   is a guest: to pivot p's region go those with d(x, p) - d(x, own) <= 2r, to the far region
   those at 1 - r or more from every pivot (r: the distance of a link).  A pair of guests of
   the same region never counts there, which a bit for each level tells, so that every link is
   found once.  Regions are parted again while that halves the largest and adds at most half.
   Then the members' distances to all pivots settle most pairs (further apart than r, or together
   no more than r), and the others are compared.  In one task: `Region`.
5. A cluster too large for one task is parted in the same way by rounds over all such clusters
   (`parted`); rounds end when all are small or cannot be parted.  What pivots cannot part goes to
   its members' window shingles as regions, if these part it (unlike documents in a chain), a
   pair counting at its first common one.  Else (thousands of near copies, all about r apart) its
   members are stored in blocks, once, and tasks join two blocks each.
6. Groups return a star of links for each component and numbers of links, never pairs.

Null text or one without words: an empty set, linked with nothing.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WordHash, by_value, hashed, map_shared, saved, shared_dir, shingle_hashes, small_batches, tidy, words_of, write_shared
from .graph import components

by_value(__name__)

#: Bits of a shingle's hash that are counted.  Chance meetings only add to a count, which changes the order but no result.
COUNTED = 48
#: Shingles that a task sorts at once, and shingles of a range of hashes, on average.
BLOCK, RANGE = 2_000_000, 8_000_000
#: Shingles in a region that one task joins, and in a block of one that cannot be parted: at least half of that, and at most.
CLUSTER, LARGEST_BLOCK = 250_000, 4_000_000


def shingle_set(text: str | None, cache: WordHash, width: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(hashed(words_of(text), cache), width))


def _pack(a: np.ndarray) -> bytes:
    """Sorted integers as 32-bit steps, or as they are where a step is too wide."""
    step = np.diff(a, prepend=np.uint64(0))
    if len(a) and step[1:].size and int(step[1:].max()) >> 32:
        return b"w" + a.tobytes()
    return b"s" + a[:1].tobytes() + step[1:].astype(np.uint32).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    if b[:1] == b"w":
        return np.frombuffer(b, np.uint64, offset=1)
    if len(b) == 1:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(b, np.uint64, 1, 1)
    return np.concatenate((first, first + np.cumsum(np.frombuffer(b, np.uint32, offset=9), dtype=np.uint64)))


def counted_shingles(docs: DataFrame, text: str, width: int, folder: str) -> int:
    """Write the sorted hashes, and counts, of shingles that two or more documents have; return the number of hash ranges."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    conf = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2 * conf, size // (6 * RANGE) + 1)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, n = WordHash(), [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            # a range is named by the leading 32 bits times the number of ranges
            of = ((h >> np.uint64(COUNTED - 32)) * np.uint64(ranges)) >> np.uint64(32)
            there, starts = np.unique(of, return_index=True)
            out = []
            for r, a, b in zip(there.tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)]):
                part, cnt = h[a:b], c[a:b]
                more = cnt > 1
                out.append((r, _pack(part[~more]), _pack(part[more]), cnt[more].astype(np.uint32).tobytes()))
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=["range", "once", "more", "counts"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for t in batch.column(0).slice(at, 500).to_pylist():
                    s = shingle_set(t, cache, width)
                    if len(s):
                        held.append(s >> np.uint64(64 - COUNTED))
                        n += len(s)
                    if n > BLOCK:
                        yield flush()
                        n = 0
        if held:
            yield flush()

    def merge(key, table):
        values, weights = [], []
        for once, more, counts in zip(*(table.column(c).to_pylist() for c in ("once", "more", "counts"))):
            a, b = _unpack(once), _unpack(more)
            values += [a, b]
            weights += [np.ones(len(a), np.uint32), np.frombuffer(counts, np.uint32)]
        v, w = np.concatenate(values), np.concatenate(weights)
        order = np.argsort(v, kind="stable")
        v, w = v[order], w[order]
        start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        total = np.add.reduceat(w.astype(np.uint64), start)
        keep = total > 1
        r = key[0].as_py()
        write_shared(f"{folder}/{r:07d}.hash", v[start][keep].tobytes())
        write_shared(f"{folder}/{r:07d}.count", np.minimum(total[keep], 0xFFFFFFFF).astype(np.uint32).tobytes())
        return pa.table({"range": pa.array([r], pa.int32()), "n": pa.array([int(keep.sum())], pa.int64())})

    rows = docs.select(text).mapInArrow(tidy(blocks), "range int, once binary, more binary, counts binary")
    done = rows.groupBy("range").applyInArrow(merge, "range int, n long")
    done.write.parquet(f"{folder}/ranges")
    return ranges


class Shared:
    """The counts of shingles, mapped from the shared folder."""

    def __init__(self, folder: str, ranges: int):
        self.folder, self.ranges, self.maps = folder, ranges, {}

    def _at(self, r: int):
        if r not in self.maps:
            if len(self.maps) > 4096:
                self.maps.clear()
            try:
                self.maps[r] = map_shared(f"{self.folder}/{r:07d}.hash", np.uint64), map_shared(f"{self.folder}/{r:07d}.count", np.uint32)
            except FileNotFoundError:  # no document has a shingle there
                self.maps[r] = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return self.maps[r]

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """In how many documents each is, 1 for those that are in one."""
        out = np.ones(len(hashes), np.uint32)
        order = np.argsort(hashes)
        h = hashes[order] >> np.uint64(64 - COUNTED)
        of = ((h >> np.uint64(COUNTED - 32)) * np.uint64(self.ranges)) >> np.uint64(32)
        rs, starts = np.unique(of, return_index=True)
        for r, a, b in zip(rs.tolist(), starts.tolist(), [*starts[1:].tolist(), len(h)]):
            known, n = self._at(r)
            if len(known):
                at = np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)
                hit = known[at] == h[a:b]
                out[order[a:b][hit]] = n[at[hit]]
        return out


def _windows(docs: DataFrame, key: str, text: str, percent: int, width: int, folder: str, ranges: int) -> DataFrame:
    """(key, n, node, near, set): node, near and set are null for documents that nobody can be linked with."""

    own = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shared = WordHash(), Shared(folder, ranges)
        types = pa.schema([("key", to_arrow_type(own)), ("n", pa.int64()), ("node", pa.binary()), ("near", pa.list_(pa.int64())), ("set", pa.binary())])

        def answer(keys, sets):
            counts = shared.counts(np.concatenate(sets))
            rows, at = [], 0
            for k, s in zip(keys, sets):
                c = counts[at : at + len(s)]
                at += len(s)
                window = len(s) - (percent * len(s) + 99) // 100 + 1
                window -= int((c == 1).sum())
                if not len(s) or window <= 0:
                    rows.append((k, len(s), None, None, None))
                    continue
                some = np.flatnonzero(c > 1)
                near = s[some[np.lexsort((s[some], c[some]))][:window]]
                raw = s.tobytes()
                rows.append((k, len(s), xxhash.xxh3_128_digest(raw), near.astype(np.int64), raw))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), types)], schema=types)

        for batch in batches:
            keys, sets, n = [], [], 0
            for at in range(0, batch.num_rows, 500):
                for k, t in zip(*(batch.column(i).slice(at, 500).to_pylist() for i in range(2))):
                    keys.append(k)
                    sets.append(shingle_set(t, cache, width))
                    n += len(sets[-1])
                    if n > 600_000:
                        yield answer(keys, sets)
                        keys, sets, n = [], [], 0
            if keys:
                yield answer(keys, sets)

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tidy(run), f"key {own.simpleString()}, n long, node binary, near array<long>, set binary")


# ------------------------------------------------------------------ one region


class Region:
    """Sets in one task, joined by pivots.

    guest: a bit for each level at which a set is a guest; two sets that share a bit are no pair here.
    side: 0 or 1; only pairs of unlike sides count.  home, near: the shingle whose region this is and
    every set's window shingles; a pair counts where its first common one is.
    """

    #: Sets that are compared without further parting; pivots of a level, at least; distances that a set keeps.
    LEAF, PIVOTS, KEPT = 8, 8, 16

    def __init__(self, sets: list[np.ndarray], percent: int, guest=None, side=None, home: int | None = None, near: list[np.ndarray] | None = None):
        self.percent, self.r = percent, 1 - percent / 100
        self.n = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        words, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(words), bool)
        self.guest = np.zeros(len(sets), np.int64) if guest is None else guest
        self.bit = int(self.guest.max()).bit_length()
        if side is not None:
            self.guest = self.guest | np.where(side, 2 << self.bit, 1 << self.bit)
            self.bit += 2
        self.home, self.near = home, near
        self.compared = 0

    def overlap(self, x: int, ids: np.ndarray) -> np.ndarray:
        """Size of x's intersection with each of `ids`."""
        own = self.flat[self.at[x] : self.at[x + 1]]
        self.mark[own] = True
        n = self.n[ids]
        ends = np.cumsum(n)
        pick = np.repeat(self.at[ids] - (ends - n), n) + np.arange(ends[-1])
        got = np.add.reduceat(self.mark[self.flat[pick]].astype(np.int64), ends - n)
        self.mark[own] = False
        self.compared += len(ids)
        return got

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """Every link once: a set's number and those of the later sets, in order of size, that it is linked with."""
        ids = np.lexsort((np.arange(len(self.n)), self.n))
        yield from self._links(ids, self.guest[ids], np.zeros((0, len(ids))), self.bit)

    def _links(self, ids: np.ndarray, guest: np.ndarray, known: np.ndarray, bit: int) -> Iterator[tuple[int, np.ndarray]]:
        if len(ids) < 2 or np.bitwise_and.reduce(guest):
            return
        if len(ids) > self.LEAF:
            pivots = ids[np.linspace(0, len(ids) - 1, min(max(self.PIVOTS, int(1.5 * len(ids) ** 0.5)), len(ids) // 3)).astype(int)]
            d = np.array([1 - (b := self.overlap(int(p), ids)) / (self.n[p] + self.n[ids] - b) for p in pivots])
            known = np.concatenate((known, d))[-self.KEPT :]
            parts = voronoi(d, self.r)
            sizes = [len(at) for at, _ in parts]
            if bit < 62 and 2 * max(sizes) <= len(ids) and 2 * sum(sizes) <= 3 * len(ids):
                for at, other in parts:
                    yield from self._links(ids[at], guest[at] | np.where(other, 1 << bit, 0), known[:, at], bit + 1)
                return
        yield from self._compared(ids, guest, known)

    def _compared(self, ids: np.ndarray, guest: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        n = self.n[ids]
        last = np.searchsorted(self.percent * n, 100 * n, "right")  # beyond, sets are too large
        for i, x in enumerate(ids.tolist()):
            may = np.arange(i + 1, last[i])
            may = may[(guest[may] & guest[i]) == 0]
            for d in known:
                may = may[np.abs(d[may] - d[i]) <= self.r + EPS]
            if not len(may):
                continue
            sure = (known[:, may] + known[:, i : i + 1] <= self.r - EPS).any(0)
            rest = may[~sure]
            if len(rest):
                both = self.overlap(x, ids[rest])
                rest = rest[100 * both >= self.percent * (self.n[x] + n[rest] - both)]
            near = ids[np.concatenate((may[sure], rest))]
            if self.home is not None:
                near = np.array([y for y in near.tolist() if np.intersect1d(self.near[x], self.near[y])[0] == self.home], np.int64)
            if len(near):
                yield x, near


EPS = 1e-9


def voronoi(d: np.ndarray, r: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members and guests, which are guests) of each region, from distances of pivots (rows) to members (columns)."""
    owner, own = d.argmin(0), d.min(0)
    owner[own >= 1] = -1
    parts = []
    for j in range(-1, len(d)):
        mine = owner == j
        if not mine.any():
            continue
        if j < 0:
            other = ~mine & (own >= 1 - r - EPS)
        else:  # nobody beyond the region's radius and r is near a member
            other = (owner > j) & (d[j] - own <= 2 * r + EPS) & (d[j] <= d[j][mine].max() + r + EPS)
        at = np.flatnonzero(mine | other)
        parts.append((at, other[at]))
    return parts


FOUND = "u binary, v binary, c long, whole boolean"


def _found(region: Region, nodes: list[bytes], rows: np.ndarray, whole: bool) -> pa.RecordBatch:
    """A star of links for each component, with null c, and the number of rows that each set is linked with here, with null v."""
    label, degree = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
    for x, ys in region.links():
        degree[x] += rows[ys].sum()
        degree[ys] += rows[x]
        old = np.unique(label[np.append(ys, x)])
        if len(old) > 1:
            label[np.isin(label, old[1:])] = old[0]
    out = [(nodes[i], nodes[root], None, whole) for i, root in enumerate(label.tolist()) if i != root]
    out += [(nodes[i], None, int(degree[i]), whole) for i in np.flatnonzero(degree).tolist()]
    types = (pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, types)], names=["u", "v", "c", "whole"])


def _region(table: pa.Table, percent: int, side=None) -> tuple[Region, list[bytes], np.ndarray]:
    sets = [np.frombuffer(b, np.uint64) for b in table.column("set").to_pylist()]
    home = table.column("home")[0].as_py()
    near = None if home is None else [np.array(x, np.int64) for x in table.column("near").to_pylist()]
    guest = table.column("guest").to_numpy().astype(np.int64)
    return Region(sets, percent, guest, side, home, near), table.column("node").to_pylist(), table.column("rows").to_numpy()


def _joined(percent: int):
    """Joins a region in one task; a cluster that was never parted is `whole`."""

    def run(key, table):
        return pa.Table.from_batches([_found(*_region(table, percent), "/" not in key[0].as_py())])

    return run


# ------------------------------------------------------------------ clusters too large for a task

MEMBER = "cluster string, node binary, set binary, rows long, guest long, home long, near array<long>"


def _by_pivots(large: DataFrame, percent: int, level: int, pivots: int = 16) -> DataFrame:
    """`large` with `subs`: the regions of each member, array<struct<sub, guest>>; large also has `docs` and `least`, one of the cluster's nodes."""
    r = 1 - percent / 100
    pick = F.pmod(F.xxhash64("node", F.lit(level)), F.greatest(F.lit(1), F.floor(F.col("docs") / pivots)).cast("long")) == 0
    picked = large.where(pick | (F.col("node") == F.col("least")))
    chosen = picked.groupBy("cluster").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("node", F.lit(level)).alias("o"), "set"))), 1, pivots)["set"].alias("pivots"))
    schema = MEMBER + ", total double, subs array<struct<sub:int,guest:boolean>>"
    names = [c.split()[0] for c in schema.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, marks = None, None
        for batch in batches:
            subs = []
            for cluster, raw, chosen_ in zip(*(batch.column(c).to_pylist() for c in ("cluster", "set", "pivots"))):
                if cluster != last:
                    last, marks = cluster, [np.frombuffer(p, np.uint64) for p in chosen_]
                s = np.frombuffer(raw, np.uint64)
                both = np.array([len(np.intersect1d(s, t, assume_unique=True)) for t in marks])
                d = 1 - both / (len(s) + np.array([len(t) for t in marks]) - both)
                own = int(d.argmin()) if d.min() < 1 else -1
                to = [(own, False)]
                if own >= 0:
                    if d.min() >= 1 - r - EPS:
                        to.append((-1, True))
                    to += [(j, True) for j in np.flatnonzero(d[:own] - d.min() <= 2 * r + EPS).tolist()]
                subs.append([{"sub": j, "guest": g} for j, g in to])
            kind = pa.list_(pa.struct([("sub", pa.int32()), ("guest", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(subs, kind)], names=names)

    return large.join(chosen, "cluster").select(*names[:-1], "pivots").mapInArrow(deal, schema)


def parted(members: DataFrame, windows: DataFrame, percent: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(regions of at most `most` shingles, members of regions that nothing parts).

    members: columns MEMBER; windows: node, near.
    """
    small: list[DataFrame] = []
    stuck: list[DataFrame] = []
    level = 0
    bytes_ = F.octet_length("set") / 8
    while True:
        sizes = members.groupBy("cluster").agg(F.sum(bytes_).alias("total"), F.count(F.lit(1)).alias("docs"), F.min_by("node", F.xxhash64("node", F.lit(level))).alias("least"))
        sizes = saved(sizes.where((F.col("total") > most) & (F.col("docs") > 1)), "large")
        if sizes.isEmpty():
            small.append(members)
            break
        small.append(members.join(sizes.select("cluster"), "cluster", "left_anti"))
        dealt = saved(_by_pivots(members.join(sizes, "cluster"), percent, level), "dealt")
        each = dealt.select("cluster", "total", bytes_.alias("size"), F.explode("subs").alias("s"))
        parts = each.groupBy("cluster", "s.sub").agg(F.sum("size").alias("size"), F.first("total").alias("total"))
        # a level must halve the largest region, and replicate by half of all at most
        works = parts.groupBy("cluster").agg(((2 * F.max("size") <= F.first("total")) & (2 * F.sum("size") <= 3 * F.first("total"))).alias("works"))
        known = dealt.join(saved(works, "works"), "cluster")
        of = [c.split()[0] for c in MEMBER.split(", ")]
        apart = known.where("works").withColumn("s", F.explode("subs"))
        apart = apart.withColumn("cluster", F.concat_ws("/", "cluster", "s.sub")).withColumn("guest", F.when(F.col("s.guest"), F.col("guest").bitwiseOR(F.lit(1 << level))).otherwise(F.col("guest"))).select(of)
        rest = known.where("not works").select(*of, "total")
        by_shingle, whole = _by_shingles(rest, windows)
        stuck.append(whole)
        members = saved(apart.unionByName(by_shingle.select(of)), "members")
        level += 1
        if level > 40:  # every round halves regions, so 2 ** 40 times `most` shingles come first
            stuck.append(members.withColumn("total", F.sum(bytes_).over(W.partitionBy("cluster"))))
            break
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts) if parts else None
    return union(small), union(stuck)


def _by_shingles(rest: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members dealt to their window shingles, members of clusters which that does not part)."""
    bare = rest.where("home is null").drop("near").join(windows.select("node", "near"), "node")
    each = bare.select("cluster", "total", (F.octet_length("set") / 8).alias("size"), F.explode("near").alias("h"))
    shingles = each.groupBy("cluster", "h").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.first("total").alias("total")).where("n > 1")
    works = saved(shingles.groupBy("cluster").agg(F.max("size").alias("top"), F.sum("size").alias("all"), F.first("total").alias("t")).where("4 * top <= t and all <= 8 * t").select("cluster"), "chains")
    dealt = bare.join(works, "cluster").withColumn("home", F.explode("near"))
    # a shingle that one member alone has leads to nobody
    dealt = dealt.join(shingles.select("cluster", F.col("h").alias("home")), ["cluster", "home"], "left_semi")
    dealt = dealt.withColumn("cluster", F.concat_ws("/", "cluster", F.concat(F.lit("s"), F.hex("home")))).drop("total")
    return dealt, rest.join(works, "cluster", "left_anti")


def _blocks_joined(stuck: DataFrame, percent: int, most: int) -> DataFrame:
    """Joins regions that nothing parts, two blocks a task; members are stored once, not sent to every task."""
    spark = stuck.sparkSession
    folder = shared_dir(spark, "blocks")
    size = F.least(F.greatest(F.col("total") / 512, F.lit(most / 2)), F.lit(float(LARGEST_BLOCK)))
    dealt = stuck.withColumn("block", F.pmod(F.xxhash64("node", F.lit(-1)), F.ceil(F.col("total") / size)))

    def store(key, table):
        path = f"{folder}/{uuid.uuid4().hex}.arrow"
        sink = pa.BufferOutputStream()
        kept = table.select(["node", "set", "rows", "guest", "home", "near"]).combine_chunks()
        with pa.ipc.new_stream(sink, kept.schema) as out:
            out.write_table(kept)
        write_shared(path, sink.getvalue())
        return pa.table({"cluster": [key[0].as_py()], "block": [key[1].as_py()], "path": [path]}, schema=pa.schema([("cluster", pa.string()), ("block", pa.int64()), ("path", pa.string())]))

    files = saved(dealt.groupBy("cluster", "block").applyInArrow(store, "cluster string, block long, path string"), "files")
    n = files.count()
    a, b = files.toDF("cluster", "i", "a"), files.toDF("cluster", "j", "b")
    pairs = a.join(b, "cluster").where("i <= j").select("a", "b")
    pairs = pairs.repartition(max(2 * spark.sparkContext.defaultParallelism, n), "a", "b")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda path: pa.ipc.open_stream(pa.py_buffer(map_shared(path, np.uint8))).read_all()
        for batch in batches:
            for x, y in zip(*(batch.column(c).to_pylist() for c in range(2))):
                if x == y:
                    yield _found(*_region(read(x), percent), False)
                    continue
                first, second = read(x), read(y)
                side = np.repeat([False, True], [first.num_rows, second.num_rows])
                yield _found(*_region(pa.concat_tables([first, second]), percent, side), False)

    return pairs.mapInArrow(tidy(join), FOUND)


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, width: int = 5, most: int = CLUSTER) -> DataFrame:
    """(key, n_shingles, component_id, n_links) for every row of `docs`.

    Two rows are linked when 100 * intersection >= percent * union; component_id is the
    smallest key that links lead to, the own one included; n_links is the number of
    other rows the row is linked with, rows of an equal set included.  most: shingles of a region that
    one task joins.

    The key may have any type that Spark orders.  Repeated rows, and rows that share a key, are rows of
    their own; null keys come after all others, so a component_id is null where all keys of a component are.
    Other columns, whatever their names, take no part.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "shingles")
    ranges = counted_shingles(docs, text, width, folder)
    all_rows = saved(_windows(docs, key, text, percent, width, folder, ranges), "windows")
    some = all_rows.where("node is not null")
    nodes = saved(some.groupBy("node").agg(F.first("near").alias("near"), F.first("set").alias("set"), F.count(F.lit(1)).alias("rows")), "nodes")
    meets = nodes.select("node", F.explode("near").alias("h"))
    hub = saved(meets.groupBy("h").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "hubs")
    stars = meets.join(hub, "h").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    clusters = components(stars)
    members = clusters.join(nodes.select("node", "set", "rows"), "node")
    members = saved(members.select(F.hex("label").alias("cluster"), "node", "set", "rows", F.lit(0).cast("long").alias("guest"), F.lit(None).cast("long").alias("home"), F.lit(None).cast("array<long>").alias("near")), "members")
    small, stuck = parted(members, nodes, percent, most)
    found = saved(small.groupBy("cluster").applyInArrow(_joined(percent), FOUND), "links")
    if stuck is not None:
        found = found.unionByName(saved(_blocks_joined(stuck, percent, most), "links"))
    links = found.where("v is not null")
    # a cluster that one task joined has one star a component already
    whole = links.where("whole").select("u", "v")
    roots = whole.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(whole.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    if stuck is not None:
        roots = roots.unionByName(components(links.where("not whole").select("u", "v")))
    own = nodes.where("rows > 1").select(F.col("node").alias("u"), (F.col("rows") - 1).alias("c"))
    degrees = saved(found.where("c is not null").select("u", "c").unionByName(own).groupBy(F.col("u").alias("node")).agg(F.sum("c").alias("n_links")), "degrees")
    roots = saved(roots, "roots")
    thin = all_rows.select("key", "n", "node")
    roots = degrees.join(roots, "node", "full").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # most nodes belong to no component but their own
    labelled = thin.where("node is not null").join(roots, "node", "left").select("key", "n", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # written first, so that a large component's rows can be split in the join
    lowest = saved(labelled.groupBy("label").agg(F.min("key").alias("component_id")), "lowest")
    out = labelled.join(lowest, "label").select("key", "n", "component_id", "n_links")
    alone = thin.where("node is null").select("key", "n", F.col("key").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return alone.unionByName(out).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "n_links")
