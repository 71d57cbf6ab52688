"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and mapped by workers.

Counting.  Tasks turn their texts into token hashes, count them in sorted blocks, and send
the blocks by hash range; a range is merged in one task and stored in the shared folder as
a sorted array of hashes beside one of counts.  A token's place in all ranges is its id.
n-grams of ids are counted in the same way, by ranges of a hash of their context (all tokens but
the last), so that all followers of a context lie together, and even a frequent first token's
n-grams are dealt to many tasks.  A block holds its distinct n-grams in order, column by column,
compressed; that takes two to four bytes an n-gram.  The merge of a range stores its table, one
file, and sends on what the next lower order counts: for each (n-1)-gram that ends an n-gram,
how many n-grams of the range it ends.  So the lower orders have continuation counts, down to
single tokens.  Everything grows with the corpus and lies in ranges of bounded mean size; only a
few numbers for each range reach the driver.  All n-grams are counted and kept, at any count.

A table.  Contexts are sorted by 64-bit hash.  Those with one follower seen once, most of them,
are a hash and a token; the others have a list of followers, sorted, with counts, and the total and the
numbers of followers seen once, twice and more.  Numbers are bytes; what does not fit has a
place in a list of exceptions, in 64 bits.

Scoring.  Workers map the files and look up the sorted contexts of a batch.

    P(w|c) = (n(cw) - D(n)) / n(c.) + g(c) P(w|c')      c': c without its first token
    P(w)   = (N(.w) - d(N)) / N(..) + g / (V + 1)

with three discounts for each order from the counts of counts, and one more class for all
unknown tokens.  A context that the corpus does not have leaves it to the lower order.  A text
stands between end tokens: order - 1 before it, and one behind, which counts as a token.

Tokens: A-Z lower-cased, runs without white space.  A null text counts as empty, which has
the end token only.  An empty training set leaves the uniform distribution.  Rows and other
columns pass through; of n_tokens, n_known, base_score, score and perplexity the operator's own
replace them.  Repeated rows count as often as they are there, and get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, by_value, hashed, map_shared, mix, release, shared_dir, small_batches, tidy, words_of, write_shared

by_value(__name__)

#: Model order by default: trigrams.
ORDER = 3
#: No word has white space, so no word has this hash.
END = np.uint64(xxhash.xxh3_64_intdigest(b" end "))
BLOCK, RANGE = 1_500_000, 4_000_000
#: Tokens that are looked up at once.
LOOK = 1_000_000
BLOCKS = "range int, once binary, more binary, counts binary"


def pack(a: np.ndarray) -> bytes:
    """Sorted integers: 16-, 32-bit or full steps, whichever holds them."""
    step = np.diff(a)
    top = int(step.max()) if len(step) else 0
    kind = np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + a[:1].tobytes() + step.astype(kind).tobytes()


def unpack(b: bytes) -> np.ndarray:
    if len(b) == 1:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(b, np.uint64, 1, 1)
    step = np.frombuffer(b, {2: np.uint16, 4: np.uint32, 8: np.uint64}[b[0]], offset=9)
    return np.concatenate((first, first + np.cumsum(step, dtype=np.uint64)))


def blocks(values: np.ndarray, counts: np.ndarray, of: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Sorted values with counts, cut where the range `of` them changes."""
    there, starts = np.unique(of, return_index=True)  # the ranges that have values
    rows = []
    for r, a, b in zip(there.tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)]):
        v, c = values[a:b], counts[a:b]
        more = c > 1
        rows.append((r, pack(v[~more]), pack(v[more]), c[more].astype(np.uint32).tobytes()))
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["range", "once", "more", "counts"])


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of many blocks, sorted, and their total counts."""
    values, weights = [], []
    for once, more, counts in zip(*(table.column(c).to_pylist() for c in ("once", "more", "counts"))):
        a, b = unpack(once), unpack(more)
        values += [a, b]
        weights += [np.ones(len(a), np.uint32), np.frombuffer(counts, np.uint32)]
    v, w = np.concatenate(values), np.concatenate(weights)
    order = np.argsort(v, kind="stable")
    v, w = v[order], w[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(v)), bool), v[1:] != v[:-1])))
    return v[start], np.add.reduceat(w.astype(np.uint64), start) if len(start) else np.zeros(0, np.uint64)


def token_hashes(text: str | None, cache: WordHash) -> np.ndarray:
    """The tokens of a text with the end token after them."""
    return np.append(hashed(words_of(text), cache), END)


def sequences(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[list[np.ndarray]]:
    """Token hashes of texts, in lists of about `most` tokens."""
    cache, held, n = WordHash(), [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            for t in batch.column(column).slice(at, 500).to_pylist():
                held.append(token_hashes(t, cache))
                n += len(held[-1])
                if n > most:
                    yield held
                    held, n = [], 0
    if held:
        yield held


@dataclass
class Model:
    """Where the arrays lie and the few numbers that all workers need."""

    folder: str
    ranges: int
    order: int = ORDER
    types: int = 0
    total: int = 0
    pairs: int = 0  # distinct bigrams, the sum of the continuation counts
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)  # by order
    low: float = 1.0  # share of the uniform distribution in the lowest order

    @property
    def dtype(self):
        return np.uint32 if self.types < 1 << 32 else np.uint64


class Arrays:
    """A worker's view of the model."""

    def __init__(self, model: Model):
        self.m, self.maps = model, {}
        self.first = map_shared(f"{model.folder}/uni/first", np.int64)  # id of each range's first token, and of none

    def _map(self, name: str, dtype):
        if name not in self.maps:
            if len(self.maps) > 8192:
                self.maps.clear()
            try:
                self.maps[name] = map_shared(f"{self.m.folder}/{name}", dtype)
            except FileNotFoundError:  # an empty range
                self.maps[name] = np.zeros(0, dtype)
        return self.maps[name]

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes; -1 for unknown ones."""
        out = np.full(len(tokens), -1, np.int64)
        for r, a, b in runs(hash_range(tokens, self.m.ranges)):
            known = self._map(f"uni/{r:07d}.hash", np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, tokens[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == tokens[a:b], at + self.first[r], -1)
        return out

    def at_ids(self, ids: np.ndarray, ending: str, dtype) -> np.ndarray:
        """Values beside the tokens of sorted ids."""
        out = np.zeros(len(ids), dtype)
        for k, a, b in runs(np.searchsorted(self.first, ids, "right") - 1):
            out[a:b] = self._map(f"uni/{k:07d}.{ending}", dtype)[ids[a:b] - self.first[k]]
        return out

    def table(self, order: int, r: int) -> "Table":
        name = f"{order}/{r:07d}"
        if name not in self.maps:
            if len(self.maps) > 8192:
                self.maps.clear()
            try:
                self.maps[name] = Table(map_shared(f"{self.m.folder}/{name}", np.uint8), self.m.dtype)
            except FileNotFoundError:
                self.maps[name] = None
        return self.maps[name]

    def look(self, order: int, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For n-grams, by the hash of the context and the id of the last token: the own share, and that of the lower order."""
        own, rest = np.zeros(len(contexts)), np.ones(len(contexts))
        sort = np.argsort(contexts)
        keys, last = contexts[sort], words[sort]
        d = np.array([0.0, *self.m.discounts[order]])
        for r, a, b in runs(hash_range(keys, self.m.ranges)):
            if (t := self.table(order, r)) is not None:
                hit, count, stat = t.look(keys[a:b], last[a:b], self.m.types)
                at = sort[a:b][hit]
                own[at] = (count - d[np.minimum(count, 3).astype(np.int64)]) / stat[:, 0]
                rest[at] = stat[:, 1:] @ d[1:] / stat[:, 0]
        return own, rest


def runs(sorted_: np.ndarray):
    """(value, start, end) of each run of equal values."""
    values, starts = np.unique(sorted_, return_index=True)
    return zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_)])


def context_hash(cols: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + c.astype(np.uint64) + np.uint64(1))
    return out


def as_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes, 255 for those that do not fit; and these in order."""
    big = numbers >= 255
    return np.where(big, 255, numbers).astype(np.uint8), numbers[big].astype(np.uint64)


class Table:
    """One range's n-grams of one order, in one array of bytes."""

    NAMES = ("key1", "word1", "key", "start", "stat", "stat_big", "word", "count", "count_at", "count_big", "stat_at")

    def __init__(self, raw: np.ndarray, dtype):
        kinds = (np.uint64, dtype, np.uint64, np.uint32, np.uint8, np.uint64, dtype, np.uint8, np.uint32, np.uint64, np.uint32)
        ends = np.frombuffer(raw[: 8 * len(kinds)].tobytes(), np.uint64).astype(np.int64).tolist()
        at = 8 * len(kinds)
        for name, kind, end in zip(self.NAMES, kinds, ends):
            setattr(self, name, raw[at:end].view(kind))
            at = -(-end // 8) * 8

    @classmethod
    def made(cls, contexts: list[np.ndarray], words: np.ndarray, counts: np.ndarray, dtype) -> tuple[bytes, list[int]]:
        """The bytes of a table, from n-grams in order of their contexts' ids; and the number of n-grams seen once to four times."""
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in contexts], axis=0)))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(words)))
        lone = (size == 1) & (counts[start] == 1)
        keys = context_hash([c[start] for c in contexts])
        alone = np.flatnonzero(lone)
        alone = alone[np.argsort(keys[alone])]
        many = np.flatnonzero(~lone)
        many = many[np.argsort(keys[many])]
        n = size[many]
        ends = np.cumsum(n)
        rows = np.repeat(start[many] - (ends - n), n) + np.arange(int(n.sum()))
        own = counts[rows]
        begin = (ends - n).astype(np.int64)
        sums = np.stack([np.add.reduceat(x.astype(np.uint64), begin) if len(begin) else np.zeros(0, np.uint64) for x in (own, own == 1, own == 2, own >= 3)], 1).reshape(-1)
        stat, stat_big = as_bytes(sums)
        count, count_big = as_bytes(own)
        parts = {
            "key1": keys[alone], "word1": words[start[alone]].astype(dtype), "key": keys[many], "start": np.append(begin, len(rows)).astype(np.uint32),
            "stat": stat, "stat_big": stat_big, "stat_at": np.flatnonzero(stat == 255).astype(np.uint32),
            "word": words[rows].astype(dtype), "count": count, "count_at": np.flatnonzero(count == 255).astype(np.uint32), "count_big": count_big,
        }
        out, ends_ = [b""], []
        at = 8 * len(cls.NAMES)
        for name in cls.NAMES:
            data = parts[name].tobytes()
            ends_.append(at + len(data))
            out.append(data + b"\0" * (-len(data) % 8))
            at += len(out[-1])
        out[0] = np.array(ends_, np.uint64).tobytes()
        return b"".join(out), _count_of_counts(counts)

    def look(self, keys: np.ndarray, words: np.ndarray, types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the n-grams have a known context, their counts, these contexts' four numbers); keys ascend."""
        hits, counts, stats = [], [], []
        if len(self.key1):
            at = np.minimum(np.searchsorted(self.key1, keys), len(self.key1) - 1)
            hit = np.flatnonzero(self.key1[at] == keys)
            hits.append(hit)
            counts.append((self.word1[at[hit]] == words[hit]).astype(np.float64))
            stats.append(np.broadcast_to(np.array([1.0, 1, 0, 0]), (len(hit), 4)))
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
            hit = np.flatnonzero(self.key[at] == keys)
            at = at[hit]
            small = self.stat.reshape(-1, 4)[at]
            stat = small.astype(np.float64)
            over = np.nonzero(small == 255)
            if len(over[0]):
                stat[over] = self.stat_big[np.searchsorted(self.stat_at, 4 * at[over[0]] + over[1])]
            place, there = self._find(at, words[hit], types)
            got = np.zeros(len(hit))
            some = self.count[place[there]]
            got[there] = some
            if (some == 255).any():
                over = np.flatnonzero(there)[some == 255]
                got[over] = self.count_big[np.searchsorted(self.count_at, place[over])]
            hits.append(hit)
            counts.append(got)
            stats.append(stat)
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 4))
        return np.concatenate(hits), np.concatenate(counts), np.concatenate(stats)

    def _find(self, at: np.ndarray, want: np.ndarray, types: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens in the lists of followers of contexts, and whether they are there."""
        start, end = self.start[at].astype(np.int64), self.start[at + 1].astype(np.int64)
        low, high = start.copy(), end.copy()
        # ids follow hashes, so they lie evenly, and a long list is searched about where the token should be
        long = np.flatnonzero(end - start > 64)
        if len(long):
            size = end[long] - start[long]
            guess = start[long] + (want[long].astype(np.float64) * size / types).astype(np.int64)
            width = (1.5 * np.sqrt(size)).astype(np.int64) + 2
            a, b = np.maximum(start[long], guess - width), np.minimum(end[long] - 1, guess + width)
            a = np.minimum(a, b)
            right = (a == start[long]) | (self.word[a] < want[long])
            low[long[right]] = a[right]
            right = self.word[b] >= want[long]
            high[long[right]] = b[right]
        open_ = np.flatnonzero(low < high)
        while len(open_):  # a binary search in every list at once
            l, h = low[open_], high[open_]
            mid = (l + h) >> 1
            less = self.word[mid] < want[open_]
            l = np.where(less, mid + 1, l)
            h = np.where(less, h, mid)
            low[open_], high[open_] = l, h
            open_ = open_[l < h]
        there = low < end
        there[there] = self.word[low[there]] == want[there]
        return low, there


# ------------------------------------------------------------------ blocks of n-grams


def combined(cols: list[np.ndarray], size: int) -> tuple[np.ndarray, bool]:
    """One number for each row of columns below `size`, in the rows' order; and whether the columns can be read from it."""
    key, width, plain = cols[0].astype(np.uint64), size, True
    for c in cols[1:]:
        if width * size >= 1 << 64:
            values, key = np.unique(key, return_inverse=True)
            key, width, plain = key.astype(np.uint64), len(values), False
        if width * size >= 1 << 64:
            values, c = np.unique(c, return_inverse=True)
            key, width = key * np.uint64(len(values)) + c.astype(np.uint64), width * len(values)
        else:
            key, width = key * np.uint64(size) + c.astype(np.uint64), width * size
    return key, plain


def summed(cols: list[np.ndarray], counts: np.ndarray | None, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows, sorted, and the sums of their counts (None: one each)."""
    key, plain = combined(cols, size)
    if plain and counts is None:
        key, total = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), sorted_[1:] != sorted_[:-1])))
        total = np.add.reduceat(np.ones(len(key), np.uint64) if counts is None else counts[order], start) if len(start) else np.zeros(0, np.uint64)
        if not plain:
            return [c[order[start]] for c in cols], total.astype(np.uint64)
        key = sorted_[start]
    out = []
    for _ in cols[1:]:
        key, last = np.divmod(key, np.uint64(size))
        out.append(last)
    return [key, *out[::-1]], total.astype(np.uint64)


def squeezed(cols: list[np.ndarray], counts: np.ndarray, dtype) -> bytes:
    """Sorted rows, column by column and byte by byte, compressed; the first column as steps."""
    import zstandard

    wide = np.uint32 if not len(counts) or int(counts.max()) < 1 << 32 else np.uint64
    cols = [np.diff(cols[0], prepend=cols[0][:1]), *cols[1:]], cols[0][:1].astype(np.uint64).tobytes()
    planes = [np.ascontiguousarray(c.astype(t)).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T.tobytes() for c, t in [*((c, dtype) for c in cols[0]), (counts, wide)]]
    return bytes([np.dtype(wide).itemsize]) + len(counts).to_bytes(8, "little") + cols[1] + zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def spread(data: bytes, width: int, dtype) -> tuple[list[np.ndarray], np.ndarray]:
    import zstandard

    n, size = int.from_bytes(data[1:9], "little"), np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[17:]), np.uint8)
    take = lambda at, t: np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).reshape(-1)
    cols = [take(i * n * size, np.dtype(dtype)) for i in range(width)]
    cols[0] = np.frombuffer(data[9:17], np.uint64)[0] + np.cumsum(cols[0], dtype=np.uint64)
    return [c.astype(np.uint64) for c in cols], take(width * n * size, np.dtype(np.uint32 if data[0] == 4 else np.uint64)).astype(np.uint64)


def n_gram_blocks(cols: list[np.ndarray], counts: np.ndarray, ranges: int, dtype) -> list[tuple[int, bytes]]:
    """Sorted distinct n-grams, by the range of their contexts' hashes."""
    of = hash_range(context_hash(cols[:-1]), ranges)
    order = np.argsort(of.astype(np.uint16) if ranges < 1 << 16 else of, kind="stable")
    return [(r, squeezed([c[order[a:b]] for c in cols], counts[order[a:b]], dtype)) for r, a, b in runs(of[order])]


def n_grams(ids: np.ndarray, lengths: list[int], order: int, pad: int) -> list[np.ndarray]:
    """Columns of the n-grams that end at each token; before a text stand `pad`s."""
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(ids)) - np.repeat(starts, lengths)
    back = lambda j: np.where(place < j, pad, np.concatenate((np.full(min(j, len(ids)), pad, ids.dtype), ids[: max(0, len(ids) - j)])))
    return [*(back(j) for j in range(order - 1, 0, -1)), ids]


def hash_range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Three discounts from the numbers of items seen 1, 2, 3 and 4 times; where there are none, in between."""
    n1, n2 = n[0], n[1]
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i
        out.append(min(max(d, 0.05), i - 0.05))
    return tuple(out)


def _count_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


GRAMS = "range int, data binary"


def trained(docs: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Count a model of `order` (2 or more) over all texts of `docs`."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    small_batches(spark)
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = int(max(conf, size // (6 * RANGE) + 1))
    folder = shared_dir(spark, "ngrams")
    texts = docs.select(text)

    def tokens(batches):
        for held in sequences(batches, 0, BLOCK):
            v, c = np.unique(np.concatenate(held), return_counts=True)
            yield blocks(v, c, hash_range(v, ranges), ranges)

    def merge_tokens(key, table):
        v, c = merged(table)
        r = key[0].as_py()
        write_shared(f"{folder}/uni/{r:07d}.hash", v.tobytes())
        write_shared(f"{folder}/uni/{r:07d}.count", c.tobytes())
        return pa.table({"range": pa.array([r], pa.int32()), "types": pa.array([len(v)], pa.int64()), "total": pa.array([int(c.sum())], pa.int64())})

    sums = texts.mapInArrow(tidy(tokens), BLOCKS).groupBy("range").applyInArrow(merge_tokens, "range int, types long, total long").collect()  # one row a range
    types = dict((r["range"], r["types"]) for r in sums)
    first = np.array([0, *np.cumsum([types.get(r, 0) for r in range(ranges)]).tolist()], np.int64)
    write_shared(f"{folder}/uni/first", first.tobytes())
    model = Model(folder, ranges, order, int(first[-1]), sum(r["total"] for r in sums))
    if not model.total:
        return model
    dtype = model.dtype
    schema = pa.schema([("range", pa.int32()), ("data", pa.binary())])
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 2, schema)], schema=schema)

    def grams(batches):
        arrays = Arrays(model)
        for held in sequences(batches, 0, BLOCK):
            own, back = np.unique(np.concatenate(held), return_inverse=True)
            local = n_grams(back, [len(h) for h in held], order, int(np.searchsorted(own, END)))
            cols, counts = summed(local, None, len(own))
            ids = arrays.ids(own).astype(np.uint64)
            rows = n_gram_blocks([ids[c.astype(np.int64)] for c in cols], counts, ranges, dtype)
            for at in range(0, len(rows), 64):
                yield as_batch(rows[at : at + 64])

    def merge(k: int):
        def run(key, table):
            got = [spread(d, k, dtype) for d in table.column("data").to_pylist()]
            cols, counts = summed([np.concatenate([g[0][j] for g in got]) for j in range(k)], np.concatenate([g[1] for g in got]), model.types)
            del got
            data, n = Table.made(cols[:-1], cols[-1], counts, dtype)
            write_shared(f"{folder}/{k}/{key[0].as_py():07d}", data)
            del data
            ends, times = summed(cols[1:], None, model.types)
            if k > 2:
                rows = n_gram_blocks(ends, times, ranges, dtype)
            else:  # by the ranges of tokens
                rows = [(r, squeezed([ends[0][a:b]], times[a:b], dtype)) for r, a, b in runs(np.searchsorted(first, ends[0].astype(np.int64), "right") - 1)]
            out = pa.Table.from_batches([as_batch(rows)])
            return out.append_column("n", pa.array([n] + [None] * (out.num_rows - 1), pa.list_(pa.int64())))

        return run

    def merge_continuations(key, table):
        r = key[0].as_py()
        got = [spread(d, 1, dtype) for d in table.column("data").to_pylist()]
        (v,), c = summed([np.concatenate([g[0][0] for g in got])], np.concatenate([g[1] for g in got]), model.types)
        beside = np.zeros(int(first[r + 1] - first[r]), np.uint64)
        beside[v.astype(np.int64) - first[r]] = c
        write_shared(f"{folder}/uni/{r:07d}.next", beside.tobytes())
        n = _count_of_counts(c) + [int((c >= 3).sum()), int(c.sum())]
        return pa.table({"n": pa.array([n], pa.list_(pa.int64()))})

    def frugal(merge_):
        """A merge that gives back what it has used: its worker goes on with the next range."""

        def run(key, table):
            try:
                return merge_(key, table)
            finally:
                release()

        return run

    below = texts.mapInArrow(tidy(grams), GRAMS)
    for k in range(order, 1, -1):
        path = f"{folder}/follow{k}"
        below.groupBy("range").applyInArrow(frugal(merge(k)), GRAMS + ", n array<long>").write.parquet(path)
        follow = spark.read.schema(GRAMS + ", n array<long>").parquet(path)
        model.discounts[k] = discounts(list(follow.where("n is not null").agg(*[F.sum(F.col("n")[i]) for i in range(4)]).first()))
        below = follow.drop("n")
    n1 = below.groupBy("range").applyInArrow(merge_continuations, "n array<long>").agg(*[F.sum(F.col("n")[i]) for i in range(6)]).first()
    model.discounts[1] = discounts(list(n1)[:4])
    d, model.pairs = model.discounts[1], n1[5]
    model.low = (d[0] * n1[0] + d[1] * n1[1] + d[2] * n1[4]) / model.pairs
    return model


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0)))


def scored(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add n_tokens, n_known, base_score, score (log10 of a text's probability) and perplexity to every row.

    keep_text: whether the text itself comes back, too.
    """
    names = [c for c in docs.columns if c not in ("n_tokens", "n_known", "base_score", "score", "perplexity", text)]
    names += [text] * keep_text

    def run(batches):
        arrays = Arrays(model)
        m, v1 = model, model.types + 1
        cache = WordHash()

        def answer(parts: list[pa.RecordBatch], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(held)
            own, back = np.unique(flat, return_inverse=True)
            ids = arrays.ids(own)
            known = ids >= 0
            c, n = np.zeros(len(own)), np.zeros(len(own))
            order = np.argsort(ids[known])
            at = np.flatnonzero(known)[order]
            if len(at):
                c[at] = arrays.at_ids(ids[at], "count", np.uint64)
                n[at] = arrays.at_ids(ids[at], "next", np.uint64)
            base = np.log10((c + 1) / (m.total + v1))
            p = (m.low / v1 + np.maximum(n - _discount(n, m.discounts.get(1, (0.5,) * 3)), 0) / max(1, m.pairs))[back]
            if m.total:
                end = int(np.searchsorted(own, END))
                cols = n_grams(back, [len(h) for h in held], m.order, end)
                words = np.where(ids < 0, m.types, ids).astype(m.dtype)[back]  # no token has that id
                for k in range(2, m.order + 1):
                    context = [ids[x] for x in cols[-k:-1]]
                    some = np.flatnonzero(np.all([x >= 0 for x in context], axis=0))
                    if not len(some):
                        break
                    # a context's hash is the same wherever it stands, so it is looked up with every token
                    share, rest = arrays.look(k, context_hash([x[some] for x in context]), words[some])
                    p[some] = share + rest * p[some]
            logs = np.log10(p)
            lengths = np.array([len(h) for h in held], np.int64)
            starts = np.cumsum(lengths) - lengths
            total = np.add.reduceat(logs, starts)
            cols = [pa.array(lengths), pa.array(np.add.reduceat(known[back].astype(np.int64), starts)), pa.array(np.add.reduceat(base[back], starts)), pa.array(total), pa.array(10 ** (-total / lengths))]
            at = 0
            for part in parts:
                yield pa.RecordBatch.from_arrays([*part.columns, *(c.slice(at, part.num_rows) for c in cols)], names=[*names, "n_tokens", "n_known", "base_score", "score", "perplexity"])
                at += part.num_rows

        # many texts at once, also of several batches: what is looked up together is sorted
        parts, held, size = [], [], 0
        for batch in batches:
            start, texts, kept = 0, batch.column(len(names) - keep_text), pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names)
            for i in range(kept.num_rows):
                held.append(token_hashes(texts[i].as_py(), cache))
                size += len(held[-1])
                if size > LOOK:
                    yield from answer([*parts, kept.slice(start, i + 1 - start)], held)
                    parts, held, size, start = [], [], 0, i + 1
            if start < kept.num_rows:
                parts.append(kept.slice(start))
        if parts:
            yield from answer(parts, held)

    src = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text])])
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in names)
    return src.mapInArrow(tidy(run), f"{schema}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def scored_by(docs: DataFrame, training: Column, text: str = "text", order: int = ORDER, keep_text: bool = True) -> tuple[DataFrame, Model]:
    """Train a model of `order` on the rows where `training` holds, and score all rows."""
    model = trained(docs.where(training), text, order)
    return scored(docs, model, text, keep_text), model
