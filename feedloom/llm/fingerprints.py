"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the k smallest distinct 48-bit hashes of a text's five-word shingles
(A-Z lower-cased, words are runs without white space; fewer words are one shingle, an
empty or null text has none).  Two sketches of parts merge into the sketch of the whole,
so parts may be sketched anywhere.  From two sketches follow estimates of resemblance
(Jaccard), of containment and of the number of distinct shingles; below k shingles all of
them are exact.  Equal texts have equal fingerprints; two empty texts have likeness 1, an
empty and another text 0.

`fingerprinted` and `estimates` add a column and leave all others, rows and their order alone;
`merged` gives one row a group, also for null groups and groups of empty texts.  `edited_pairs`
gives one row for every row, with the columns that it names and no others; its docstring says
what it does with ties, repeated rows and null keys.  Empty tables stay empty.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import WordHash, by_value, hashed, shingle_hashes, small_batches, words_of

by_value(__name__)

BITS = 48
K = 128
WIDTH = 5
#: Bytes of text of a run of neighbouring keys, on average.
RUN = 128 << 20


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    h = hashes >> np.uint64(64 - BITS)
    if len(h) > 4 * k:  # most texts need no full sort: the smallest few hold the answer
        part = np.unique(np.partition(h, 2 * k)[: 2 * k])
        if len(part) >= k:
            return part[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def encode(s: np.ndarray) -> str:
    raw = s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(raw.tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(s)) if len(s) < k else (k - 1) * float(1 << BITS) / float(s[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity, from the k smallest hashes of the union."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:] == both[:-1]
    keep = np.concatenate(([True], ~twice))
    last = np.cumsum(keep)[1:][twice]  # rank in the union of each common hash
    n = int(keep.sum())
    top = n if len(a) < k and len(b) < k else min(n, k)
    return float((last <= top).sum()) / top


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * distinct(merge(a, b, k), k) / distinct(a, k))


def _sketch_text(text: str, cache: WordHash, k: int, width: int) -> np.ndarray:
    return sketch(shingle_hashes(hashed(words_of(text), cache), width), k)


def fingerprinted(docs: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, width: int = WIDTH) -> DataFrame:
    """Add the fingerprint of `text` to every row."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = WordHash()
        for texts in batches:
            yield pd.Series([encode(_sketch_text(t or "", cache, k, width)) for t in texts], dtype=object)

    return docs.withColumn(out, run(F.col(text)))


def merged(prints: DataFrame, by: list[str], fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each group of parts.

    Hashes are counted as rows of their own, dealt by group and hash; each task then keeps the k
    smallest of a group before they meet, so no task ever holds a hot group as a whole.
    """

    @F.pandas_udf("array<long>")
    def hashes(prints: pd.Series) -> pd.Series:
        return pd.Series([decode(p or "").astype(np.int64) for p in prints])

    @F.pandas_udf("string")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([encode(np.array(sorted(p), np.int64).astype(np.uint64)) for p in parts], dtype=object)

    names = [f"__by{i}" for i in range(len(by))]
    each = prints.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, names)], F.explode_outer(hashes(F.col(f"`{fingerprint}`"))).alias("__h")).distinct()
    least = each.withColumn("__no", F.row_number().over(W.partitionBy(*names).orderBy(F.col("__h").asc_nulls_last()))).where(F.col("__no") <= k)
    whole = least.groupBy(*names).agg(F.collect_list("__h").alias("__h"))
    return whole.select(*[F.col(n).alias(c) for c, n in zip(by, names)], joined(F.col("__h")).alias(fingerprint))


def estimates(a: Column, b: Column, k: int = K) -> Column:
    """struct<resemblance, containment, distinct_a, distinct_b> of two fingerprint columns."""

    @F.pandas_udf("resemblance double, containment double, distinct_a double, distinct_b double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y):
            s, t = decode(p or ""), decode(q or "")
            rows.append((resemblance(s, t, k), containment(s, t, k), distinct(s, k), distinct(t, k)))
        return pd.DataFrame(rows, columns=["resemblance", "containment", "distinct_a", "distinct_b"])

    return run(a, b)


# ------------------------------------------------------------------ neighbours in an order


class Runs:
    """The first (key, hash) of every run of an order: keys descending, then hashes; null keys last."""

    def __init__(self, firsts: list[tuple]):
        self.firsts, self.n = firsts, len(firsts)
        known = [(f[0], f[1]) for f in firsts if f[0] is not None]
        self.known = len(known)
        # ascending, for searches: of equal keys the higher hash is the earlier run
        self.keys = pd.Index([k for k, _ in reversed(known)]) if known else pd.Index([])
        self.hashes = [h for _, h in reversed(known)]
        self.none = np.array([-f[1] - 1 for f in firsts if f[0] is None], np.int64)  # ascending: -h - 1 never overflows
        self.at = {f: i for i, f in enumerate(firsts)}

    def place(self, keys: pd.Series, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's run, and the run before it if the row is the run's first one, else -1."""
        run = np.zeros(len(keys), np.int64)
        null = keys.isna().to_numpy()
        run[null] = self.known + np.searchsorted(self.none, -hashes[null] - 1, "right") - 1
        if not null.all():
            own = keys[~null]
            low, high = (self.keys.searchsorted(own.to_numpy(), side) for side in ("left", "right"))
            h = hashes[~null]
            # firsts that are not after the row: those of higher keys, and of its key those of no lower hash
            before = self.known - high
            for i in np.flatnonzero(low != high).tolist():
                before[i] += high[i] - bisect.bisect_left(self.hashes, h[i], low[i], high[i])
            run[~null] = before - 1
        run = np.maximum(run, 0)
        edge = np.full(len(keys), -1, np.int64)
        for i, (k, x, none) in enumerate(zip(keys.tolist(), hashes.tolist(), null.tolist())):
            j = self.at.get((None if none else k, x))
            if j is not None:
                edge[i] = (j - 1) % self.n
        return run, edge


def in_runs(docs: DataFrame, key: str, text: str, runs: int) -> tuple[DataFrame, int]:
    """Deal rows to runs of neighbours in an order: columns __run, __edge, __hash and all of `docs`; and the number of runs.

    Order: key descending, nulls last, then a hash of the text, so that rows of one key can lie in
    many runs.  Keys and hashes alone are dealt by range to find the first of each run, one row a
    run.  Each run also gets, marked __edge, the row that follows its last one, which is the first
    row of the next run (for the last run, of the first).  So a task finds every row's follower in
    its own run, and texts move once.
    """
    k, h = F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`"))
    name = docs.schema[key].dataType.simpleString()
    thin = docs.select(k.alias("k"), h.alias("h")).repartitionByRange(runs, F.col("k").desc_nulls_last(), F.col("h").desc())
    found = thin.groupBy(F.spark_partition_id().alias("part")).agg(F.max_by(F.struct("k", "h"), F.struct("k", "h")).alias("first")).select("part", "first.k", "first.h")
    firsts = Runs([(r["k"], r["h"]) for r in sorted(found.collect(), key=lambda r: r["part"])])

    @F.pandas_udf("run int, edge int")
    def place(keys: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        run, edge = firsts.place(keys, hashes.to_numpy())
        return pd.DataFrame({"run": run.astype(np.int32), "edge": edge.astype(np.int32)})

    placed = docs.select(*docs.columns, h.alias("__hash")).withColumn("__p", place(k.cast(name), F.col("__hash")))
    to = F.filter(F.array(F.struct(F.col("__p.run").alias("run"), F.lit(False).alias("edge")), F.struct(F.col("__p.edge").alias("run"), F.lit(True).alias("edge"))), lambda x: x["run"] >= 0)
    dealt = placed.withColumn("__t", F.explode(to))
    return dealt.select(F.col("__t.run").alias("__run"), F.col("__t.edge").alias("__edge"), "__hash", *docs.columns), max(1, firsts.n)


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH, run: int = RUN) -> DataFrame:
    """Fingerprint every text, its edited text and compare them with each other and the next document.

    Order: descending key, nulls last, equal keys by a descending hash of the text; the last is
    followed by the first.  Edited text: the last floor(n / 3) code points give way to the first as
    many (or all) of the next document's.  A single document follows itself.  The key may have any
    type that Spark orders; run: bytes of text that a task walks through, on average.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    dealt, runs = in_runs(rows, "__key", "__text", int(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // run + 1)))
    dealt = dealt.repartitionById(runs, "__run").sortWithinPartitions("__run", "__edge", F.col("__key").desc_nulls_last(), F.col("__hash").desc(), F.col("__text").desc()).drop("__hash")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        cache = WordHash()
        out: list[tuple] = []
        held = None  # run, key, text, sketch: the row whose follower is awaited
        closed = None  # the run whose edge has come

        def answer(row, after_text, after_sketch):
            _, i, t, s = row
            cut = len(t) // 3
            edited = t[: len(t) - cut] + after_text[:cut]
            e = _sketch_text(edited, cache, k, width)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return i, len(t), sha, encode(s), encode(e), resemblance(s, e, k), resemblance(s, after_sketch, k)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            cols = [batch.column(c) for c in range(4)]
            for at in range(0, batch.num_rows, 500):
                for run, edge, i, t in zip(*(c.slice(at, 500).to_pylist() for c in cols)):
                    if run == closed:
                        continue  # of equal edge rows the first counts
                    s = _sketch_text(t, cache, k, width)
                    if held is not None and held[0] == run:
                        out.append(answer(held, t, s))
                    held = None if edge else (run, i, t, s)
                    closed = run if edge else None
                if len(out) >= 500:
                    yield flush()
        if out:
            yield flush()

    own = docs.schema[key].dataType
    arrow = pa.schema([(key, to_arrow_type(own)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    schema = T.StructType([T.StructField(key, own), *T._parse_datatype_string("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])
    return dealt.mapInArrow(walk, schema)
