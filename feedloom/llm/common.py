"""Helpers shared by the text operators: shared storage, words, hashes, arrays."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterable
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: lower-cases A-Z of UTF-8 and leaves everything else alone.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

_ours: list[str] = []


def by_value(name: str) -> None:
    """Pickle the functions of module `name` by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


# ------------------------------------------------------------------ shared storage


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or, where it is unset on one machine (tests), a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(sc, "_feedloom_root", None)
        if not root:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="feedloom-")
            sc._feedloom_root = root
            sc.setCheckpointDir(root)
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one; removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/feedloom-{what}-{uuid.uuid4().hex}"
    if not _ours:
        atexit.register(_tidy)
    _ours.append(path)
    return path


def _tidy() -> None:
    for path in _ours:
        if (local := local_path(path)) is not None:
            shutil.rmtree(local, ignore_errors=True)
            continue
        with contextlib.suppress(Exception):  # the process ends; what cannot be reached stays
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            store.delete_dir(inner)


def local_path(uri: str) -> str | None:
    """The path under which this machine sees `uri`, or None for a remote store."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return parsed.path if parsed.scheme else uri
    return None


def write_shared(uri: str, data: bytes | memoryview) -> None:
    """Write a whole file at once; a second attempt of the same task replaces it by the same bytes."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def map_shared(uri: str, dtype) -> np.ndarray:
    """A shared file as a read-only array: memory-mapped where the store is mounted, else read once."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


#: Rows of a batch between Spark and Python; texts may be long, so the default of 10,000 is too many.
BATCH_ROWS = 1500


def small_batches(spark: SparkSession) -> None:
    """Bound what a task holds of its texts on either side; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that a finished task has freed back to the machine: its worker lives on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run):
    """A function over batches that releases memory when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


# ------------------------------------------------------------------ columns


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


# ------------------------------------------------------------------ words and hashes


class WordHash(dict):
    """Word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs without \\x20 and \\x09-\\x0D, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


def hashed(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the word shingles, in text order with repeats; fewer words make one shingle, none makes none."""
    n = len(h)
    if n == 0:
        return h
    w = min(width, n)
    acc = np.full(n - w + 1, 0x9E3779B97F4A7C15 * w & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(w):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + mix(h[i : n - w + 1 + i] + np.uint64(i))
    return mix(acc)


def text_or_empty(s: pd.Series) -> Iterable[str]:
    return (x if isinstance(x, str) else "" for x in s)
