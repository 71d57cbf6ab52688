"""Snapshots: keyset pages, adaptive page sizes, strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = {
    "snapshot_and_stream": (True, True), "stream_only": (False, True), "snapshot_only": (True, False),
    "snapshot_deferred": (True, True), "snapshot_partial": (True, True),
}
FIRST, LEAST, MOST = 5000, 100, 50_000


def page(table: DataFrame, keys: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The page of `size` rows after the key values `after`, in key order; never an offset."""
    if after is not None:
        table = table.where(F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, after)]))
    return table.orderBy(*keys).limit(size)


def next_size(size: int, seconds: float) -> int:
    """A quarter more below one second, half above three."""
    if seconds < 1:
        return min(MOST, size * 5 // 4)
    if seconds > 3:
        return max(LEAST, size // 2)
    return size


def replayed_size(durations: Column, first: int = FIRST) -> Column:
    """The page size after a series of durations (array<double> in order)."""
    step = lambda n, s: F.when(s < 1, F.least(F.lit(MOST), F.floor(n * 5 / 4).cast("int"))).when(s > 3, F.greatest(F.lit(LEAST), F.floor(n / 2).cast("int"))).otherwise(n)
    return F.aggregate(durations, F.lit(first), step)


def branches(strategy: str, snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """What a strategy lets through."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    use_snapshot, use_live = STRATEGIES[strategy]
    if use_snapshot and use_live:
        return snapshot.unionByName(live, allowMissingColumns=True)
    return snapshot if use_snapshot else live


def require_keys(tables: dict[str, list[str]]) -> None:
    """A table without a primary key is a start-up error."""
    if bad := sorted(t for t, k in tables.items() if not k):
        raise ValueError(f"no primary key: {', '.join(bad)}")
