"""Subscriptions to changes: how many a key may hold, what they keep, when they are nudged."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.project import Access
from ..operators.views import ring
from ..plans.where import where

#: Subscriptions a key may hold, events a subscription keeps, debounce of nudges.
MOST, RING, DEBOUNCE_MS = 16, 1024, 100


def admitted(requests: DataFrame, by: str = "key", order: str = "opened", most: int = MOST) -> DataFrame:
    """Add `open`: whether a request for a subscription is granted.  A key holds at most `most`."""
    return requests.withColumn("open", F.row_number().over(W.partitionBy(by).orderBy(order)) <= most)


def matched(events: DataFrame, predicate: str = "", access: Access | None = None) -> DataFrame:
    """What a subscription sees: its predicate first, then what its key may read, with masked columns."""
    rows = events.where(where(predicate)) if predicate else events
    return rows if access is None else access.apply(rows)


def buffered(events: DataFrame, by: str = "subscription", size: int = RING, order: str = "seq") -> DataFrame:
    """The last events of each subscription, with the number that its ring pushed out."""
    return ring(events, [by], size, order)


def nudges(events: DataFrame, by: str = "subscription", time_ms: str = "ms", debounce: int = DEBOUNCE_MS) -> DataFrame:
    """When each subscription is nudged: `debounce` after an event that finds no nudge pending.

    An event at the very moment of a nudge starts the next one.  Every task reads its subscriptions
    in order of time and keeps one number, so a busy subscription needs no more memory than a quiet one.
    """
    rows = events.select(F.col(by).alias("subscription"), F.col(time_ms).cast("bigint").alias("ms")).where("ms is not null")
    kind = dict(rows.dtypes)["subscription"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, due, started = None, 0, False
        for b in batches:
            names, at = [], []
            for s, t in zip(b["subscription"], b["ms"]):
                same = s == name or (pd.isna(s) and pd.isna(name))
                if not started or not same or t >= due:
                    name, due, started = s, t + debounce, True
                    names.append(s)
                    at.append(due)
            yield pd.DataFrame({"subscription": pd.Series(names, dtype=b["subscription"].dtype), "nudge_ms": pd.Series(at, dtype="int64")})

    return rows.repartition("subscription").sortWithinPartitions("subscription", "ms").mapInPandas(run, f"subscription {kind}, nudge_ms bigint")
