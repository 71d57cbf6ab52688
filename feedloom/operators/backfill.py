"""Snapshot rows merged with the live log by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import snapshot_key


def latest_positions(log: DataFrame, above: Column | None = None) -> DataFrame:
    """max(lsn) of each (schema, table, key), of positions above `above` only."""
    rows = log.where("lsn is not null")
    if above is not None:
        rows = rows.where(F.col("lsn") > above)
    return rows.groupBy("schema", "table", "key").agg(F.max("lsn").alias("max_lsn"))


def still_current(snapshot: DataFrame, log: DataFrame, position: str = "snapshot_lsn") -> DataFrame:
    """Snapshot rows that no logged event with a strictly greater position supersedes.

    The log is first reduced to one row a key, so the anti join is linear whatever a key's history.
    """
    high = latest_positions(log)
    s, h = snapshot.alias("s"), high.alias("h")
    same = (F.col("s.schema") == F.col("h.schema")) & (F.col("s.table") == F.col("h.table")) & (F.col("s.key") == F.col("h.key"))
    return s.join(h, same & (F.col("h.max_lsn") > F.col(f"s.{position}")), "left_anti")


def read_events(rows: DataFrame, source: str, snapshot_id: str, total: Column, completed: Column) -> DataFrame:
    """Snapshot rows (schema, table, key, after) as read events with progress."""
    progress = F.to_json(F.struct(F.lit(True).alias("snapshot"), F.lit(snapshot_id).alias("snapshot_id"), F.struct(total.alias("total"), completed.alias("completed")).alias("snapshot_progress")))
    return rows.select("*", F.lit(source).alias("source"), F.lit("read").alias("operation"), F.lit(None).cast("string").alias("before"), snapshot_key(F.lit(source), F.col("schema"), F.col("table"), F.col("key"), F.lit(snapshot_id)).alias("idempotency_key"), progress.alias("metadata"))


def control_events(reads: DataFrame, source: str, control: str, snapshot_id: str) -> DataFrame:
    """One control event for each table: key {}, no images, the number of rows."""
    done = reads.groupBy("table").agg(F.count(F.lit(1)).alias("total_rows"))
    meta = F.to_json(F.struct(F.lit(control).alias("control_type"), "total_rows", F.lit(snapshot_id).alias("snapshot_id")))
    return done.select(F.concat_ws(":", F.lit(source), "table", F.lit("control"), F.lit(control), F.lit(snapshot_id)).alias("idempotency_key"), F.lit(source).alias("source"), F.lit("control").alias("operation"), "table", F.lit("{}").alias("key"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"), meta.alias("metadata"), "total_rows")


def merged(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """Current snapshot rows and all live events, as one log."""
    return still_current(snapshot, live).unionByName(live, allowMissingColumns=True)
