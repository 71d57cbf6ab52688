"""From decoded log messages to change events: columns left out, keys, transactions, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fill_unchanged(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], op: str = "operation", unchanged: str = "unchanged") -> DataFrame:
    """Fill columns that the log left out as unchanged from the row's previous image.

    `unchanged` is array<string>, the names left out; a real null is not in it.  A delete ends the
    row's life, and what follows it knows nothing of before; such a column stays in `unchanged`.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("__life", F.coalesce(F.sum(F.when(F.col(op) == "delete", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    life = W.partitionBy(*keys, "__life").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    known = []
    for c in columns:
        left_out = F.array_contains(unchanged, c)
        last = F.last(F.when(~left_out, F.struct(F.col(c).alias("v"))), ignorenulls=True).over(life)
        rows = rows.withColumn(f"__{c}", last)
        known.append(F.when(left_out & F.col(f"__{c}").isNull(), F.lit(c)))
    still = F.filter(F.array(*known), lambda x: x.isNotNull())
    out = rows.withColumn(unchanged, still)
    for c in columns:
        out = out.withColumn(c, F.col(f"__{c}.v")).drop(f"__{c}")
    return out.drop("__life")


def with_relation(rows: DataFrame, relations: DataFrame, by: str = "rel_id", position: str = "lsn") -> DataFrame:
    """Attach the table definition in force: the latest announced for `by` at or before the row.

    Definitions and rows meet in one sorted stream for each relation, so the work is linear.
    """
    fields = [c for c in relations.columns if c not in (by, position)]
    defs = relations.select(by, position, F.struct(*fields).alias("__def"), F.lit(0).alias("__kind"))
    both = rows.withColumn("__kind", F.lit(1)).unionByName(defs, allowMissingColumns=True)
    w = W.partitionBy(by).orderBy(position, "__kind").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("__def", F.last("__def", ignorenulls=True).over(w)).where("__kind = 1")
    return out.select(*rows.columns, *[F.col(f"__def.{f}").alias(f) for f in fields])


def change_ordinal(rows: DataFrame, txn: list[str], order: list[str], out: str = "change_seq") -> DataFrame:
    """The 0-based ordinal of each change in its transaction."""
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*txn).orderBy(*order)) - 1)


def committed(rows: DataFrame, outcomes: DataFrame, xid: str = "xid") -> DataFrame:
    """Streamed changes whose transaction committed, stamped with its position; aborted and open ones vanish.

    outcomes: xid, outcome (commit or abort), commit_lsn.
    """
    done = outcomes.where("outcome = 'commit'").select(xid, "commit_lsn")
    return rows.join(done, xid).withColumn("lsn", F.col("commit_lsn")).drop("commit_lsn")


def acknowledged(read: Column, saved: Column) -> Column:
    """Never beyond what is durable."""
    return F.least(read, saved)


def slot_decision(checkpoint: Column, slot: Column) -> Column:
    """start (no checkpoint), resume (slot there), or lost (a checkpoint without its slot)."""
    return F.when(checkpoint.isNull() | (checkpoint == 0), "start").when(slot.isNull(), "lost").otherwise("resume")


def start_position(checkpoint: Column, consistent: Column) -> Column:
    """After the checkpoint; else a new slot's consistent point; else 0."""
    return F.when(checkpoint > 0, checkpoint + 1).otherwise(F.coalesce(consistent, F.lit(0)))
