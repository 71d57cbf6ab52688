"""Views over the stream: latest state, diffs, feeds, rings, keyed lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .project import Access


def latest_state(events: DataFrame, keys: list[str], order: str = "seq", op: str = "operation") -> DataFrame:
    """The last event of each key, unless it is a delete: an upsert/delete fold as one aggregate."""
    fields = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("__e"))
    return last.where(F.col(f"__e.{op}") != "delete").select(*keys, *[F.col(f"__e.{c}").alias(c) for c in fields])


def changed_fields(events: DataFrame, before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """One row for each audited field that an update changed: field, from_value, to_value."""
    each = [F.struct(F.lit(f).alias("field"), before[f].cast("string").alias("from_value"), after[f].cast("string").alias("to_value")) for f in after]
    rows = events.where("operation = 'update'").withColumn("__c", F.explode(F.array(*each)))
    return rows.where(~F.col("__c.from_value").eqNullSafe(F.col("__c.to_value"))).select(*events.columns, "__c.*")


def with_previous(events: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """previous_<column> from the row before, for sources without before images."""
    w = W.partitionBy(*keys).orderBy(order)
    return events.select("*", *[F.lag(c).over(w).alias(f"previous_{c}") for c in columns])


def ring(events: DataFrame, by: list[str], size: int, order: str = "seq") -> DataFrame:
    """The last `size` events of each group, with the number that fell out."""
    w = W.partitionBy(*by)
    return events.withColumn("__rn", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("dropped", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - size)).where(F.col("__rn") <= size).drop("__rn")


def drained(events: DataFrame, by: list[str], size: int, most: int = 100, order: str = "seq") -> DataFrame:
    """The oldest `most` of a ring, with dropped and remaining."""
    kept = ring(events, by, size, order)
    w = W.partitionBy(*by)
    return kept.withColumn("__rn", F.row_number().over(w.orderBy(order))).withColumn("remaining", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - most)).where(F.col("__rn") <= most).drop("__rn")


def recent_index(events: DataFrame, size: int = 10_000, key: str = "id", order: str = "seq") -> DataFrame:
    """The last `size` ids by first appearance; a repeated id shows its latest payload in its old place."""
    fields = [c for c in events.columns if c != key]
    one = events.groupBy(key).agg(F.min(order).alias("position"), F.max_by(F.struct(*fields), order).alias("__e"))
    return one.orderBy(F.desc("position")).limit(size).select(key, "position", *[F.col(f"__e.{c}").alias(c) for c in fields])


def recent_feed(events: DataFrame, size: int, order: str = "seq", by: list[str] | None = None) -> DataFrame:
    """Newest first, overall or for each group."""
    if not by:
        return events.orderBy(F.desc(order)).limit(size)
    return events.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("__rn") <= size).drop("__rn")


def counts(events: DataFrame, by: list[str], out: str = "n") -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def versions(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """version: the ordinal of a change within its key's life; a delete starts a new life."""
    w = W.partitionBy(*keys).orderBy(order)
    life = F.coalesce(F.sum(F.when(F.col("operation") == "delete", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = events.withColumn("life", life)
    return rows.withColumn("version", F.row_number().over(W.partitionBy(*keys, "life").orderBy(order)))


def cache_counters(events: DataFrame, keys: list[str]) -> DataFrame:
    """Refreshes (writes) and invalidations (deletes) of each key."""
    return events.groupBy(*keys).agg(F.count_if(F.col("operation") != "delete").alias("refreshes"), F.count_if(F.col("operation") == "delete").alias("invalidations"))


def with_latest(parents: DataFrame, children: DataFrame, on: str, value: str, order: str, first: str, out: str) -> DataFrame:
    """The latest child value of each parent, of children that came after the parent was known (`first`)."""
    known = children.join(parents.select(on, first), on).where(F.col(order) > F.col(first))
    last = known.groupBy(on).agg(F.max_by(value, order).alias(out))
    return parents.join(last, on, "left")


def as_of(rows: DataFrame, facts: DataFrame, on: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row with the facts in force at its position: one sorted stream a key, no pair join."""
    right = facts.select(*on, order, F.struct(*columns).alias("__f"), F.lit(0).alias("__kind"))
    both = rows.withColumn("__kind", F.lit(1)).unionByName(right, allowMissingColumns=True)
    w = W.partitionBy(*on).orderBy(order, "__kind").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("__f", F.last("__f", ignorenulls=True).over(w)).where("__kind = 1")
    return out.select(*rows.columns, *[F.col(f"__f.{c}").alias(c) for c in columns])


def looked_up(rows: DataFrame, dimension: DataFrame, on: str, name: str, out: str) -> DataFrame:
    """A dimension's name, or the id itself where it is unknown."""
    d = dimension.select(F.col(on).alias("__on"), F.col(name).alias("__name"))
    return rows.join(d, rows[on] == d["__on"], "left").withColumn(out, F.coalesce("__name", F.col(on).cast("string"))).drop("__on", "__name")


def runs(events: DataFrame, by: list[str], order: str, kind: Column, out: str = "run", place: str = "place") -> DataFrame:
    """Number runs of consecutive rows of the same kind, and rows within their run from 0; all in one sort."""
    w = W.partitionBy(*by).orderBy(order)
    rows = events.withColumn("__k", kind).withColumn("__n", F.row_number().over(w))
    rows = rows.withColumn("__s", F.when(F.lag("__k").over(w).eqNullSafe(F.col("__k")) & (F.col("__n") > 1), 0).otherwise(1))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn(out, F.sum("__s").over(so_far)).withColumn(place, F.col("__n") - F.max(F.when(F.col("__s") == 1, F.col("__n"))).over(so_far))
    return rows.drop("__k", "__n", "__s")


def per_key_order(events: DataFrame, partitions: int = 64) -> DataFrame:
    """Rows of a key in one partition, ascending."""
    return events.repartition(partitions, "partition").sortWithinPartitions("partition", "seq")


def search_terms(*columns: Column, long: Column, least: int = 4) -> Column:
    """Distinct lower-case words of short fields, and of a long one those with at least `least` letters."""
    split = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")
    words = F.concat(*[split(c) for c in columns], F.filter(split(long), lambda x: F.length(x) >= least))
    return F.array_sort(F.filter(F.array_distinct(words), lambda x: x != ""))


def by_id(events: DataFrame, value: str, size: int = 10_000, key: str = "id", order: str = "seq", access: Access | None = None) -> DataFrame:
    """One event of the recent index, or none; none, too, where its table may not be read."""
    found = recent_index(events, size, key, order).where(F.col(key) == value)
    return found if access is None else access.apply(found)
