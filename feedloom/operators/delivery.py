"""Delivery bookkeeping as relations: retries, floors, cursors, poison, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds before each further attempt; the last one repeats.
BACKOFF = (1, 5, 30, 120, 600)
MAX_ATTEMPTS = 15
POISON_STREAK = 25
REASON_BYTES = 1024


def next_delay(attempt: Column) -> Column:
    """Seconds after failure number `attempt` (from 0)."""
    return F.element_at(F.array(*[F.lit(s) for s in BACKOFF]), F.least(attempt + 1, F.lit(len(BACKOFF))).cast("int"))


def jittered_delay(attempt: Column) -> Column:
    """Uniform in (0, delay]."""
    return next_delay(attempt) * (1 - F.rand())


def classify(status: Column) -> Column:
    """ok (2xx), transient (408, 429, 5xx) or poison."""
    return F.when(status.between(200, 299), "ok").when(status.isin(408, 429) | status.between(500, 599), "transient").otherwise("poison")


def reason(text: Column, most: int = REASON_BYTES) -> Column:
    """At most so many bytes; a character cut in half at the end goes."""
    raw = F.encode(text, "UTF-8")
    cut = F.substring(raw, 1, most)
    clean = F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(clean)


def outcomes(attempts: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """What happens to each queued event of a key, in order.

    attempts: `failures`, the failed tries before success (null: never succeeds), `permanent`.
    An event is parked at once if its error is permanent, or after 15 failures; it then counts as
    done and lets the key go on.  waited: seconds of backoff for the event itself; blocked_by: how
    many earlier events of the key failed at least once.
    """
    parked = F.col("permanent") | F.col("failures").isNull() | (F.col("failures") >= MAX_ATTEMPTS)
    tries = F.when(F.col("permanent"), 1).when(parked, MAX_ATTEMPTS).otherwise(F.col("failures") + 1)
    schedule = F.transform(F.sequence(F.lit(0), F.lit(MAX_ATTEMPTS)), lambda i: next_delay(i))
    waited = F.aggregate(F.slice(schedule, F.lit(1), F.greatest(F.lit(0), tries - 1)), F.lit(0), lambda a, s: a + s)
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = attempts.withColumn("outcome", F.when(parked, "parked").otherwise("delivered")).withColumn("attempts", tries).withColumn("waited", waited)
    return out.withColumn("blocked_by", F.coalesce(F.sum(F.when(F.col("attempts") > 1, 1).otherwise(0)).over(w), F.lit(0)))


def floors(queued: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The lowest undelivered seq of each consumer and partition."""
    return queued.groupBy(*(by or ["consumer", "partition"])).agg(F.min("seq").alias("floor"))


def cursors(reads: DataFrame, queued: DataFrame) -> DataFrame:
    """The cursor to persist: after the last entry read, but never beyond a queued one.

    reads: consumer, partition, seq of everything read.
    """
    top = reads.groupBy("consumer", "partition").agg((F.max("seq") + 1).alias("next"))
    return top.join(floors(queued), ["consumer", "partition"], "left").select("consumer", "partition", F.least("next", F.coalesce("floor", "next")).alias("cursor"))


def pending(log: DataFrame, positions: DataFrame) -> DataFrame:
    """Entries that each consumer has still to see; an unknown cursor is 1.

    positions: consumer, partition, cursor; its consumers all read every partition.
    """
    consumers = positions.select("consumer").distinct()
    grid = consumers.crossJoin(log.select("partition").distinct())  # consumers times 64 partitions
    at = grid.join(positions, ["consumer", "partition"], "left").select("consumer", "partition", F.coalesce("cursor", F.lit(1)).alias("cursor"))
    return log.join(at, "partition").where(F.col("seq") >= F.col("cursor"))


def rewind(positions: DataFrame) -> DataFrame:
    """Where to read each partition from: the lowest cursor."""
    return positions.groupBy("partition").agg(F.min(F.coalesce("cursor", F.lit(1))).alias("cursor"))


def without_skipped(log: DataFrame, skipped: DataFrame) -> DataFrame:
    """Entries but those parked as poison."""
    return log.join(skipped, ["partition", "seq"], "left_anti")


def poison_streaks(results: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """streak: consecutive poisons up to a row; after 25 of them a further one counts as transient (the endpoint is at fault)."""
    w = W.partitionBy(*by).orderBy(order)
    rows = results.withColumn("__ok", F.sum(F.when(F.col("result") != "poison", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    streak = F.sum(F.when(F.col("result") == "poison", 1).otherwise(0)).over(W.partitionBy(*by, "__ok").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("streak", streak).drop("__ok")
    return rows.withColumn("verdict", F.when((F.col("result") == "poison") & (F.col("streak") > POISON_STREAK), "transient").otherwise(F.col("result")))


def poison_skips(results: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """What a consumer does with each entry of a partition, from the results of sending them in order.

    delivered (ok), skipped (poison: dead-lettered, then passed over), blocked (the first that is
    transient, or poison after a streak of them: it is tried again, nothing overtakes it) or pending
    (all behind that).  cursor: where the partition is read from next.
    """
    judged = poison_streaks(results, by, order)
    whole = W.partitionBy(*by)
    stop = F.min(F.when(F.col("verdict") == "transient", F.col(order))).over(whole)
    rows = judged.withColumn("__stop", stop).withColumn("cursor", F.coalesce("__stop", F.max(order).over(whole) + 1))
    action = F.when(F.col(order) > F.col("__stop"), "pending").when(F.col(order) == F.col("__stop"), "blocked").when(F.col("verdict") == "poison", "skipped").otherwise("delivered")
    return rows.withColumn("action", action).drop("__stop", "streak", "verdict")


def dead_letters(failed: DataFrame, existing: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """Rows to add to the dead-letter table: one for each consumer and event, the first."""
    fields = [c for c in failed.columns if c not in ("consumer", "event_id")]
    one = failed.groupBy("consumer", "event_id").agg(F.min(F.struct(order, *[f for f in fields if f != order])).alias("__e"))
    one = one.select("consumer", "event_id", *[F.col(f"__e.{f}").alias(f) for f in fields])
    if existing is not None:
        one = one.join(existing, ["consumer", "event_id"], "left_anti")
    return one


def list_dead(letters: DataFrame, consumer: str | None = None, partition: int | None = None, limit: int | None = None) -> DataFrame:
    """Dead letters in the order of consumer, partition and seq; no limit unless asked for."""
    if consumer is not None:
        letters = letters.where(F.col("consumer") == consumer)
    if partition is not None:
        letters = letters.where(F.col("partition") == partition)
    out = letters.orderBy("consumer", "partition", "seq")
    return out.limit(limit) if limit is not None else out


def purge(letters: DataFrame, older_than: Column, at: str = "parked_at") -> DataFrame:
    return letters.where(F.col(at) >= older_than)
