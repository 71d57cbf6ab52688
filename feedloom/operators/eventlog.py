"""The durable event log: first arrivals, partitions, sequences, expiry and range scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import PARTITIONS, partition_of


def first_arrivals(events: DataFrame, key: str = "idempotency_key", arrival: str = "arrival") -> DataFrame:
    """The first event of each idempotency key.

    A hash aggregate with partial combining: duplicates never cross the network whole, and a hot
    key costs one row a task.
    """
    fields = [c for c in events.columns if c not in (key, arrival)]
    first = events.groupBy(key).agg(F.min(F.struct(arrival, *fields)).alias("__e"))
    return first.select(*[F.col(key) if c == key else F.col(f"__e.{c}").alias(c) for c in events.columns])


#: Bytes of a partition that one task numbers.
RUN_BYTES = 1 << 30


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a result's size; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def numbered(new: DataFrame, order: list[str], ranges: int, by: tuple[str, ...] = ("partition",)) -> DataFrame:
    """Add seq, from 1 in each group of `by` by `order` (the first of it a number); without `by`, over all rows.

    A group is cut into `ranges` ranges of the first column, each numbered in a task of its own;
    what earlier ranges hold is added from one count a range.
    """
    within = lambda *more: W.partitionBy(*by, *more) if by or more else W.partitionBy(F.lit(0))
    if ranges == 1:
        return new.withColumn("seq", F.row_number().over(within().orderBy(*order)).cast("bigint"))
    cuts = new.approxQuantile(order[0], [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    cut = F.lit(sorted({float(c) for c in cuts})).cast("array<double>")
    rows = new.withColumn("__r", F.size(F.filter(cut, lambda c: c < F.col(order[0]))))
    before = within().orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "__r").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(within("__r").orderBy(*order))
    return rows.withColumn("seq", own.cast("bigint")).join(counts, [*by, "__r"]).withColumn("seq", F.col("seq") + F.col("__before")).drop("__r", "__before")


def append(events: DataFrame, log: DataFrame | None = None, n: int = PARTITIONS, key: str = "idempotency_key", arrival: str = "arrival", ranges: int | None = None) -> DataFrame:
    """Rows to add to `log`: new keys only, with partition and seq.

    seq is monotone within a partition and goes on after the log's highest; gaps are allowed.
    ranges: tasks that number a partition; by default as many as its planned size asks for.  The
    numbers are the same for any.
    """
    new = first_arrivals(events, key, arrival)
    if log is not None:
        new = new.join(log.select(key), key, "left_anti")
    new = new.withColumn("partition", partition_of(F.col("key"), n))
    new = numbered(new, [arrival, key], ranges or planned_bytes(new) // (n * RUN_BYTES) + 1)
    if log is not None:
        high = log.groupBy("partition").agg(F.max("seq").alias("__high"))
        new = new.join(F.broadcast(high), "partition", "left").withColumn("seq", F.col("seq") + F.coalesce("__high", F.lit(0))).drop("__high")
    return new


def append_stream(events: DataFrame, log: DataFrame | None = None, n: int = PARTITIONS, key: str = "idempotency_key", arrival: str = "arrival", ranges: int | None = None) -> DataFrame:
    """The same for a log that numbers all partitions as one stream; readers take seq as an opaque cursor.

    `log` holds what is within the window in which keys are remembered, and its highest seq.
    """
    new = first_arrivals(events, key, arrival)
    high = 0
    if log is not None:
        new = new.join(log.select(key), key, "left_anti")
        high = log.agg(F.max("seq")).first()[0] or 0
    new = new.withColumn("partition", partition_of(F.col("key"), n))
    return numbered(new, [arrival, key], ranges or planned_bytes(new) // RUN_BYTES + 1, ()).withColumn("seq", F.col("seq") + F.lit(high).cast("bigint"))


def acknowledged(events: DataFrame, new: DataFrame, key: str = "idempotency_key", arrival: str = "arrival") -> DataFrame:
    """Every event sent with the seq it got, 0 if it was a duplicate; arrivals are unique."""
    got = new.select(key, arrival, "seq")
    return events.join(got, [key, arrival], "left").withColumn("seq", F.coalesce("seq", F.lit(0).cast("bigint")))


def live(log: DataFrame, now: Column, retention: str = "1 hour", appended: str = "appended") -> DataFrame:
    """Entries within the retention; an entry's key expires with it, so it may come again."""
    return log.where(F.col(appended) > now - F.expr(f"interval {retention}"))


def scan(log: DataFrame, partition: int, from_seq: int, limit: int) -> DataFrame:
    """Entries of a partition from `from_seq` on, ascending."""
    return log.where((F.col("partition") == partition) & (F.col("seq") >= from_seq)).orderBy("seq").limit(limit)


def save(log: DataFrame, path: str) -> None:
    """Store the log by partition, so that scans read one folder and per-key order lies in one file set."""
    log.repartition("partition").sortWithinPartitions("partition", "seq").write.partitionBy("partition").mode("append").parquet(path)


def chunks(sizes: Column, budget: int, most: int) -> Column:
    """array<int>: the chunk of each item of an ordered array of sizes.

    Greedy: a chunk closes before the item that would exceed half of `budget` or `most` items; an
    item that is larger alone has a chunk of its own.
    """
    half = budget // 2

    def step(a: Column, s: Column) -> Column:
        full = (a["n"] > 0) & ((a["bytes"] + s > half) | (a["n"] >= most))
        chunk = F.when(full, a["chunk"] + 1).otherwise(a["chunk"])
        return F.struct(F.concat(a["out"], F.array(chunk)).alias("out"), chunk.alias("chunk"), F.when(full, s).otherwise(a["bytes"] + s).cast("bigint").alias("bytes"), F.when(full, 1).otherwise(a["n"] + 1).alias("n"))

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).cast("bigint").alias("bytes"), F.lit(0).alias("n"))
    return F.aggregate(sizes, start, step, lambda a: a["out"])
