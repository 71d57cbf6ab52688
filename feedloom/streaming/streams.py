"""Structured Streaming: the log as a source, fan-out, keyed delivery state, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.delivery import BACKOFF, MAX_ATTEMPTS
from ..plans.routing import Route


def log_source(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def deduplicated(stream: DataFrame, time: str = "timestamp", retention: str = "1 hour", key: str = "idempotency_key") -> DataFrame:
    """The first event of each key within the retention; its state expires with the watermark."""
    return stream.withWatermark(time, retention).dropDuplicatesWithinWatermark([key])


def consumer(stream: DataFrame, route: Route, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """One query for each consumer, with a checkpoint (its cursor) of its own.

    The cursor moves when `write` returns; if it fails, the whole micro-batch comes again.
    """
    q = stream.where(route.column()).writeStream.queryName(route.name).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (q.trigger(availableNow=True) if once else q).start()


def ordered(write: Callable[[DataFrame, int], None], partitions: int = 64) -> Callable[[DataFrame, int], None]:
    """Rows of a key in one partition and in order, whatever the file order was."""

    def run(batch: DataFrame, n: int) -> None:
        write(batch.repartition(partitions, "key").sortWithinPartitions("key", "seq"), n)

    return run


OUTCOME = "consumer string, key string, seq long, event_id string, outcome string, attempts int, due long"
QUEUE = "head int, attempts int, due long, seqs array<long>, ids array<string>"


def delivery(stream: DataFrame, send: Callable[[str, int], str]) -> DataFrame:
    """Deliver (consumer, key, seq, event_id) in order of each (consumer, key), with retries.

    send: (event_id, attempt) -> ok, transient or permanent.  A transient failure blocks its key
    only; what follows queues up behind.  After 15 failures, or at once if permanent, the event is
    parked and its key goes on.  Retries are due after the backoff, by processing time.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, due, seqs, ids = (0, 0, [], [])
        if state.exists:
            _, attempts, due, seqs, ids = state.get
            seqs, ids = list(seqs), list(ids)
        queued = set(seqs)
        for b in batches:
            for s, i in sorted(zip(b["seq"], b["event_id"])):
                if s not in queued:
                    queued.add(int(s))
                    seqs.append(int(s))
                    ids.append(i)
        order = sorted(range(len(seqs)), key=seqs.__getitem__) if attempts == 0 else [0, *sorted(range(1, len(seqs)), key=seqs.__getitem__)]
        seqs, ids = [seqs[k] for k in order], [ids[k] for k in order]
        now = state.getCurrentProcessingTimeMs()
        out = []
        while seqs and now >= due:
            result = send(ids[0], attempts)
            attempts += 1
            if result == "ok" or result == "permanent" or attempts >= MAX_ATTEMPTS:
                out.append((*name, seqs.pop(0), ids.pop(0), "delivered" if result == "ok" else "parked", attempts, 0))
                attempts, due = 0, 0
            else:
                due = now + 1000 * BACKOFF[min(attempts - 1, len(BACKOFF) - 1)]
                out.append((*name, seqs[0], ids[0], "retry", attempts, due))
        if seqs:
            state.update((0, attempts, due, seqs, ids))
            state.setTimeoutDuration(max(1, due - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["consumer", "key", "seq", "event_id", "outcome", "attempts", "due"])

    return stream.groupBy("consumer", "key").applyInPandasWithState(run, OUTCOME, QUEUE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def tumbling(events: DataFrame, size: str, by: list[str], time: str = "ts", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by window; for streams `late` sets the watermark."""
    if late:
        events = events.withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, by: list[str], time: str = "ts", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))


def drain(spark: SparkSession, table: str, most: int, order: str = "seq") -> list[dict]:
    """The oldest rows of a memory sink."""
    return [r.asDict() for r in spark.table(table).orderBy(order).limit(most).collect()]


def on_event(stream: DataFrame, call: Callable[[str, dict], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start something for each event, with its idempotency key as the run id."""

    def run(batch: DataFrame, _: int) -> None:
        def each(rows):
            for r in rows:
                call(r["idempotency_key"], r.asDict())

        batch.foreachPartition(each)

    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (q.trigger(availableNow=True) if once else q).start()
