import pytest
from pyspark.sql import functions as F

from feedloom.operators import eventlog
from feedloom.plans.routing import Route
from feedloom.sources.feed import order_feed
from feedloom.streaming import streams


def test_restart_loses_nothing_and_keeps_order(spark, sf, tmp_path):
    log = eventlog.append(order_feed(spark, sf))
    path = str(tmp_path / "log")
    log.where("seq % 2 = 1").repartition(3).write.parquet(path)
    seen, fail = [], [True]

    def write(batch, _):
        rows = [(r["key"], r["seq"]) for r in batch.orderBy("seq").collect()]
        if fail[0] and rows:
            fail[0] = False
            raise RuntimeError("down")
        seen.extend(rows)

    run = lambda: streams.consumer(streams.log_source(spark, path, log.schema, 2), Route("c", operations=("insert", "update")), write, str(tmp_path / "cp"), once=True).awaitTermination()
    with pytest.raises(Exception):
        run()
    run()
    log.where("seq % 2 = 0").write.mode("append").parquet(path)
    run()
    want = log.where("operation in ('insert', 'update')").count()
    assert len(seen) == want == len(set(seen))


def test_deduplicated_stream(spark, sf, tmp_path):
    feed = order_feed(spark, sf)
    path = str(tmp_path / "feed")
    feed.coalesce(1).write.parquet(path)
    q = streams.deduplicated(streams.log_source(spark, path, feed.schema)).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == feed.select("idempotency_key").distinct().count()
    assert len(streams.drain(spark, "dedup", 5, "arrival")) == 5


def test_delivery_retries_and_parks(spark, tmp_path):
    rows = [("c", "k1", 1, "ok1"), ("c", "k1", 2, "bad"), ("c", "k1", 3, "ok2"), ("c", "k2", 4, "flaky"), ("c", "k2", 5, "after")]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "consumer string, key string, seq long, event_id string").coalesce(1).write.parquet(path)

    def send(event, attempt):
        return "permanent" if event == "bad" else "transient" if event == "flaky" and attempt == 0 else "ok"

    stream = spark.readStream.schema("consumer string, key string, seq long, event_id string").parquet(path)
    q = streams.delivery(stream, send).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    import time

    for _ in range(80):
        time.sleep(0.5)
        if spark.table("outcomes").where("outcome != 'retry'").count() == 5:
            break
    q.stop()
    got = {r["event_id"]: r["outcome"] for r in spark.table("outcomes").where("outcome != 'retry'").collect()}
    assert got == {"ok1": "delivered", "bad": "parked", "ok2": "delivered", "flaky": "delivered", "after": "delivered"}
    order = [r["event_id"] for r in spark.table("outcomes").where("outcome != 'retry' and key = 'k2'").collect()]
    assert order == ["flaky", "after"]


def test_windowed_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "e")
    e.write.parquet(path)
    out = streams.tumbling(streams.log_source(spark, path, e.schema), "1 day", ["event_type"], late="1 day")
    q = out.writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("days").agg(F.sum("n")).first()[0] == e.count()


def test_raw_log_source(spark, sf, tmp_path):
    from feedloom.queries_capture import _messages
    from feedloom.sources import log_files
    from feedloom.sources.logical import change_events, decoded

    folder = tmp_path / "segments"
    folder.mkdir()
    by_slot = {}
    for r in _messages(spark, sf).orderBy("slot", "pos").collect():
        by_slot.setdefault(r["slot"], []).append((r["lsn"], bytes(r["data"])))
    log_files.register(spark)
    for slot, own in by_slot.items():
        log_files.write(str(folder / f"{slot}-1"), own[:3])
        log_files.write(str(folder / f"{slot}-2"), own[3:])
    batch, direct = (sorted(map(str, change_events(decoded(m)).drop("pos").collect())) for m in (spark.read.format("raw_log").load(str(folder)), _messages(spark, sf)))
    assert batch == direct and len(batch) > 4000
    q = spark.readStream.format("raw_log").load(str(folder)).writeStream.format("memory").queryName("raw").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("raw").count() == sum(map(len, by_slot.values()))
