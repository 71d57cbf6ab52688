"""Queries: sources, capture, event log, backfill."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import keys as K
from .operators import backfill, eventlog
from .registry import FEED, FNV, query, table
from .sources import capture, documents, snapshot, streams_text
from .sources.feed import order_feed
from .sources.logical import change_events, decoded


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey > 1000 order by o_orderkey limit 500")
def s_keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot.page(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], 500, (1000,))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where (l_orderkey, l_linenumber, l_partkey, l_suppkey) > (1000, 2, 0, 0) order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 500")
def s_keyset_composite(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return snapshot.page(table(spark, sf, "lineitem").select(*keys), keys, 500, (1000, 2, 0, 0))


@query("""
    select user_id, cast(list_reduce(list_prepend(cast(5000 as double), list((event_id % 50) / 10.0 order by event_id)),
           lambda n, s: case when s < 1 then least(50000, floor(n * 5 / 4)) when s > 3 then greatest(100, floor(n / 2)) else n end) as integer) as size
    from events group by user_id
""")
def s_batch_size(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", ((F.col("event_id") % 50) / 10.0).alias("s")))), lambda x: x["s"]).alias("d"))
    return e.select("user_id", snapshot.replayed_size(F.col("d")).alias("size"))


@query("""
    with r as (
        select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity >= 49 as dead, l_linenumber % 3 = 0 as out_, l_returnflag,
               coalesce(sum(case when l_quantity >= 49 then 1 else 0 end) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey rows between unbounded preceding and 1 preceding), 0) as life from lineitem
    ), f as (
        select *, last_value(case when not out_ then l_returnflag end ignore nulls) over (partition by l_suppkey, life order by l_orderkey, l_linenumber, l_partkey rows between unbounded preceding and current row) as v from r
    )
    select l_suppkey, l_orderkey, l_linenumber, l_partkey, v as l_returnflag, case when out_ and v is null then 1 else 0 end as unknown from f
""")
def s_toast_merge(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.when(F.col("l_quantity") >= 49, "delete").otherwise("update").alias("operation"), F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit("l_returnflag"))).otherwise(F.array().cast("array<string>")).alias("unchanged"))
    out = capture.fill_unchanged(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], ["l_returnflag"])
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.size("unchanged").alias("unknown"))


@query("select l_orderkey, l_linenumber, l_partkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as integer) as change_seq from lineitem")
def s_txn_seq(spark, sf):
    return capture.change_ordinal(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@query("select l_orderkey as xid, l_linenumber, l_partkey, o_orderkey * 100 as lsn from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'")
def s_txn_commit_abort(spark, sf):
    o = table(spark, sf, "orders")
    outcomes = o.select(F.col("o_orderkey").alias("xid"), F.when(F.col("o_orderstatus") == "F", "commit").when(F.col("o_orderstatus") == "O", "abort").alias("outcome"), (F.col("o_orderkey") * 100).alias("commit_lsn"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("xid"), "l_linenumber", "l_partkey")
    return capture.committed(rows, outcomes)


@query("select c_custkey as lsn, c_nationkey as rel_id, s_name as relation from customer asof left join (select s_nationkey, s_suppkey * 10 as at, s_name from supplier) s on c_nationkey = s_nationkey and c_custkey >= s.at")
def s_relation_lookup(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("lsn"), F.col("c_nationkey").alias("rel_id"))
    rel = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("rel_id"), (F.col("s_suppkey") * 10).alias("lsn"), F.col("s_name").alias("relation"))
    return capture.with_relation(rows, rel)


@query("""select l_orderkey, l_linenumber, l_partkey, '{"l_linenumber":"' || l_linenumber || '","l_orderkey":"' || l_orderkey || '"}' as key from lineitem""")
def s_pk_extract(spark, sf):
    li = table(spark, sf, "lineitem")
    key = K.canonical_key({c: (F.col(c), li.schema[c].dataType) for c in ("l_orderkey", "l_linenumber")})
    return li.select("l_orderkey", "l_linenumber", "l_partkey", key.alias("key"))


@query(f"with {FEED} select arrival, 'feed:tpch.orders:' || key || ':' || op || ':' || upper(to_base(lsn >> 32, 16)) || '/' || upper(to_base(lsn & 4294967295, 16)) || ':0' as idempotency_key from feed")
def s_idempotency_key(spark, sf):
    return order_feed(spark, sf).select("arrival", "idempotency_key")


@query("select c_custkey, least(c_custkey * 7 % 1000, c_custkey * 13 % 1000) as ack, case when c_custkey % 5 = 0 then 'start' when c_custkey % 3 = 0 then 'lost' else 'resume' end as decision, case when c_custkey % 5 <> 0 then c_custkey + 1 else c_custkey * 2 end as start_lsn from customer")
def s_slot_positions(spark, sf):
    k = F.col("c_custkey")
    checkpoint = F.when(k % 5 != 0, k)
    return table(spark, sf, "customer").select(k, capture.acknowledged(k * 7 % 1000, k * 13 % 1000).alias("ack"), capture.slot_decision(checkpoint, F.when(k % 3 != 0, k)).alias("decision"), capture.start_position(checkpoint, k * 2).alias("start_lsn"))


@query("""
    select s as strategy, origin, case origin when 'live' then l.n else o.n end as n, case origin when 'live' then l.total else o.total end as total
    from (values ('snapshot_and_stream'), ('stream_only'), ('snapshot_only'), ('snapshot_deferred'), ('snapshot_partial')) t(s), (values ('live'), ('snapshot')) u(origin),
         (select count(*) as n, cast(sum(event_id) as bigint) as total from events) l, (select count(*) as n, cast(sum(o_orderkey) as bigint) as total from orders) o
    where not (s = 'stream_only' and origin = 'snapshot') and not (s = 'snapshot_only' and origin = 'live')
""")
def s_strategies(spark, sf):
    snap = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit("snapshot").alias("origin"))
    live = table(spark, sf, "events").select(F.col("event_id").alias("k"), F.lit("live").alias("origin"))
    out = None
    for s in snapshot.STRATEGIES:
        one = snapshot.branches(s, snap, live).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")).select(F.lit(s).alias("strategy"), "origin", "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


_DOC = """'{"_id":"t' || event_id || '","operationType":"' || (case event_id % 5 when 0 then 'insert' when 1 then 'update' when 2 then 'replace' when 3 then 'delete' else 'drop' end) || '","ns":{"db":"app","coll":"' || event_type || '"},"documentKey":{"_id":' || user_id || '},"clusterTime":{"$timestamp":{"t":' || (1700000000 + event_id) || ',"i":' || (event_id % 3) || '}}' || (case when event_id % 5 in (0, 1, 2) and event_id % 10 <> 0 then ',"fullDocument":' || props else '' end) || '}'"""


@query("""
    select 'm:app.' || event_type || ':{"_id":' || user_id || '}:' || (case event_id % 5 when 0 then 'insert' when 3 then 'delete' else 'update' end) || ':' || lpad(upper(to_base(1700000000 + event_id, 16)), 8, '0') || lpad(upper(to_base(event_id % 3, 16)), 8, '0') as idempotency_key,
           (1700000000 + event_id) * 4294967296 + event_id % 3 as lsn, event_type as "table"
    from events where event_id % 5 <> 4 and event_id % 10 <> 0
""")
def s_mongo_normalise(spark, sf):
    raw = table(spark, sf, "events").selectExpr(f"{_DOC} as doc")
    good, _ = documents.normalised(raw, "m")
    return good.select("idempotency_key", "lsn", "table")


@query("select case when event_id % 5 = 4 then 'unsupported operationType drop' else 'insert without fullDocument' end as error, count(*) as n from events where event_id % 5 = 4 or event_id % 10 = 0 group by 1")
def s_mongo_errors(spark, sf):
    raw = table(spark, sf, "events").selectExpr(f"{_DOC} as doc")
    _, bad = documents.normalised(raw, "m")
    return bad.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'm:app.events:{"_id":"' || event_id || '"}:read' as idempotency_key, 'read' as operation from events where event_id % 4 <> 0""")
def s_mongo_snapshot(spark, sf):
    docs = table(spark, sf, "events").select(F.when(F.col("event_id") % 4 == 0, F.lit('{"x":1}')).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("_id"), "value"))).alias("doc"))
    return documents.snapshot(docs, "m", "app", "events").select("idempotency_key", "operation")


@query("select event_id from events where event_id % 7 <> 0")
def s_ndjson_skip(spark, sf):
    lines = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("value"))
    return streams_text.ndjson(lines).select("event_id")


@query("""select event_id, cast(case when event_id % 3 = 0 then 1 else 2 end as integer) as n, '{"id":' || event_id || '}' as first from events""")
def s_sse_parse(spark, sf):
    e = F.col("event_id").cast("string")
    text = F.concat(F.lit(": hello\r\nid: 1\r\ndata: {\"id\":"), e, F.lit("}\r\n\r\n"), F.when(F.col("event_id") % 3 == 0, "data: nonsense{\n\n").otherwise("event: x\ndata: {\"a\":\ndata: 1}\n\n"))
    d = streams_text.sse_data(text)
    return table(spark, sf, "events").select("event_id", F.size(d).alias("n"), F.get(d, F.lit(0)).alias("first"))


SLOTS = 32


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Protocol messages of a history of `lineitem`, on 32 slots: each order is a transaction.

    Lines are inserted, updated with an old key and an unchanged column, updated with an old row, or
    deleted.  Every third order is streamed in two segments with those of other orders between
    them, and then committed or aborted.
    """
    num = lambda c, digits: F.lpad(F.hex(c), digits, "0")
    word = lambda c: F.hex(F.encode(c, "UTF-8"))
    value = lambda c: F.concat(F.lit("74"), num(F.octet_length(c), 8), word(c))
    o = F.col("l_orderkey")
    w = W.partitionBy("l_orderkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("int").cast("string").alias("qty"))
    lines = lines.withColumn("n", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey"))).withColumn("half", F.floor((F.count(F.lit(1)).over(w) + 1) / 2))
    streamed, second = o % 3 == 0, F.col("n") > F.col("half")
    id_ = (o * 100 + F.col("n")).cast("string")
    full = F.concat(F.lit("0003"), value(id_), value(F.col("l_returnflag")), value(F.col("qty")))
    bare = F.concat(F.lit("0003"), value(id_), F.lit("6E6E"))
    part = F.concat(F.lit("0003"), value(id_), F.lit("75"), value(F.col("qty")))
    kind = F.col("n") % 4
    tail = F.when(kind == 1, F.concat(F.lit("4E"), full)).when(kind == 2, F.concat(F.lit("4B"), bare, F.lit("4E"), part)).when(kind == 3, F.concat(F.lit("4F"), full, F.lit("4E"), full)).otherwise(F.concat(F.lit("4F"), full))
    data = F.concat(F.when(kind == 1, "49").when(kind == 0, "44").otherwise("55"), F.when(streamed, num(o, 8)).otherwise(""), F.lit("00000007"), tail)
    later = (o + 2 * SLOTS) * 1000 + 400  # the second segment comes after the first one of a later order
    pos = F.when(streamed & second, later + 1 + F.col("n")).otherwise(o * 1000 + F.col("n"))
    changes = lines.select(o, pos.alias("pos"), data.alias("data"))
    at = lambda p, d: F.struct(p.cast("long").alias("pos"), d.alias("data"))
    base = o * 1000
    plain = F.array(at(base, F.concat(F.lit("42"), num(o * 100, 16), F.lit("0" * 16), num(o, 8))), at(base + 300, F.lit("43")))
    end = F.when(o % 2 == 0, F.concat(F.lit("63"), num(o, 8), F.lit("00"), num(o * 100 + 7, 16), F.lit("0" * 32))).otherwise(F.concat(F.lit("41"), num(o, 8), num(o, 8)))
    segments = F.array(at(base, F.concat(F.lit("53"), num(o, 8), F.lit("01"))), at(base + 300, F.lit("45")), at(later + 1, F.concat(F.lit("53"), num(o, 8), F.lit("00"))), at(later + 300, F.lit("45")), at(later + 301, end))
    marks = lines.where("n = 1").select(o, F.explode(F.when(streamed, segments).otherwise(plain)).alias("m")).select(o, "m.pos", "m.data")
    z = lambda s: s.encode() + b"\0"
    columns = b"".join(struct.pack(">B", key) + z(name) + struct.pack(">Ii", oid, -1) for key, name, oid in ((1, "id", 20), (0, "flag", 25), (0, "qty", 1700)))
    relation = b"R" + struct.pack(">I", 7) + z("public") + z("lineitem") + b"d" + struct.pack(">H", 3) + columns
    relations = spark.range(SLOTS).select(F.col("id").alias("l_orderkey"), F.lit(-1).cast("long").alias("pos"), F.lit(relation.hex()).alias("data"))
    rows = changes.unionByName(marks).unionByName(relations)
    return rows.select(F.concat(F.lit("slot"), o % SLOTS).alias("slot"), F.lit(0).cast("long").alias("lsn"), "pos", F.unhex("data").alias("data"))


@query("""
    with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n from lineitem),
    v as (select *, l_orderkey * 100 + n as id, cast(cast(l_quantity as integer) as varchar) as qty, case n % 4 when 1 then 'insert' when 0 then 'delete' else 'update' end as operation,
          l_orderkey * 100 + case when l_orderkey % 3 = 0 then 7 else 0 end as lsn from r where not (l_orderkey % 3 = 0 and l_orderkey % 2 = 1)),
    j as (select *, '{"id":"' || id || '"}' as key, '{"flag":"' || l_returnflag || '","id":"' || id || '","qty":"' || qty || '"}' as image from v)
    select 'slot' || (l_orderkey % 32) as slot, operation, key, case n % 4 when 2 then '{"flag":null,"id":"' || id || '","qty":null}' when 1 then null else image end as before,
           case n % 4 when 2 then '{"id":"' || id || '","qty":"' || qty || '"}' when 0 then null else image end as after, case when n % 4 = 2 then 'flag' else '' end as unchanged, lsn, n - 1 as change_seq,
           'pg:public.lineitem:' || key || ':' || operation || ':' || upper(to_base(lsn >> 32, 16)) || '/' || upper(to_base(lsn & 4294967295, 16)) || ':' || (n - 1) as idempotency_key
    from j
""")
def s_logical_decode(spark, sf):
    rows = change_events(decoded(_messages(spark, sf)))
    return rows.select("slot", "operation", "key", "before", "after", F.array_join("unchanged", ",").alias("unchanged"), "lsn", "change_seq", "idempotency_key")


# ------------------------------------------------------------------ event log


@query(f"with {FEED} select arrival, cast({FNV} % 64 as integer) as partition from feed")
def l_fnv_partition(spark, sf):
    return order_feed(spark, sf).select("arrival", K.partition_of(F.col("key")).alias("partition"))


@query(f"with {FEED} select k, op as operation, min(arrival) as arrival from feed group by k, op, lsn")
def l_dedup_first(spark, sf):
    return eventlog.first_arrivals(order_feed(spark, sf)).select(F.col("o_orderkey").alias("k"), "operation", "arrival")


@query(f"with {FEED}, p as (select *, cast({FNV} % 64 as integer) as partition from log) select arrival, partition, row_number() over (partition by partition order by arrival) as seq from p")
def l_seq_assign(spark, sf):
    return eventlog.append(order_feed(spark, sf)).select("arrival", "partition", "seq")


@query(f"with {FEED}, p as (select *, cast({FNV} % 64 as integer) as partition from log) select arrival, partition, row_number() over (partition by partition order by case when op = 'insert' then 0 else 1 end, arrival) as seq from p qualify op <> 'insert'")
def l_append_existing(spark, sf):
    feed = order_feed(spark, sf)
    log = eventlog.append(feed.where("operation = 'insert'"))
    return eventlog.append(feed, log).select("arrival", "partition", "seq")


@query("select event_id from events where ts > (select max(ts) from events) - interval 10 day")
def l_ttl(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts")).first()[0]
    return eventlog.live(e, F.lit(now), "10 days", "ts").select("event_id")


@query(f"with {FEED}, p as (select *, cast({FNV} % 64 as integer) as partition from log), s as (select *, row_number() over (partition by partition order by arrival) as seq from p) select arrival, seq from s where partition = 7 and seq >= 20 order by seq limit 50")
def l_range_scan(spark, sf):
    return eventlog.scan(eventlog.append(order_feed(spark, sf)), 7, 20, 50).select("arrival", "seq")


@query("""
    select user_id, cast(list_reduce(list_prepend({'c': 0, 'b': 0::bigint, 'n': 0}, list({'c': 0, 'b': event_id % 40 + 1, 'n': 1} order by event_id)),
        lambda a, x: case when a.n > 0 and (a.b + x.b > 100 or a.n >= 8) then {'c': a.c + 1, 'b': x.b, 'n': 1} else {'c': a.c, 'b': a.b + x.b, 'n': a.n + 1} end).c as integer) as last_chunk
    from events group by user_id
""")
def l_chunks(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", (F.col("event_id") % 40 + 1).alias("s")))), lambda x: x["s"]).alias("sizes"))
    return e.select("user_id", F.element_at(eventlog.chunks(F.col("sizes"), 200, 8), -1).alias("last_chunk"))


def _snapshot(spark, sf):
    o = table(spark, sf, "orders")
    key = K.canonical_key({"o_orderkey": (F.col("o_orderkey"), o.schema["o_orderkey"].dataType)})
    return o.select("o_orderkey", F.lit("tpch").alias("schema"), F.lit("orders").alias("table"), key.alias("key"), F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("after"), (F.col("o_orderkey") * 10 + F.col("o_orderkey") % 4).alias("snapshot_lsn"))


_SUPERSEDED = "exists (select 1 from log where log.k = o_orderkey and log.lsn > o_orderkey * 10 + o_orderkey % 4)"


@query("select 'feed:tpch.orders:{\"o_orderkey\":\"' || o_orderkey || '\"}:read:snap1' as idempotency_key, 'read' as operation, (select count(*) from orders) as total from orders")
def l_read_events(spark, sf):
    snap = _snapshot(spark, sf)
    total = snap.count()
    rows = backfill.read_events(snap, "feed", "snap1", F.lit(total), F.lit(total))
    return rows.select("idempotency_key", "operation", F.get_json_object("metadata", "$.snapshot_progress.total").cast("bigint").alias("total"))


@query("select t as \"table\", 'feed:' || t || ':control:snapshot_complete:snap1' as idempotency_key, '{}' as key, n as total_rows from (select 'orders' as t, count(*) as n from orders union all select 'events', count(*) from events)")
def l_control_events(spark, sf):
    rows = table(spark, sf, "orders").select(F.lit("orders").alias("table")).unionByName(table(spark, sf, "events").select(F.lit("events").alias("table")))
    return backfill.control_events(rows, "feed", "snapshot_complete", "snap1").select("table", "idempotency_key", "key", "total_rows")


@query(f"with {FEED} select o_orderkey from orders where not {_SUPERSEDED}")
def j_watermark_anti(spark, sf):
    return backfill.still_current(_snapshot(spark, sf), order_feed(spark, sf)).select("o_orderkey")


@query(f"with {FEED} select o_orderkey, 'read' as operation from orders where not {_SUPERSEDED} union all select k, op from log")
def j_snapshot_merge(spark, sf):
    snap = _snapshot(spark, sf).withColumn("operation", F.lit("read"))
    live = eventlog.first_arrivals(order_feed(spark, sf))
    return backfill.merged(snap, live).select("o_orderkey", "operation")


@query(f"with {FEED} select k as o_orderkey, max(lsn) as max_lsn from feed where lsn > 1000 group by k")
def a_max_lsn(spark, sf):
    high = backfill.latest_positions(order_feed(spark, sf), F.lit(1000))
    return high.select(F.get_json_object("key", "$.o_orderkey").cast("bigint").alias("o_orderkey"), "max_lsn")
