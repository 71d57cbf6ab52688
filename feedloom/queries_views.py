"""Queries: joins, aggregates, windows, views, delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import delivery, eventlog, report, views
from .registry import FEED, FNV, query, table
from .sources.feed import order_feed
from .streaming import streams


def _log(spark, sf):
    return eventlog.first_arrivals(order_feed(spark, sf)).withColumn("status", F.get_json_object("after", "$.o_orderstatus"))


# ------------------------------------------------------------------ joins

_WINDOWS = "(values ('steady', timestamp '2024-01-02', timestamp '2024-01-10'), ('burst', timestamp '2024-01-08', timestamp '2024-01-15'), ('crash', timestamp '2024-01-20', timestamp '2024-01-22')) w(scenario, s, e)"


def _windows(spark):
    rows = [("steady", "2024-01-02", "2024-01-10"), ("burst", "2024-01-08", "2024-01-15"), ("crash", "2024-01-20", "2024-01-22")]
    return spark.createDataFrame(rows, "scenario string, start string, end string").select("scenario", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))


@query(f"select event_id, coalesce((select arg_min(w.scenario, w.s) from {_WINDOWS} where ts between w.s and w.e), event_type) as scenario from events")
def j_interval_attr(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("scenario"))
    return report.attributed(e, _windows(spark), "ts").select("event_id", "scenario")


@query(f"select w.scenario, count(*) as n from events join {_WINDOWS} on ts between w.s and w.e where not exists (select 1 from {_WINDOWS.replace(' w(', ' v(')} where ts between v.s and v.e and v.s < w.s) group by 1")
def j_window_stats(spark, sf):
    e = table(spark, sf, "events").select("ts", F.lit(None).cast("string").alias("scenario"))
    return report.attributed(e, _windows(spark), "ts").where("scenario is not null").groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_orderstatus, arg_max(l_returnflag, ((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 128 + ascii(l_returnflag)) as shipment from orders left join lineitem on l_orderkey = o_orderkey and l_linenumber > o_orderkey % 3 group by all")
def j_order_status(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 3).alias("first"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", (((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")) * 128 + F.ascii("l_returnflag")).alias("o"), F.col("l_linenumber").alias("ln"))
    known = li.join(o.select("o_orderkey", "first"), "o_orderkey").where("ln > first").drop("first", "ln")
    out = views.with_latest(o.withColumn("zero", F.lit(-1)), known, "o_orderkey", "l_returnflag", "o", "zero", "shipment")
    return out.select("o_orderkey", "o_orderstatus", "shipment")


@query("select o_orderkey, coalesce(c_name, cast(o_custkey + o_orderkey % 2 * 1000000 as varchar)) as name from orders left join customer on c_custkey = o_custkey + o_orderkey % 2 * 1000000")
def j_dim_lookup(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 2 * 1000000).alias("c_custkey"))
    return views.looked_up(o, table(spark, sf, "customer"), "c_custkey", "c_name", "name").select("o_orderkey", "name")


@query("select event_id, p.value as price from events asof left join (select user_id, ts, value from events where event_type = 'purchase') p on events.user_id = p.user_id and events.ts >= p.ts")
def j_as_of(spark, sf):
    e = table(spark, sf, "events")
    facts = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("price"))
    return views.as_of(e.select("event_id", "user_id", "ts"), facts, ["user_id"], "ts", ["price"]).select("event_id", "price")


_SEQ = f"with {FEED}, p as (select *, cast({FNV} % 64 as integer) as partition from log), s as (select *, row_number() over (partition by partition order by arrival) as seq from p)"


def _positions(spark):
    return spark.range(0, 128).select(F.when(F.col("id") < 64, "a").otherwise("b").alias("consumer"), (F.col("id") % 64).cast("int").alias("partition"), ((F.col("id") * 7) % 50 + 1).alias("cursor")).where("id % 9 <> 0")


_POS = "(select case when i < 64 then 'a' else 'b' end as consumer, cast(i % 64 as integer) as partition, (i * 7) % 50 + 1 as cursor from range(0, 128) t(i) where i % 9 <> 0) c"


@query(f"{_SEQ} select g.consumer, arrival from s cross join (values ('a'), ('b')) g(consumer) left join {_POS} on c.consumer = g.consumer and c.partition = s.partition where s.seq >= coalesce(c.cursor, 1)")
def j_cursor_gate(spark, sf):
    log = eventlog.append(order_feed(spark, sf))
    return delivery.pending(log, _positions(spark)).select("consumer", "arrival")


@query(f"select partition, min(cursor) as cursor from {_POS} group by partition")
def j_min_cursor(spark, sf):
    return delivery.rewind(_positions(spark))


@query(f"{_SEQ} select arrival from s where seq % 5 <> 0")
def u_skip_set(spark, sf):
    log = eventlog.append(order_feed(spark, sf))
    return delivery.without_skipped(log, log.where("seq % 5 = 0").select("partition", "seq")).select("arrival")


# ------------------------------------------------------------------ aggregates


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by event_type")
def a_percentiles(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(*[report.nearest_rank("value", p).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


@query("select event_type, count(*) as n, min(ts) as first, max(ts) as last, round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6), 6) as throughput from events group by event_type")
def a_throughput(spark, sf):
    out = report.summary(table(spark, sf, "events"), ["event_type"], "ts", "value")
    return out.select("event_type", "n", "first", "last", F.round("throughput", 6).alias("throughput"))


@query("select event_type, round(avg(value), 6) as cpu_pct, round(avg(user_id) / 1024, 6) as rss_mb from events group by event_type")
def a_mean(spark, sf):
    stats = table(spark, sf, "events").select("event_type", F.col("value").alias("cpu_pct"), F.col("user_id").alias("vmrss_kb"))
    return report.resource_means(stats, ["event_type"]).select("event_type", F.round("cpu_pct", 6).alias("cpu_pct"), F.round("rss_mb", 6).alias("rss_mb"))


@query("select event_type, count(*) as n from events group by event_type")
def a_counts_by_type(spark, sf):
    return views.counts(table(spark, sf, "events"), ["event_type"])


@query("select user_id, count(*) as unread from events where event_type = 'view' group by user_id")
def a_unread(spark, sf):
    return views.counts(table(spark, sf, "events").where("event_type = 'view'"), ["user_id"], "unread")


@query(f"with {FEED} select k, arg_max(op, lsn) as operation, arg_max(coalesce(a_status, '-'), lsn) as status from log group by k having arg_max(op, lsn) <> 'delete'")
def a_latest_state(spark, sf):
    out = views.latest_state(_log(spark, sf), ["o_orderkey"], "lsn")
    return out.select(F.col("o_orderkey").alias("k"), "operation", F.coalesce("status", F.lit("-")).alias("status"))


@query(f"with {FEED} select k, cast(count(*) filter (op <> 'delete') as bigint) as refreshes, cast(count(*) filter (op = 'delete') as bigint) as invalidations from log group by k")
def a_cache_counters(spark, sf):
    return views.cache_counters(_log(spark, sf), ["o_orderkey"]).withColumnRenamed("o_orderkey", "k")


@query(f"with {FEED}, l as (select *, coalesce(sum(case when op = 'delete' then 1 else 0 end) over (partition by k order by arrival rows between unbounded preceding and 1 preceding), 0) as life from feed) select arrival, cast(row_number() over (partition by k, life order by arrival) as integer) as version from l")
def a_versions(spark, sf):
    return views.versions(order_feed(spark, sf), ["o_orderkey"], "arrival").select("arrival", "version")


@query(f"with {FEED} select op as operation, 'orders' as \"table\", count(*) as n from feed group by op")
def a_delivered(spark, sf):
    return views.counts(order_feed(spark, sf), ["operation", "table"])


@query("select cast(le as double) as le, (select count(*) from events where value <= le) as n from (values (5), (10), (25), (50), (100), (1000)) b(le)")
def a_histogram(spark, sf):
    return report.histogram(table(spark, sf, "events"), "value", [5, 10, 25, 50, 100, 1000])


@query("""
    with c as (select event_type as scenario, count(*) as throughput, quantile_disc(value, 0.5) as p50 from events group by 1), b as (select event_type as scenario, count(*) * (case when event_type < 'd' then 2 else 1 end) as t, quantile_disc(value, 0.5) / 2 as p from events group by 1)
    select scenario, throughput < t * 0.65 as failed, scenario = 'burst' and p50 > p * 1.35 as advisory from c join b using (scenario)
""")
def a_regression(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "scenario")
    cur = e.groupBy("scenario").agg(F.count(F.lit(1)).alias("throughput"), report.nearest_rank("value", 0.5).alias("p50"))
    base = cur.select("scenario", (F.col("throughput") * F.when(F.col("scenario") < "d", 2).otherwise(1)).alias("throughput"), (F.col("p50") / 2).alias("p50"))
    return report.gate(cur, base).select("scenario", "failed", "advisory")


@query("select c_custkey, cast(floor((c_custkey % 900 + 0.5) * u.f / 1024) as bigint) as kib, cast(c_custkey % 100 as double) / 10 as pct from customer, (values (0, 'GiB', 1073741824.0), (1, 'MiB', 1048576.0), (2, 'KiB', 1024.0), (3, 'GB', 1e9), (4, 'MB', 1e6), (5, 'kB', 1e3), (6, 'B', 1.0)) u(i, n, f) where u.i = c_custkey % 7")
def a_sizes(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u, _ in report.UNITS]), (F.col("c_custkey") % 7 + 1).cast("int"))
    text = F.concat((F.col("c_custkey") % 900).cast("string"), F.lit(".5"), unit, F.lit(" / 7.77GiB"))
    pct = F.concat(((F.col("c_custkey") % 100) / 10).cast("string"), F.lit("%"))
    return table(spark, sf, "customer").select("c_custkey", report.size_kib(text).alias("kib"), report.percent(pct).alias("pct"))


@query("select n_name, case n_nationkey % 4 when 0 then 'loom-fast' when 1 then 'loom' when 2 then 'other' else 'bench-strange-x' end as tool from nation")
def a_container_tool(spark, sf):
    names = F.element_at(F.array(*[F.lit(x) for x in ("bench-loom-fast-1", "bench-loom-12", "alias-2", "bench-strange-x")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, sf, "nation").select("n_name", report.container_tool(names, ["loom", "loom-fast"], {"alias": "other"}).alias("tool"))


@query("select event_id, (event_id % 1000) * 1000 + 7 as latency_us from events")
def a_latency(spark, sf):
    t = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", report.latency_us(t + F.make_dt_interval(secs=((F.col("event_id") % 1000) * 1000 + 7) / F.lit(1_000_000).cast("decimal(18,6)")), t).alias("latency_us"))


@query("select event_type as tool, least(120.0, date_diff('microsecond', timestamp '2024-01-10', min(ts)) / 1e6) as recovery_seconds from events where ts > timestamp '2024-01-10' group by 1")
def a_recovery(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("receive_ts"))
    kills = e.select("tool").distinct().withColumn("kill_ts", F.lit("2024-01-10").cast("timestamp"))
    return report.recovery_seconds(e, kills).select("tool", "recovery_seconds")


@query("select event_id, case event_id % 4 when 3 then null else date_trunc('second', ts) end as t from events")
def x_bench_time(spark, sf):
    base = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    s = F.when(F.col("event_id") % 4 == 0, F.concat(base, F.lit("+00"))).when(F.col("event_id") % 4 == 1, F.concat(F.replace(base, F.lit(" "), F.lit("T")), F.lit("Z"))).when(F.col("event_id") % 4 == 2, base).otherwise("yesterday")
    return table(spark, sf, "events").select("event_id", report.bench_time(s).cast("timestamp_ntz").alias("t"))


# ------------------------------------------------------------------ windows and views


@query(f"with {FEED} select arrival, 'o_orderstatus' as field, b_status as from_value, a_status as to_value from log where op = 'update'")
def w_field_diff(spark, sf):
    g = lambda side, f: F.get_json_object(side, f"$.{f}")
    audited = ("o_orderstatus", "o_totalprice", "o_orderpriority")
    out = views.changed_fields(_log(spark, sf), {f: g("before", f) for f in audited}, {f: g("after", f) for f in audited})
    return out.select("arrival", "field", "from_value", "to_value")


@query("select event_id, lag(event_type) over (partition by user_id order by event_id) as previous_event_type from events")
def w_previous(spark, sf):
    return views.with_previous(table(spark, sf, "events"), ["user_id"], "event_id", ["event_type"]).select("event_id", "previous_event_type")


@query("with c as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as s from events window w as (partition by user_id order by event_id)) select event_id, cast(sum(s) over (partition by user_id order by event_id rows between unbounded preceding and current row) as bigint) as run from c")
def w_runs(spark, sf):
    return views.runs(table(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type")).select("event_id", "run")


@query("with r as (select *, row_number() over (partition by user_id order by event_id desc) as rn, count(*) over (partition by user_id) as c from events) select event_id, greatest(0, c - 16) as dropped from r where rn <= 16")
def w_ring(spark, sf):
    return views.ring(table(spark, sf, "events"), ["user_id"], 16, "event_id").select("event_id", "dropped")


@query("with r as (select *, row_number() over (partition by user_id order by event_id desc) as rn from events), k as (select *, row_number() over (partition by user_id order by event_id) as a, count(*) over (partition by user_id) as c from r where rn <= 16) select event_id, greatest(0, c - 5) as remaining from k where a <= 5")
def t_drain(spark, sf):
    return views.drained(table(spark, sf, "events"), ["user_id"], 16, 5, "event_id").select("event_id", "remaining")


@query("select event_id, user_id, event_type from events order by event_id desc limit 20")
def t_recent_feed(spark, sf):
    return views.recent_feed(table(spark, sf, "events").select("event_id", "user_id", "event_type"), 20, "event_id")


@query("select event_id from events qualify row_number() over (partition by event_type order by event_id desc) <= 20")
def t_recent_by_user(spark, sf):
    return views.recent_feed(table(spark, sf, "events"), 20, "event_id", ["event_type"]).select("event_id")


@query("select user_id as id, min(event_id) as position, arg_max(event_type, event_id) as event_type from events group by user_id order by position desc limit 100")
def t_recent_index(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type")
    return views.recent_index(e, 100).select("id", "position", "event_type")


@query(f"{_SEQ} select partition, seq, arrival from s")
def t_per_key_order(spark, sf):
    return views.per_key_order(eventlog.append(order_feed(spark, sf))).select("partition", "seq", "arrival")


@query("""
    with r as (select *, case when event_type = 'click' then 'ok' when event_id % 211 = 0 then 'transient' else 'poison' end as result from events),
    g as (select *, sum(case when result <> 'poison' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and current row) as g from r),
    s as (select *, sum(case when result = 'poison' then 1 else 0 end) over (partition by user_id, g order by event_id rows between unbounded preceding and current row) as streak from g),
    t as (select *, min(case when result = 'transient' or result = 'poison' and streak > 25 then event_id end) over (partition by user_id) as stop, max(event_id) over (partition by user_id) as top from s)
    select user_id, event_id, case when event_id > stop then 'pending' when event_id = stop then 'blocked' when result = 'poison' then 'skipped' else 'delivered' end as action, coalesce(stop, top + 1) as cursor from t
""")
def k_poison_skip(spark, sf):
    result = F.when(F.col("event_type") == "click", "ok").when(F.col("event_id") % 211 == 0, "transient").otherwise("poison")
    return delivery.poison_skips(table(spark, sf, "events").select("user_id", "event_id", result.alias("result")), ["user_id"], "event_id").select("user_id", "event_id", "action", "cursor")


@query("with r as (select *, case when event_type = 'click' then 'ok' else 'poison' end as result from events), g as (select *, sum(case when result <> 'poison' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and current row) as g from r), s as (select *, sum(case when result = 'poison' then 1 else 0 end) over (partition by user_id, g order by event_id rows between unbounded preceding and current row) as streak from g) select event_id, cast(streak as bigint) as streak, case when result = 'poison' and streak > 25 then 'transient' else result end as verdict from s")
def w_poison_streak(spark, sf):
    e = table(spark, sf, "events").withColumn("result", F.when(F.col("event_type") == "click", "ok").otherwise("poison"))
    return delivery.poison_streaks(e, ["user_id"], "event_id").select("event_id", "streak", "verdict")


# ------------------------------------------------------------------ delivery


@query("""
    with o as (
        select event_id, user_id, event_id % 11 = 0 as permanent, case when event_id % 13 = 0 then null else event_id % 17 end as failures from events
    ), d as (
        select *, permanent or failures is null or failures >= 15 as parked, case when permanent then 1 when failures is null or failures >= 15 then 15 else failures + 1 end as attempts from o
    )
    select event_id, case when parked then 'parked' else 'delivered' end as outcome, cast(attempts as bigint) as attempts,
           cast(list_sum(list_transform(range(0, attempts - 1), lambda i: case i when 0 then 1 when 1 then 5 when 2 then 30 when 3 then 120 else 600 end)) as bigint) as waited,
           cast(coalesce(sum(case when attempts > 1 then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as blocked_by
    from d
""")
def k_retry_outcomes(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 11 == 0).alias("permanent"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 17).alias("failures"))
    out = delivery.outcomes(e, ["user_id"], "event_id")
    return out.select("event_id", "outcome", F.col("attempts").cast("bigint").alias("attempts"), F.when(F.col("attempts") > 1, F.col("waited").cast("bigint")).alias("waited"), "blocked_by")


@query("with r as (select event_type as consumer, user_id % 8 as partition, event_id as seq, event_id % 97 = 0 as queued from events) select consumer, partition, least(max(seq) + 1, coalesce(min(seq) filter (queued), max(seq) + 1)) as cursor from r group by 1, 2")
def k_cursor_floor(spark, sf):
    r = table(spark, sf, "events").select(F.col("event_type").alias("consumer"), (F.col("user_id") % 8).alias("partition"), F.col("event_id").alias("seq"))
    return delivery.cursors(r, r.where("seq % 97 = 0"))


@query("select event_type as consumer, user_id % 8 as partition, min(event_id) as floor from events where event_id % 97 = 0 group by 1, 2")
def k_floor(spark, sf):
    r = table(spark, sf, "events").select(F.col("event_type").alias("consumer"), (F.col("user_id") % 8).alias("partition"), F.col("event_id").alias("seq"))
    return delivery.floors(r.where("seq % 97 = 0"))


@query("select event_type as consumer, user_id as event_id, min(event_id) as seq from events where user_id % 3 <> 0 group by 1, 2")
def k_dlq_dedup(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("consumer"), F.col("user_id").alias("event_id"), F.col("event_id").alias("seq"))
    old = e.where("event_id % 3 = 0").select("consumer", "event_id").distinct()
    return delivery.dead_letters(e, old)


@query("select event_type as consumer, cast(user_id % 8 as integer) as partition, event_id as seq from events where event_type = 'view' and user_id % 8 = 3 order by seq limit 10")
def t_dlq_list(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("consumer"), (F.col("user_id") % 8).cast("int").alias("partition"), F.col("event_id").alias("seq"))
    return delivery.list_dead(e, "view", 3, 10)


@query("select event_id from events where ts >= timestamp '2024-01-15'")
def k_dlq_purge(spark, sf):
    return delivery.purge(table(spark, sf, "events"), F.lit("2024-01-15").cast("timestamp_ntz"), "ts").select("event_id")


@query("select event_id, case when s between 200 and 299 then 'ok' when s in (408, 429) or s between 500 and 599 then 'transient' else 'poison' end as verdict from (select event_id, case event_id % 7 when 0 then 200 when 1 then 204 when 2 then 404 when 3 then 408 when 4 then 429 when 5 then 503 else 302 end as s from events)")
def o_status_class(spark, sf):
    s = F.element_at(F.array(*[F.lit(x) for x in (200, 204, 404, 408, 429, 503, 302)]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", delivery.classify(s).alias("verdict"))


@query("select event_id, case least(event_id % 9, 4) when 0 then 1 when 1 then 5 when 2 then 30 when 3 then 120 else 600 end as delay from events")
def x_backoff(spark, sf):
    return table(spark, sf, "events").select("event_id", delivery.next_delay(F.col("event_id") % 9).alias("delay"))


@query("select event_id, repeat('é', 512) as reason from events where event_id % 2 = 0 union all select event_id, 'short' from events where event_id % 2 = 1")
def x_reason(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("é"), 600)).otherwise("short")
    return table(spark, sf, "events").select("event_id", delivery.reason(text).alias("reason"))


# ------------------------------------------------------------------ event-time windows


@query("select event_type, date_trunc('day', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def z_tumbling(spark, sf):
    return streams.tumbling(table(spark, sf, "events"), "1 day", ["event_type"]).select("event_type", F.col("w.start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("select event_type, s as start, count(*) as n, round(sum(value), 4) as total from events, (select unnest([0, 1]) as i), lateral (select time_bucket(interval 12 hour, ts) - i * interval 12 hour as s) group by 1, 2")
def z_sliding(spark, sf):
    return streams.tumbling(table(spark, sf, "events"), "24 hours", ["event_type"], slide="12 hours").select("event_type", F.col("w.start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("with g as (select *, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 2 hour then 1 else 0 end as s from events window w as (partition by user_id order by ts)), n as (select *, sum(s) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as k from g) select user_id, min(ts) as start, count(*) as n from n group by user_id, k")
def z_session(spark, sf):
    return streams.sessions(table(spark, sf, "events"), "2 hours", ["user_id"]).select("user_id", F.col("w.start").alias("start"), "n")
