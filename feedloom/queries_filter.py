"""Queries: predicates, projections, masks, access rules, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .model import json_text
from .operators import eventlog, project
from .operators.project import Access, Redaction
from .plans.jq import jq
from .plans.routing import Route, fan_out, glob, matching
from .plans.templates import template
from .plans.where import typed_images, where
from .registry import FEED, FNV, query, table
from .sources.feed import order_feed


def _feed(spark, sf, predicate):
    return order_feed(spark, sf).where(where(predicate)).select("arrival")


@query(f"with {FEED} select arrival from feed where a_status is not null and o_totalprice > 100000 or a_status is null and o_totalprice > 100000")
def f_where_numeric(spark, sf):
    return _feed(spark, sf, "o_totalprice > 100000")


@query(f"with {FEED} select arrival from feed where b_status is null or b_status <> 'F'")
def f_where_null2vl(spark, sf):
    return _feed(spark, sf, "NOT before.o_orderstatus = 'F'")


@query(f"with {FEED} select arrival from feed where not (coalesce(a_status, b_status) in ('F', 'P')) and o_custkey > 50")
def f_where_in_not(spark, sf):
    return _feed(spark, sf, "NOT o_orderstatus IN ('F', 'P') AND o_custkey > 50")


@query(f"with {FEED} select arrival from feed where b_status = 'O' and a_status = 'F' or (a_status is not null and o_orderpriority = '1-URGENT' and o_totalprice <= 50000.5)")
def f_where_sides(spark, sf):
    return _feed(spark, sf, "before.o_orderstatus = 'O' AND after.o_orderstatus = 'F' OR (after.o_orderpriority = '1-URGENT' AND after.o_totalprice <= 50000.5)")


@query(f"with {FEED} select arrival from feed where b_status is null")
def f_isnull(spark, sf):
    return _feed(spark, sf, "before.o_orderkey IS NULL AND missing IS NULL AND o_orderkey IS NOT NULL")


@query("select event_id from events where value > 50 and event_type <> 'view' or cast(user_id as varchar) = '7'")
def f_where_typed(spark, sf):
    e = table(spark, sf, "events")
    images = typed_images({}, {c: F.col(c) for c in ("event_id", "event_type", "value", "user_id")}, F.lit(False), F.lit(True), frozenset({"value", "user_id", "event_id"}))
    return e.where(where("value > 50 AND event_type != 'view' OR user_id = '7'", images=images)).select("event_id")


@query("select event_id from events where event_id % 6 <> 5 and (case event_id % 6 when 0 then false when 1 then false when 2 then true when 3 then false else true end)")
def f_where_text_numbers(spark, sf):
    e = table(spark, sf, "events")
    v = F.element_at(F.array(*[F.lit(x) for x in ("5", "9", "10", " 10", "1e2", "abc")]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = e.select("event_id", F.lit(None).cast("string").alias("before"), F.to_json(F.struct(v.alias("x"))).alias("after"))
    # ' 10' is no number, so it compares as text and is below '9.5'; 'abc' is above it
    return rows.where(where("x > 9.5 AND x != 'abc'")).select("event_id")


@query(f"with {FEED} select arrival from feed where op in ('insert', 'delete')")
def f_allow(spark, sf):
    return order_feed(spark, sf).where(project.allowed(["tpch.orders"], ["insert", "delete"])).select("arrival")


@query(f"with {FEED} select arrival, k as o_orderkey, a_status as o_orderstatus, cast(null as varchar) as o_totalprice, cast(case when a_status is null then 0 else 2 end as integer) as n from feed")
def f_project(spark, sf):
    kept = project.keep_columns(F.col("after"), ["o_orderstatus", "o_orderkey", "nothing"])
    rows = order_feed(spark, sf).select("arrival", "o_orderkey", kept.alias("after"))
    return rows.select("arrival", "o_orderkey", json_text(F.col("after"), "o_orderstatus").alias("o_orderstatus"), json_text(F.col("after"), "o_totalprice").alias("o_totalprice"), F.coalesce(F.size(F.json_object_keys("after")), F.lit(0)).alias("n"))


@query(f"with {FEED} select arrival, case when a_status is not null then '***' end as o_totalprice, a_status as o_orderstatus from feed")
def f_mask(spark, sf):
    masked = project.mask_columns(F.col("after"), ["o_totalprice", "nothing"])
    rows = order_feed(spark, sf).select("arrival", masked.alias("after"))
    return rows.select("arrival", json_text(F.col("after"), "o_totalprice").alias("o_totalprice"), json_text(F.col("after"), "o_orderstatus").alias("o_orderstatus"))


@query(f"with {FEED} select arrival, case when a_status is not null then '***' end as o_custkey, cast(null as varchar) as ai_context from feed where k % 2 = 0")
def f_acl(spark, sf):
    rows = order_feed(spark, sf).withColumn("table", F.when(F.col("o_orderkey") % 2 == 0, "orders").otherwise("secret")).withColumn("ai_context", F.lit("{}"))
    out = Access(("tpch.ord*",), (Redaction(("tpch.*",), ("o_custkey",)),)).apply(rows)
    return out.select("arrival", json_text(F.col("after"), "o_custkey").alias("o_custkey"), "ai_context")


@query("select n_name, n_name = 'CHINA' as exact, true as every, starts_with(n_name, 'I') as pre, ends_with(n_name, 'A') as suf, starts_with(n_name, 'IND') and ends_with(n_name, 'DIA') and length(n_name) >= 6 as both from nation")
def f_glob(spark, sf):
    n = F.col("n_name")
    return table(spark, sf, "nation").select(n, glob("CHINA", n).alias("exact"), glob("*", n).alias("every"), glob("I*", n).alias("pre"), glob("*A", n).alias("suf"), glob("IND*DIA", n).alias("both"))


@query(f"with {FEED} select arrival from feed where op in ('insert', 'update') and a_status = 'F' and o_totalprice > 100000")
def f_route(spark, sf):
    return matching(order_feed(spark, sf), Route("r", ("tpch.o*",), (" INSERT ", "update"), "after.o_orderstatus = 'F' AND after.o_totalprice > 100000")).select("arrival")


@query(f"with {FEED} select 'all' as consumer, arrival from feed union all select 'deletes', arrival from feed where op = 'delete' union all select 'urgent', arrival from feed where o_orderpriority = '1-URGENT' and op = 'insert'")
def f_fanout(spark, sf):
    routes = [Route("all"), Route("deletes", operations=("delete",)), Route("urgent", ("*.orders",), ("insert",), "o_orderpriority = '1-URGENT'"), Route("none", ("other",))]
    return fan_out(order_feed(spark, sf), routes).select("consumer", "arrival")


@query(f"with {FEED} select arrival, 'orders' as \"table\", op as operation, strftime(make_timestamp(1700000000000000 + lsn * 1000), '%Y-%m-%dT%H:%M:%S') as ts, a_status as status from feed")
def f_vector_metadata(spark, sf):
    rows = order_feed(spark, sf).select("arrival", project.vector_metadata(["o_orderstatus", "nothing"]).alias("m"))
    g = lambda k: F.get_json_object("m", f"$.{k}")
    return rows.select("arrival", g("table").alias("table"), g("operation").alias("operation"), F.substr(g("timestamp"), F.lit(1), F.lit(19)).alias("ts"), g("o_orderstatus").alias("status"))


@query(f"with {FEED} select arrival, 'tpch.orders' as \"table\", op as operation, b_status is not null as has_before, a_status as status from feed")
def f_agent_context(spark, sf):
    rows = order_feed(spark, sf).withColumn("id", F.col("idempotency_key")).withColumn("ai_context", F.lit(None).cast("string")).select("arrival", project.agent_context().alias("c"))
    g = lambda k: F.get_json_object("c", f"$.{k}")
    return rows.select("arrival", g("table").alias("table"), g("operation").alias("operation"), g("before").isNotNull().alias("has_before"), g("after.o_orderstatus").alias("status"))


@query("select n as \"table\", case when n_regionkey is not null then 0 else 1 end as captured from (select distinct n_name as n from nation union select r_name from region) left join (select n_name, n_regionkey from nation) on n = n_name")
def u_tables(spark, sf):
    conf = table(spark, sf, "nation").select(F.concat(F.lit(" "), "n_name").alias("table"), F.col("n_nationkey").alias("position"))
    seen = table(spark, sf, "region").select(F.col("r_name").alias("table"), F.col("r_regionkey").alias("position")).unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("table"), F.col("n_nationkey").alias("position")))
    return project.table_names(conf, seen).select("table", "captured")


@query("select n_name as \"table\", c as \"column\", c = 'email' and starts_with(n_name, 'N') as redacted from nation, (values ('id'), ('email')) t(c) where ends_with(n_name, '1')")
def f_schema_listing(spark, sf):
    cols = table(spark, sf, "nation").select(F.col("n_name").alias("table"), F.explode(F.array(F.lit("id"), F.lit("email"))).alias("column"))
    return project.column_listing(cols, Access(("*1",), (Redaction(("N*",), ("email",)),)))


@query(f"with {FEED}, p as (select *, cast({FNV} % 64 as integer) as partition from log) select k as o_orderkey, partition, a_status as o_orderstatus, round(o_totalprice, 2) as o_totalprice, lsn from p where op in ('insert', 'update') and a_status = 'F' and o_totalprice > 100000")
def q_route_project(spark, sf):
    """Feed, keys, partitions, first arrivals, a route with a predicate, a projection."""
    log = eventlog.append(order_feed(spark, sf))
    hit = matching(log, Route("big", ("tpch.o*",), ("insert", "update"), "after.o_orderstatus = 'F' AND after.o_totalprice > 100000"))
    kept = hit.withColumn("after", project.keep_columns(F.col("after"), ["o_orderstatus", "o_totalprice"]))
    return kept.select("o_orderkey", "partition", json_text(F.col("after"), "o_orderstatus").alias("o_orderstatus"), F.round(json_text(F.col("after"), "o_totalprice").cast("double"), 2).alias("o_totalprice"), "lsn")


@query(f"with {FEED} select arrival, 'cdc.tpch.orders-' || op || '/' || coalesce(a_status, '') as name from feed")
def x_template(spark, sf):
    return order_feed(spark, sf).select("arrival", template("cdc.{{.Schema}}.{{ .Table }}-{{.Operation}}/{{.After.o_orderstatus}}").alias("name"))


@query(f"with {FEED} select arrival, case when op = 'delete' then null else '{{\"s\":\"' || lower(a_status) || '\",\"big\":' || (o_totalprice > 200000) || ',\"n\":' || (o_custkey + 1) || '}}' end as out from feed")
def p_jq(spark, sf):
    event = F.to_json(F.struct("operation", F.try_parse_json("after").alias("after")))
    expr = 'if .operation == "delete" then empty else {s: (.after.o_orderstatus | ascii_downcase), big: (.after.o_totalprice > 200000), n: (.after["o_custkey"] + 1)} end'
    return order_feed(spark, sf).select("arrival", jq(expr, event).alias("out"))
