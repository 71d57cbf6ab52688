"""Queries: templates, signatures, subscriptions, the hash cache, documents."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from . import sinks
from .functions import scalars
from .functions import sql as sql_functions
from .functions.signing import sigv4_headers, signing_key
from .model import CHANGE_EVENT
from .operators import eventlog, project, report, vector, views
from .plans.render import transform
from .plans.where import branches
from .registry import FEED, FNV, query, table
from .sources.feed import order_feed
from .streaming import subscriptions

_ESCAPED = "replace(key, '\"', chr(92) || '\"')"


@query(f"""with {FEED} select arrival, case when op <> 'delete' then 'orders:"' || {_ESCAPED} || '" [' || a_status || ']'
    || case when o_totalprice > 200000 then ' big' when o_totalprice < 50000 then ' small' else '' end || case when op = 'insert' or a_status = 'F' then ' ' || printf('%06d', o_custkey) else '' end end as out from feed""")
def p_template(spark, sf):
    text = """
        {{- if ne .Operation "delete" }}{{ printf "%s:%q" .Table .Key }} {{ .After.o_orderstatus | printf "[%s]" }}
        {{- if gt .After.o_totalprice 200000 }} big{{ else if lt (index .After "o_totalprice") 50000.0 }} small{{ end }}
        {{- /* padded */ -}}
        {{ if or (eq .Operation "insert" "read") (eq .After.o_orderstatus "F") }} {{ printf "%06d" .After.o_custkey }}{{ end }}{{ end -}}
    """
    return order_feed(spark, sf).select("arrival", transform(text).alias("out"))


_NOW = dt.datetime(2026, 1, 2, 3, 4, 5)
_KEY = signing_key("secret", "20260102", "eu-west-1", "lambda")
_HEAD = "POST\\n/f\\na=1&b=%20x\\nhost:h.example\\nx-amz-date:20260102T030405Z\\n\\nhost;x-amz-date\\n"
_SCOPE = "20260102/eu-west-1/lambda/aws4_request"


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in _KEY.ljust(64, b"\0")).hex()


@query(f"""with r as (select event_id, sha256(e'{_HEAD}' || sha256(props)) as request from events)
    select event_id, 'AWS4-HMAC-SHA256 Credential=id/{_SCOPE}, SignedHeaders=host;x-amz-date, Signature='
    || sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(e'AWS4-HMAC-SHA256\\n20260102T030405Z\\n{_SCOPE}\\n' || request)))) as authorization from r""")
def x_sigv4(spark, sf):
    signed = sigv4_headers("https://h.example/f?b=%20x&a=1", F.col("props"), "eu-west-1", "lambda", "id", "secret", _NOW)
    return table(spark, sf, "events").select("event_id", F.element_at(signed, "Authorization").alias("authorization"))


@query("""with n as (select user_id, list_reduce(list(list_value(epoch_us(ts) // 1000) order by ts), lambda a, x: case when x[1] >= a[-1] + 3600000 then a || x else a end) as starts from events group by user_id)
    select user_id as subscription, unnest(starts) + 3600000 as nudge_ms from n""")
def k_nudges(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("subscription"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return subscriptions.nudges(rows, debounce=3_600_000)


@query("select c_custkey, row_number() over (partition by c_nationkey order by c_custkey) <= 16 as open from customer")
def k_admitted(spark, sf):
    return subscriptions.admitted(table(spark, sf, "customer"), "c_nationkey", "c_custkey").select("c_custkey", "open")


@query(f"""with {FEED}, m as (select o_custkey as subscription, arrival, row_number() over w as n, count(*) over (partition by o_custkey) as c from log where op = 'insert' and o_totalprice > 50000 window w as (partition by o_custkey order by arrival desc))
    select subscription, arrival, greatest(c - 8, 0) as dropped from m where n <= 8""")
def k_subscription(spark, sf):
    rows = eventlog.append(order_feed(spark, sf))
    seen = subscriptions.matched(rows.where("operation = 'insert'"), "o_totalprice > 50000", project.Access(("tpch.*",)))
    seen = seen.withColumn("subscription", F.get_json_object("after", "$.o_custkey").cast("bigint"))
    return subscriptions.buffered(seen, size=8, order="arrival").select("subscription", "arrival", "dropped")


@query("select max(event_id) as event_id from events")
def k_by_id(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.lit("app").alias("schema"), F.lit("events").alias("table"))
    newest = rows.agg(F.max("event_id")).first()[0]
    return views.by_id(rows, newest, 100, "event_id", "event_id", project.Access(("app.*",))).select("event_id")


@query(f"""with {FEED}, a as (select k, arg_max(op, arrival) as op, max(arrival) as arrival from log where op <> 'insert' group by k)
    select 'k' || log.k as vector_id, sha256('insert' || log.arrival) as text_hash from log where op = 'insert' and log.arrival % 10 = 0 and not exists (select 1 from a where a.k = log.k)
    union all select 'k' || k, sha256('update' || arrival) from a where op = 'update'""")
def k_hash_cache(spark, sf):
    rows = eventlog.append(order_feed(spark, sf)).select(F.concat(F.lit("k"), F.get_json_object("key", "$.o_orderkey")).alias("vector_id"), "operation", "arrival", F.sha2(F.concat("operation", F.col("arrival").cast("string")), 256).alias("text_hash"))
    known = rows.where("operation = 'insert' and arrival % 10 = 0")
    batch = rows.where("operation != 'insert'").withColumn("decision", F.when(F.col("operation") == "delete", "delete").otherwise("upsert"))
    return vector.remembered(known, batch, order="arrival").select("vector_id", "text_hash")


@query("""select '{"vectors":[{"id":"customer:' || c_custkey || '","values":[' || c_custkey || '.0,' || c_nationkey || '.5],"metadata":{"segment":"' || c_mktsegment || '"}}],"namespace":"n"}' as body from customer""")
def o_upsert_body(spark, sf):
    c = table(spark, sf, "customer")
    rows = c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.array(F.col("c_custkey").cast("double"), F.col("c_nationkey") + F.lit(0.5)).alias("vector"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("metadata"))
    return sinks.upsert_body(rows, "n")


@query("""select * from (values ('after', null, null, true), ('ai_context', null, null, false), ('before', null, null, true), ('database', 'string', null, false), ('id', 'string', null, true), ('idempotency_key', 'string', null, true), ('key', null, null, true),
    ('lsn', 'integer', 'int64', false), ('metadata', null, null, true), ('operation', 'string', null, true), ('schema', 'string', null, false), ('source', 'string', null, true), ('table', 'string', null, true), ('timestamp', 'string', 'date-time', true)) t(name, type, format, required)""")
def x_event_schema(spark, sf):
    doc = scalars.event_schema(CHANGE_EVENT)
    rows = [(n, p.get("type"), p.get("format"), n in doc["required"]) for n, p in doc["properties"].items()]
    return spark.createDataFrame(rows, "name string, type string, format string, required boolean")


@query("select * from (values ('/kafka', 'get', 'object'), ('/sse', 'get', 'object'), ('/webhook', 'post', 'object')) t(path, method, event)")
def o_openapi(spark, sf):
    doc = json.loads(sinks.openapi_text(scalars.openapi(CHANGE_EVENT, ["webhook", "sse", "kafka"])))
    kind = doc["components"]["schemas"]["ChangeEvent"]["type"]
    return spark.createDataFrame([(path, method, kind) for path, ways in doc["paths"].items() for method in ways], "path string, method string, event string")


@query("""with r as (select event_type, count(*) as n, max(value) as most from events group by event_type)
    select '| event_type | n | most |' as line union all select '|---|---|---|' union all select '| ' || event_type || ' | ' || n || ' | ' || printf('%.2f', most) || ' |' from r""")
def o_report(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    lines = report.markdown(rows, ["event_type", "n", "most"]).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query(f"with {FEED} select arrival, case when k % 5 = 0 and op <> 'delete' then 'malformed image' end as reason from feed where k % 5 = 0 and op <> 'delete' or coalesce(a_status = 'F', false)")
def f_malformed(spark, sf):
    cut = (F.get_json_object("key", "$.o_orderkey").cast("bigint") % 5 == 0) & (F.col("operation") != "delete")
    rows = order_feed(spark, sf).withColumn("after", F.when(cut, F.substr("after", F.lit(1), F.lit(9))).otherwise(F.col("after")))
    good, dead = branches(rows, "after.o_orderstatus = 'F'")
    return good.select("arrival", F.lit(None).cast("string").alias("reason")).unionByName(dead.select("arrival", "reason"))


@query("select o_orderkey, upper(to_base(o_orderkey * 5000000000 >> 32, 16)) || '/' || upper(to_base(o_orderkey * 5000000000 & 4294967295, 16)) as lsn, 'auth:' || substr(sha256(o_orderpriority), 1, 16) as scope, 'tpch.' || o_orderstatus as name, o_orderkey % 2 = 0 as ok from orders")
def x_sql_functions(spark, sf):
    sql_functions.register(spark)
    return table(spark, sf, "orders").selectExpr("o_orderkey", "loom_lsn(o_orderkey * 5000000000L) AS lsn", "loom_scope(o_orderpriority) AS scope", "loom_qualified('tpch', o_orderstatus) AS name", "loom_subject_ok(if(o_orderkey % 2 = 0, 'a.b', 'a..b')) AS ok")


@query(f"with {FEED} select arrival, case when arrival % 10 = 9 then 0 else row_number() over (partition by arrival % 10 = 9 order by arrival) end as seq from feed")
def l_stream_append(spark, sf):
    rows = order_feed(spark, sf)
    return eventlog.acknowledged(rows, eventlog.append_stream(rows)).select("arrival", "seq")


@query(f"with {FEED}, s as (select *, cast({FNV} % 64 as integer) as partition, row_number() over (order by arrival) as seq from log) select seq, arrival from s where partition = 5 and seq >= 100 order by seq limit 50")
def l_stream_scan(spark, sf):
    return eventlog.scan(eventlog.append_stream(order_feed(spark, sf)), 5, 100, 50).select("seq", "arrival")
