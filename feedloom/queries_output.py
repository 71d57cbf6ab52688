"""Queries: scalars, payloads, vectors, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sinks
from .functions import keys as K
from .functions import scalars
from .model import plain_number, short_number
from .operators import actions, enrich, eventlog, vector, views
from .plans.templates import destination
from .registry import EVENT, FEED, FNV, FNV64, IDK, query, table, uuid5_sql
from .sources.feed import order_feed

_SEQ = f"with {FEED}, p as (select *, cast({FNV} % 64 as integer) as partition from log), s as (select *, row_number() over (partition by partition order by arrival) as seq from p)"


def _log(spark, sf):
    return eventlog.append(order_feed(spark, sf)).withColumn("status", F.get_json_object("after", "$.o_orderstatus"))


# ------------------------------------------------------------------ scalars


@query("""select c_custkey, '{"a":"' || c_custkey || '","b":' || case when c_custkey % 3 = 0 then 'null' else '"' || (case when c_custkey % 2 = 0 then 't' else 'f' end) || '"' end || ',"c":"x\\u003c\\u0026\\"' || c_custkey || '"}' as key from customer""")
def x_canonical_key(spark, sf):
    k = F.col("c_custkey")
    cols = {"c": (F.concat(F.lit('x<&"'), k.cast("string")), T.StringType()), "a": (k, T.LongType()), "b": (F.when(k % 3 != 0, k % 2 == 0), T.BooleanType())}
    return table(spark, sf, "customer").select(k, K.canonical_key(cols).alias("key"))


@query("select v, p, s from (values (1, '5', '5'), (2, '0.1', '0.1'), (3, '100000000000000000000', '100000000000000000000'), (4, '1000000000000000000000', '1e+21'), (5, '-2.5', '-2.5'), (6, '0.00001', '1e-05'), (7, '123456789.125', '123456789.125')) t(v, p, s)")
def x_numbers(spark, sf):
    values = [5.0, 0.1, 1e20, 1e21, -2.5, 1e-5, 123456789.125]
    rows = spark.createDataFrame(list(enumerate(values, 1)), "v int, d double")
    return rows.select("v", plain_number(F.col("d")).alias("p"), short_number(F.col("d")).alias("s"))


@query(f"with {FEED} select arrival, lsn, upper(to_base(lsn >> 32, 16)) || '/' || upper(to_base(lsn & 4294967295, 16)) as text from feed")
def x_lsn(spark, sf):
    rows = order_feed(spark, sf).select("arrival", K.lsn_text(F.col("lsn")).alias("text"))
    return rows.select("arrival", K.lsn_number(F.col("text")).alias("lsn"), "text")


@query("select doc_id, sha256(text) as hash from documents")
def x_sha(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.dedup_id(F.col("text")).alias("hash"))


@query("select p_partkey, 'auth:' || substr(sha256(p_name), 1, 16) as scope from part")
def x_scope(spark, sf):
    return table(spark, sf, "part").select("p_partkey", K.scope_id(F.col("p_name")).alias("scope"))


@query(f"with {FEED} select arrival, 'tpch.orders:' || key as id from feed")
def x_vector_id(spark, sf):
    return order_feed(spark, sf).select("arrival", K.vector_id(F.col("schema"), F.col("table"), F.col("key")).alias("id"))


@query("select p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split_regex(lower(p_name), '\\s+'), string_split_regex(lower(p_brand), '\\s+'), list_filter(string_split_regex(lower(p_type), '\\s+'), lambda x: length(x) > 3)), lambda x: x <> ''))), ',') as terms from part".replace("\\\\", "\\"))
def x_terms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(views.search_terms(F.col("p_name"), F.col("p_brand"), long=F.col("p_type")), ",").alias("terms"))


@query("select p_partkey, 'p_name: ' || p_name || chr(10) || 'p_size: ' || p_size || chr(10) || 'nothing:' as text from part")
def x_extract_text(spark, sf):
    after = F.to_json(F.struct("p_name", F.col("p_size").cast("double").alias("p_size")))
    return table(spark, sf, "part").select("p_partkey", vector.extracted(["p_name", "p_size", "nothing"], after).alias("text"))


@query("select c_custkey, 'postgres://u:xxxxx@h/db?sslmode=off&password=xxxxx' as url, 'host=h password=xxxxx user=u' as words from customer")
def x_redact(spark, sf):
    k = F.col("c_custkey").cast("string")
    return table(spark, sf, "customer").select("c_custkey", scalars.redact_url(F.concat(F.lit("postgres://u:p"), k, F.lit("@h/db?sslmode=off&password=x"), k)).alias("url"), scalars.redact_url(F.concat(F.lit("host=h password=pw"), k, F.lit(" user=u"))).alias("words"))


@query("select o_orderkey, case o_orderkey % 3 when 0 then 'completed' when 1 then 'processing' else 'shipped' end as status from orders")
def x_order_status(spark, sf):
    s = F.element_at(F.array(F.lit("delivered"), F.lit("packed"), F.lit("shipped")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", scalars.order_status(s).alias("status"))


@query("select n_name, n_nationkey % 3 = 0 as ok from nation")
def x_subject(spark, sf):
    s = F.element_at(F.array(F.concat(F.lit("cdc."), "n_name"), F.lit("a..b"), F.lit("a b")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf, "nation").select("n_name", scalars.valid_subject(s).alias("ok"))


@query("select n_name, case n_nationkey % 2 when 0 then 'int4' else 'oid:99999' end as type from nation")
def x_oid(spark, sf):
    return table(spark, sf, "nation").select("n_name", scalars.oid_name(F.when(F.col("n_nationkey") % 2 == 0, 23).otherwise(99999)).alias("type"))


@query(f"with {FEED} select arrival, case when op = 'delete' then null else 't-' || a_status end as topic from feed")
def x_destination(spark, sf):
    rows = order_feed(spark, sf)
    prefix = F.when(F.col("operation") == "delete", " ").otherwise(F.concat(F.lit("t-"), F.get_json_object("after", "$.o_orderstatus")))
    return rows.withColumn("table", prefix).select("arrival", destination("{{.Table}} ").alias("topic"))


@query(f"with {FEED} select arrival, {uuid5_sql("'tpch.orders:' || key", str(K.POINTS))} as point from feed")
def x_uuid5(spark, sf):
    return order_feed(spark, sf).select("arrival", K.uuid5(K.vector_id(F.col("schema"), F.col("table"), F.col("key"))).alias("point"))


@query(f"with {FEED} select arrival, {FNV64} as group_id, sha256({IDK}) as dedup_id from feed")
def x_sqs_ids(spark, sf):
    return order_feed(spark, sf).select("arrival", K.fnv64_hex(F.col("key")).alias("group_id"), K.dedup_id(F.col("idempotency_key")).alias("dedup_id"))


def _pad(byte: int) -> str:
    """The signing key's block, as hex."""
    return bytes(b ^ byte for b in b"secret".ljust(64, b"\0")).hex()


@query(f"with m as (select *, cast(floor(epoch(ts)) as bigint) as t from events) select event_id, 't=' || t || ',v1=' || sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(t || '.' || props)))) as signature from m")
def x_signature(spark, sf):
    return table(spark, sf, "events").select("event_id", K.signature("secret", F.unix_seconds(F.col("ts").cast("timestamp")), F.col("props")).alias("signature"))


@query("select event_id, lower(event_type) || '_on_events' as intent from events")
def x_intent(spark, sf):
    return table(spark, sf, "events").select("event_id", enrich.naive_intent(F.col("event_type"), F.lit("events")).alias("intent"))


# ------------------------------------------------------------------ payloads


@query(f"with {FEED} select arrival, '[' || op || '] orders — key ' || key as text from feed")
def p_slack(spark, sf):
    return order_feed(spark, sf).select("arrival", F.get_json_object(actions.chat_payload("text"), "$.text").alias("text"))


@query(f"with {FEED} select arrival, '[' || op || '] orders — key ' || key as text from feed")
def p_discord(spark, sf):
    return order_feed(spark, sf).select("arrival", F.get_json_object(actions.chat_payload("content"), "$.content").alias("text"))


@query(f"with {FEED} select arrival, 'to@x.org' as receiver, '[' || op || '] orders' as subject, b_status from feed")
def p_email(spark, sf):
    p = order_feed(spark, sf).select("arrival", actions.email_payload("to@x.org", "from@x.org", actions.DEFAULT_SUBJECT).alias("p"))
    g = lambda k: F.get_json_object("p", k)
    return p.select("arrival", g("$.personalizations[0].to[0].email").alias("receiver"), g("$.subject").alias("subject"), F.get_json_object(g("$.content[0].value"), "$.before.o_orderstatus").alias("b_status"))


@query(f"with {FEED} select arrival, '{{\"files\":[\"https://cdn.example.com/orders/' || coalesce(a_status, '') || '\"]}}' as payload from feed")
def p_purge(spark, sf):
    return order_feed(spark, sf).select("arrival", actions.purge_payload("https://cdn.example.com/{{.Table}}/{{.After.o_orderstatus}}").alias("payload"))


@query(f"with {FEED} select arrival, case when op <> 'delete' then k end as id from feed")
def p_pinecone_drop(spark, sf):
    return order_feed(spark, sf).select("arrival", F.get_json_object(actions.upsert_payload("o_orderkey", "o_totalprice", "ns"), "$.vectors[0].id").cast("bigint").alias("id"))


@query(f"with {FEED} select arrival, 'cdc/orders.' || op as name, 1700000000000 + lsn as ts, a_status as status from feed")
def p_inngest(spark, sf):
    p = order_feed(spark, sf).select("arrival", actions.function_payload(actions.DEFAULT_NAME).alias("p"))
    return p.select("arrival", F.get_json_object("p", "$.name").alias("name"), F.get_json_object("p", "$.ts").cast("bigint").alias("ts"), F.get_json_object("p", "$.data.after.o_orderstatus").alias("status"))


@query(f"with {FEED} select arrival, 'cdc/orders.' || op as name, a_status as status from feed")
def p_triggerdev(spark, sf):
    p = order_feed(spark, sf).select("arrival", actions.trigger_payload(actions.DEFAULT_NAME).alias("p"))
    return p.select("arrival", F.get_json_object("p", "$.event.name").alias("name"), F.get_json_object("p", "$.event.payload.after.o_orderstatus").alias("status"))


@query(f"with {FEED} select arrival, op as operation, a_status as status from feed")
def p_raw_event(spark, sf):
    p = order_feed(spark, sf).select("arrival", actions.event_json().alias("p"))
    return p.select("arrival", F.get_json_object("p", "$.operation").alias("operation"), F.get_json_object("p", "$.after.o_orderstatus").alias("status"))


@query("select event_id, case event_id % 8 when 0 then null when 1 then 'none' when 2 then 'status' when 3 then 'oversize' when 4 then 'invalid' when 5 then 'non_object' when 6 then 'error' else 'timeout' end as reason from events")
def p_ai_context_validate(spark, sf):
    m = F.col("event_id") % 8
    status = F.when(m == 1, 204).when(m == 2, 500).when(m < 6, 200)
    body = F.when(m == 0, F.lit('{"a":1}')).when(m == 3, F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 17000), F.lit('"}'))).when(m == 4, "{oops").when(m == 5, "[1]")
    return table(spark, sf, "events").select("event_id", enrich.verdict(status, body, timed_out=m == 7).alias("reason"))


@query("select event_id, case when event_id % 4 = 0 then 'error' when event_id % 4 = 1 then 'non_object' end as enrich_reason, event_id % 4 in (2, 3) and event_type <> 'view' as has_context from events where event_type <> 'view' union all select event_id, null, false from events where event_type = 'view'")
def p_enrich(spark, sf):
    import json

    def call(text):
        n = json.loads(text)["event_id"]
        if n % 4 == 0:
            raise RuntimeError("down")
        return 200, "[]" if n % 4 == 1 else '{"intent":"x"}'

    e = table(spark, sf, "events").select("event_id", "event_type")
    out = enrich.enriched(e, call, F.col("event_type") != "view")
    return out.select("event_id", "enrich_reason", F.col("ai_context").isNotNull().alias("has_context"))


# ------------------------------------------------------------------ vectors


@query(f"""with {FEED}, m as (select *, case when op = 'delete' then '' else 'o_orderpriority: ' || o_orderpriority || chr(10) || 'x: ' || (case when a_status = 'P' then 'O' else a_status end) end as text from log),
    l as (select *, last_value(text) over (partition by k order by arrival rows between unbounded preceding and 1 preceding) as prev from m)
    select arrival, case when op = 'delete' then 'delete' when text = prev then 'skip_unchanged' else 'upsert' end as decision from l""")
def w_unchanged_text(spark, sf):
    g = lambda f: F.get_json_object("after", f"$.{f}")
    rows = _log(spark, sf).withColumn("text", F.when(F.col("operation") == "delete", "").otherwise(vector.extracted_typed({"o_orderpriority": g("o_orderpriority"), "x": F.when(F.col("status") == "P", "O").otherwise(F.col("status"))})))
    rows = rows.withColumn("vector_id", F.col("key"))
    return vector.decisions(rows, "vector_id", "text", "arrival").select("arrival", "decision")


@query(f"""{_SEQ}, d as (select *, case when op = 'delete' then 'delete' else 'upsert' end as decision from s), r as (select *, case when lag(decision) over w = decision then 0 else 1 end as c from d window w as (partition by partition order by seq)),
    n as (select *, sum(c) over (partition by partition order by seq rows between unbounded preceding and current row) as run from r)
    select arrival, cast(run as bigint) as run, cast((row_number() over (partition by partition, run order by seq) - 1) // 5 as integer) as batch from n""")
def k_vector_batches(spark, sf):
    rows = _log(spark, sf).withColumn("decision", F.when(F.col("operation") == "delete", "delete").otherwise("upsert"))
    return vector.batched(rows, ["partition"], "seq", 5).select("arrival", "run", "batch")


@query(f"with {FEED} select k, arg_max(op, arrival) as operation from log group by k")
def k_vector_net(spark, sf):
    rows = _log(spark, sf).withColumn("decision", F.when(F.col("operation") == "delete", "delete").otherwise("upsert"))
    return vector.net_effect(rows, "o_orderkey", "arrival").select(F.col("o_orderkey").alias("k"), "operation")


@query(f"with {FEED} select arrival from log where op <> 'delete' and not (k % 4 = 0 and op = 'insert')")
def k_vector_unknown(spark, sf):
    rows = _log(spark, sf).where("operation != 'delete'").select("arrival", F.col("key").alias("vector_id"), F.sha2("after", 256).alias("text_hash"), "operation", "o_orderkey")
    known = rows.where("o_orderkey % 4 = 0 and operation = 'insert'").select("vector_id", "text_hash")
    return vector.unknown_texts(rows, known).select("arrival")


@query("select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as similarity from embeddings order by similarity desc, vec_id limit 5")
def t_vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    return vector.nearest(e, q, 5, "embedding", "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("select vec_id, case when vec_id % 5 = 0 then null else len(embedding) end as n from embeddings")
def t_embedding_order(spark, sf):
    e = table(spark, sf, "embeddings")
    items = F.transform("embedding", lambda x, i: F.struct((F.size("embedding") - 1 - i + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)).alias("index"), F.array(x).alias("vector")))
    return e.select("vec_id", F.size(vector.ordered_vectors(items)).cast("bigint").alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query("select p_partkey, len(p_name) as dims, cast(list_sum(list_transform(range(1, length(p_name) + 1), lambda i: i * ord(substr(p_name, i, 1)))) as bigint) as digest from part")
def p_embed(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text"))
    out = vector.embedded(rows, lambda texts: [[float(ord(c)) for c in t] for t in texts])
    digest = F.aggregate(F.transform("vector", lambda x, i: (i + 1) * x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("p_partkey", F.size("vector").cast("bigint").alias("dims"), digest.alias("digest"))


@query("select vec_id, '[' || array_to_string(list_transform(embedding, lambda x: rtrim(rtrim(cast(cast(cast(cast(x as varchar) as double) as decimal(38, 12)) as varchar), '0'), '.')), ',') || ']' as literal from embeddings")
def x_vector_text(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", vector.vector_text(F.col("embedding")).alias("literal"))


# ------------------------------------------------------------------ sinks


def _digest(c: str):
    return F.sha2(c, 256)


@query(f"{_SEQ} select seq, sha256('id: ' || {IDK} || chr(10) || 'data: ' || {EVENT} || chr(10) || chr(10)) as frame from s")
def o_sse_frames(spark, sf):
    out = sinks.sse_frames(_log(spark, sf).withColumn("id", F.col("idempotency_key")))
    return out.select("seq", _digest("frame").alias("frame"))


@query(f"with {FEED} select sha256({EVENT} || chr(10)) as line from feed")
def o_stdout(spark, sf):
    return sinks.stdout_lines(order_feed(spark, sf)).select(_digest("value").alias("line"))


@query(f"with {FEED} select 'cdc.tpch.orders' as topic, key, sha256({EVENT}) as value, 'Idempotency-Key' as header, {IDK} as idempotency_key from feed")
def o_kafka_rows(spark, sf):
    rows = sinks.kafka_rows(order_feed(spark, sf), "cdc.{{.Schema}}.{{.Table}}")
    h = F.col("headers")[0]
    return rows.select("topic", F.decode("key", "UTF-8").alias("key"), _digest("value").alias("value"), h["key"].alias("header"), F.decode(h["value"], "UTF-8").alias("idempotency_key"))


@query(f"with {FEED} select 'orders.' || op as subject, sha256({EVENT}) as payload, {IDK} as message_id from feed")
def o_subjects(spark, sf):
    return sinks.subject_rows(order_feed(spark, sf), "{{.Table}}.{{.Operation}}").withColumn("payload", _digest("payload"))


@query(f"with {FEED} select op as queue, (row_number() over (partition by op order by arrival) - 1) // 10 as batch, arrival as seq, {FNV64} as group_id, sha256({IDK}) as dedup_id, sha256({EVENT}) as body from feed")
def o_queue_batches(spark, sf):
    rows = order_feed(spark, sf).withColumnRenamed("arrival", "seq")
    return sinks.queue_rows(rows, "{{.Operation}}").select("queue", "batch", "seq", "group_id", "dedup_id", _digest("body").alias("body"))


@query(f"with {FEED} select 'orders' as topic, key as ordering_key, sha256({EVENT}) as data, {IDK} as idempotency_key from feed")
def o_pubsub(spark, sf):
    return sinks.pubsub_rows(order_feed(spark, sf), "{{.Table}}").select("topic", "ordering_key", _digest("data").alias("data"), F.element_at("attributes", sinks.HEADER).alias("idempotency_key"))


@query(f"{_SEQ} select 'tpch.' || op as routing_key, partition as channel, 2 as delivery_mode, sha256({EVENT}) as body, {IDK} as message_id from s")
def o_exchange(spark, sf):
    return sinks.exchange_rows(_log(spark, sf), "{{.Schema}}.{{.Operation}}").withColumn("body", _digest("body"))


@query(f"with {FEED} select {IDK} as idempotency_key, 'orders' as \"table\", op as operation, key, sha256({EVENT}) as payload from feed")
def o_rpc(spark, sf):
    return sinks.rpc_messages(order_feed(spark, sf)).withColumn("payload", _digest("payload"))


@query(f"""{_SEQ}, u as (select *, 'https://h/' || op as url from s), r as (select *, case when lag(url) over w = url then 0 else 1 end as c from u window w as (partition by partition order by seq)),
    n as (select *, sum(c) over (partition by partition order by seq rows between unbounded preceding and current row) as run from r), b as (select *, (row_number() over (partition by partition, run order by seq) - 1) // 4 as batch from n)
    select partition, min(seq) as first_seq, url, cast(count(*) as integer) as events, sha256('[' || string_agg({EVENT}, ',' order by seq) || ']') as body, sha256(string_agg({IDK}, ',' order by seq)) as keys from b group by partition, run, batch, url""")
def o_webhook_batches(spark, sf):
    return sinks.webhook_requests(_log(spark, sf), "https://h/{{.Operation}}", ["partition"], 4).select("partition", "first_seq", "url", "events", _digest("body").alias("body"), _digest("keys").alias("keys"))


@query(f"with {FEED} select arrival, 'tpch.orders:' || key as id, {uuid5_sql("'tpch.orders:' || key", str(K.POINTS))} as point_id from feed")
def o_vector_rows(spark, sf):
    return sinks.point_rows(order_feed(spark, sf).withColumn("text", F.col("arrival").cast("string"))).select(F.col("text").cast("bigint").alias("arrival"), "id", "point_id")


@query("select '{\"ids\":[' || string_agg('\"' || n_name || '\"', ',' order by n_name) || ']}' as body from nation")
def o_delete_body(spark, sf):
    return sinks.delete_body(table(spark, sf, "nation").select(F.col("n_name").alias("id")))


@query("select event_id, '{\"ts\":\"t\",\"key\":\"' || user_id || '\",\"tool\":\"' || event_type || '\",\"params_summary\":\"p\",\"tables\":[\"events\"],\"outcome\":\"ok\",\"duration_ms\":' || event_id || '}' as value from events")
def o_audit(spark, sf):
    calls = table(spark, sf, "events").select(F.lit("t").alias("ts"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("tool"), F.lit("p").alias("params_summary"), F.array(F.lit("events")).alias("tables"), F.lit("ok").alias("outcome"), F.col("event_id").alias("duration_ms"))
    return sinks.audit_rows(calls).select(F.get_json_object("value", "$.duration_ms").cast("bigint").alias("event_id"), "value")
