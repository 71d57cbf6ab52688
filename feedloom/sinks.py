"""What every sink gets: rows mapped to records, batches and payloads; thin writers for streams."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.keys import dedup_id, fnv64_hex, qualified, uuid5, vector_id
from .functions.signing import sigv4_headers
from .operators.actions import ActionError, Delivery, event_json
from .operators.delivery import POISON_STREAK
from .operators.views import runs
from .plans.templates import destination, template

HEADER = "Idempotency-Key"
#: Output modes a configuration may name.
MODES = ("stdout", "sse", "grpc", "kafka", "nats", "sqs", "pubsub", "rabbitmq", "webhook", "vector", "none")


def stdout_lines(events: DataFrame) -> DataFrame:
    return events.select(F.concat(event_json(), F.lit("\n")).alias("value"))


def sse_frames(events: DataFrame) -> DataFrame:
    """id and data lines, ended by a blank one."""
    return events.select("seq", F.concat(F.lit("id: "), F.coalesce("id", "idempotency_key"), F.lit("\ndata: "), event_json(), F.lit("\n\n")).alias("frame"))


def rpc_messages(events: DataFrame) -> DataFrame:
    return events.select("idempotency_key", "table", "operation", "key", event_json().alias("payload"))


def kafka_rows(events: DataFrame, topic: str) -> DataFrame:
    """topic, key, value, headers; rows whose topic is blank have a null one."""
    return events.select(destination(topic).alias("topic"), F.encode("key", "UTF-8").alias("key"), F.encode(event_json(), "UTF-8").alias("value"), F.array(F.struct(F.lit(HEADER).alias("key"), F.encode("idempotency_key", "UTF-8").alias("value"))).alias("headers"))


def subject_rows(events: DataFrame, subject: str) -> DataFrame:
    return events.select(destination(subject).alias("subject"), event_json().alias("payload"), F.col("idempotency_key").alias("message_id"))


def queue_rows(events: DataFrame, queue: str, most: int = 10) -> DataFrame:
    """queue, group_id (FNV-1a-64 of the key), dedup_id (SHA-256), batch: at most ten a request."""
    rows = events.select("seq", destination(queue).alias("queue"), fnv64_hex(F.col("key")).alias("group_id"), dedup_id(F.col("idempotency_key")).alias("dedup_id"), event_json().alias("body"))
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("queue").orderBy("seq")) - 1) / most))


def pubsub_rows(events: DataFrame, topic: str) -> DataFrame:
    return events.select(destination(topic).alias("topic"), F.col("key").alias("ordering_key"), event_json().alias("data"), F.create_map(F.lit(HEADER), F.col("idempotency_key")).alias("attributes"))


def exchange_rows(events: DataFrame, routing_key: str, channels: int = 64) -> DataFrame:
    return events.select(destination(routing_key).alias("routing_key"), (F.col("partition") % channels).alias("channel"), F.lit(2).alias("delivery_mode"), event_json().alias("body"), F.col("idempotency_key").alias("message_id"))


def webhook_requests(events: DataFrame, url: str, by: list[str], most: int = 100, payload: Column | None = None, order: str = "seq", items_too: bool = False) -> DataFrame:
    """Consecutive events of one URL, at most `most`, as one request with a JSON array.

    A batch of one is sent as the object itself when `most` is one.  Requests carry the keys of
    their events, comma-joined in order.  Events are numbered before they are written as JSON.
    """
    rows = events.withColumn("url", template(url))
    if payload is not None:  # an event without one is not sent, so it is made first
        rows = rows.withColumn("__p", payload).where("__p is not null")
    rows = runs(rows, by, order, F.col("url")).withColumn("batch", F.floor(F.col("place") / most).cast("int"))
    if payload is None:
        rows = rows.withColumn("__p", event_json())
    items = F.sort_array(F.collect_list(F.struct(order, "__p", "idempotency_key")))
    out = rows.groupBy(*by, "run", "batch", "url").agg(items.alias("i"))
    joined = F.array_join(F.transform("i", lambda x: x["__p"]), ",")
    body = joined if most == 1 else F.concat(F.lit("["), joined, F.lit("]"))
    return out.select(*by, F.col("i")[0][order].alias(f"first_{order}"), "url", F.size("i").alias("events"), body.alias("body"), F.array_join(F.transform("i", lambda x: x["idempotency_key"]), ",").alias("keys"), *([F.col("i").alias("items")] if items_too else []))


def request_headers(requests: DataFrame, delivery: Delivery, now: dt.datetime, key_id: str = "", secret: str = "", token: str = "") -> DataFrame:
    """Add `headers` to requests of one URL: the delivery's own, the keys, and a signature if it asks for one.

    A signature covers the body and the URL; the keys are a header beside it, as they differ by request.
    """
    own = F.create_map(*[F.lit(x) for kv in delivery.headers.items() for x in kv]) if delivery.headers else F.create_map()
    keys = F.create_map(F.lit(HEADER), F.col("keys"))
    if not delivery.auth:
        return requests.withColumn("headers", F.map_concat(own.cast("map<string,string>"), keys))
    kind, region = delivery.auth
    if kind != "sigv4" or not (key_id and secret):
        raise ActionError("a signed delivery needs a key id and a secret")
    signed = sigv4_headers(delivery.url, F.col("body"), region, "lambda", key_id, secret, now, headers=delivery.headers, token=token)
    return requests.withColumn("headers", F.map_concat(signed, keys))


def vector_rows(events: DataFrame) -> DataFrame:
    """id, text, metadata and the deletes for a table of vectors."""
    return events.select(vector_id(F.col("schema"), F.col("table"), F.col("key")).alias("id"), "operation", *[c for c in ("text", "vector", "metadata") if c in events.columns])


def point_rows(events: DataFrame) -> DataFrame:
    """The same with name-based point ids, for stores that want UUIDs."""
    return vector_rows(events).withColumn("point_id", uuid5(F.col("id")))


def upsert_body(vectors: DataFrame, namespace: str = "") -> DataFrame:
    item = F.struct("id", F.col("vector").alias("values"), F.try_parse_json("metadata").alias("metadata"))
    return vectors.select(F.to_json(F.struct(F.array(item).alias("vectors"), F.lit(namespace or None).alias("namespace"))).alias("body"))


def delete_body(ids: DataFrame) -> DataFrame:
    return ids.agg(F.to_json(F.struct(F.sort_array(F.collect_set("id")).alias("ids"))).alias("body"))


def audit_rows(calls: DataFrame) -> DataFrame:
    """One JSON line a call, without row data."""
    return calls.select(F.to_json(F.struct("ts", F.col("key"), "tool", "params_summary", "tables", "outcome", "duration_ms")).alias("value"))


def qualified_name() -> Column:
    return qualified(F.col("schema"), F.col("table"))


def sender(send: Callable[[str, str, str], int], url: str, by: list[str], most: int = 100, park: Callable[[dict], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each request goes out from its task, in order for each `by`.

    send: (url, body, keys) -> status.  2xx is success.  A transient status (408, 429, 5xx) fails the
    micro-batch, which then runs again as a whole, so receivers see every event at least once.  Any
    other one is poison: the request's events are sent one by one, those that are refused are handed
    to `park`, which must return only when it has stored them, and the rest goes on.  After
    25 refusals in a row the endpoint itself is at fault, and the micro-batch fails; so it does
    without `park`, since nothing is passed over without a copy.
    """

    def run(batch: DataFrame, _: int) -> None:
        requests = webhook_requests(batch, url, by, most, items_too=True)

        def post(rows):
            streak: dict[tuple, int] = {}

            def refused(group: tuple, target: str, body: str, keys: str) -> int | None:
                """The status if it is poison; raises if it is transient."""
                status = send(target, body, keys)
                if 200 <= status < 300:
                    streak[group] = 0
                    return None
                if status in (408, 429) or 500 <= status < 600 or park is None:
                    raise RuntimeError(f"status {status}")
                return status

            for r in rows:
                group = tuple(r[c] for c in by)
                if refused(group, r["url"], r["body"], r["keys"]) is None:
                    continue
                for item in r["items"]:
                    seq, payload, key = item
                    status = refused(group, r["url"], payload if most == 1 else f"[{payload}]", key)
                    if status is None:
                        continue
                    if streak.get(group, 0) >= POISON_STREAK:
                        raise RuntimeError(f"status {status}, {POISON_STREAK} times in a row")
                    park(dict(zip(by, group)) | {"seq": seq, "idempotency_key": key, "payload": payload, "reason": f"status {status}"})
                    streak[group] = streak.get(group, 0) + 1

        requests.repartition(*by).sortWithinPartitions(*by, "first_seq").foreachPartition(post)

    return run


def openapi_text(doc: dict) -> str:
    return json.dumps(doc, sort_keys=True, indent=2) + "\n"
