"""Actions: payload builders and delivery presets by type name."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.templates import template

NAME = re.compile(r"^[a-z0-9-]+$")
SECRET = re.compile(r"^\$\{([A-Za-z_][A-Za-z0-9_]*)\}$")
EVENT_FIELDS = {"Table": "table", "Operation": "operation", "Schema": "schema"}


class ActionError(ValueError):
    """A configuration that cannot be used."""


@dataclass(frozen=True)
class Param:
    required: bool = False
    secret: bool = False
    default: str = ""


@dataclass(frozen=True)
class Delivery:
    """Where and how a payload is sent."""

    url: str
    payload: Column | None  # None: the raw event
    headers: dict[str, str] = field(default_factory=dict)
    max_batch: int = 1
    auth: tuple[str, ...] = ()


@dataclass(frozen=True)
class Type:
    name: str
    params: dict[str, Param]
    build: Callable[[dict[str, str]], Delivery]
    pins_batch: bool = False
    auth_headers: tuple[str, ...] = ()


def _json(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.try_parse_json(F.when(c != "null", c))


def event_object() -> Column:
    """The whole event as a struct that serialises like the event itself; images stay null where absent."""
    return F.struct("idempotency_key", "timestamp", "source", "operation", "schema", "table", _json("key").alias("key"), _json("before").alias("before"), _json("after").alias("after"))


def event_json() -> Column:
    return F.to_json(event_object(), {"ignoreNullFields": "false"})


def summary_line() -> Column:
    return F.concat(F.lit("["), "operation", F.lit("] "), "table", F.lit(" — key "), F.coalesce("key", F.lit("?")))


def chat_payload(name: str) -> Column:
    return F.to_json(F.struct(summary_line().alias(name)))


def email_payload(to: str, sender: str, subject: str) -> Column:
    return F.to_json(
        F.struct(
            F.array(F.struct(F.array(F.struct(F.lit(to).alias("email"))).alias("to"))).alias("personalizations"),
            F.struct(F.lit(sender).alias("email")).alias("from"),
            template(subject).alias("subject"),
            F.array(F.struct(F.lit("text/plain").alias("type"), event_json().alias("value"))).alias("content"),
        )
    )


def purge_payload(url: str) -> Column:
    return F.to_json(F.struct(F.array(template(url)).alias("files")))


def upsert_payload(id_field: str, vector_field: str, namespace: str = "") -> Column:
    """Null for deletes, which drops them."""
    get = lambda k: F.get_json_object("after", f"$['{k}']")
    item = F.struct(F.coalesce(get(id_field), F.lit("null")).alias("id"), F.try_parse_json(get(vector_field)).alias("values"))
    body = [F.array(item).alias("vectors")] + ([F.lit(namespace).alias("namespace")] if namespace else [])
    return F.when(F.col("operation") != "delete", F.to_json(F.struct(*body), {"ignoreNullFields": "false"}))


def event_name(text: str) -> Column:
    return template(text, EVENT_FIELDS, images=False)


def function_payload(name: str) -> Column:
    return F.to_json(F.struct(event_name(name).alias("name"), F.col("idempotency_key").alias("id"), F.unix_millis("timestamp").alias("ts"), event_object().alias("data")))


def trigger_payload(name: str) -> Column:
    return F.to_json(F.struct(F.struct(event_name(name).alias("name"), event_object().alias("payload"), F.col("idempotency_key").alias("id")).alias("event")))


JSON_TYPE = {"Content-Type": "application/json"}
DEFAULT_SUBJECT = "[{{.Operation}}] {{.Table}}"
DEFAULT_NAME = "cdc/{{.Table}}.{{.Operation}}"


def _email(p: dict[str, str]) -> Delivery:
    if p["provider"] not in ("", "sendgrid"):
        raise ActionError(f"unsupported provider {p['provider']!r}")
    return Delivery("https://api.sendgrid.com/v3/mail/send", email_payload(p["to"], p["from"], p["subject-template"]), JSON_TYPE | {"Authorization": f"Bearer {p['api-key']}"})


def _purge(p: dict[str, str]) -> Delivery:
    return Delivery(f"https://api.cloudflare.com/client/v4/zones/{p['zone-id']}/purge_cache", purge_payload(p["url-template"]), JSON_TYPE | {"Authorization": f"Bearer {p['api-token']}"})


def _worker(p: dict[str, str]) -> Delivery:
    if not p["token"] and p["unauthenticated"] != "true":
        raise ActionError("a token, or unauthenticated: true, is needed")
    return Delivery(p["url"], None, {"Authorization": f"Bearer {p['token']}"} if p["token"] else {}, 100)


def _lambda(p: dict[str, str]) -> Delivery:
    return Delivery(p["url"], None, {"X-Amz-Invocation-Type": "Event"} if p["async"] == "true" else {}, 100, ("sigv4", p["region"]))


REGISTRY: dict[str, Type] = {
    t.name: t
    for t in (
        Type("slack", {"webhook-url": Param(True, True)}, lambda p: Delivery(p["webhook-url"], chat_payload("text"), JSON_TYPE), True),
        Type("discord", {"webhook-url": Param(True, True)}, lambda p: Delivery(p["webhook-url"], chat_payload("content"), JSON_TYPE), True),
        Type("email", {"provider": Param(), "api-key": Param(True, True), "from": Param(True), "to": Param(True), "subject-template": Param(default=DEFAULT_SUBJECT)}, _email, True, ("Authorization",)),
        Type("http-request", {"url": Param(True)}, lambda p: Delivery(p["url"], None, JSON_TYPE, 100)),
        Type("custom", {"url": Param(True)}, lambda p: Delivery(p["url"], None, {}, 100)),
        Type("cache-invalidate", {"zone-id": Param(True), "api-token": Param(True, True), "url-template": Param(True)}, _purge, True, ("Authorization",)),
        Type("vector-upsert", {"url": Param(True), "api-key": Param(True, True), "id-field": Param(default="id"), "vector-field": Param(default="embedding"), "namespace": Param()}, lambda p: Delivery(p["url"], upsert_payload(p["id-field"], p["vector-field"], p["namespace"]), JSON_TYPE | {"Api-Key": p["api-key"]}), True, ("Api-Key",)),
        Type("inngest", {"event-key": Param(True, True), "api-url": Param(default="https://inn.gs"), "event-name-template": Param(default=DEFAULT_NAME)}, lambda p: Delivery(f"{p['api-url'].rstrip('/')}/e/{p['event-key']}", function_payload(p["event-name-template"]), JSON_TYPE, 100)),
        Type("triggerdev", {"api-key": Param(True, True), "api-url": Param(default="https://api.trigger.dev"), "event-name-template": Param(default=DEFAULT_NAME)}, lambda p: Delivery(f"{p['api-url'].rstrip('/')}/api/v1/events", trigger_payload(p["event-name-template"]), JSON_TYPE | {"Authorization": f"Bearer {p['api-key']}"}), True, ("Authorization",)),
        Type("lambda", {"url": Param(True), "region": Param(True), "async": Param(default="true")}, _lambda),
        Type("cloudflare-worker", {"url": Param(True), "token": Param(False, True), "unauthenticated": Param()}, _worker, False, ("Authorization",)),
        Type("vercel", {"url": Param(True), "token": Param(False, True)}, lambda p: Delivery(p["url"], None, {"Authorization": f"Bearer {p['token']}"} if p["token"] else {}, 100), False, ("Authorization",)),
    )
}


def compiled(name: str, kind: str, params: dict[str, str], taken: set[str] = frozenset(), transform: Column | None = None, headers: dict[str, str] | None = None, batch: int | None = None, env: dict[str, str] | None = None) -> Delivery:
    """A checked action.  Secrets must be ${VAR}; a transform replaces the payload; headers merge, but not over computed ones."""
    env = dict(os.environ) if env is None else env
    if not NAME.match(name) or name in taken:
        raise ActionError(f"bad or repeated name {name!r}")
    if kind not in REGISTRY:
        raise ActionError(f"unknown type {kind!r}")
    t = REGISTRY[kind]
    if unknown := set(params) - set(t.params):
        raise ActionError(f"unknown params {sorted(unknown)}")
    got = {}
    for k, spec in t.params.items():
        v = params.get(k, spec.default)
        if spec.required and not v:
            raise ActionError(f"{k} is required")
        if m := SECRET.match(v):
            if m[1] not in env:
                raise ActionError(f"{m[1]} is not set")
            v = env[m[1]]
        elif spec.secret and v:
            raise ActionError(f"{k} must be given as ${{VAR}}")
        got[k] = v
    out = t.build(got)
    lower = {h.lower() for h in t.auth_headers}
    if clash := [h for h in headers or {} if h.lower() in lower]:
        raise ActionError(f"{clash[0]} is computed")
    if batch is not None and t.pins_batch:
        raise ActionError(f"{kind} sends one event at a time")
    return Delivery(out.url, out.payload if transform is None else transform, out.headers | (headers or {}), batch or out.max_batch, out.auth)
