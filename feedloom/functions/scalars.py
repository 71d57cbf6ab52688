"""Small scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Database type oids and their names.
OID_NAMES = {16: "bool", 17: "bytea", 20: "int8", 21: "int2", 23: "int4", 25: "text", 114: "json", 700: "float4", 701: "float8", 1042: "bpchar", 1043: "varchar", 1082: "date", 1114: "timestamp", 1184: "timestamptz", 1700: "numeric", 2950: "uuid", 3802: "jsonb"}
#: Carrier words of a shipment or payment that change an order's status.
STATUS = {"delivered": "completed", "packed": "processing"}


def oid_name(oid: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in OID_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, oid.cast("int")), F.concat(F.lit("oid:"), oid.cast("string")))


def order_status(c: Column) -> Column:
    out = c
    for a, b in STATUS.items():
        out = F.when(c == a, F.lit(b)).otherwise(out)
    return out


def redact_url(c: Column) -> Column:
    """Passwords of a connection string hidden: in user:password@, in query parameters and in key=value strings; what cannot be read is hidden as well."""
    user = F.regexp_replace(c, r"(?i)^([a-z][a-z0-9+.-]*://[^:/?#@]*:)[^@]*@", "$1xxxxx@")
    query = F.regexp_replace(user, r"(?i)([?&][^=&]*password=)[^&#]*", "$1xxxxx")
    words = F.regexp_replace(c, r"(?i)(\bpassword\s*=\s*)('(?:[^'\\]|\\.)*'|\S+)", "$1xxxxx")
    return F.when(c.contains("://"), query).otherwise(words)


def valid_subject(c: Column) -> Column:
    """Not empty, no white space, no empty token between dots."""
    return c.isNotNull() & c.rlike(r"^[^\s.]+(?:\.[^\s.]+)*$")


def audited(c: Column, kind: str) -> Column:
    """A field for an audit line: money from cents, days without time."""
    if kind == "cents":
        return F.concat(F.lit("$"), F.format_number(c / 100, 2))
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    return F.coalesce(c.cast("string"), F.lit("-"))


def event_schema(schema: T.StructType, required: set[str] | None = None) -> dict:
    """JSON schema of the event envelope, with sorted keys."""
    kinds = {"string": {"type": "string"}, "timestamp": {"type": "string", "format": "date-time"}, "bigint": {"type": "integer", "format": "int64"}, "int": {"type": "integer", "format": "int32"}, "double": {"type": "number"}, "boolean": {"type": "boolean"}}
    free = {"key", "before", "after", "metadata", "ai_context"}
    props = {f.name: ({} if f.name in free else kinds.get(f.dataType.simpleString(), {})) for f in schema.fields}
    props["id"] = {"type": "string", "pattern": "^[0-9A-HJKMNP-TV-Z]{26}$"}
    need = required if required is not None else {f.name for f in schema.fields} - {"ai_context", "database", "schema", "lsn"}
    return {"type": "object", "properties": dict(sorted(props.items())), "required": sorted(need)}


def openapi(schema: T.StructType, sinks: list[str], title: str = "Change events") -> dict:
    """A deterministic description of the feeds; secrets never enter it."""
    paths = {f"/{s}": {"post" if s == "webhook" else "get": {"responses": {"200": {"description": "events", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/ChangeEvent"}}}}}}} for s in sorted(sinks)}
    return {"components": {"schemas": {"ChangeEvent": event_schema(schema)}}, "info": {"title": title, "version": "1"}, "openapi": "3.1.0", "paths": paths}
