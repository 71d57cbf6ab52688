"""Allow-lists, column projection, masking and access rules on JSON images."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import qualified, unqualified
from ..model import variant_map
from ..plans.routing import any_glob

MASK = "***"


def allowed(tables: list[str] | None = None, operations: list[str] | None = None) -> Column:
    """Tables by qualified or bare name, operations; empty lists allow all."""
    out = F.lit(True)
    if tables:
        out = out & (F.col("table").isin(tables) | qualified(F.col("schema"), F.col("table")).isin(tables))
    if operations:
        out = out & F.col("operation").isin(operations)
    return out


def keep_columns(json: Column, columns: list[str] | None) -> Column:
    """Only these keys, sorted; no list, no object or malformed JSON passes unchanged."""
    if not columns:
        return json
    m = variant_map(json)
    return F.when(m.isNull(), json).otherwise(F.to_json(F.map_filter(m, lambda k, _: k.isin(columns))))


def mask_columns(json: Column, columns: list[str]) -> Column:
    """These keys, where present, hide their values; unchanged if none is."""
    if not columns:
        return json
    m = variant_map(json)
    hidden = F.transform_values(m, lambda k, v: F.when(k.isin(columns), F.parse_json(F.lit(f'"{MASK}"'))).otherwise(v))
    return F.when(m.isNull() | ~F.arrays_overlap(F.map_keys(m), F.array(*[F.lit(c) for c in columns])), json).otherwise(F.to_json(hidden))


@dataclass(frozen=True)
class Redaction:
    tables: tuple[str, ...]
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Access:
    """Tables that may be read (globs; an empty list is an error), and columns hidden by table."""

    tables: tuple[str, ...]
    redact: tuple[Redaction, ...] = ()

    def __post_init__(self):
        if not self.tables:
            raise ValueError("tables must not be empty")

    def apply(self, events: DataFrame) -> DataFrame:
        """Allowed events with masked images; ai_context goes where any rule touches the table."""
        name = qualified(F.col("schema"), F.col("table"))
        out = events.where(any_glob(list(self.tables), name))
        for rule in self.redact:
            hit = any_glob(list(rule.tables), name)
            for side in ("key", "before", "after"):
                if side in out.columns:
                    out = out.withColumn(side, F.when(hit, mask_columns(F.col(side), list(rule.columns))).otherwise(F.col(side)))
            if "ai_context" in out.columns:
                out = out.withColumn("ai_context", F.when(~hit, F.col("ai_context")))
        return out


def agent_context() -> Column:
    """A compact view of an event; nulls are left out."""
    obj = lambda c: F.try_parse_json(F.when(F.col(c) != "null", F.col(c)))
    return F.to_json(F.struct("id", "operation", qualified(F.col("schema"), F.col("table")).alias("table"), obj("key").alias("key"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), obj("before").alias("before"), obj("after").alias("after"), obj("ai_context").alias("ai_context")))


def vector_metadata(columns: list[str]) -> Column:
    """Table, operation, time, schema if there is one, and the listed fields that the row has."""
    base = F.map_from_arrays(F.array(F.lit("table"), F.lit("operation"), F.lit("timestamp"), F.lit("schema")), F.array(F.parse_json(F.to_json(F.array("table"))), F.parse_json(F.to_json(F.array("operation"))), F.parse_json(F.to_json(F.array(nano_time(F.col("timestamp"))))), F.parse_json(F.to_json(F.array(F.coalesce("schema", F.lit("")))))))
    one = F.transform_values(base, lambda _, v: F.variant_get(v, "$[0]", "variant"))
    one = F.map_filter(one, lambda k, v: (k != "schema") | (F.variant_get(v, "$", "string") != ""))
    m = variant_map(F.col("after"))
    more = F.coalesce(F.map_filter(m, lambda k, _: k.isin(columns) & ~k.isin("table", "operation", "timestamp", "schema")), F.map_filter(one, lambda k, v: F.lit(False)))
    return F.to_json(F.map_concat(one, more))


def nano_time(ts: Column) -> Column:
    """RFC 3339 in UTC with as many fractional digits as needed."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(whole, "0+$", ""), r"\.$", ""), F.lit("Z"))


def table_names(configured: DataFrame, captured: DataFrame, name: str = "table", position: str = "position") -> DataFrame:
    """The distinct trimmed names of both in order of first appearance, configured ones first."""
    one = configured.select(F.trim(name).alias(name), F.lit(0).alias("__from"), position)
    two = captured.select(F.trim(name).alias(name), F.lit(1).alias("__from"), position)
    first = one.unionByName(two).where(F.col(name) != "").groupBy(name).agg(F.min(F.struct("__from", position)).alias("first"))
    return first.select(name, F.col("first.__from").alias("captured"), F.col(f"first.{position}").alias(position))


def column_listing(columns: DataFrame, access: Access) -> DataFrame:
    """(table, column, type, is_pk) with a `redacted` flag, for allowed tables."""
    name = F.col("table")
    hidden = F.lit(False)
    for rule in access.redact:
        hidden = hidden | (any_glob(list(rule.tables), name) & F.col("column").isin(list(rule.columns)))
    return columns.where(any_glob(list(access.tables), name)).withColumn("redacted", hidden)


def bare(name: Column) -> Column:
    return unqualified(name)
