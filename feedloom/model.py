"""The universal change event and helpers for its JSON images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATIONS = ("insert", "update", "delete", "read", "control")

#: One row of the stream. Images are JSON text, so their exact bytes are kept; `lsn` is the log
#: position (for document stores the cluster time), first-class so that both kinds of source have it.
CHANGE_EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("idempotency_key", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("before", T.StringType()),
        T.StructField("after", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("ai_context", T.StringType()),
        T.StructField("lsn", T.LongType()),
    ]
)


def variant_map(json: Column) -> Column:
    """A JSON object as map<string, variant> with sorted keys; null for anything else."""
    return F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")


def field(json: Column, name: str) -> Column:
    """The variant under exactly this key, which may hold dots; null if the key is missing."""
    return F.try_element_at(variant_map(json), F.lit(name))


def text(v: Column) -> Column:
    """A variant scalar as text; JSON null and missing are null."""
    return F.try_variant_get(v, "$", "string")


def json_text(json: Column, name: str) -> Column:
    """The value of a plain top-level key as text, without building a map."""
    return F.get_json_object(json, f"$['{name}']")


def plain_number(c: Column) -> Column:
    """A double in the shortest form without exponent: 5, 0.1, 100000000000000000000."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
    exact = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(c.isNull(), None).when(F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf").when(whole, c.try_cast("bigint").cast("string")).when(F.abs(c) < 1e18, exact).otherwise(c.try_cast("decimal(38,0)").cast("string"))


def short_number(c: Column) -> Column:
    """A double in the shortest form with an exponent below 1e-4 and from 1e21: 5, 0.1, 1e+21."""
    raw = c.cast("string")  # Spark's shortest digits, such as 1.0E21
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    e = F.substring_index(raw, "E", -1).try_cast("int")
    sign = F.when(e < 0, "-").otherwise("+")
    exponent = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(e).cast("string"), 2, "0"))
    return F.when(c.isNull(), None).when(F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf").when(c == 0, "0").when(raw.contains("E") & ((F.abs(c) < 1e-4) | (F.abs(c) >= 1e21)), exponent).otherwise(plain_number(c))


def escape_html(json: Column) -> Column:
    """<, > and & as escapes, as key JSON is written."""
    for c, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        json = F.replace(json, F.lit(c), F.lit(code))
    return json
