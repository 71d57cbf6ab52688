"""Change streams of document stores, as rows of extended JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import cluster_position, cluster_text


def _part(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def normalised(raw: DataFrame, source: str, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(events, errors): insert, update and replace (as update), delete; anything else is an error row.

    An insert needs its full document.  Documents that cannot be read are errors too, and the
    stream goes on after them.
    """
    d = F.col(doc)
    kind = _part(d, "$.operationType")
    op = F.when(kind == "insert", "insert").when(kind.isin("update", "replace"), "update").when(kind == "delete", "delete")
    after = _part(d, "$.fullDocument")
    sec = F.coalesce(_part(d, "$.clusterTime.$timestamp.t"), _part(d, "$.clusterTime['$timestamp'].t")).cast("bigint")
    inc = F.coalesce(_part(d, "$.clusterTime.$timestamp.i"), _part(d, "$.clusterTime['$timestamp'].i")).cast("bigint")
    error = F.when(F.try_parse_json(d).isNull(), "unreadable").when(op.isNull(), F.concat(F.lit("unsupported operationType "), F.coalesce(kind, F.lit("")))).when((op == "insert") & after.isNull(), "insert without fullDocument")
    rows = raw.select(
        "*", op.alias("operation"), _part(d, "$.ns.db").alias("database"), _part(d, "$.ns.coll").alias("table"),
        _part(d, "$.documentKey").alias("key"), _part(d, "$.fullDocumentBeforeChange").alias("before"), after.alias("after"),
        sec.alias("__t"), inc.alias("__i"), _part(d, "$._id").alias("resume_token"), error.alias("error"),
    )
    good = rows.where("error is null").select(
        F.concat_ws(":", F.lit(source), F.concat_ws(".", "database", "table"), "key", "operation", cluster_text(F.col("__t"), F.col("__i"))).alias("idempotency_key"),
        F.timestamp_seconds("__t").alias("timestamp"), F.lit(source).alias("source"), "operation", "database", F.lit("").alias("schema"), "table", "key", "before", "after", "resume_token",
        cluster_position(F.col("__t"), F.col("__i")).alias("lsn"),
    )
    return good, rows.where("error is not null").select(doc, "error")


def snapshot(docs: DataFrame, source: str, database: str, collection: str, doc: str = "doc") -> DataFrame:
    """Documents of a collection as read events; those without `_id` are skipped."""
    key = F.get_json_object(doc, "$._id")
    key = F.when(F.try_parse_json(key).isNotNull() & key.startswith("{"), F.concat(F.lit('{"_id":'), key, F.lit("}"))).otherwise(F.to_json(F.struct(key.alias("_id"))))
    rows = docs.where(F.get_json_object(doc, "$._id").isNotNull())
    return rows.select(F.concat_ws(":", F.lit(source), F.lit(f"{database}.{collection}"), key, F.lit("read")).alias("idempotency_key"), F.lit(source).alias("source"), F.lit("read").alias("operation"), F.lit(database).alias("database"), F.lit("").alias("schema"), F.lit(collection).alias("table"), key.alias("key"), F.lit(None).cast("string").alias("before"), F.col(doc).alias("after")).orderBy("key")
