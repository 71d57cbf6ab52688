"""A change feed made from the `orders` table by plain arithmetic.

Every order is inserted with status O; if its status differs, an update follows; every tenth order
is deleted; every seventh insert arrives twice.  Positions follow from the order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import canonical_key, idempotency_key

FIELDS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _image(status: Column) -> Column:
    return F.to_json(F.struct(*[(status if f == "o_orderstatus" else F.col(f)).alias(f) for f in FIELDS]))


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events of `orders`, one row an arrival; `arrival` orders them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*FIELDS)
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    none = F.lit(None).cast("string")
    step = lambda cond, op, off, arr, b, a: F.when(cond, F.struct(F.lit(op).alias("operation"), (k * 10 + off).alias("lsn"), (k * 10 + arr).alias("arrival"), b.alias("before"), a.alias("after")))
    open_, real = _image(F.lit("O")), _image(status)
    steps = F.array(
        step(F.lit(True), "insert", 0, 0, none, open_),
        step(status != "O", "update", 3, 3, open_, real),
        step(k % 10 == 0, "delete", 7, 7, real, none),
        step(k % 7 == 0, "insert", 0, 9, none, open_),
    )
    rows = orders.select(k.alias("k"), F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s"))
    key = canonical_key({"o_orderkey": (F.col("k"), orders.schema["o_orderkey"].dataType)})
    return rows.select(
        F.col("k").alias("o_orderkey"), F.lit("feed").alias("source"), F.lit("tpch").alias("schema"), F.lit("orders").alias("table"),
        key.alias("key"), "s.*",
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("s.lsn") * 1000).alias("timestamp"),
    ).withColumn("idempotency_key", idempotency_key(F.col("source"), F.col("schema"), F.col("table"), F.col("key"), F.col("operation"), F.col("lsn"), F.lit(0)))
