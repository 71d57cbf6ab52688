"""Connected components of an edge table, by alternating large and small stars.

Every round hooks each node's larger neighbours to its smallest one, then each node and
its smaller neighbours to the smallest.  Rounds grow with the logarithm of the graph and
end when the edges no longer change.  Edges stay in tables all the time; each round is
written to the shared folder.  A hub's edges are thin rows in a join that adaptive
execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) for every node of an edge; label: the smallest node of its component.

    Null ends and loops are ignored; repeated edges do no harm; no edges give no rows.
    """
    a, b = F.col(u), F.col(v)
    e = saved(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that a hub's edges can be split in the join
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = saved(small.where("u != v").distinct(), "edges")
        now = _state(e)
        if now == before:
            break
        before = now
    labels = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labels.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
