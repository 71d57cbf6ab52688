"""The engine's functions under SQL names, and functions of users beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: SQL functions: parameters, result, body.  They are inlined into the plans that call them.
FUNCTIONS = {
    "loom_lsn": ("n BIGINT", "STRING", "concat(hex(shiftrightunsigned(n, 32)), '/', hex(n & 4294967295))"),
    "loom_scope": ("token STRING", "STRING", "concat('auth:', substr(sha2(token, 256), 1, 16))"),
    "loom_qualified": ("s STRING, t STRING", "STRING", "CASE WHEN coalesce(s, '') = '' THEN t ELSE concat(s, '.', t) END"),
    "loom_subject_ok": ("c STRING", "BOOLEAN", r"c IS NOT NULL AND c RLIKE r'^[^\s.]+(?:\.[^\s.]+)*$'"),
}


def register(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS known to a session; their names."""
    for name, (params, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    return sorted(FUNCTIONS)


def register_user(spark: SparkSession, name: str, f: Callable, returns: str, kind: str = "scalar") -> None:
    """A user's function: `scalar` and `aggregate` get pandas Series (with type hints), `table` is a class with `eval`."""
    if name in FUNCTIONS:
        raise ValueError(f"{name} is taken")
    if kind == "table":
        spark.udtf.register(name, F.udtf(f, returnType=returns))
    elif kind in ("scalar", "aggregate"):
        spark.udf.register(name, F.pandas_udf(f, returns))
    else:
        raise ValueError(f"unknown kind {kind!r}")
