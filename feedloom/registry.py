"""All registered queries of the change-data engine, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from . import queries_actions, queries_capture, queries_filter, queries_output, queries_views  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed, keys, partitions, first arrivals, a route with a predicate, a projection."""
    return queries()["q_route_project"](spark, sf_dir)


#: The order feed as SQL, with typed columns for its images.
FEED = """
feed as (
    select o_orderkey as k, s.op, o_orderkey * 10 + s.off as lsn, o_orderkey * 10 + s.arr as arrival, o_custkey, o_totalprice, o_orderpriority,
           case when s.op = 'insert' then 'O' when s.op = 'update' then o_orderstatus end as a_status,
           case when s.op = 'update' then 'O' when s.op = 'delete' then o_orderstatus end as b_status,
           '{"o_orderkey":"' || o_orderkey || '"}' as key
    from orders, (values ('insert', 0, 0), ('update', 3, 3), ('delete', 7, 7), ('insert', 0, 9)) as s(op, off, arr)
    where s.arr = 0 or (s.arr = 3 and o_orderstatus <> 'O') or (s.arr = 7 and o_orderkey % 10 = 0) or (s.arr = 9 and o_orderkey % 7 = 0)
), log as (
    select * from feed where arrival % 10 <> 9
)"""

#: Of an event of the feed: its idempotency key, and its JSON as sinks send it.
IDK = "('feed:tpch.orders:' || key || ':' || op || ':' || upper(to_base(lsn >> 32, 16)) || '/' || upper(to_base(lsn & 4294967295, 16)) || ':0')"


def _image(status: str) -> str:
    price = "case when o_totalprice = floor(o_totalprice) then cast(cast(o_totalprice as bigint) as varchar) else cast(o_totalprice as varchar) end"
    return f"""coalesce('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || k || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || {status} || '","o_totalprice":' || {price} || '}}', 'null')"""


_TIME = "strftime(make_timestamp(1700000000000000 + lsn * 1000), '%Y-%m-%dT%H:%M:%S.%g')"
EVENT = f"""('{{"idempotency_key":"' || replace({IDK}, '"', chr(92) || '"') || '","timestamp":"' || {_TIME} || 'Z","source":"feed","operation":"' || op || '","schema":"tpch","table":"orders","key":' || key || ',"before":' || {_image("b_status")} || ',"after":' || {_image("a_status")} || '}}')"""


def uuid5_sql(name: str, namespace: str) -> str:
    """A name-based UUID in SQL; `name` is an expression without duplicates to fear."""
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    variant = f"lower(to_base((cast('0x' || substr({h}, 17, 2) as integer) & 63) | 128, 16))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 19, 2) || '-' || substr({h}, 21, 12)"


#: FNV-1a of 64 bits, as hex, of a text of ASCII characters.
_FNV64 = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i, 1))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) & 18446744073709551615::HUGEINT)"
FNV64 = f"lower(lpad(to_base(cast({_FNV64} // 4294967296 as bigint), 16), 8, '0') || lpad(to_base(cast({_FNV64} % 4294967296 as bigint), 16), 8, '0'))"

FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i, 1))::UBIGINT)), lambda h, b: (xor(h, b) * 16777619::UBIGINT) & 4294967295::UBIGINT)"
