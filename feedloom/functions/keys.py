"""Keys, hashes and log positions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import escape_html, short_number
from .signing import hmac_sha256

PARTITIONS = 64


def canonical_value(c: Column, kind: T.DataType) -> Column:
    """A key column in the one text form that live and snapshot rows share; null stays null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return short_number(c.cast("double"))
    if isinstance(kind, T.BooleanType):
        return F.when(c, "t").when(~c, "f")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(c)))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.concat(F.regexp_replace(F.regexp_replace(whole, "0+$", ""), r"\.$", ""), F.lit("+00"))
    return c.cast("string")


def canonical_key(columns: dict[str, tuple[Column, T.DataType]]) -> Column:
    """Key JSON: sorted names, text values, nulls kept."""
    pairs = [F.struct(F.lit(n).alias("k"), canonical_value(c, t).alias("v")) for n, (c, t) in sorted(columns.items())]
    quoted = lambda s: F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2)
    parts = [F.concat(quoted(p["k"]), F.lit(":"), F.when(p["v"].isNull(), "null").otherwise(quoted(p["v"]))) for p in pairs]
    return escape_html(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def _fold(c: Column, start: Column, step) -> Column:
    """Fold step(state, byte) over the UTF-8 bytes of a text, which are made once; null stays null."""
    each = lambda b: F.aggregate(F.sequence(F.lit(1), F.octet_length(b)), start, lambda h, i: step(h, F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("bigint")))
    done = F.element_at(F.transform(F.array(F.encode(c, "UTF-8")), each), 1)
    return F.when(F.octet_length(c) > 0, done).when(c.isNotNull(), start)


def fnv32(c: Column) -> Column:
    """FNV-1a, 32 bits, as bigint."""
    return _fold(c, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")))


def partition_of(key: Column, n: int = PARTITIONS) -> Column:
    return (fnv32(key) % n).cast("int")


def fnv64_hex(c: Column) -> Column:
    """FNV-1a, 64 bits, as hex.

    The product is taken in two halves of 32 bits so that nothing overflows: with h = hi * 2**32
    + lo and the prime 2**40 + 435, the low half is lo * 435 and the high half hi * 435 + lo * 256
    plus the carry.
    """
    m32 = F.lit(4294967295).cast("bigint")

    def step(s: Column, b: Column) -> Column:
        lo = s["lo"].bitwiseXOR(b)
        low = lo * F.lit(435).cast("bigint")
        high = s["hi"] * F.lit(435).cast("bigint") + lo * F.lit(256).cast("bigint") + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(m32).alias("hi"), low.bitwiseAND(m32).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    shown = lambda out: F.lower(F.concat(F.lpad(F.hex(out["hi"]), 8, "0"), F.lpad(F.hex(out["lo"]), 8, "0")))
    return F.element_at(F.transform(F.array(_fold(c, start, step)), shown), 1)


def lsn_number(c: Column) -> Column:
    """`X/Y` in hex as a number; null if it cannot be read."""
    ok = c.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")
    part = lambda i: F.conv(F.split_part(c, F.lit("/"), F.lit(i)), 16, 10).cast("bigint")
    return F.when(ok, part(1) * F.lit(1 << 32) + part(2))


def lsn_text(c: Column) -> Column:
    return F.concat(F.hex(F.shiftrightunsigned(c, 32)), F.lit("/"), F.hex(c.bitwiseAND(F.lit(4294967295).cast("bigint"))))


def cluster_position(seconds: Column, ordinal: Column) -> Column:
    """A document store's cluster time as one number."""
    return F.shiftleft(seconds.cast("bigint"), 32) + ordinal


def cluster_text(seconds: Column, ordinal: Column) -> Column:
    return F.concat(F.lpad(F.hex(seconds), 8, "0"), F.lpad(F.hex(ordinal), 8, "0"))


def idempotency_key(source: Column, schema: Column, table: Column, key: Column, op: Column, lsn: Column, change: Column) -> Column:
    return F.concat_ws(":", source, F.concat_ws(".", schema, table), key, op, lsn_text(lsn), change.cast("string"))


def snapshot_key(source: Column, schema: Column, table: Column, key: Column, snapshot: Column) -> Column:
    return F.concat_ws(":", source, qualified(schema, table), key, F.lit("read"), snapshot)


def qualified(schema: Column, table: Column) -> Column:
    return F.when(F.coalesce(schema, F.lit("")) == "", table).otherwise(F.concat(schema, F.lit("."), table))


def unqualified(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def vector_id(schema: Column, table: Column, key: Column) -> Column:
    return F.concat(qualified(F.trim(schema), F.trim(table)), F.lit(":"), key)


def dedup_id(c: Column) -> Column:
    return F.sha2(c, 256)


def scope_id(token: Column) -> Column:
    """A bearer's scope: the first eight bytes of the token's hash."""
    return F.concat(F.lit("auth:"), F.substr(F.sha2(token, 256), F.lit(1), F.lit(16)))


#: Fixed value: the namespace that point ids of stored vectors are derived in.
POINTS = uuid.UUID("a1b2c3d4-e5f6-7890-abcd-ef1234567890")


def uuid5(c: Column, namespace: uuid.UUID = POINTS) -> Column:
    """A name-based UUID (version 5)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(c, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substr(h, F.lit(17), F.lit(2)), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    at = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("5"), at(14, 3)), F.concat(variant, at(19, 2)), at(21, 12))


def signature(secret: str, unix: Column, body: Column) -> Column:
    """`t=<unix>,v1=<HMAC-SHA256 of t.body>`; null without a secret."""
    if not secret:
        return F.lit(None).cast("string")
    t = unix.cast("bigint").cast("string")
    return F.concat(F.lit("t="), t, F.lit(",v1="), hmac_sha256(secret.encode(), F.concat(t, F.lit("."), body)))
