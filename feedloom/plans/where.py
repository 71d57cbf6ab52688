"""The row predicate language, compiled to Columns.

OR < AND < NOT < primary; =, !=, >, <, >=, <=, IS [NOT] NULL, IN (...), parentheses.  Keywords are
case-insensitive; strings stand in single quotes without escapes; numbers are -?[0-9][0-9.]*;
identifiers may hold dots, and `before.x` / `after.x` choose an image (a bare name means `after`,
else `before`).  The rest of a dotted name is one key.  Anything else is rejected when compiled.

Logic has two values.  Null or missing fields compare as "", a comparison against an image that
is absent is false, and if both sides look like numbers they compare as numbers.  Two absent images
match everything.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import json_text, plain_number, variant_map

TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*')|(?P<num>-?[0-9][0-9.]*)|(?P<id>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>!=|>=|<=|=|>|<|\(|\)|,))")
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"
REJECTED = {"BETWEEN", "LIKE", "ILIKE", "CASE", "SELECT", "FROM", "JOIN", "EXISTS", "ANY", "ALL", "CAST", "HAVING", "GROUP", "ORDER", "LIMIT", "UNION", "WITH"}


class WhereError(ValueError):
    """The expression is outside the language."""


@dataclass(frozen=True)
class Name:
    side: str | None
    key: str


@dataclass(frozen=True)
class Literal:
    value: str | None  # None is NULL
    number: bool = False


@dataclass(frozen=True)
class Compare:
    name: Name
    op: str
    value: Literal


@dataclass(frozen=True)
class IsNull:
    name: Name
    negated: bool


@dataclass(frozen=True)
class In:
    name: Name
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class Both:
    op: str
    items: tuple


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise WhereError(f"unexpected character at {at}: {text[at : at + 10]!r}")
        kind = m.lastgroup
        value = m[kind]
        if kind == "id" and value.upper() in REJECTED:
            raise WhereError(f"{value} is not supported")
        if kind == "num" and value.count(".") > 1:
            raise WhereError(f"bad number {value}")
        out.append((kind, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.t, self.i = _tokens(text), 0

    def peek(self, *words: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][0] in ("id", "op") and self.t[self.i][1].upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise WhereError(f"{word} expected at token {self.i}")

    def any_of(self):
        items = [self.all_of()]
        while self.take("OR"):
            items.append(self.all_of())
        return items[0] if len(items) == 1 else Both("or", tuple(items))

    def all_of(self):
        items = [self.negated()]
        while self.take("AND"):
            items.append(self.negated())
        return items[0] if len(items) == 1 else Both("and", tuple(items))

    def negated(self):
        return Not(self.negated()) if self.take("NOT") else self.primary()

    def primary(self):
        if self.take("("):
            item = self.any_of()
            self.need(")")
            return item
        if self.i >= len(self.t) or self.t[self.i][0] != "id" or self.peek("AND", "OR", "IN", "IS", "NULL"):
            raise WhereError(f"a column expected at token {self.i}")
        raw = self.t[self.i][1]
        self.i += 1
        side, dot, key = raw.partition(".")
        name = Name(side, key) if dot and side in ("before", "after") else Name(None, raw)
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return IsNull(name, negated)
        if self.take("IN"):
            self.need("(")
            values = [self.literal()]
            while self.take(","):
                values.append(self.literal())
            self.need(")")
            return In(name, tuple(values))
        if self.i < len(self.t) and self.t[self.i][1] in ("=", "!=", ">", "<", ">=", "<="):
            op = self.t[self.i][1]
            self.i += 1
            return Compare(name, op, self.literal())
        raise WhereError(f"an operator expected after {raw}")

    def literal(self) -> Literal:
        if self.i >= len(self.t):
            raise WhereError("a value expected at the end")
        kind, value = self.t[self.i]
        self.i += 1
        if kind == "str":
            return Literal(value[1:-1])
        if kind == "num":
            return Literal(value, True)
        if kind == "id" and value.upper() == "NULL":
            return Literal(None)
        if kind == "id" and value.upper() in ("TRUE", "FALSE"):
            return Literal(value.lower())
        raise WhereError(f"a value expected, not {value}")


def parse(text: str):
    """The syntax tree; None for an empty expression."""
    if not text.strip():
        return None
    p = _Parser(text)
    tree = p.any_of()
    if p.i != len(p.t):
        raise WhereError(f"unexpected {p.t[p.i][1]!r}")
    return tree


@dataclass(frozen=True)
class Value:
    """A field of an image: whether the image is there, its text as it stands, its plain form and its number.

    The last two are made when asked for: a comparison with a number needs no plain form, since what is
    no number compares as it stands.
    """

    present: Column
    is_null: Column
    raw: Column
    text: Callable[[], Column]
    number: Callable[[], Column]


#: Gives the Value of a key in one image.
Images = Callable[[str, str], Value]


def _number(s: Column) -> Column:
    return F.when(s.rlike(NUMBER), s).try_cast("double")


def json_images(before: Column, after: Column) -> Images:
    """Images that are JSON objects in two text columns."""
    raw = {"before": before, "after": after}

    def get(side: str, key: str) -> Value:
        t = json_text(raw[side], key)  # the text of any value; null for a missing key and for null

        def shown() -> Column:
            # a numeric text may be a string, compared as it is, or a number, compared in its plain form
            v = F.try_element_at(variant_map(raw[side]), F.lit(key))
            kind = F.schema_of_variant(v)
            plain = F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), plain_number(F.try_variant_get(v, "$", "double"))).otherwise(t)
            return F.when(t.isNull(), "").when(t.rlike(NUMBER), plain).otherwise(t)

        return Value(raw[side].isNotNull() & (raw[side] != "null"), t.isNull(), t, shown, lambda: _number(t))

    return get


def typed_images(before: dict[str, Column], after: dict[str, Column], has_before: Column, has_after: Column, numbers: frozenset[str] = frozenset()) -> Images:
    """Images whose fields are columns already; fields in `numbers` are numeric."""

    def get(side: str, key: str) -> Value:
        fields, there = (before, has_before) if side == "before" else (after, has_after)
        c = fields.get(key, F.lit(None).cast("string"))
        if key in numbers:
            d = c.cast("double")
            return Value(there, c.isNull(), plain_number(d), lambda: F.coalesce(plain_number(d), F.lit("")), lambda: d)
        s = c.cast("string")
        return Value(there, c.isNull(), s, lambda: F.coalesce(s, F.lit("")), lambda: _number(s))

    return get


def _pick(images: Images, name: Name) -> Value:
    if name.side:
        return images(name.side, name.key)
    a, b = images("after", name.key), images("before", name.key)
    use = lambda x, y: F.when(a.present, x).otherwise(y)
    return Value(a.present | b.present, use(a.is_null, b.is_null), use(a.raw, b.raw), lambda: use(a.text(), b.text()), lambda: use(a.number(), b.number()))


def _compare(v: Value, op: str, value: Literal) -> Column:
    s = F.lit(value.value if value.value is not None else "")
    by = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}[op]
    if value.value is not None and re.search(NUMBER, value.value):
        x = float(value.value)
        n = v.number()
        if x != x:  # nothing equals or orders with NaN
            as_number = F.when(n.isNotNull(), F.lit(op == "!="))
        elif op in (">", ">="):  # NaN is no larger than anything
            as_number = by(n, F.lit(x)) & (n <= float("inf"))
        else:
            as_number = by(n, F.lit(x))
        return F.coalesce(v.present & F.coalesce(as_number, by(F.coalesce(v.raw, F.lit("")), s)), F.lit(False))
    return F.coalesce(v.present & by(v.text(), s), F.lit(False))


def to_column(tree, images: Images) -> Column:
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Both):
        items = [to_column(x, images) for x in tree.items]
        out = items[0]
        for x in items[1:]:
            out = (out | x) if tree.op == "or" else (out & x)
        return out
    if isinstance(tree, Not):
        return ~to_column(tree.item, images)
    v = _pick(images, tree.name)
    if isinstance(tree, IsNull):
        null = F.coalesce(~v.present | v.is_null, F.lit(True))
        return ~null if tree.negated else null
    if isinstance(tree, In):
        out = F.lit(False)
        for x in tree.values:
            out = out | _compare(v, "=", x)
        return out
    return _compare(v, tree.op, tree.value)


def where(expression: str, before: Column | None = None, after: Column | None = None, images: Images | None = None) -> Column:
    """Compile `expression`; raises WhereError at once if it is outside the language."""
    tree = parse(expression)
    b = F.col("before") if before is None else before
    a = F.col("after") if after is None else after
    if images is not None:
        return to_column(tree, images)
    absent = lambda c: c.isNull() | (c == "null")
    return F.when(absent(b) & absent(a), F.lit(True)).otherwise(to_column(tree, json_images(b, a)))


def malformed(before: Column | None = None, after: Column | None = None) -> Column:
    """Rows whose images are not JSON objects: for the dead-letter branch."""
    bad = lambda c: c.isNotNull() & (c != "null") & variant_map(c).isNull()
    return bad(F.col("before") if before is None else before) | bad(F.col("after") if after is None else after)


def branches(events: DataFrame, expression: str) -> tuple[DataFrame, DataFrame]:
    """Events that match, and those for the dead-letter branch, whose images cannot be read."""
    dead = malformed()
    return events.where(~dead & where(expression)), events.where(dead).withColumn("reason", F.lit("malformed image"))
