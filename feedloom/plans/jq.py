"""A subset of jq, compiled to Columns; anything else is rejected when compiled.

Paths (.a, .a.b, .["x"], .[0], .[-1], .[1:3], .a?), object and array construction, literals,
if/elif/else, and, or, not, comparisons, + - * / %, //, pipes, and the functions in FUNCTIONS.  An
expression gives one value: null or `empty` drops the event.  What gives several (.[], range) stands
inside [ ], where it is collected; elsewhere it is outside the subset.  flatten goes four levels deep.

A value is JSON text, null for JSON null: numbers keep all their digits.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import plain_number, variant_map

TOKEN = re.compile(r'\s*(?:(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>[0-9]+(?:\.[0-9]+)?)|(?P<word>[A-Za-z_@][A-Za-z0-9_]*)|(?P<op>//|==|!=|<=|>=|[-+*/%<>|.,:;()\[\]{}?]))')
KEYWORDS = {"if", "then", "elif", "else", "end", "and", "or"}
FUNCTIONS = {"tostring", "tojson", "fromjson", "tonumber", "not", "length", "ascii_downcase", "ascii_upcase", "floor", "sqrt", "type", "keys", "has", "startswith", "endswith", "ltrimstr", "rtrimstr", "split", "join", "select", "empty", "test", "contains", "todate", "fromdateiso8601"} | {
    "map", "add", "any", "all", "min", "max", "sort", "unique", "reverse", "first", "last", "range", "flatten", "del", "to_entries", "from_entries", "with_entries", "error", "pow", "sub", "gsub",
    "ceil", "round", "fabs", "now", "strftime", "@base64", "@base64d", "@uri", "@csv", "@json", "@text",
}


class JqError(ValueError):
    """Outside the subset."""


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise JqError(f"unexpected {text[at : at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    LEVELS = (("//",), ("or",), ("and",), ("==", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))

    def __init__(self, text: str):
        self.t, self.i = _lex(text), 0

    def at(self, *values: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][0] != "str" and self.t[self.i][1] in values

    def take(self, *values: str) -> str | None:
        if self.at(*values):
            self.i += 1
            return self.t[self.i - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise JqError(f"{value!r} expected")

    def pipe(self) -> Node:
        left = self.level(0)
        while self.take("|"):
            left = Node("pipe", (left, self.level(0)))
        return left

    def level(self, n: int) -> Node:
        if n == len(self.LEVELS):
            return self.postfix()
        left = self.level(n + 1)
        while op := self.take(*self.LEVELS[n]):
            left = Node("op", (op, left, self.level(n + 1)))
        return left

    def postfix(self) -> Node:
        node = self.term()
        while True:
            if self.at("."):
                self.i += 1
                node = self.path(node)
            elif self.at("["):
                node = self.index(node)
            elif self.take("?"):
                pass
            else:
                return node

    def path(self, base: Node) -> Node:
        if self.at("["):
            return self.index(base)
        if self.i < len(self.t) and self.t[self.i][0] in ("word", "str"):
            kind, v = self.t[self.i]
            self.i += 1
            return Node("get", (base, json.loads(v) if kind == "str" else v))
        return base

    def index(self, base: Node) -> Node:
        self.need("[")
        if self.take("]"):
            return Node("each", (base,))
        low, high = self.whole(), None
        if self.take(":"):
            high = self.whole()
            self.need("]")
            if low is None and high is None:
                raise JqError("a slice needs a bound")
            return Node("slice", (base, low, high))
        if low is not None:
            self.need("]")
            return Node("get", (base, low))
        if self.i < len(self.t) and self.t[self.i][0] == "str":
            key = json.loads(self.t[self.i][1])
        else:
            raise JqError("only literal keys and indexes")
        self.i += 1
        self.need("]")
        return Node("get", (base, key))

    def whole(self) -> int | None:
        """A whole number, with a sign if it has one, or nothing."""
        sign = -1 if self.at("-") else 1
        at = self.i + (sign < 0)
        if at < len(self.t) and self.t[at][0] == "num" and self.t[at][1].isdigit():
            self.i = at + 1
            return sign * int(self.t[at][1])
        return None

    def term(self) -> Node:
        if self.i >= len(self.t):
            raise JqError("unexpected end")
        kind, v = self.t[self.i]
        self.i += 1
        if kind == "str":
            if "\\(" in v:
                raise JqError("string interpolation")
            return Node("lit", (json.loads(v),))
        if kind == "num":
            return Node("lit", (json.loads(v),))
        if v == "-" and self.i < len(self.t) and self.t[self.i][0] == "num":
            self.i += 1
            return Node("lit", (-json.loads(self.t[self.i - 1][1]),))
        if v == ".":
            return self.path(Node("self", ()))
        if v == "(":
            node = self.pipe()
            self.need(")")
            return node
        if v == "[":
            items = []
            while not self.take("]"):
                items.append(self.pipe_item())
                if not self.at("]"):
                    self.need(",")
            return Node("array", tuple(items))
        if v == "{":
            return self.object()
        if v == "if":
            return self.branch()
        if kind == "word" and v in ("null", "true", "false"):
            return Node("lit", (json.loads(v),))
        if kind == "word" and v in FUNCTIONS:
            args = []
            if self.take("("):
                args.append(self.pipe())
                while self.take(";"):
                    args.append(self.pipe())
                self.need(")")
            return Node("call", (v, *args))
        raise JqError(f"{v!r} is not supported")

    def pipe_item(self) -> Node:
        left = self.level(0)
        while self.take("|"):
            left = Node("pipe", (left, self.level(0)))
        return left

    def object(self) -> Node:
        items = []
        while not self.take("}"):
            kind, v = self.t[self.i]
            self.i += 1
            if kind not in ("word", "str"):
                raise JqError("only literal keys")
            key = json.loads(v) if kind == "str" else v
            items.append((key, self.level(0) if self.take(":") else Node("get", (Node("self", ()), key))))
            if not self.at("}"):
                self.need(",")
        return Node("object", tuple(items))

    def branch(self) -> Node:
        cond = self.pipe()
        self.need("then")
        yes = self.pipe()
        if self.take("elif"):
            return Node("if", (cond, yes, self.branch()))
        no = self.pipe() if self.take("else") else Node("self", ())
        self.need("end")
        return Node("if", (cond, yes, no))


def parse(text: str) -> Node:
    p = _Parser(text)
    node = p.pipe()
    if p.i != len(p.t):
        raise JqError(f"unexpected {p.t[p.i][1]!r}")
    _check(node, False)
    return node


def _check(n, collected: bool) -> None:
    """Several values may come only where [ ] collects them."""
    if isinstance(n, tuple):
        for x in n:
            _check(x, False)
    elif isinstance(n, Node):
        if (n.kind == "each" or n.kind == "call" and n.args[0] == "range") and not collected:
            raise JqError("several values outside [ ]")
        keeps = n.kind == "array" or collected and n.kind in ("pipe", "get", "each")
        for x in n.args:
            _check(x, keeps)


def _kind(c: Column) -> Column:
    f = F.substr(c, F.lit(1), F.lit(1))
    return F.when(c.isNull() | (c == "null"), "null").when(f == '"', "string").when(f == "{", "object").when(f == "[", "array").when(f.isin("t", "f"), "boolean").otherwise("number")


def _rank(c: Column) -> Column:
    k = _kind(c)
    return F.when(k == "null", 0).when(c == "false", 1).when(c == "true", 2).when(k == "number", 3).when(k == "string", 4).when(k == "array", 5).otherwise(6)


def _text(c: Column) -> Column:
    """A JSON string's text."""
    return F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")


def _string(c: Column) -> Column:
    """Text as a JSON string."""
    j = F.to_json(F.array(c))
    return F.substr(j, F.lit(2), F.length(j) - 2)


def _number(c: Column) -> Column:
    return F.when(_kind(c) == "number", c.try_cast("double"))


def _true(c: Column) -> Column:
    return F.coalesce(c != "false", F.lit(False)) & F.coalesce(c != "null", F.lit(False))


def _bool(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def _null(c: Column) -> Column:
    return F.coalesce(c, F.lit("null"))


def _let(values: list[Column], f) -> Column:
    """f of the values, each evaluated once: expressions stay as long as their source text."""
    names = [f"v{i}" for i in range(len(values))]
    bound = F.array(F.struct(*[c.cast("string").alias(n) for n, c in zip(names, values)]))
    return F.get(F.transform(bound, lambda s: f(*[s[n] for n in names]).cast("string")), F.lit(0))


def _items(c: Column) -> Column:
    """array<string>: the elements of a JSON array; null for anything else."""
    return F.transform(F.try_variant_get(F.try_parse_json(c), "$", "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _drops(n) -> bool:
    """Whether an expression may give nothing, so that its null is no value."""
    return isinstance(n, Node) and (n.kind == "call" and n.args[0] in ("select", "empty") or any(map(_drops, n.args))) or isinstance(n, tuple) and any(map(_drops, n))


def _mapped(items: Column, n: Node) -> Column:
    """An expression over every element."""
    got = F.transform(items, lambda x: compile_node(n, F.nullif(x, F.lit("null"))))
    return F.filter(got, lambda x: x.isNotNull()) if _drops(n) else F.transform(got, _null)


def _several(n: Node, v: Column) -> Column | None:
    """array<string> of the values of an expression that gives several; None if it gives one."""
    if n.kind == "each":
        return _items(compile_node(n.args[0], v))
    if n.kind == "call" and n.args[0] == "range":
        ends = [_number(compile_node(a, v)).cast("bigint") for a in n.args[1:]]
        low, high = (F.lit(0).cast("bigint"), ends[0]) if len(ends) == 1 else ends[:2]
        return F.when(high > low, F.transform(F.sequence(low, F.greatest(low, high - 1)), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    if n.kind == "pipe":
        left = _several(n.args[0], v)
        if left is None:
            return _several(n.args[1], compile_node(n.args[0], v))
        if _several(n.args[1], F.lit("null")) is not None:
            return F.flatten(F.transform(left, lambda x: _several(n.args[1], x)))
        return _mapped(left, n.args[1])
    if n.kind == "get":
        left = _several(n.args[0], v)
        return None if left is None else _mapped(left, Node("get", (Node("self", ()), n.args[1])))
    return None


def compile_node(n: Node, v: Column) -> Column:
    if n.kind == "slice":
        return _let([compile_node(n.args[0], v)], lambda x: _slice(x, n.args[1], n.args[2]))
    if n.kind == "self":
        return v
    if n.kind == "lit":
        return F.lit(None if n.args[0] is None else json.dumps(n.args[0], ensure_ascii=False)).cast("string")
    if n.kind == "get":
        base, key = compile_node(n.args[0], v), n.args[1]
        if isinstance(key, int) and key < 0:
            return F.nullif(F.try_element_at(_items(base), F.lit(key)), F.lit("null"))
        path = f"$[{key}]" if isinstance(key, int) else "$['" + key.replace("'", "\\'") + "']"
        return F.nullif(F.to_json(F.try_variant_get(F.try_parse_json(base), path, "variant")), F.lit("null"))
    if n.kind == "pipe":
        return _let([compile_node(n.args[0], v)], lambda x: compile_node(n.args[1], x))
    if n.kind == "array":
        parts = [(_several(x, v), x) for x in n.args]
        if any(many is not None for many, _ in parts):
            return _list(F.concat(*[many if many is not None else F.array(_null(compile_node(x, v))) for many, x in parts]))
        return F.concat(F.lit("["), F.concat_ws(",", *[_null(compile_node(x, v)) for _, x in parts]), F.lit("]"))
    if n.kind == "object":
        return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), _null(compile_node(x, v))) for k, x in n.args]), F.lit("}"))
    if n.kind == "if":
        return F.when(_true(compile_node(n.args[0], v)), compile_node(n.args[1], v)).otherwise(compile_node(n.args[2], v))
    if n.kind == "op":
        return _let([compile_node(n.args[1], v), compile_node(n.args[2], v)], lambda a, b: _operator(n.args[0], a, b))
    return _call(n.args[0], n.args[1:], v)


def _operator(op: str, a: Column, b: Column) -> Column:
    if op == "//":
        return F.when(_true(a), a).otherwise(b)
    if op == "and":
        return _bool(_true(a) & _true(b))
    if op == "or":
        return _bool(_true(a) | _true(b))
    x, y = _number(a), _number(b)
    if op in ("==", "!="):
        same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(_null(a) == _null(b))
        return _bool(same if op == "==" else ~same)
    if op in ("<", "<=", ">", ">="):
        r, s = _rank(a), _rank(b)
        less = F.when(r != s, r < s).when(r == 3, x < y).when(r == 4, _text(a) < _text(b)).otherwise(F.lit(False))
        same = (r == s) & F.when(r == 3, x == y).otherwise(_null(a) == _null(b))
        return _bool({"<": less, "<=": less | same, ">": ~(less | same), ">=": ~less}[op])
    if op == "+":
        whole = a.rlike("^-?[0-9]+$") & b.rlike("^-?[0-9]+$")
        exact = (a.try_cast("decimal(38,0)") + b.try_cast("decimal(38,0)")).cast("string")
        ka, kb = _kind(a), _kind(b)
        return F.when(ka == "null", b).when(kb == "null", a).when(whole, exact).when((ka == "number") & (kb == "number"), plain_number(x + y)).when((ka == "string") & (kb == "string"), F.concat(F.substr(a, F.lit(1), F.length(a) - 1), F.substr(b, F.lit(2), F.length(b)))).otherwise(F.raise_error(F.lit("cannot add")))
    return plain_number({"-": x - y, "*": x * y, "/": F.try_divide(x, y), "%": F.try_mod(x.try_cast("bigint"), y.try_cast("bigint")).cast("double")}[op])


def _call(name: str, args: tuple, v: Column) -> Column:
    if name == "empty":
        return F.lit(None).cast("string")
    if name == "select":
        return F.when(_true(compile_node(args[0], v)), v)
    if name in LISTS:
        return _let([v], lambda x: _list_call(name, args, x))
    arg = [compile_node(a, v) for a in args]
    t = _text(v)
    k = _kind(v)
    table = {
        "tostring": lambda: F.when(k == "string", v).otherwise(_string(_null(v))),
        "tojson": lambda: _string(_null(v)),
        "fromjson": lambda: F.nullif(F.to_json(F.try_parse_json(t)), F.lit("null")),
        "tonumber": lambda: F.when(k == "number", v).otherwise(plain_number(t.try_cast("double"))),
        "not": lambda: _bool(~_true(v)),
        "length": lambda: F.when(k == "null", "0").when(k == "string", F.char_length(t).cast("string")).when(k == "array", F.json_array_length(v).cast("string")).when(k == "object", F.size(F.json_object_keys(v)).cast("string")),
        "ascii_downcase": lambda: _string(F.lower(t)),
        "ascii_upcase": lambda: _string(F.upper(t)),
        "floor": lambda: plain_number(F.floor(_number(v)).cast("double")),
        "sqrt": lambda: plain_number(F.sqrt(_number(v))),
        "type": lambda: _string(k),
        "keys": lambda: F.to_json(F.array_sort(F.json_object_keys(v))),
        "has": lambda: _bool(F.array_contains(F.json_object_keys(v), _text(arg[0]))),
        "startswith": lambda: _bool(t.startswith(_text(arg[0]))),
        "endswith": lambda: _bool(t.endswith(_text(arg[0]))),
        "ltrimstr": lambda: F.when(t.startswith(_text(arg[0])), _string(F.substr(t, F.length(_text(arg[0])) + 1))).otherwise(v),
        "rtrimstr": lambda: F.when(t.endswith(_text(arg[0])), _string(F.substr(t, F.lit(1), F.length(t) - F.length(_text(arg[0]))))).otherwise(v),
        "split": lambda: F.to_json(F.split(t, F.concat(F.lit("\\Q"), _text(arg[0]), F.lit("\\E")))),
        "join": lambda: _string(F.array_join(F.from_json(v, "array<string>"), ",") if not args else F.array_join(F.from_json(v, "array<string>"), _literal(args[0]))),
        "test": lambda: _bool(F.rlike(t, _text(arg[0]))),
        "contains": lambda: _bool(F.when(k == "array", F.forall(_items(arg[0]), lambda y: F.exists(_items(v), lambda x: (x == y) | F.coalesce((_kind(x) == "string") & (_kind(y) == "string") & _text(x).contains(_text(y)), F.lit(False))))).when(k == "string", t.contains(_text(arg[0]))).otherwise(_null(v) == _null(arg[0]))),
        "error": lambda: F.raise_error(_text(arg[0]) if arg else F.coalesce(t, _null(v))),
        "pow": lambda: plain_number(F.pow(_number(arg[0]), _number(arg[1]))),
        "ceil": lambda: plain_number(F.ceil(_number(v)).cast("double")),
        "round": lambda: plain_number(F.when(_number(v) < 0, -F.floor(-_number(v) + 0.5)).otherwise(F.floor(_number(v) + 0.5)).cast("double")),
        "fabs": lambda: plain_number(F.abs(_number(v))),
        "sub": lambda: _sub(t, _text(arg[0]), _text(arg[1])),
        "gsub": lambda: _string(F.regexp_replace(t, _text(arg[0]), F.replace(F.replace(_text(arg[1]), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))),
        "now": lambda: plain_number(F.unix_micros(F.current_timestamp()) / 1e6),
        "strftime": lambda: _string(F.date_format(F.timestamp_seconds(_number(v)), _pattern(_literal(args[0])))),
        "@base64": lambda: _string(F.base64(F.encode(F.coalesce(t, _null(v)), "UTF-8"))),
        "@base64d": lambda: _string(F.decode(F.unbase64(t), "UTF-8")),
        "@uri": lambda: _string(F.replace(F.replace(F.replace(F.url_encode(F.coalesce(t, _null(v))), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))),
        "@csv": lambda: _string(F.array_join(F.transform(_items(v), lambda x: F.when(_kind(x) == "string", F.concat(F.lit('"'), F.replace(_text(x), F.lit('"'), F.lit('""')), F.lit('"'))).when(x == "null", "").otherwise(x)), ",")),
        "@json": lambda: _string(_null(v)),
        "@text": lambda: F.when(k == "string", v).otherwise(_string(_null(v))),
        "todate": lambda: _string(F.date_format(F.timestamp_seconds(_number(v)), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "fromdateiso8601": lambda: F.unix_seconds(t.try_cast("timestamp")).cast("string"),
    }
    return table[name]()


#: Functions of arrays and objects.
LISTS = {"map", "add", "any", "all", "min", "max", "sort", "unique", "reverse", "first", "last", "flatten", "del", "to_entries", "from_entries", "with_entries"}


def _slice(v: Column, low: int | None, high: int | None) -> Column:
    """From `low` to before `high`, negative ones from the end, of an array or a string."""
    t, items = _text(v), _items(v)
    n = F.when(_kind(v) == "string", F.char_length(t)).otherwise(F.size(items))
    place = lambda i, none: none if i is None else F.least(n, F.lit(i)) if i >= 0 else F.greatest(F.lit(0), n + i)
    a, b = place(low, F.lit(0)), place(high, n)
    size = F.greatest(F.lit(0), b - a)
    return F.when(_kind(v) == "string", _string(F.substr(t, a + 1, size))).when(_kind(v) == "array", _list(F.slice(items, a + 1, size)))


def _sub(t: Column, pattern: Column, by: Column) -> Column:
    """The first match replaced."""
    at, m = F.regexp_instr(t, pattern), F.regexp_substr(t, pattern)
    return _string(F.when(at > 0, F.concat(F.substr(t, F.lit(1), at - 1), by, F.substr(t, at + F.char_length(m)))).otherwise(t))


#: Letters of strftime and of Spark's patterns.
TIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "Z": "'UTC'"}


def _pattern(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        if text[i] == "%" and text[i + 1 : i + 2] in TIME:
            out.append(TIME[text[i + 1]])
            i += 2
        elif text[i] == "%":
            raise JqError(f"{text[i : i + 2]!r} is not supported")
        else:
            out.append("'" + text[i].replace("'", "''") + "'" if text[i].isalpha() or text[i] == "'" else text[i])
            i += 1
    return "".join(out)


def _below(a: Column, b: Column) -> Column:
    return _operator("<", F.nullif(a, F.lit("null")), F.nullif(b, F.lit("null"))) == "true"


def _list_call(name: str, args: tuple, v: Column) -> Column:
    items = _items(v)
    none = F.lit(None).cast("string")
    if name == "map":
        return _list(_mapped(items, args[0]))
    if name in ("any", "all"):
        test = (lambda x: _true(compile_node(args[0], F.nullif(x, F.lit("null"))))) if args else _true
        return _bool(F.exists(items, test) if name == "any" else F.forall(items, test))
    if name == "add":
        return F.aggregate(items, none, lambda a, x: _operator("+", a, F.nullif(x, F.lit("null"))).cast("string"))
    if name in ("sort", "unique", "min", "max"):
        order = F.array_sort(items, lambda a, b: F.when(_below(a, b), -1).when(_below(b, a), 1).otherwise(0))
        if name in ("sort", "unique"):
            return _list(order if name == "sort" else F.array_distinct(order))
        return F.nullif(F.try_element_at(order, F.lit(1 if name == "min" else -1)), F.lit("null"))
    if name in ("first", "last"):
        if args:
            raise JqError(f"{name} has no argument here")
        return F.nullif(F.try_element_at(items, F.lit(1 if name == "first" else -1)), F.lit("null"))
    if name == "reverse":
        return _list(F.reverse(items))
    if name == "flatten":
        out = v
        for _ in range(4):
            out = _let([out], lambda x: _list(F.flatten(F.transform(_items(x), lambda y: F.when(_kind(y) == "array", _items(y)).otherwise(F.array(y))))))
        return out
    fields = variant_map(v)
    if name == "del":
        path = args[0]
        if path.kind != "get" or path.args[0].kind != "self":
            raise JqError("del takes one key")
        key = path.args[1]
        if isinstance(key, int):
            n = F.lit(key) if key >= 0 else F.size(items) + key
            return _list(F.filter(items, lambda _, i: i != n))
        return F.coalesce(F.to_json(F.map_filter(fields, lambda k, _: k != key)), v)
    if name == "to_entries":
        return _list(F.transform(F.map_entries(fields), lambda e: F.concat(F.lit('{"key":'), _string(e["key"]), F.lit(',"value":'), F.coalesce(F.to_json(e["value"]), F.lit("null")), F.lit("}"))))
    if name == "with_entries":
        return _let([_list_call("to_entries", (), v)], lambda x: _let([_list(_mapped(_items(x), args[0]))], lambda y: _list_call("from_entries", (), y)))
    pair = lambda x: F.concat(_string(F.coalesce(F.get_json_object(x, "$.key"), F.get_json_object(x, "$.name"))), F.lit(":"), F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(x), "$.value", "variant")), F.lit("null")))
    return F.concat(F.lit("{"), F.array_join(F.transform(items, pair), ","), F.lit("}"))


def _literal(n: Node) -> str:
    if n.kind != "lit" or not isinstance(n.args[0], str):
        raise JqError("a literal string expected")
    return n.args[0]


def jq(expression: str, value: Column) -> Column:
    """The output as JSON text, null where the event is dropped."""
    return F.nullif(compile_node(parse(expression), value), F.lit("null"))


def compile_transform(language: str, expression: str, value: Column) -> Column:
    """An engine by name: jq, or go-template (field templates; a blank output drops the event)."""
    if language == "jq":
        return jq(expression, value)
    if language == "go-template":
        from .templates import template

        out = template(expression)
        return F.when(F.trim(out) != "", out)
    raise JqError(f"unknown language {language!r}")
