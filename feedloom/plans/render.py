"""The text-template language of transforms, compiled to a Column.

Fields (`.Table`, `.After.name`), strings, numbers, true and false, pipelines, parentheses, comments,
trimming marks, `if` / `else if` / `else` / `end`, and the functions of FUNCTIONS.  All of it is
checked when it is compiled.  A null field is the empty text.  Texts and numbers are compared as
numbers where one side is a number; a text that is none equals no number and is below none.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import json_text, plain_number
from .templates import FIELDS, TemplateError

ACTION = re.compile(r'\{\{(-(?=\s))?((?:"(?:[^"\\]|\\.)*"|`[^`]*`|/\*.*?\*/|[^"`}]|\}(?!\}))*?)((?<=\s)-)?\}\}', re.S)
TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|`[^`]*`|-?\d+(?:\.\d+)?|(?:\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Za-z_][A-Za-z0-9_]*|[|()])')
VERB = re.compile(r"%([-+0 #]*\d*(?:\.\d+)?)([a-zA-Z%])")


@dataclass(frozen=True)
class Value:
    """A Column with what it is: text, number or bool; `literal` where it is known when compiled."""

    kind: str
    column: Column
    literal: object = None


def _text(v: Value) -> Column:
    if v.kind == "number":
        return F.lit(str(v.literal)) if v.literal is not None else plain_number(v.column.cast("double"))
    return v.column.cast("string")


def _number(v: Value) -> Column:
    return v.column.cast("double") if v.kind == "number" else v.column.cast("string").try_cast("double")


def _true(v: Value) -> Column:
    """Whether `if` takes it: not empty, not zero."""
    if v.kind == "bool":
        return v.column
    return v.column != (F.lit(0) if v.kind == "number" else F.lit(""))


def _pair(a: Value, b: Value) -> tuple[Column, Column]:
    if "bool" in (a.kind, b.kind) and a.kind != b.kind:
        raise TemplateError("a bool is compared with another kind")
    if "number" in (a.kind, b.kind):
        return _number(a), _number(b)
    return a.column, b.column


def _compared(test):
    def run(args: list[Value]) -> Value:
        _need(args, 2, 2)
        return Value("bool", F.coalesce(test(*_pair(*args)), F.lit(False)))

    return run


def _need(args: list[Value], least: int, most: int | None = None) -> None:
    if len(args) < least or (most is not None and len(args) > most):
        raise TemplateError(f"{len(args)} arguments")


def _equal(args: list[Value]) -> Value:
    """The first equals any of the others."""
    _need(args, 2)
    tests = []
    for other in args[1:]:
        a, b = _pair(args[0], other)
        tests.append(F.coalesce(a == b, F.lit(False)))
    return Value("bool", reduce(lambda x, y: x | y, tests))


def _unequal(args: list[Value]) -> Value:
    _need(args, 2, 2)
    return Value("bool", ~_equal(args).column)


def _chosen(stop_when: bool):
    """`or` and `and`: the first argument that settles it, else the last."""

    def run(args: list[Value]) -> Value:
        _need(args, 1)
        same = len({a.kind for a in args}) == 1
        show = (lambda v: v.column) if same else _text
        out = show(args[-1])
        for a in reversed(args[:-1]):
            out = F.when(_true(a) if stop_when else ~_true(a), show(a)).otherwise(out)
        return Value(args[0].kind if same else "text", out)

    return run


def _not(args: list[Value]) -> Value:
    _need(args, 1, 1)
    return Value("bool", ~_true(args[0]))


def _len(args: list[Value]) -> Value:
    """Bytes of a text."""
    _need(args, 1, 1)
    if args[0].kind != "text":
        raise TemplateError("len of what is no text")
    return Value("number", F.octet_length(args[0].column))


def _quoted(c: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _printf(args: list[Value]) -> Value:
    """%s %v %q %d %f %t %x and %%, with flags and widths; as many arguments as verbs.  %f rounds halves of the decimal form up."""
    _need(args, 1)
    if not isinstance(args[0].literal, str):
        raise TemplateError("printf needs a literal format")
    layout, rest, at, parts, end = args[0].literal, args[1:], 0, [], 0
    for m in VERB.finditer(layout):
        parts.append(F.lit(layout[end : m.start()]))
        end = m.end()
        flags, verb = m.groups()
        if verb == "%":
            parts.append(F.lit("%"))
            continue
        if verb not in "svqdftx" or at >= len(rest):
            raise TemplateError(f"printf: %{verb}")
        v, at = rest[at], at + 1
        if verb in "df":
            shown = _number(v).cast("bigint") if verb == "d" else _number(v)
        else:
            shown = _quoted(_text(v)) if verb == "q" else F.lower(F.hex(F.encode(_text(v), "UTF-8"))) if verb == "x" else _text(v)
        if verb == "f" and "." not in flags:
            flags += ".6"
        parts.append(F.format_string(f"%{flags}{verb if verb in 'df' else 's'}", shown) if flags or verb == "f" else shown.cast("string"))
    if "%" in VERB.sub("", layout) or at < len(rest):
        raise TemplateError("printf: verbs and arguments differ")
    parts.append(F.lit(layout[end:]))
    return Value("text", F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))


def _print(args: list[Value]) -> Value:
    """Arguments joined; a space between two of which neither is a text."""
    parts: list[Column] = []
    for i, v in enumerate(args):
        if i and v.kind != "text" and args[i - 1].kind != "text":
            parts.append(F.lit(" "))
        parts.append(_text(v))
    return Value("text", F.concat(F.lit(""), *parts))


def _println(args: list[Value]) -> Value:
    return Value("text", F.concat(F.concat_ws(" ", *[_text(v) for v in args]), F.lit("\n")))


def _html(args: list[Value]) -> Value:
    _need(args, 1)
    c = _print(args).column
    for old, new in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return Value("text", c)


def _urlquery(args: list[Value]) -> Value:
    _need(args, 1)
    c = F.url_encode(_print(args).column)
    return Value("text", F.replace(F.replace(c, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


FUNCTIONS = {
    "eq": _equal, "ne": _unequal, "lt": _compared(lambda a, b: a < b), "le": _compared(lambda a, b: a <= b),
    "gt": _compared(lambda a, b: a > b), "ge": _compared(lambda a, b: a >= b), "and": _chosen(False), "or": _chosen(True),
    "not": _not, "len": _len, "printf": _printf, "print": _print, "println": _println, "html": _html, "urlquery": _urlquery,
}


def _field(path: str, fields: dict[str, str]) -> Value:
    name, _, key = path[1:].partition(".")
    if name in ("After", "Before") and key and "." not in key:
        c = json_text(F.col(name.lower()), key)
    elif name in ("After", "Before") and not key:
        c = F.col(name.lower())
    elif name in fields and not key:
        c = F.col(fields[name]).cast("string")
    else:
        raise TemplateError(f"unsupported field {path!r}")
    return Value("text", F.coalesce(c, F.lit("")))


class _Pipeline:
    """One action's expression."""

    def __init__(self, source: str, fields: dict[str, str]) -> None:
        self.fields, self.tokens, at = fields, [], 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if m is None:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def whole(self) -> Value:
        out = self.pipeline()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at]!r}")
        return out

    def pipeline(self) -> Value:
        out = self.command(None)
        while self.at < len(self.tokens) and self.tokens[self.at] == "|":
            self.at += 1
            out = self.command(out)
        return out

    def command(self, piped: Value | None) -> Value:
        if self.at >= len(self.tokens):
            raise TemplateError("an empty command")
        name = self.tokens[self.at]
        if name == "index":  # a key of an image, read as one
            self.at += 1
            if piped is not None or len(self.tokens) < self.at + 2 or self.tokens[self.at] not in (".After", ".Before"):
                raise TemplateError("index takes .After or .Before and a key")
            side, key = self.tokens[self.at], self.tokens[self.at + 1]
            self.at += 2
            if key[0] not in '"`':
                raise TemplateError("index takes a literal key")
            return Value("text", F.coalesce(json_text(F.col(side[1:].lower()), _string(key)), F.lit("")))
        if name in FUNCTIONS:
            self.at += 1
            args = []
            while self.at < len(self.tokens) and self.tokens[self.at] not in "|)":
                args.append(self.operand())
            return FUNCTIONS[name](args + ([piped] if piped is not None else []))
        if piped is not None:
            raise TemplateError(f"{name!r} is no function")
        return self.operand()

    def operand(self) -> Value:
        t = self.tokens[self.at]
        self.at += 1
        if t == "(":
            out = self.pipeline()
            if self.at >= len(self.tokens) or self.tokens[self.at] != ")":
                raise TemplateError("a missing )")
            self.at += 1
            return out
        if t[0] in '"`':
            return Value("text", F.lit(_string(t)), _string(t))
        if t[0] == ".":
            return _field(t, self.fields)
        if t in ("true", "false"):
            return Value("bool", F.lit(t == "true"), t == "true")
        if t[0].isdigit() or t[0] == "-":
            n = float(t) if "." in t else int(t)
            return Value("number", F.lit(n), n)
        if t in FUNCTIONS:  # a function without arguments would be an error of its own
            return FUNCTIONS[t]([])
        raise TemplateError(f"unknown word {t!r}")


def _string(token: str) -> str:
    if token[0] == "`":
        return token[1:-1]
    try:
        return json.loads(token, strict=False)
    except ValueError as e:
        raise TemplateError(f"bad text {token}") from e


def _pieces(text: str) -> list[tuple[str, str]]:
    """Texts and actions in order, spaces beside trimming marks taken off."""
    out: list[tuple[str, str]] = []
    end, trim = 0, False
    for m in ACTION.finditer(text):
        plain = text[end : m.start()]
        plain = plain.lstrip() if trim else plain
        out.append(("text", plain.rstrip() if m[1] else plain))
        out.append(("action", m[2].strip()))
        end, trim = m.end(), bool(m[3])
    out.append(("text", text[end:].lstrip() if trim else text[end:]))
    if any(kind == "text" and "{{" in s for kind, s in out):
        raise TemplateError("an action without end")
    return [(k, s) for k, s in out if k == "action" or s]


def rendered(text: str, fields: dict[str, str] = FIELDS) -> Column:
    """The template's text for an event."""
    pieces, at = _pieces(text), 0

    def block(inside: bool) -> tuple[Column, str]:
        """Up to the `else` or `end` that closes it."""
        nonlocal at
        parts: list[Column] = [F.lit("")]
        while at < len(pieces):
            kind, s = pieces[at]
            at += 1
            word = s.split(None, 1)[0] if kind == "action" and s else ""
            if kind == "text":
                parts.append(F.lit(s))
            elif s.startswith("/*"):
                if not s.endswith("*/"):
                    raise TemplateError("a comment without end")
            elif word in ("end", "else"):
                if not inside:
                    raise TemplateError(f"{word} without if")
                if word == "end" and s != "end":
                    raise TemplateError(f"unexpected {s!r}")
                return F.concat(*parts), s
            elif word == "if":
                parts.append(branch(s[2:]))
            elif word in ("range", "with", "define", "template", "block", "break", "continue"):
                raise TemplateError(f"{word} is not supported")
            else:
                parts.append(_text(_Pipeline(s, fields).whole()))
        if inside:
            raise TemplateError("if without end")
        return F.concat(*parts), ""

    def branch(test: str) -> Column:
        condition = _true(_Pipeline(test, fields).whole())
        then, closed = block(True)
        if closed == "end":
            return F.when(condition, then).otherwise("")
        rest = closed[4:].strip()
        if rest.startswith("if") and rest[2:3] in (" ", "\t", "("):
            return F.when(condition, then).otherwise(branch(rest[2:]))
        if rest:
            raise TemplateError(f"unexpected {closed!r}")
        other, closed = block(True)
        if closed != "end":
            raise TemplateError("else after else")
        return F.when(condition, then).otherwise(other)

    return block(False)[0]


def transform(text: str, fields: dict[str, str] = FIELDS) -> Column:
    """The rendered text; null, which drops the event, where it is blank."""
    c = rendered(text, fields)
    return F.when(F.regexp_replace(c, r"\s+", "") != "", c)
