"""Database identifiers: schema."Weird.Name" with "" as the escape, two parts at most."""

from __future__ import annotations


class IdentifierError(ValueError):
    """Not an identifier."""


def parse(text: str) -> tuple[str | None, str]:
    """(schema or None, table)."""
    parts: list[str] = []
    i = 0
    while True:
        if i < len(text) and text[i] == '"':
            i += 1
            out = ""
            while True:
                if i >= len(text):
                    raise IdentifierError(f"unclosed quote in {text!r}")
                if text[i] == '"':
                    if text[i + 1 : i + 2] == '"':
                        out += '"'
                        i += 2
                        continue
                    i += 1
                    break
                out += text[i]
                i += 1
        else:
            start = i
            while i < len(text) and text[i] not in '."':
                i += 1
            out = text[start:i]
            if not out.replace("_", "a").replace("$", "a").isalnum() or out[:1].isdigit():
                raise IdentifierError(f"bad identifier {text!r}")
        if not out:
            raise IdentifierError(f"empty part in {text!r}")
        parts.append(out)
        if i == len(text):
            break
        if text[i] != ".":
            raise IdentifierError(f"unexpected {text[i]!r} in {text!r}")
        i += 1
    if len(parts) > 2:
        raise IdentifierError(f"too many parts in {text!r}")
    return (parts[0], parts[1]) if len(parts) == 2 else (None, parts[0])


def quoted(schema: str | None, table: str, mark: str = "`") -> str:
    """For Spark SQL; use '"' for databases."""
    q = lambda s: mark + s.replace(mark, mark * 2) + mark
    return f"{q(schema)}.{q(table)}" if schema else q(table)
