"""Field templates such as `cdc.{{.Schema}}.{{ .Table }}`, compiled to Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import json_text

FIELDS = {
    "Table": "table", "Operation": "operation", "Schema": "schema", "Database": "database", "Source": "source",
    "Key": "key", "ID": "id", "IdempotencyKey": "idempotency_key",
}
PLACE = re.compile(r"\{\{\s*\.([A-Za-z_][A-Za-z0-9_.-]*)\s*\}\}")


class TemplateError(ValueError):
    """An unknown field or construct."""


def template(text: str, fields: dict[str, str] = FIELDS, images: bool = True) -> Column:
    """Literals and fields joined; nulls render as nothing.  Only {{.Field}}, {{.After.col}} and {{.Before.col}}."""
    parts: list[Column] = []
    end = 0
    for m in PLACE.finditer(text):
        parts.append(_literal(text[end : m.start()]))
        parts.append(F.coalesce(_field(m[1], fields, images), F.lit("")))
        end = m.end()
    parts.append(_literal(text[end:]))
    return F.concat(*parts)


def _literal(s: str) -> Column:
    if "{{" in s or "}}" in s:
        raise TemplateError(f"unsupported template syntax in {s!r}")
    return F.lit(s)


def _field(name: str, fields: dict[str, str], images: bool) -> Column:
    if name in fields:
        return F.col(fields[name]).cast("string")
    side, _, key = name.partition(".")
    if images and side in ("After", "Before") and key:
        return json_text(F.col(side.lower()), key)
    raise TemplateError(f"unsupported field {name!r}; supported: {', '.join(sorted(fields))}")


def destination(text: str) -> Column:
    """A destination name; a blank one is null, which is an error for its event."""
    c = F.trim(template(text))
    return F.when(c != "", c)
