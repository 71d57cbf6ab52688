"""Routes: operations, table globs and a predicate, compiled once and evaluated in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import qualified
from ..model import OPERATIONS
from .where import where


class RouteError(ValueError):
    """A route that cannot be compiled."""


def glob(pattern: str, name: Column) -> Column:
    """exact, *, pre*, *suf, pre*suf; start and end may not overlap."""
    if not pattern or pattern.count("*") > 1:
        raise RouteError(f"bad table pattern {pattern!r}")
    if pattern == "*":
        return F.lit(True)
    start, star, end = pattern.partition("*")
    if not star:
        return name == pattern
    return name.startswith(start) & name.endswith(end) & (F.length(name) >= len(start) + len(end))


def any_glob(patterns: list[str], name: Column) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | glob(p, name)
    return out


@dataclass(frozen=True)
class Route:
    """Empty tables or operations mean all; control events never match."""

    name: str
    tables: tuple[str, ...] = ()
    operations: tuple[str, ...] = ()
    where: str = ""

    def column(self, images=None) -> Column:
        ops = [o.strip().lower() for o in self.operations]
        if bad := set(ops) - set(OPERATIONS):
            raise RouteError(f"unknown operations {sorted(bad)}")
        cond = F.col("operation") != "control"
        if ops:
            cond = cond & F.col("operation").isin(ops)
        if self.tables:
            cond = cond & any_glob(list(self.tables), qualified(F.col("schema"), F.col("table")))
        return cond & where(self.where, images=images)


def matching(events: DataFrame, route: Route, images=None) -> DataFrame:
    return events.where(route.column(images))


def fan_out(events: DataFrame, routes: list[Route], images=None) -> DataFrame:
    """One row for each event and matching route, named in `consumer`; the events are read once."""
    if len({r.name for r in routes}) != len(routes):
        raise RouteError("route names must differ")
    hits = F.filter(F.array(*[F.when(r.column(images), F.lit(r.name)) for r in routes]), lambda x: x.isNotNull())
    return events.withColumn("consumer", F.explode(hits))
