"""Enrichment by an external function, failing open, and the checks on its answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 16 * 1024
CONCURRENCY = 8
BREAK_AFTER, COOL_DOWN = 5, 5.0


def verdict(status: Column, body: Column, circuit_open: Column | None = None, timed_out: Column | None = None) -> Column:
    """Why an answer is not used: circuit_open, timeout, status, oversize, invalid, non_object; none for 204; null if it is used."""
    false = F.lit(False)
    v = F.try_parse_json(body)
    return (
        F.when(F.coalesce(circuit_open, false) if circuit_open is not None else false, "circuit_open")
        .when(F.coalesce(timed_out, false) if timed_out is not None else false, "timeout")
        .when(status.isNull(), "error")
        .when(status == 204, "none")
        .when(~status.between(200, 299), "status")
        .when(F.octet_length(body) > MOST_BYTES, "oversize")
        .when(body.isNull() | (F.trim(body) == "") | v.isNull(), "invalid")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "non_object")
    )


class Breaker:
    """Open after five timeouts in a row for five seconds, then one probe."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.timeouts, self.opened = clock, 0, None

    def allows(self) -> bool:
        if self.opened is None:
            return True
        if self.clock() - self.opened >= COOL_DOWN:
            self.opened = self.clock()  # half open: one probe, the others wait again
            return True
        return False

    def record(self, timed_out: bool) -> None:
        self.timeouts = self.timeouts + 1 if timed_out else 0
        if self.timeouts >= BREAK_AFTER:
            self.opened = self.clock()
        elif not timed_out:
            self.opened = None


def enriched(events: DataFrame, call: Callable[[str], tuple[int, str]], match: Column, payload: Column | None = None) -> DataFrame:
    """Call `call` with the JSON of each matching event; add ai_context and enrich_reason.

    call: JSON -> (status, body); may raise TimeoutError or anything else.  Events that do not
    match, and failures, keep a null ai_context and go on.
    """
    body = F.to_json(F.struct(*[c for c in events.columns if c != "ai_context"])) if payload is None else payload

    @F.pandas_udf("status int, body string, timed_out boolean, circuit_open boolean")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        breaker = Breaker()

        def one(text):
            if text is None:
                return None, None, False, False
            if not breaker.allows():
                return None, None, False, True
            try:
                status, answer = call(text)
                breaker.record(False)
                return status, answer, False, False
            except TimeoutError:
                breaker.record(True)
                return None, None, True, False
            except Exception:
                return None, None, False, False

        with ThreadPoolExecutor(CONCURRENCY) as pool:
            for texts in batches:
                out = pd.DataFrame(list(pool.map(one, texts)), columns=["status", "body", "timed_out", "circuit_open"])
                yield out.astype({"status": "Int32"})

    a = events.withColumn("__m", match).withColumn("__a", ask(F.when(F.col("__m"), body)))
    why = F.when(F.col("__m"), verdict(F.col("__a.status"), F.col("__a.body"), F.col("__a.circuit_open"), F.col("__a.timed_out")))
    return a.withColumn("enrich_reason", why).withColumn("ai_context", F.when(F.col("__m") & F.col("enrich_reason").isNull(), F.col("__a.body"))).drop("__m", "__a")


def naive_intent(operation: Column, table: Column) -> Column:
    return F.lower(F.concat(operation, F.lit("_on_"), table))


def text_fields(columns: dict[str, Column], wanted: tuple[str, ...] = ("text", "body", "title", "description", "message", "comment", "content")) -> Column:
    """The text columns of a row by their names, joined."""
    return F.concat_ws(" ", *[c for n, c in columns.items() if n in wanted])
