"""Text streams: newline-delimited JSON and server-sent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ndjson(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines that hold a JSON object; malformed ones are skipped."""
    v = F.try_parse_json(F.col(line))
    return lines.where(F.schema_of_variant(v).startswith("OBJECT"))


def metrics(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, markers) of a benchmark log; a marker has `scenario_event`."""
    good = ndjson(lines, line)
    g = lambda k: F.get_json_object(line, f"$.{k}")
    ts = lambda k: g(k).try_cast("timestamp")
    events = good.where(g("scenario_event").isNull()).select(g("tool").alias("tool"), g("scenario").alias("scenario"), ts("receive_ts").alias("receive_ts"), ts("bench_ts").alias("bench_ts"), g("latency_us").try_cast("bigint").alias("latency_us"))
    markers = good.where(g("scenario_event").isNotNull()).select(g("scenario_event").alias("event"), g("scenario").alias("scenario"), ts("ts").alias("ts"), g("tool").alias("tool"), g("recovery_seconds").try_cast("double").alias("recovery_seconds"))
    return events, markers


def sse_data(stream: Column) -> Column:
    """array<string>: the data of each frame of a server-sent-event text.

    Frames end at a blank line; CRLF counts as LF; comments and other fields are ignored; several
    data lines are joined; frames without data or with data that is no JSON are left out.
    """
    frames = F.split(F.regexp_replace(stream, "\r\n?", "\n"), "\n\n+")
    data = F.transform(frames, lambda f: F.array_join(F.transform(F.filter(F.split(f, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))
    return F.filter(data, lambda d: (d != "") & F.try_parse_json(d).isNotNull())


def sse_backoff(attempt: int, first: float = 1.0, most: float = 30.0) -> float:
    """Seconds to wait before reconnecting, without jitter."""
    return min(most, first * 2**attempt)


def sse_terminal(status: int) -> bool:
    """A client error ends the stream."""
    return 400 <= status < 500
