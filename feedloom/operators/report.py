"""Benchmark analytics: attribution, throughput, percentiles, gates, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.35
MOST_WINDOWS = 10_000
#: Bytes of the size units, longest suffix first.
UNITS = (("GiB", 1024**3), ("MiB", 1024**2), ("KiB", 1024), ("GB", 1e9), ("MB", 1e6), ("kB", 1e3), ("B", 1))


def scenario_windows(markers: DataFrame) -> DataFrame:
    """(scenario, start, end) from start and end markers."""
    return markers.groupBy("scenario").agg(F.min(F.when(F.col("event") == "start", F.col("ts"))).alias("start"), F.max(F.when(F.col("event") == "end", F.col("ts"))).alias("end")).where("start is not null and end is not null")


def attributed(events: DataFrame, windows: DataFrame, at: str = "bench_ts") -> DataFrame:
    """The scenario whose window (both ends included) holds the event; else its own tag.

    Of overlapping windows the one that starts first wins.  Windows are few (a count checks it) and are
    folded into one array, so the event side is neither shuffled nor multiplied.
    """
    if windows.limit(MOST_WINDOWS + 1).count() > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows")
    all_ = windows.agg(F.sort_array(F.collect_list(F.struct("start", "end", "scenario"))).alias("__w"))
    hit = F.filter("__w", lambda w: (w["start"] <= F.col(at)) & (F.col(at) <= w["end"]))
    return events.crossJoin(F.broadcast(all_)).withColumn("scenario", F.coalesce(F.get(hit, F.lit(0))["scenario"], F.col("scenario"))).drop("__w")


def nearest_rank(column: str, p: float) -> Column:
    """The value of rank ceil(p * n), for p in (0, 1]."""
    return F.expr(f"percentile_disc({p}) within group (order by `{column}`)")


def summary(events: DataFrame, by: list[str], at: str = "receive_ts", latency: str = "latency_us") -> DataFrame:
    """Count, span, throughput (0 for no span) and nearest-rank percentiles."""
    aggs = [nearest_rank(latency, p).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    out = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), *aggs)
    seconds = F.expr("timestampdiff(MICROSECOND, first, last)") / 1e6
    return out.withColumn("throughput", F.when(seconds > 0, F.col("n") / seconds).otherwise(0.0))


def resource_means(stats: DataFrame, by: list[str]) -> DataFrame:
    return stats.groupBy(*by).agg(F.avg("cpu_pct").alias("cpu_pct"), (F.avg("vmrss_kb") / 1024).alias("rss_mb"))


def histogram(rows: DataFrame, value: str, buckets: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative counts: (le, n) for each bucket."""
    counts = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = rows.groupBy(*(by or [])).agg(*counts)
    each = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)])
    return wide.select(*(by or []), F.explode(each).alias("x")).select(*(by or []), "x.le", "x.n")


def gate(current: DataFrame, baseline: DataFrame, on: str = "scenario") -> DataFrame:
    """failed: throughput below 65 % of the baseline's; advisory: burst p50 above 135 %."""
    b = baseline.select(on, F.col("throughput").alias("base_throughput"), F.col("p50").alias("base_p50"))
    rows = current.join(b, on)
    return rows.withColumn("failed", F.col("throughput") < F.col("base_throughput") * (1 - TOLERANCE)).withColumn("advisory", (F.col(on) == "burst") & (F.col("p50") > F.col("base_p50") * (1 + TOLERANCE)))


def container_tool(name: Column, tools: list[str], aliases: dict[str, str] | None = None) -> Column:
    """The tool of a container name: prefix `bench-` and a trailing instance number go, the longest tool wins."""
    s = F.regexp_replace(F.regexp_replace(name, "^bench-", ""), "-[0-9]+$", "")
    out = F.lit(None).cast("string")
    for t in sorted(tools, key=len):
        out = F.when((s == t) | s.startswith(f"{t}-"), F.lit(t)).otherwise(out)
    for a, t in (aliases or {}).items():
        out = F.when(s == a, F.lit(t)).otherwise(out)
    return F.coalesce(out, name)


def size_kib(c: Column) -> Column:
    """`15.3MiB / 7.77GiB` as whole KiB of the part in front; null if it cannot be read."""
    s = F.trim(F.substring_index(c, "/", 1))
    out = F.lit(None).cast("bigint")
    for unit, n in reversed(UNITS):
        number = F.trim(F.substr(s, F.lit(1), F.greatest(F.length(s) - len(unit), F.lit(0)))).try_cast("double")
        out = F.when(s.endswith(unit), F.floor(number * float(n) / 1024).cast("bigint")).otherwise(out)
    return out


def percent(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "%$", "")).try_cast("double")


def bench_time(c: Column) -> Column:
    """The first of the known layouts that reads the text, else null."""
    zoned = F.regexp_replace(c, r"([+-][0-9]{2})$", "$1:00")
    ok = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,9})?(?:Z|[+-][0-9]{2}(?::[0-9]{2})?)?$")
    return F.when(ok, zoned.try_cast("timestamp"))


def latency_us(receive: Column, bench: Column) -> Column:
    return F.unix_micros(receive) - F.unix_micros(bench)


def recovery_seconds(events: DataFrame, kills: DataFrame, by: str = "tool", cap: float = 120.0) -> DataFrame:
    """Seconds from each kill to the first event after it, at most `cap`."""
    first = events.join(kills, by).where(F.col("receive_ts") > F.col("kill_ts")).groupBy(by, "kill_ts").agg(F.min("receive_ts").alias("back"))
    seconds = (F.unix_micros("back") - F.unix_micros("kill_ts")) / 1e6
    return kills.join(first, [by, "kill_ts"], "left").select(by, "kill_ts", F.least(F.coalesce(seconds, F.lit(cap)), F.lit(cap)).alias("recovery_seconds"))


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A report table; its rows are one a tool and scenario."""
    out = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in rows.select(*columns).orderBy(*columns[:2]).collect():
        out.append("| " + " | ".join("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(out)


def html(rows: DataFrame, columns: list[str]) -> str:
    from html import escape

    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows.select(*columns).orderBy(*columns[:2]).collect())
    return "<table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in columns) + f"</tr>{body}</table>"
