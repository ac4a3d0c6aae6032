"""Reports on load runs: latency, status, thresholds, consistency, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timeutil import epoch_micros
from tidelog.operators.numbering import join_metadata, running_total

# The percentiles of a latency summary.
PERCENTILES = {"med": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def latency_summary(
    results: DataFrame,
    group: str = "endpoint",
    value: str = "latency_ms",
    accuracy: int | None = None,
) -> DataFrame:
    """avg, min, max and percentiles per group.

    Percentiles interpolate between neighbours and are exact: the results are read once
    and counted by value, and all figures come from the counts. With ``accuracy`` the
    percentiles are approximate and take a single aggregation.
    """
    if accuracy is not None:
        return results.groupBy(group).agg(
            F.count(value).alias("samples"), F.avg(value).alias("avg"),
            F.min(value).alias("min"), F.max(value).alias("max"),
            *(F.percentile_approx(value, p, accuracy).alias(name) for name, p in PERCENTILES.items()),
        )
    counts = results.groupBy(group, value).agg(F.count(value).alias("_n"))
    figures = {
        "samples": F.sum("_n"), "_sum": F.sum(F.col(value) * F.col("_n")), "min": F.min(value), "max": F.max(value),
    }
    found = ranked_figures(counts, group, value, "_n", PERCENTILES, figures)
    average = F.when(F.col("samples") > 0, F.col("_sum") / F.col("samples")).alias("avg")
    return found.select(group, "samples", average, "min", "max", *PERCENTILES)


def ranked_figures(
    counts: DataFrame, group: str, value: str, times: str, wanted: dict[str, float], figures: dict[str, Column]
) -> DataFrame:
    """Exact interpolated percentiles per group, and other ``figures``, however large a group is.

    ``counts`` say how many ``times`` each value occurs in its group (0 for rows that only
    make the group show). A distributed running total gives each value the ranks it
    covers; no task holds a whole group.
    """
    ranked = running_total(counts, [F.col(group), F.col(value)], times, "_upto")
    groups = ranked.groupBy(F.col(group).alias("_group")).agg(
        F.min(F.col("_upto") - F.col(times)).alias("_start"), F.sum(times).alias("_total")
    )
    small = groups.select(
        F.coalesce(F.col("_group").cast("string"), F.lit("")).alias("_key"),
        F.col("_group").isNull().alias("_null"), "_start", "_total",
    )
    keyed = ranked.withColumn("_key", F.coalesce(F.col(group).cast("string"), F.lit(""))).withColumn(
        "_null", F.col(group).isNull()
    )
    placed = join_metadata(keyed, small, ["_key", "_null"], groups.count())
    last = F.col("_upto") - F.col("_start") - 1
    first = last - F.col(times) + 1

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col(times) > 0) & rank.between(first, last), F.col(value)))

    found, result = [], []
    for name, p in wanted.items():
        position = F.lit(p) * (F.col("_total") - 1)
        found += [
            at_rank(F.floor(position)).alias(f"_{name}_low"),
            at_rank(F.ceil(position)).alias(f"_{name}_high"),
            F.max(position - F.floor(position)).alias(f"_{name}_part"),
        ]
        low, high, part = (F.col(f"_{name}_{end}") for end in ("low", "high", "part"))
        result.append((low + (high - low) * part).alias(name))
    more = [column.alias(name) for name, column in figures.items()]
    return placed.groupBy(group).agg(*more, *found).select(group, *figures, *result)


def status_summary(
    results: DataFrame, group: str = "endpoint", status: str = "status"
) -> DataFrame:
    """Requests, answers by status, timeouts (status 0) and success rate per group."""
    code = F.col(status)
    return results.groupBy(group).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(code == 200).alias("responses_200"),
        F.count_if(code == 429).alias("responses_429"),
        F.count_if(code == 503).alias("responses_503"),
        F.count_if(code == 0).alias("timeouts"),
        F.avg((code == 200).cast("double")).alias("success_rate"),
    )


def long_metrics(summary: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """A summary as rows of ``(metric, value)``, metric being ``group.column``."""
    wide = summary.select(group, *(F.col(c).cast("double").alias(c) for c in columns))
    rows = wide.unpivot(group, columns, "_column", "value")
    return rows.select(F.concat_ws(".", group, "_column").alias("metric"), "value")


def failed_checks(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules ``(metric, op, bound)`` that the metrics break; no such metric breaks too."""
    measured = rules.join(metrics, "metric", "left")
    value, bound = F.col("value"), F.col("bound")
    holds = (
        F.when(F.col("op") == "<", value < bound)
        .when(F.col("op") == "<=", value <= bound)
        .when(F.col("op") == ">", value > bound)
        .when(F.col("op") == ">=", value >= bound)
        .when(F.col("op") == "==", value == bound)
    )
    return measured.filter(~F.coalesce(holds, F.lit(False))).select("metric", "op", "bound", "value")


def reconcile(accepted: DataFrame, persisted: DataFrame, key: str = "service") -> DataFrame:
    """Accepted against stored logs per key: consistent, missing or excess.

    Either side holds rows to count, or a ``count`` column to add up.
    """
    sides = [_counted(accepted, key, "accepted"), _counted(persisted, key, "persisted")]
    joined = sides[0].join(sides[1], key, "full_outer").na.fill(0, ["accepted", "persisted"])
    gap = F.col("accepted") - F.col("persisted")
    return joined.select(
        key, "accepted", "persisted",
        F.when(gap == 0, "CONSISTENT")
        .when(gap > 0, F.concat_ws(" ", F.lit("MISSING"), gap))
        .otherwise(F.concat_ws(" ", F.lit("EXCESS"), -gap))
        .alias("status"),
    )


def throughput(commits: DataFrame, seconds: float, target: int) -> DataFrame:
    """Logs per second over the scheduled window and the gap to a target total.

    Of a store's commits only those of kind ``ingest`` count: the others move or drop rows.
    """
    if "kind" in commits.columns:
        commits = commits.filter(F.col("kind") == "ingest")
    total = commits.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("accepted"))
    gap = F.col("accepted") - F.lit(target)
    return total.select(
        "accepted",
        (F.col("accepted") / F.lit(float(seconds))).alias("logs_per_second"),
        F.when(gap == 0, "MET TARGET")
        .when(gap > 0, F.concat(F.lit("EXCEEDED TARGET BY "), gap))
        .otherwise(F.concat(F.lit("BELOW TARGET BY "), -gap))
        .alias("status"),
    )


def visibility_lag(logs: DataFrame, commits: DataFrame, bound_seconds: int = 20) -> DataFrame:
    """How long after its timestamp each segment's logs could be queried.

    ``logs`` carry ``segment`` and ``timestamp``; ``commits`` hold one row per
    segment with ``committed_at``. Percentiles interpolate and are exact, in whole
    milliseconds of the event time: logs are counted by segment and millisecond, and
    ranked over the counts, so no task holds a segment.
    """
    ages = logs.select("segment", epoch_micros(logs, "timestamp").alias("_at"))
    ages = ages.withColumn("_ms", F.floor(F.col("_at") / 1000))
    counted = ages.groupBy("segment", "_ms").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"), F.max("_at").alias("_high")
    )
    points = [0.5, 0.95, 0.99]
    figures = {"logs": F.sum("_n"), "oldest": F.min("_low"), "newest": F.max("_high")}
    # The age that p of the logs stay below is the time that 1 - p of them lie before.
    span = ranked_figures(counted, "segment", "_ms", "_n", {f"_age{i}": 1 - p for i, p in enumerate(points)}, figures)
    stamped = commits.filter(F.col("kind").isin("ingest", "backfill")) if "kind" in commits.columns else commits
    committed = span.join(
        stamped.select("segment", epoch_micros(stamped, "committed_at").alias("_done")), "segment"
    )
    longest, shortest = ((F.col("_done") - F.col(c)) / 1e6 for c in ("oldest", "newest"))
    usual = [
        ((F.floor(F.col("_done") / 1000) - F.col(f"_age{i}")) / 1e3).alias(f"p{round(100 * p)}_lag_s")
        for i, p in enumerate(points)
    ]
    return committed.select(
        "segment", "logs", longest.alias("max_lag_s"), *usual, shortest.alias("min_lag_s"),
        (longest <= bound_seconds).alias("within_bound"),
    )


def _counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    total = F.sum("count") if "count" in rows.columns else F.count(F.lit(1))
    return rows.groupBy(key).agg(total.cast("long").alias(name))
