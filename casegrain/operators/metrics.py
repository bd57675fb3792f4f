"""Metric summaries over (name, seq, value): quantiles by nearest rank, counters, gauges, series of operations, health."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegrain.operators.shared import written


def histogram(samples: DataFrame, keys: list[str], window: int | None = None) -> DataFrame:
    """Count and mean of all samples, and the values at rank round((n - 1) p), halves up, for p50, p95 and p99.

    With `window` the ranks are those of the last `window` samples of each series by seq.  Without it a series of any length
    is met in ranges: values are counted, the counted values cut into equal ranges, and ranks come from the ranges' sums.
    """
    counts = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    if window is not None:
        age = Window.partitionBy(*keys).orderBy(F.desc("seq"))
        samples = samples.withColumn("age", F.row_number().over(age)).where(F.col("age") <= window)
    by_value = samples.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))
    ranged = written(by_value.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, "part").agg(F.sum("c").alias("s"))
    starts = starts.select(*keys, "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"), F.sum("s").over(Window.partitionBy(*keys)).alias("ranked"))
    inside = Window.partitionBy(*keys, "part").orderBy("value")
    placed = _met(ranged, starts, [*keys, "part"]).withColumn("upto", F.col("start") + F.sum("c").over(inside))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("ranked") - 1) * p + 0.5), F.col("value")))
    found = placed.groupBy(*keys).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    return _met(counts, found, keys).select(*keys, "n", "mean", "p50", "p95", "p99")


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys, nulls included, with the left side's keys."""
    named = right.withColumnsRenamed({k: f"{k}_right" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_right")) for k in keys])
    return left.join(named, same).drop(*[f"{k}_right" for k in keys])


def counters(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.sum("value").alias("total"))


def gauges(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The last write of each series."""
    return samples.groupBy(*keys).agg(F.max_by("value", "seq").alias("last"))


def health(issues: DataFrame) -> DataFrame:
    """Unhealthy on any critical issue, Degraded on any, else Healthy; over (severity)."""
    worst = F.max(F.when(F.col("severity") == "critical", 2).otherwise(1))
    return issues.agg(F.count(F.lit(1)).alias("issues"), F.when(worst == 2, "Unhealthy").when(worst == 1, "Degraded").otherwise("Healthy").alias("status"))


def operation_series(operations: DataFrame) -> DataFrame:
    """series, labels (type/status) and total of operations (type, what, good, amount).

    what is start, complete (amount: seconds), bytes (amount), cache (good: a hit) or error.  Starts and completions also
    move the gauge of active operations.  One scan and one aggregation.
    """
    status = F.when(F.col("what") == "complete", F.when(F.col("good"), "success").otherwise("error")).when(F.col("what") == "cache", F.when(F.col("good"), "hit").otherwise("miss")).otherwise("")
    entry = lambda series, labels, value: F.struct(F.lit(series).alias("series"), F.concat("type", F.lit("/"), labels).alias("labels"), value.cast("double").alias("value"))
    one, none = F.lit(1.0), F.lit("")
    what = F.col("what")
    entries = (
        F.when(what == "start", F.array(entry("operations_started_total", none, one), entry("active_operations", none, one)))
        .when(what == "complete", F.array(entry("operations_completed_total", status, one), entry("active_operations", none, -one), entry("operation_duration_seconds", none, F.col("amount"))))
        .when(what == "bytes", F.array(entry("bytes_processed_total", none, F.col("amount"))))
        .when(what == "cache", F.array(entry("cache_accesses_total", status, one)))
        .when(what == "error", F.array(entry("errors_total", none, one)))
    )
    return operations.select(F.explode(entries).alias("e")).groupBy("e.series", "e.labels").agg(F.sum("e.value").alias("total"))


def rates(operations: DataFrame, seconds: float) -> DataFrame:
    """Of each type MB/s over `seconds`, and mean milliseconds of a completed operation; 0 without time or completions."""
    done = F.col("what") == "complete"
    moved = F.sum(F.when(F.col("what") == "bytes", F.col("amount")))
    mean = F.sum(F.when(done, F.col("amount"))) * 1000 / F.nullif(F.count_if(done), F.lit(0))
    speed = moved / seconds / (1 << 20) if seconds > 0 else F.lit(0.0)
    return operations.groupBy("type").agg(speed.alias("mb_per_second"), F.coalesce(mean, F.lit(0.0)).alias("mean_ms"))


def performance(entries: DataFrame) -> DataFrame:
    """Counts and mean durations of renders and effects, the slowest component by mean render and the most rendered one.

    entries have type, component and duration; ties go to the least component, means are compared to nine decimals.
    """
    mean = lambda kind: F.coalesce(F.avg(F.when(F.col("type") == kind, F.col("duration"))), F.lit(0.0))
    count = lambda kind: F.count_if(F.col("type") == kind)
    every = entries.agg(count("render").alias("renders"), count("effect").alias("effects"), mean("render").alias("mean_render"), mean("effect").alias("mean_effect"))
    by = entries.where("type = 'render'").groupBy("component").agg(F.round(F.avg("duration"), 9).alias("m"), F.count(F.lit(1)).alias("n"))
    top = by.agg(F.min_by("component", F.struct(-F.col("m"), F.col("component"))).alias("slowest"), F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("most_rendered"))
    return every.crossJoin(F.broadcast(top))  # one row each


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    """name and n of a column's values that are neither null nor empty."""
    return rows.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def first_non_empty(attempts: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first attempt that can be planned (its tables and columns exist) and has a row; the last that can be planned, if none has."""
    out = None
    for attempt in attempts:
        try:
            out = attempt()
            empty = out.isEmpty()
        except AnalysisException:
            continue
        if not empty:
            break
    if out is None:
        raise ValueError("no attempt can be planned")
    return out


def table_count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")


def counts_by(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit(prefix), column).alias("name"), "n")


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def compression(entries: DataFrame, key: str, stored: str, plain: str) -> DataFrame:
    """Stored over uncompressed size of each archive; null where nothing is uncompressed."""
    return entries.groupBy(key).agg((F.sum(stored) / F.nullif(F.sum(plain), F.lit(0))).alias("ratio"))


def totals(projects: DataFrame, chosen: list[str], columns: list[str]) -> DataFrame:
    """How many projects are chosen, and the sums of their columns."""
    return projects.where(F.col("project").isin(*chosen)).agg(F.count(F.lit(1)).alias("projects"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
