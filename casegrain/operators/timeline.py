"""Activity-timeline analytics over (id, ts, user, action)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dow(ts: Column) -> Column:
    """0 = Sunday."""
    return F.dayofweek(ts) - 1


def summary(log: DataFrame) -> DataFrame:
    """In three scans: totals, first and last time, hours spanned (whole minutes), busiest day and hour (ties: the earliest); zeros and nulls on empty input."""
    day = log.where("ts is not null").groupBy(F.to_date("ts").alias("d")).count().agg(F.min_by("d", F.struct(-F.col("count"), F.col("d"))).alias("busiest_day"))
    hour = log.where("ts is not null").groupBy(F.hour("ts").alias("h")).count().agg(F.min_by("h", F.struct(-F.col("count"), F.col("h"))).alias("busiest_hour"))
    total = log.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("user").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    minutes = F.floor((F.unix_timestamp(F.col("last_ts").cast("timestamp")) - F.unix_timestamp(F.col("first_ts").cast("timestamp"))) / 60)
    return total.withColumn("duration_hours", F.coalesce(minutes / 60.0, F.lit(0.0))).crossJoin(day).crossJoin(hour)  # one row each


def heatmap(log: DataFrame) -> DataFrame:
    """All 168 cells of weekday and hour with their counts."""
    spark = log.sparkSession
    grid = spark.range(168).select((F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    cells = log.groupBy(dow(F.col("ts")).alias("dow"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(cells, ["dow", "hour"], "left").select("dow", "hour", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def daily(log: DataFrame) -> DataFrame:
    day = F.to_date("ts").alias("day")
    return log.where("ts is not null").groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user").alias("users")).withColumn("dow", dow(F.col("day")))


def daily_by_type(log: DataFrame) -> DataFrame:
    return log.where("ts is not null").groupBy(F.to_date("ts").alias("day"), "action").agg(F.count(F.lit(1)).alias("n"))


def type_distribution(log: DataFrame) -> DataFrame:
    out = log.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("percentage", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def users(log: DataFrame) -> DataFrame:
    return log.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct(F.to_date("ts")).alias("active_days"))


def users_by_type(log: DataFrame) -> DataFrame:
    return log.groupBy("user", "action").agg(F.count(F.lit(1)).alias("n"))


def peaks(log: DataFrame, most: int = 5) -> DataFrame:
    """The fullest half hours, ties by start."""
    w = log.where("ts is not null").groupBy(F.window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start_ts"), F.col("w.end").cast("timestamp_ntz").alias("end_ts"), "n", (F.col("n") / 30.0).alias("rate")).orderBy(F.desc("n"), "start_ts").limit(most)


def trend(log: DataFrame) -> DataFrame:
    """Mean of the two halves of the ordered days: direction by a fifth, weekly mean, confidence; stable on fewer than two days."""
    days = daily(log)
    placed = days.withColumn("i", F.row_number().over(Window.orderBy("day"))).withColumn("days", F.count(F.lit(1)).over(Window.partitionBy()))
    half = F.floor(F.col("days") / 2)
    a, b = F.avg(F.when(F.col("i") <= half, F.col("n"))), F.avg(F.when(F.col("i") > half, F.col("n")))
    out = placed.agg(F.count(F.lit(1)).alias("days"), F.coalesce(a, F.lit(0.0)).alias("first_half"), F.coalesce(b, F.lit(0.0)).alias("second_half"), F.coalesce(F.avg("n") * 7, F.lit(0.0)).alias("weekly_avg"))
    word = F.when(F.col("days") < 2, "stable").when(F.col("first_half") < 0.01, F.when(F.col("second_half") > 0, "increasing").otherwise("stable")).when(F.col("second_half") > 1.2 * F.col("first_half"), "increasing").when(F.col("second_half") < 0.8 * F.col("first_half"), "decreasing").otherwise("stable")
    return out.withColumn("trend", word).withColumn("confidence", F.least(F.col("days") / 30.0, F.lit(1.0)))


def per_session(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """Activities, sessions, and activities for each session (for each of one, where there is none)."""
    n, k = log.agg(F.count(F.lit(1)).alias("activities")), sessions.agg(F.count(F.lit(1)).alias("sessions"))
    both = n.crossJoin(F.broadcast(k))  # one row each
    return both.withColumn("mean_per_session", F.round(F.col("activities") / F.greatest("sessions", F.lit(1)), 6))


def trend_by_type(log: DataFrame) -> DataFrame:
    """Of each type its mean a day in the first and in the second half of the ordered days; a half without it counts 0."""
    counts = daily_by_type(log)
    days = counts.select("day").distinct()
    placed = days.withColumn("i", F.row_number().over(Window.orderBy("day"))).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy()))  # a row a day
    half = F.floor(F.col("k") / 2)
    rows = counts.join(F.broadcast(placed), "day")
    total = lambda cond: F.sum(F.when(cond, F.col("n")))
    out = rows.groupBy("action").agg(total(F.col("i") <= half).alias("a"), total(F.col("i") > half).alias("b"), F.max("k").alias("k"))
    return out.select("action", (F.coalesce("a", F.lit(0)) / F.nullif(half, F.lit(0))).alias("first_half"), (F.coalesce("b", F.lit(0)) / F.nullif(F.col("k") - half, F.lit(0))).alias("second_half"))
