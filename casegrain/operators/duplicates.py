"""Duplicate files by size, then name, with waste accounting; over (container, name, size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def name_groups(files: DataFrame) -> DataFrame:
    """Files of one size and lower-case name, two or more; empty files are skipped."""
    out = files.where("size > 0").groupBy("size", F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("container").alias("containers"), F.min("container").alias("representative"))
    out = out.where("n > 1")
    return out.select(F.concat_ws(":", F.col("size").cast("string"), "name").alias("key"), "size", "n", ((F.col("n") - 1) * F.col("size")).alias("waste"), (F.col("containers") > 1).alias("cross_container"), "representative")


def size_groups(files: DataFrame) -> DataFrame:
    """Files that are in no name group, of one size, two or more."""
    left = files.where("size > 0").groupBy("size", F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("container").alias("lo"), F.max("container").alias("hi")).where("n = 1")
    out = left.groupBy("size").agg(F.count(F.lit(1)).alias("n"), (F.min("lo") != F.max("hi")).alias("cross_container")).where("n > 1")
    return out.select(F.concat(F.lit("size:"), F.col("size").cast("string")).alias("key"), "size", "n", ((F.col("n") - 1) * F.col("size")).alias("waste"), "cross_container")


def statistics(files: DataFrame) -> DataFrame:
    groups = name_groups(files).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("waste"), F.lit(0)).alias("waste"))
    total = files.where("size > 0").agg(F.count(F.lit(1)).alias("files"))
    return total.crossJoin(groups).withColumn("unique_files", F.col("files") - F.col("duplicates") + F.col("groups"))  # one row each


def enrich(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Match type of each name group: ExactHash where every file is hashed and all hashes agree, else SizeAndName."""
    joined = files.where("size > 0").join(hashes, "file_id", "left")
    out = joined.groupBy("size", F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count("hash").alias("hashed"), F.count_distinct("hash").alias("kinds")).where("n > 1")
    return out.select("size", "name", "n", F.when((F.col("hashed") == F.col("n")) & (F.col("kinds") == 1), "ExactHash").otherwise("SizeAndName").alias("match_type"))
