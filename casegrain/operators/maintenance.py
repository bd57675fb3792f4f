"""Upkeep of written tables: snapshots, compaction, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(spark: SparkSession, folder: str, target: str, partition_by: tuple[str, ...] = ()) -> None:
    """A copy of a table of Parquet in another folder, in place of what stands there."""
    spark.read.parquet(folder).write.mode("overwrite").partitionBy(*partition_by).parquet(target)


def compact(spark: SparkSession, folder: str, target: str, file_bytes: int = 128 << 20) -> int:
    """The table in files of about `file_bytes`, in another folder; the number of files.  The old one is the caller's to drop."""
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    n = max(1, round((sizes.agg(F.sum("length")).first()[0] or 0) / file_bytes))
    spark.read.parquet(folder).repartition(n).write.mode("overwrite").parquet(target)
    return n


def integrity(tables: dict[str, tuple[DataFrame, list[str]]], links: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """check, subject, n: rows with null or repeated keys of each table (with its key columns), and links without a parent.

    links are (child, foreign key, parent, key).  n is 0 where all is well.
    """
    found = []
    for name, (rows, keys) in tables.items():
        null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        found.append(rows.where(null).agg(F.count(F.lit(1)).alias("n")).select(F.lit("null key").alias("check"), F.lit(name).alias("subject"), "n"))
        repeated = rows.where(~null).groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        found.append(repeated.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(F.lit("repeated key").alias("check"), F.lit(name).alias("subject"), "n"))
    for child, foreign, parent, key in links:
        ids = tables[parent][0].select(F.col(key).alias("parent_key")).distinct()
        orphans = tables[child][0].where(F.col(foreign).isNotNull()).join(ids, F.col(foreign) == F.col("parent_key"), "left_anti")
        found.append(orphans.agg(F.count(F.lit(1)).alias("n")).select(F.lit("no parent").alias("check"), F.lit(f"{child}.{foreign}").alias("subject"), "n"))
    return reduce(DataFrame.unionByName, found)
