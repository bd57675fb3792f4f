"""Sorted, paged and nested listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a page, least and most.
PAGE_ROWS = (1, 500)


def page(rows: DataFrame, order: list[str], number: int = 0, size: int = 100) -> DataFrame:
    """One page with total, has_more and the page size used, which is kept between 1 and 500."""
    size = min(max(size, PAGE_ROWS[0]), PAGE_ROWS[1])
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    out = rows.orderBy(*order).offset(number * size).limit(size).crossJoin(F.broadcast(total))  # one row
    return out.withColumn("has_more", F.col("total") > (number + 1) * size).withColumn("page_size", F.lit(size).cast("long"))


def latest(rows: DataFrame, ts: str, tie: str, most: int | None = None) -> DataFrame:
    out = rows.orderBy(F.desc(ts), F.desc(tie))
    return out if most is None else out.limit(most)


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows by an order, with their places rn; only they are numbered."""
    return rows.orderBy(*order).limit(most).withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))


def sheet_order(cell: Column) -> list[Column]:
    """Empty cells, then numbers by value, then texts whatever their case."""
    number = cell.try_cast("double")
    return [F.when(cell.isNull() | (cell == ""), 0).when(number.isNotNull(), 1).otherwise(2), F.coalesce(number, F.lit(0.0)), F.lower(F.coalesce(cell, F.lit("")))]


def hash_order() -> list[Column]:
    """Stored hashes of containers first, then by algorithm, then the newest; those without time last."""
    return [(F.col("source") != "container").cast("int"), F.col("algorithm"), F.desc_nulls_last("timestamp")]


def buckets(rows: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """kind and its rows, an array of structs in ascending order; for lists that a person looks at."""
    return rows.groupBy(kind).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))


def count_map(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """key and by_type, a map from kind to count; counted before they are gathered."""
    n = rows.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(kind, "n"))).alias("by_type"))


def map_union(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key and the union of its maps; of one map key the value of the earliest source_ordinal stays."""
    pairs = rows.select(key, "source_ordinal", F.explode(column).alias("k", "v"))
    first = pairs.groupBy(key, "k").agg(F.min_by("v", "source_ordinal").alias("v"))
    return first.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(column))
