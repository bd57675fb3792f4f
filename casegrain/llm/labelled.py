"""What the two classifiers share: the rows they may learn from, and the bound of the sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from: crc32 of the doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(y, text) of at most `rows` labelled rows of each class that may be learnt from, picked by a hash of doc_id.

    Rows with a null doc_id, label or text are left out.  Of rows with one doc_id and label the least text counts.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("y")).where(F.col("__id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("__id")))
    picked = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(picked.distinct()), "__id")  # bounded by 2 * rows
    return found.groupBy("__id", "y").agg(F.min("text").alias("text"))
