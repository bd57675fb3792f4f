"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Each document draws an exponential key, -ln(u) / w, with u from a hash of its id and text and w its quality weight; in
ascending order of keys, a source's documents are a weighted sample without replacement of every size.  A source's target
is met by whole epochs first, and by a prefix of that order for the rest: the last document is taken in part.

Prefix sums don't gather a source in one task: rows are cut into ranges of (source, key), as many rows in each whatever
their weights, sources and ties; sums of buckets, the ranges' parts of one source, are added up first, and windows run
inside buckets only.  Only numbers move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.llm import frames
from casegrain.llm.textkit import SPACE, word_chunks

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BUCKET_ROWS = 100_000  # and no fewer buckets than shuffle partitions
#: Their table is broadcast up to so many sources.
FEW_SOURCES = 100_000
#: Bytes that begin a code point other than white space, and those of ASCII punctuation.
_FIRST = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)
_MARK = np.zeros(256, dtype=bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its quality weight, 0.1 to 1: the share of code points other than ASCII punctuation among
    those that aren't ASCII white space (0.1 where there are none)."""
    size, weight = [np.zeros(0, np.int64)], [np.zeros(0)]
    for _, _, words in word_chunks(texts):
        per_text = lambda mask, w=words: np.diff(np.searchsorted(np.flatnonzero(mask), w.offsets))
        solid, marks = per_text(_FIRST[words.data]), per_text(_MARK[words.data])
        size.append(words.counts.astype(np.int64))
        weight.append(0.1 + 0.9 * np.divide((solid - marks).astype(float), solid, out=np.zeros(len(solid)), where=solid > 0))
    return np.concatenate(size), np.concatenate(weight)


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, source, u of each row, and its text's measures."""
    for batch in batches:
        size, weight = measures(batch.column("text"))
        kept = [batch.column(c) for c in ("doc_id", "source", "u")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(size), pa.array(weight)], names=["doc_id", "source", "u", "size", "weight"])


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1), the same on every run: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, source_rows, target of each source of (source, size) rows.

    Sources by code point, null last, weigh 5, 2, 1, repeating.  Targets share the total; those above MOST_EPOCHS times
    their source's size stop there and the excess goes to the others by weight: sources in ascending order of cap / weight
    stop as long as the share of the rest is above that.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    ranked = by_source.withColumn("i", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((F.col("i") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", MOST_EPOCHS * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", "i").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("final", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "i", "level"))).over(every)["level"])
    return ranked.select("source", "source_size", "source_rows", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Returns a row for each row of docs: doc_id, size (words; 0 for a null or wordless text), source, source_size, target
    (its source's), taken.  `taken` is at most MOST_EPOCHS times size; a source's sum is its target rounded to a word.
    Empty documents are taken 0 times; a source of such only has target 0.  Null doc_ids take part (their draws come from
    the text).  Repeated rows have equal keys and stand side by side.  An empty table gives none; other columns are not read.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), uniform(F.col(doc_id), t).alias("u"), t.alias("text"))
    sized = frames.map_batches(rows, measured, "doc_id long, source string, u double, size long, weight double")
    sized = sized.select("doc_id", "source", "size", (-F.log("u") / F.col("weight")).alias("key"))
    sized = frames.checkpointed(sized.withColumn("tie", F.monotonically_increasing_id()))
    goals = targets(sized)
    total = goals.agg(F.count(F.lit(1)), F.sum("source_rows")).first()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((total[1] or 0) / BUCKET_ROWS))
    order = ["key", "doc_id", "size", "tie"]
    ranged = frames.checkpointed(sized.repartitionByRange(buckets, "source", *order).withColumn("bucket", F.spark_partition_id()))
    sums = ranged.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    goal = goals.select(F.col("source").alias("g"), "source_size", "target")
    start = start.join(F.broadcast(goal) if total[0] <= FEW_SOURCES else goal, start["s"].eqNullSafe(goal["g"])).drop("g")
    rows = ranged.join(start, (ranged["bucket"] == start["b"]) & ranged["source"].eqNullSafe(start["s"]))
    inside = Window.partitionBy("bucket", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    words = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return rows.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))
