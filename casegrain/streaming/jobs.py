"""Streaming forms: incremental discovery, windowed counts with late data, idempotent upserts."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of new files below a folder; contents are not read."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def half_hours(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts of half hours and types; events later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "30 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start_ts"), "event_type", "n")


def _by(rows: DataFrame, others: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A semi or anti join on keys, nulls included."""
    named = others.select(*[F.col(k).alias(f"other_{i}") for i, k in enumerate(keys)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"other_{i}")) for i, k in enumerate(keys)])
    return rows.join(named, same, how)


def upsert_by_container(stream: DataFrame, target: str, checkpoint: str, container: str = "source", key: str | None = None) -> StreamingQuery:
    """Rows replace those of their container and key in the target; a batch that runs again gives the same table.

    Without a key equal rows replace each other.  Null keys and containers are equal.

    Only the containers of a batch are read and written anew: what stands there and is not replaced stays.  Of a batch's
    rows with one key the greatest row counts.  The merged rows are staged beside the checkpoint before the target changes.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = [container, key] if key else batch.columns
        new = batch.groupBy(*keys).agg(F.max(F.struct(*batch.columns)).alias("kept_row")).select("kept_row.*")
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            old = spark.read.schema(batch.schema).parquet(target)
            old = _by(old, new, [container], "left_semi")
            old = _by(old, new, keys, "left_anti")
            new = old.unionByName(new)
        staged = f"{checkpoint.rstrip('/')}-staged/{number}"
        new.write.mode("overwrite").parquet(staged)
        merged = spark.read.schema(new.schema).parquet(staged)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(container).parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def discover_containers(stream: DataFrame, target: str, checkpoint: str, found: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Containers among newly listed files (path, length), each path once in the target; `found` gets each batch's new ones."""
    from casegrain.operators import discovery

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = discovery.containers(batch.select("path", F.col("length").alias("size"))).withColumn("batch", F.lit(number).cast("long"))
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = rows.join(spark.read.schema(rows.schema).parquet(target).where(F.col("batch") != number).select("path"), "path", "left_anti")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)
        if found is not None:
            found(spark.read.schema(rows.schema).parquet(target).where(F.col("batch") == number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Fixed value: samples of a series that a running histogram keeps.
HISTORY = 10_000


def running_metrics(stream: DataFrame, target: str, checkpoint: str, history: int = HISTORY) -> StreamingQuery:
    """Counters, last values and the last `history` samples of each series (name, seq, value), updated batch by batch.

    target/N holds the state after batch N: totals (name, n, total, last_seq, last) and samples.  A batch that runs again
    starts from the state before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max(F.struct("seq", "value")).alias("last"))
        samples = batch.select("name", "seq", "value")
        if number:
            new = new.unionByName(spark.read.parquet(f"{target}/{number - 1}/totals"))
            samples = samples.unionByName(spark.read.parquet(f"{target}/{number - 1}/samples"))
        new.groupBy("name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last").alias("last")).write.mode("overwrite").parquet(f"{target}/{number}/totals")
        age = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("seq")))
        samples.withColumn("age", age).where(F.col("age") <= history).drop("age").write.mode("overwrite").parquet(f"{target}/{number}/samples")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Job:
    """An action with a name that can be asked how far it is, paused between its parts, and cancelled."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.done, self.total = spark, name, 0, 0
        self._go = threading.Event()
        self._go.set()
        self._stopped = False

    def run(self, parts: list[Callable[[], object]]) -> list[object]:
        """The results of the parts, one after the other, up to where the job is cancelled."""
        self.total, out = len(parts), []
        self.spark.addTag(self.name)
        try:
            for part in parts:
                self._go.wait()
                if self._stopped:
                    break
                out.append(part())
                self.done += 1
        finally:
            self.spark.removeTag(self.name)
        return out

    def progress(self) -> float:
        """Share of the parts that are done; 1 without any."""
        return self.done / self.total if self.total else 1.0

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def cancel(self) -> None:
        """Running Spark jobs are interrupted, and no further part starts."""
        self._stopped = True
        self._go.set()
        self.spark.interruptTag(self.name)


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
