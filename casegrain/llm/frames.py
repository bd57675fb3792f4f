"""Plan helpers of the training-data operators: sizes, checkpoints, graph components."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About this many bytes of text go to one group of rows that a Python task holds at once.
GROUP_BYTES = 4 << 20


#: The queries ask for Arrow batches of about this many bytes (a longer row goes alone), unless the session says otherwise.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

Batches = Iterator[pa.RecordBatch]
_own_folder = ""


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, told to send batches of BATCH_BYTES to Python where it says nothing of it; for those who own the session."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return spark


def map_batches(df: DataFrame, run: Callable[[Batches], Batches], schema) -> DataFrame:
    """df.mapInArrow; each task gives the memory it has freed back to the system."""

    def tidy(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Workers live on after a task, and their allocators keep what was freed: return it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fresh_name(taken: Iterable[str], stem: str) -> str:
    """A column name that none of `taken` equals, whatever the case."""
    names, k = {t.lower() for t in taken}, 0
    while f"{stem}_{k}" in names:
        k += 1
    return f"{stem}_{k}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of this process, but on a local master only."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder = _own_folder or tempfile.mkdtemp(prefix="checkpoints-")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again.

    Unlike DataFrame.checkpoint() this keeps no constraints of the old plan, which grow without bound in iterations, and
    gives the optimizer true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what checkpointed() wrote; nothing may read it any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def volume(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and bytes of text, over all rows."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text)))).first()
    return row[0], row[1] or 0


def groups_for(n_bytes: int) -> int:
    """How many groups keep each at about GROUP_BYTES."""
    return max(8, math.ceil(n_bytes / GROUP_BYTES))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph given by its edges: (node, root), root the least node reachable.

    Contraction: each round every node goes up to the neighbour (or itself) that is first in an order drawn anew, and on to
    where that one goes; the edges between what is left, a constant share of the nodes at most, are the next round's.  So all
    rounds together cost a few passes over the edges.  Nodes without an edge (a self-loop counts as one) are not returned.
    Null ends are ignored; repeated edges don't matter.
    """
    ways = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))
    both = checkpointed(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct())
    labels, turn = None, 0
    while True:
        drawn = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("o"), F.col(c).alias("v"))
        up = checkpointed(both.groupBy("a").agg(F.min(drawn("b")).alias("m")).select(F.col("a").alias("v"), F.least(drawn("a"), "m")["v"].alias("up")))
        step = checkpointed(up.join(up.select(F.col("v").alias("up"), F.col("up").alias("top")), "up").select("v", "top"))
        forget(up)
        if labels is None:
            labels = step.select(F.col("v").alias("node"), F.col("top").alias("root"))
        else:
            labels = checkpointed(labels.join(step, labels["root"] == step["v"], "left").select("node", F.coalesce("top", "root").alias("root")))
        left = both.join(step.select(F.col("v").alias("a"), F.col("top").alias("x")), "a").join(step.select(F.col("v").alias("b"), F.col("top").alias("y")), "b")
        left = checkpointed(left.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        forget(both)
        both, turn = left, turn + 1
        if not both.limit(1).count():
            forget(both)
            break
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return checkpointed(labels.join(least, "root").select("node", F.col("least").alias("root")))
