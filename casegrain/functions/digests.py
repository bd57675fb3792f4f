"""Digests that Spark has no function for, over Arrow batches, and digests of byte sequences in parts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.functions import blake3

MADE: dict[str, Callable] = {"blake2b": hashlib.blake2b, "xxh64": xxhash.xxh64, "xxh3": xxhash.xxh3_128, "md5": hashlib.md5, "sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha512": hashlib.sha512}


def digest(content: Column, algorithm: str) -> Column:
    """Lower-case hex digest of binary values: blake2b (64 bytes), blake3, xxh64 and xxh3 (128 bits) with seed 0; null of null."""
    if algorithm == "blake3":
        return F.pandas_udf(_blake3, "string")(content)
    made = MADE[algorithm]

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else made(bytes(v)).hexdigest())

    return run(content)


#: BLAKE3 takes about this many bytes of values at once (a longer value goes alone).
TOGETHER = 4 << 20


def _blake3(values: pd.Series) -> pd.Series:
    found, waiting, held = {}, [], 0

    def finish() -> None:
        found.update(zip(waiting, blake3.digests([bytes(values.iat[i]) for i in waiting]), strict=True))
        waiting.clear()

    for i, value in enumerate(values):
        if value is not None:
            waiting.append(i)
            held += len(value) + blake3.CHUNK
            if held >= TOGETHER:
                finish()
                held = 0
    finish()
    return pd.Series([found.get(i) for i in range(len(values))], dtype="object")


def combined(parts: DataFrame, key: str, order: str, content: str, algorithm: str = "sha256") -> DataFrame:
    """key, segments, digest: one digest of each set's parts one after the other, in order.

    A set is met in a stream by one task, as its digest can only be worked out in order; no part but the present one is held.
    """
    made, names = MADE[algorithm], (key, content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n, own = None, 0, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([own], pa.string()), pa.array([n], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=[names[0], "segments", "digest"])
        for batch in batches:
            for k, value in zip(batch.column(names[0]).to_pylist(), batch.column(names[1]), strict=True):
                if state is None or k != own:
                    if state is not None:
                        yield done()
                    state, n, own = made(), 0, k
                state.update(value.as_buffer() if value.is_valid else b"")
                n += 1
        if state is not None:
            yield done()

    placed = parts.select(F.col(key).cast("string").alias(key), order, content).repartition(key).sortWithinPartitions(key, order)
    return placed.mapInArrow(run, f"`{key}` string, segments long, digest string")
