"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line that has words) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors: the order of paragraphs doesn't matter, and adding or subtracting a paragraph's vector inserts or
deletes it without the rest of the text (`combine`).  The vector has two parts:

* 32 64-bit words of the paragraph's SHAKE-128 digest, summed modulo 2**64: equality of multisets;
* 256 sums, modulo 2**32, of the random signs of the paragraph's three-word shingles: the inner product of two
  fingerprints estimates that of the shingle counts, so likeness is graded (standard error about 1/16).  A text holds
  less than 2**31 bytes, so no sum of one text wraps.

A fingerprint is the base64 text of those 1280 bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256, shake_128

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.llm import frames
from casegrain.llm.textkit import Words, chunks, mix64

STRONG, SIGNS, SHINGLE = 32, 256, 3
#: Documents go to at most so many ranges of ids; the bounds of the ranges are all that is broadcast.
RANGES = 20_000
#: Signs are drawn for so many shingles at once.
SHINGLES_AT_ONCE = 1 << 16
_SALTS = mix64(np.arange(1, SIGNS // 64 + 1, dtype=np.uint64))


def sums(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two parts for each text: uint64 (n, 32) and int32 (n, 256)."""
    strong = np.zeros((len(texts), STRONG), np.uint64)
    signs = np.zeros((len(texts), SIGNS), np.int32)
    for row, _, data, offsets in chunks(texts, 1 << 18):
        edges = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
        words = Words(data, edges)
        full = np.flatnonzero(words.counts)
        owner = row + np.searchsorted(offsets, edges[full], "right") - 1
        for i, p in enumerate(full):
            raw = data[edges[p] : edges[p + 1]].tobytes().rstrip(b"\n")
            strong[owner[i]] += np.frombuffer(shake_128(raw).digest(8 * STRONG), "<u8")
        room = np.repeat(words.counts, words.counts) - words.within >= SHINGLE
        short = full[words.counts[full] < SHINGLE]
        h = np.concatenate([words.ngrams(SHINGLE)[room], words.spans(words.pointers[short], words.pointers[short + 1])])
        doc = np.concatenate([row + np.searchsorted(offsets, words.starts[room], "right") - 1, row + np.searchsorted(offsets, edges[short], "right") - 1])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
        for lo in range(0, len(doc), SHINGLES_AT_ONCE):
            part, own = h[lo : lo + SHINGLES_AT_ONCE], doc[lo : lo + SHINGLES_AT_ONCE]
            ones = np.unpackbits(np.stack([mix64(part ^ s) for s in _SALTS], axis=1).view(np.uint8), axis=1)
            keys, first = np.unique(own, return_index=True)
            for d, a, b in zip(keys, first, np.append(first[1:], len(own)), strict=True):
                signs[d] += (2 * ones[a:b].sum(axis=0, dtype=np.int64) - (b - a)).astype(np.int32)
    return strong, signs


def to_text(strong: np.ndarray, signs: np.ndarray) -> str:
    return base64.b64encode(strong.astype("<u8").tobytes() + signs.astype("<i4").tobytes()).decode()


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * STRONG], "<u8"), np.frombuffer(raw[8 * STRONG :], "<i4")


def combine(a: str, b: str, delete: bool = False) -> str:
    """The fingerprint of a's paragraphs with b's inserted (or deleted)."""
    (s, t), (u, v) = from_text(a), from_text(b)
    return to_text(s - u, t - v) if delete else to_text(s + u, t + v)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dice likeness of shingle counts that rows of signs a and b estimate, 0 to 1; two without shingles are alike."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    scale = (a * a).sum(axis=1) + (b * b).sum(axis=1)
    return np.where(scale > 0, np.clip(2 * (a * b).sum(axis=1) / np.where(scale > 0, scale, 1), 0, 1), 1.0)


_PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_text string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_text", pa.string())])


def _pairs(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next one is still to come
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            strong, signs = sums(batch.column("text"))
            if held:
                ids, texts = [held[0], *ids], [held[1], *texts]
                strong, signs = np.vstack([held[2], strong]), np.vstack([held[3], signs])
            n = len(ids) - 1
            held = (ids[-1], texts[-1], strong[-1:], signs[-1:])
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts[:-1], texts[1:], strict=True)]
            e_strong, e_signs = sums(pa.array(edited, pa.large_string()))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([to_text(strong[i], signs[i]) for i in range(n)], pa.string()), pa.array([to_text(e_strong[i], e_signs[i]) for i in range(n)], pa.string()),
                pa.array(likeness(signs[:-1], e_signs)), pa.array(likeness(signs[:-1], signs[1:])), pa.array(edited if keep_text else [None] * n, pa.string()),
            ], schema=_SCHEMA)

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Fingerprints of every document and of its edited text: its last floor(n/2) code points replaced by as many (or all) first ones of the next document.

    Next is by ascending doc_id (nulls first; equal ids by a hash of the text; after the last: the first; a single document
    follows itself).  Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    edited_text (null unless keep_text).

    A null text is empty; an empty one has the fingerprint of no paragraphs.  Repeated rows follow each other.  An empty
    table gives none.  Other columns are not read.

    Texts move once: rows go to ranges of (id, hash of the text), and only each range's first document is sent to the range
    before it too.  Ids and hashes alone are sampled for the bounds, RANGES of them at most; a range is sorted by Spark,
    which spills, and met in a stream.  Rows that are equal in id and text stay in one range, however many they are.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    n = min(RANGES, frames.groups_for(frames.volume(rows, "text")[1]))
    order = [F.asc_nulls_first("doc_id"), F.asc("tkey")]
    first = rows.select("doc_id", "tkey").repartitionByRange(n, *order).groupBy(F.spark_partition_id()).agg(F.min(_key()).alias("k")).select("k.*").collect()
    place = _place(docs.sparkSession, sorted((r["known"], r["doc_id"], r["tkey"]) for r in first))
    rows = rows.withColumn("at", place(*[_key()[c] for c in ("known", "doc_id", "tkey")]))
    heads = rows.where("at.head").groupBy("doc_id", "tkey", F.col("at.before").alias("part")).agg(F.min("text").alias("text")).withColumn("last", F.lit(1))
    both = rows.select("doc_id", "tkey", "text", F.col("at.part").alias("part"), F.lit(0).alias("last")).unionByName(heads)
    placed = both.repartitionById(max(1, len(first)), F.col("part")).sortWithinPartitions("last", *order, "text")
    return frames.map_batches(placed.select("doc_id", "text"), _pairs(keep_text), _PAIRS)


def _key() -> Column:
    """What rows are ordered by, without nulls."""
    return F.struct(F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("tkey").alias("tkey"))


def _place(spark: SparkSession, first: list[tuple[int, int, int]]):
    """A UDF of a row's key: its range, the range before it, and whether it is the first of its range."""
    shared = spark.sparkContext.broadcast(np.array(first, "i8,i8,i8") if first else np.zeros(0, "i8,i8,i8"))  # at most RANGES keys

    @F.pandas_udf("part int, before int, head boolean")
    def place(known: pd.Series, doc_id: pd.Series, tkey: pd.Series) -> pd.DataFrame:
        keys = np.empty(len(known), "i8,i8,i8")
        keys["f0"], keys["f1"], keys["f2"] = known, doc_id, tkey
        part = np.searchsorted(shared.value, keys, "right") - 1
        return pd.DataFrame({"part": part, "before": (part - 1) % len(shared.value), "head": shared.value[part] == keys})

    return place
