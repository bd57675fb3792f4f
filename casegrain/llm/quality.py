"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

Terms are the byte pairs of a text, hashed to `TERMS` columns, weighted log(1 + count) * idf.  A truncated singular value
decomposition of a bounded sample of labelled rows gives the latent space; the labelled vectors in it are broadcast
(SAMPLE_ROWS * 2 * RANK floats, whatever the corpus).  Every document is projected, its cosines with all labelled vectors
are computed exactly in blocks, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm import frames
from casegrain.llm.labelled import held_out, sample
from casegrain.llm.textkit import chunks

#: At most so many labelled rows of each class are learnt from.
SAMPLE_ROWS = 2500
TERMS, RANK, NEIGHBOURS, SHARPNESS = 4096, 48, 25, 12


def counts(texts: pa.Array, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """log(1 + count) of each hashed byte pair, for pieces of the texts: float32 (rows, TERMS)."""
    for _, _, data, offsets in chunks(texts, size):
        n = len(offsets) - 1
        for a in range(0, n, 256):
            b = min(n, a + 256)
            raw, cut = data[offsets[a] : offsets[b]].astype(np.uint32), offsets[a : b + 1] - offsets[a]
            pair = ((raw[:-1] * np.uint32(257) + raw[1:]) * np.uint32(2654435761)) >> np.uint32(20)
            doc = np.repeat(np.arange(b - a), np.diff(cut))[: len(pair)]
            inner = np.ones(len(pair), bool)
            inner[cut[1:-1][(cut[1:-1] > 0) & (cut[1:-1] <= len(pair))] - 1] = False  # a pair across two texts
            at = doc[inner] * TERMS + pair[inner]
            yield np.log1p(np.bincount(at, minlength=(b - a) * TERMS).reshape(b - a, TERMS).astype(np.float32))


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        x = (x * self.idf) @ self.basis
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors; a vector without length gets the prior."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        own = self.project(x)
        cosine = own @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, None).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 0, np.clip(vote / np.where(total > 0, total, 1), 0, 1), self.prior)


def learn(labels: np.ndarray, x: np.ndarray) -> Model:
    """The model from labels and count rows.  Without rows, or with one class only, every score is the share of class 1."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or len(set(labels.tolist())) < 2:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    weighted = x * idf
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
    rank = min(RANK, *weighted.shape)
    q = np.random.default_rng(7).standard_normal((TERMS, rank + 8)).astype(np.float32)
    for _ in range(4):  # randomised subspace iteration
        q, _ = np.linalg.qr(weighted.T @ (weighted @ q))
    _, _, vt = np.linalg.svd(weighted @ q, full_matrices=False)
    basis = (q @ vt.T)[:, :rank].astype(np.float32)
    model = Model(idf, basis, np.zeros((0, rank), np.float32), labels.astype(np.float64), prior)
    model.vectors = model.project(x).astype(np.float32)
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r.astype(np.float16).tobytes() for part in counts(batch.column("text")) for r in part]
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("y"), pa.array(rows, pa.binary())], names=["__id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most `rows` labelled rows of each class, never from held-out ones; only their counts come to the driver."""
    found = frames.map_batches(sample(docs, labels, "quality", rows), _counted, "__id long, y int, x binary").orderBy("__id", "x").collect()
    x = np.array([np.frombuffer(r["x"], np.float16) for r in found], np.float32).reshape(-1, TERMS)
    return learn(np.array([r["y"] for r in found], np.int64), x)


def score_quality(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= threshold) of every row, from its text alone.

    A null, empty or one-byte text has no terms and gets the share of class 1 in the sample.  No shuffle; rows are
    independent; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(x) for x in counts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    out = frames.map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score_quality(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
