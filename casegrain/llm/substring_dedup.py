"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks of `window // 2` words; those blocks are the index, and every rolling
window of as many words probes it.  A repeated passage of `window` words always holds a whole block of the other
document, so no repeat is missed.  Probes and blocks meet on the least hash of the 8-word shingles inside them
(neighbouring windows mostly share it, so one record stands for a run of probes).  Around the hits, the hashes of all
`window`-word sequences decide exactly which words repeat; overlapping sequences join up to maximal repeats.

Only hashes move between tasks, packed into one binary value per (task, bucket).  A task sends at most one document's
occurrences of a sequence, the one with the smallest doc_id it has seen, since any other is already known to be a
repeat: a passage in a third of all rows costs one record per task.  Shuffles: the texts once (the three steps share that
exchange), the anchors, and the sequences near hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm import frames
from casegrain.llm.textkit import Words, expand, ids, word_chunks

ANCHOR = np.dtype([("m", "<u8"), ("doc", "<i8"), ("many", "u1"), ("block", "u1")])
SEQUENCE = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("row", "<i4"), ("at", "<i4")])
PLACE = np.dtype([("row", "<i4"), ("at", "<i4")])
_SHINGLE = 8
_SECOND = 0xA24BAED4963EE407


def _table(group: int, keys: list[int], blobs: list[bytes], buckets: list[int] | None = None) -> pa.Table:
    columns = {"pid": pa.array(keys, pa.int32()), "blob": pa.array(blobs, pa.binary())}
    if buckets is not None:
        columns = {"bucket": pa.array(buckets, pa.int32())} | columns
    return pa.table(columns)


def _ordered(docs: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of a group in an order that does not depend on how they arrived."""
    doc, null = ids(docs.column("doc_id"))
    key, _ = ids(docs.column("tkey"))
    order = np.lexsort((key, doc, null))
    return docs.take(pa.array(order)), doc[order], null[order]


def _runs(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of probes that share their least shingle hash: that hash, first and last probe (word number), whether one starts a block."""
    k, n = min(_SHINGLE, block), len(words.starts)
    left = np.repeat(words.counts, words.counts) - words.within
    grams = np.where(left >= k, words.ngrams(k), np.uint64(2**64 - 1))
    span, width, least = block - k + 1, 1, grams
    while width < span:  # least of span neighbours by doubling
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        width += step
    probes = np.flatnonzero(left >= block)
    if not len(probes):
        return np.zeros(0, np.uint64), probes, probes, np.zeros(0, bool)
    value = least[probes]
    doc = words.doc[probes]
    first = np.ones(len(probes), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(probes)) - 1
    starts_block = np.logical_or.reduceat(words.within[probes] % block == 0, at)
    return value[at], probes[at], probes[last], starts_block


def _split(rows: np.ndarray, by: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """Blobs of the rows by bucket."""
    bucket = (by % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n + 1))
    return [(int(b), rows[cuts[b] : cuts[b + 1]].tobytes()) for b in np.unique(bucket)]


def _join(blobs: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(b, kind) for b in blobs.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _anchors(block: int, buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        pid = docs.column("pid")[0].as_py()
        docs, doc, null = _ordered(docs)
        parts = []
        for row, end, words in word_chunks(docs.column("text")):
            m, lo, _, own = _runs(words, block)
            d = words.doc[lo] + row
            known = ~null[d]
            part = np.zeros(int(known.sum()), ANCHOR)
            part["m"], part["doc"], part["block"] = m[known], doc[d[known]], own[known]
            parts.append(part)
        rows = np.concatenate(parts) if parts else np.zeros(0, ANCHOR)
        if not len(rows):
            return _table(0, [], [], [])
        rows = rows[np.lexsort((rows["doc"], rows["m"]))]
        first = np.flatnonzero(np.append(True, rows["m"][1:] != rows["m"][:-1]))
        last = np.append(first[1:], len(rows)) - 1
        out = rows[first].copy()
        out["many"] = rows["doc"][first] != rows["doc"][last]
        out["block"] = np.maximum.reduceat(rows["block"], first)
        out = out[np.argsort(out["doc"], kind="stable")]  # equal ids side by side compress
        found = _split(out, out["m"], buckets)
        return _table(0, [pid] * len(found), [b for _, b in found], [k for k, _ in found])

    return run


def _live(group: pa.Table) -> pa.Table:
    """Least hashes that two documents share and that lie in an indexed block, back to the groups they came from."""
    rows = _join(group.column("blob"), ANCHOR)
    pid = np.repeat(np.asarray(group.column("pid")), [len(b) // ANCHOR.itemsize for b in group.column("blob").to_pylist()])
    order = np.lexsort((rows["doc"], rows["m"]))
    rows, pid = rows[order], pid[order]
    first = np.flatnonzero(np.append(True, rows["m"][1:] != rows["m"][:-1]))
    size = np.diff(np.append(first, len(rows)))
    shared = np.maximum.reduceat(rows["many"], first).astype(bool) | (rows["doc"][first] != rows["doc"][first + size - 1])
    live = np.repeat(shared & np.maximum.reduceat(rows["block"], first).astype(bool), size)
    m, pid = rows["m"][live], pid[live]
    order = np.argsort(pid, kind="stable")
    m, pid = m[order], pid[order]
    keys, cuts = np.unique(pid, return_index=True)
    return _table(0, keys.tolist(), [p.tobytes() for p in np.split(m, cuts[1:])] if len(keys) else [])


def _sequences(window: int, block: int, buckets: int):
    def run(key: tuple, docs: pa.Table, live: pa.Table) -> pa.Table:
        pid = key[0].as_py()
        hits = np.unique(_join(live.column("blob"), np.dtype("<u8")))
        if not len(hits) or not docs.num_rows:
            return _table(0, [], [], [])
        docs, doc, null = _ordered(docs)
        parts = []
        for row, end, words in word_chunks(docs.column("text")):
            m, lo, hi, _ = _runs(words, block)
            at = np.searchsorted(hits, m)
            found = (hits[np.minimum(at, len(hits) - 1)] == m) & ~null[words.doc[lo] + row]
            if not found.any():
                continue
            d = words.doc[lo[found]]
            base, stop = words.pointers[d], words.pointers[d + 1] - window
            a, b = np.maximum(lo[found] - (window - block), base), np.minimum(hi[found], stop)
            a, b = a[b >= a], b[b >= a]
            mark = np.zeros(len(words.starts) + 1, np.int32)
            np.add.at(mark, a, 1)
            np.add.at(mark, b + 1, -1)
            start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            if not len(start):
                continue
            part = np.zeros(len(start), SEQUENCE)
            part["h"] = words.spans(start, start + window)
            part["g"] = (words.spans(start, start + window, _SECOND) >> np.uint64(32)).astype(np.uint32)
            own = words.doc[start]
            part["row"], part["at"], part["doc"] = own + row, start - words.pointers[own], doc[own + row]
            parts.append(part)
        if not parts:
            return _table(0, [], [], [])
        keep, lost = _decide(np.concatenate(parts))
        found = _split(keep, keep["h"], buckets)
        keys, blobs, where = [pid] * len(found), [b for _, b in found], [k for k, _ in found]
        if len(lost):
            keys, blobs, where = [*keys, -1 - pid], [*blobs, _places(lost)], [*where, pid % buckets]
        return _table(0, keys, blobs, where)

    return run


def _decide(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each sequence, what stands in its smallest document, and the rest."""
    rows = rows[np.lexsort((rows["doc"], rows["g"], rows["h"]))]
    new = np.append(True, (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1]))
    first = np.flatnonzero(new)
    least = np.repeat(rows["doc"][first], np.diff(np.append(first, len(rows))))
    return rows[rows["doc"] == least], rows[rows["doc"] != least]


def _places(rows: np.ndarray) -> bytes:
    out = np.zeros(len(rows), PLACE)
    out["row"], out["at"] = rows["row"], rows["at"]
    return out.tobytes()


def _repeats(group: pa.Table) -> pa.Table:
    """Places whose sequence starts in a smaller document, by the group of their document."""
    pids, blobs = group.column("pid").to_pylist(), group.column("blob").to_pylist()
    out = [(-1 - p, b) for p, b in zip(pids, blobs, strict=True) if p < 0]
    sent = [(p, np.frombuffer(b, SEQUENCE)) for p, b in zip(pids, blobs, strict=True) if p >= 0]
    if sent:
        rows = np.concatenate([x for _, x in sent])
        pid = np.repeat([p for p, _ in sent], [len(x) for _, x in sent])
        order = np.lexsort((rows["doc"], rows["g"], rows["h"]))
        rows, pid = rows[order], pid[order]
        new = np.append(True, (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1]))
        first = np.flatnonzero(new)
        least = np.repeat(rows["doc"][first], np.diff(np.append(first, len(rows))))
        lost = rows["doc"] != least
        rows, pid = rows[lost], pid[lost]
        order = np.argsort(pid, kind="stable")
        rows, pid = rows[order], pid[order]
        keys, cuts = np.unique(pid, return_index=True)
        out += [(int(k), _places(x)) for k, x in zip(keys, np.split(rows, cuts[1:]), strict=True)] if len(keys) else []
    return _table(0, [k for k, _ in out], [b for _, b in out])


_RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


def _cut(window: int):
    def run(key: tuple, docs: pa.Table, places: pa.Table) -> pa.Table:
        docs, doc, null = _ordered(docs)
        places = _join(places.column("blob"), PLACE)
        places = places[np.argsort(places["row"], kind="stable")]
        cuts = np.searchsorted(places["row"], np.arange(docs.num_rows + 1))
        n_words, n_removed, kept, removed = [], [], [], []
        for i, text in enumerate(docs.column("text")):
            words = (text.as_py() or "").encode().split()  # bytes split at the six ASCII white spaces
            n_words.append(len(words))
            at = places["at"][cuts[i] : cuts[i + 1]]
            if not len(at):
                n_removed.append(0)
                removed.append([])
                kept.append(b" ".join(words).decode())
                continue
            mark = np.zeros(len(words) + 1, np.int32)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + window, -1)
            gone = np.cumsum(mark[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            removed.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([words[j] for j in np.flatnonzero(~gone)]).decode())
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"doc_id": pa.array(doc, pa.int64(), mask=null), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "removed": pa.array(removed, spans)})

    return run


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """Remove every word that a `window`-word sequence covers which also starts in a document with a smaller id.

    Returns one row per row of `docs`: doc_id, n_words, n_removed, kept_text (kept words joined by one space) and
    removed (word ranges, end exclusive: the maximal repeats).  Sequences are judged on the input.

    Null or empty text: no words, nothing removed, kept_text empty.  Null doc_id: the row is returned as it is and neither
    removes nor loses words.  Rows with one doc_id don't remove from each other.  An empty table gives an empty result.
    Other columns of `docs` are not read, whatever their names.  `window` must be even and at least 16.
    """
    if window < 16 or window % 2:
        raise ValueError("window must be even and at least 16")
    block = window // 2
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = frames.groups_for(frames.volume(docs, "text")[1])
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("pid"))
    packed, back = "bucket int, pid int, blob binary", "pid int, blob binary"
    anchors = rows.groupBy("pid").applyInArrow(_anchors(block, n), packed)
    live = anchors.groupBy("bucket").applyInArrow(_live, back)
    near = rows.groupBy("pid").cogroup(live.groupBy("pid")).applyInArrow(_sequences(window, block, n), packed)
    places = near.groupBy("bucket").applyInArrow(_repeats, back)
    return rows.groupBy("pid").cogroup(places.groupBy("pid")).applyInArrow(_cut(window), _RESULT)
