"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, and an overlap check.

The index holds the test items, in parts of about ITEMS_AT_ONCE, so what a task gets is bounded however many there are.
Term frequencies, the number of items and their mean length are those of all items, so scores don't depend on the parts.
Every passage of every training document is a query.  WAND in three steps, each over all passages of a piece at once:

* pivot: a passage whose terms' greatest impacts over the whole index don't add up to the least threshold ends there;
* block maxima: items stand in blocks of similar full score, each with its greatest impact of every term; a block whose
  sum stays under the least threshold of its items is skipped;
* only what is left is scored in full.

All items that reach their threshold are retrieved.  A document is contaminated by an item when enough of the item's word
shingles stand near the passages that retrieved it: of its question part and, where the item has one, of its answer part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm import frames
from casegrain.llm.textkit import Words, buffers, chunks, expand

K1, B = 1.2, 0.75
PASSAGE, STRIDE = 64, 32
#: An item is retrieved at this share of its full score (its score with itself as query).
SHARE = 0.5
#: Least share of word shingles that must be found, of the question and of the answer part (shorter shingles in parts under ten words).
OVERLAP, SHINGLE = 0.5, 5
#: Items in a part of the index, parts that one pass over the documents meets, items in a block.
ITEMS_AT_ONCE, PARTS_AT_ONCE, BLOCK = 2000, 8, 8
#: Passages scored at once; a longer text goes on in the next round.
PASSAGES_AT_ONCE = 8192

#: Case and ASCII punctuation don't tell words apart.
_NORM = np.arange(256, dtype=np.uint8)
_NORM[65:91] += 32
_NORM[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
_ANSWER = re.compile(r"(?:\banswer\s*:|\bA:|\?)(?=\s*\S)", re.IGNORECASE)


def parts(text: str) -> tuple[str, str]:
    """Question and answer: cut after the last question mark or answer sign; without one the whole text is the question."""
    cut = [m.end() for m in _ANSWER.finditer(text)]
    return (text[: cut[-1]], text[cut[-1] :]) if cut else (text, "")


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(_NORM[data], offsets)


def _grams(text: str) -> tuple[np.ndarray, int]:
    """The distinct shingles of a part, and how many words each has."""
    w = _words(*buffers(pa.array([text])))
    n = max(1, min(SHINGLE, len(w.starts) // 2))
    at = np.arange(max(0, len(w.starts) - n + 1))
    return np.unique(w.spans(at, at + n)), n


@dataclass
class Statistics:
    """What BM25 needs to know of all items: their number, their mean length in words, and in how many each term is."""

    items: int
    mean: float
    terms: np.ndarray  # sorted hashes; those of the part of the index are enough
    df: np.ndarray

    @classmethod
    def of(cls, w: Words) -> Statistics:
        terms, term = np.unique(w.hashes, return_inverse=True)
        pair = np.unique(w.doc * max(len(terms), 1) + term.reshape(-1))
        return cls(len(w.counts), float(w.counts.sum()) / max(len(w.counts), 1), terms, np.bincount(pair % max(len(terms), 1), minlength=len(terms)))


class Index:
    """Items sorted by full score, impacts of common terms as a dense matrix, of the others as postings."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        texts = [t for _, t in items]
        w = _words(*buffers(pa.array(texts, pa.large_string())))
        every = statistics or Statistics.of(w)
        self.vocabulary, term = np.unique(w.hashes, return_inverse=True)
        term, v, n = term.reshape(-1), len(self.vocabulary), len(items)
        pair, tf = np.unique(w.doc * max(v, 1) + term, return_counts=True)
        item, term = pair // max(v, 1), pair % max(v, 1)
        df = every.df[np.searchsorted(every.terms, self.vocabulary)]
        idf = np.log(1 + (every.items - df + 0.5) / (df + 0.5))
        length = w.counts / max(every.mean, 1e-9)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item]))
        full = np.bincount(item, impact, minlength=n)
        order = np.argsort(full, kind="stable")
        item = np.argsort(order)[item]
        self.ids, self.length = [items[i][0] for i in order], w.counts[order]
        self.threshold = (SHARE * full * np.minimum(1, 0.75 * PASSAGE / np.maximum(w.counts, 1)))[order]
        self.threshold[full[order] == 0] = np.inf  # items without words match nothing
        halves = [parts(texts[i]) for i in order]
        self.question, self.answer = [_grams(q) for q, _ in halves], [_grams(a) for _, a in halves]
        self.blocks = -(-n // BLOCK)
        self.block_threshold = np.minimum.reduceat(self.threshold, np.arange(0, n, BLOCK))
        self.most = np.zeros(v)
        np.maximum.at(self.most, term, impact)
        within = np.bincount(term, minlength=v)
        common = np.flatnonzero(within > max(4, 0.1 * n))
        self.common = np.full(v, -1)
        self.common[common] = np.arange(len(common))
        dense = self.common[term] >= 0
        padded = np.zeros((len(common), self.blocks * BLOCK))
        padded[self.common[term[dense]], item[dense]] = impact[dense]
        self.dense = padded[:, :n]
        self.dense_max = padded.reshape(len(common), self.blocks, BLOCK).max(axis=2)
        term, item, impact = term[~dense], item[~dense], impact[~dense]
        order = np.lexsort((item, term))
        self.item, self.impact = item[order], impact[order]
        self.at = np.searchsorted(term[order], np.arange(v + 1))
        key, first = np.unique(term[order] * self.blocks + self.item // BLOCK, return_index=True)
        self.top_block = key % self.blocks
        self.top = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.top_at = np.searchsorted(key // self.blocks, np.arange(v + 1))

    def retrieve(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, best score of a passage) of all items that reach their threshold."""
        return self.located(words)[:3]

    def located(self, words: Words) -> tuple[np.ndarray, ...]:
        """(document, item, best score, first passage, last passage) of all items that reach their threshold in a passage."""
        v, n = len(self.vocabulary), len(self.ids)
        count = np.maximum(1, -(-(words.counts - PASSAGE) // STRIDE) + 1) * (words.counts > 0)  # passages of each document
        base = np.cumsum(count) - count
        hits: list[tuple[np.ndarray, ...]] = []
        if v and len(words.starts):
            term = np.minimum(np.searchsorted(self.vocabulary, words.hashes), v - 1)
            known = np.flatnonzero(self.vocabulary[term] == words.hashes)
            doc, step = words.doc[known], words.within[known] // STRIDE
            late = np.minimum(step, count[doc] - 1)
            early = np.maximum(late - (PASSAGE // STRIDE - 1), 0)
            early = np.where(words.within[known] < early * STRIDE + PASSAGE, early, late)
            pair = np.unique(np.concatenate([base[doc] + late, base[doc] + early]) * v + np.concatenate([term[known], term[known]]))
            passage, term = pair // v, pair % v
            reach = np.bincount(passage, self.most[term], minlength=int(count.sum()))
            pivot = reach >= self.threshold.min() * (1 - 1e-9)
            live, place = np.flatnonzero(pivot), np.cumsum(pivot) - 1
            kept = pivot[passage]
            passage, term = place[passage[kept]], term[kept]
            for lo in range(0, len(live), PASSAGES_AT_ONCE):
                hi = min(len(live), lo + PASSAGES_AT_ONCE)
                a, b = np.searchsorted(passage, [lo, hi])
                p, item, score = self._score(passage[a:b] - lo, term[a:b], hi - lo)
                hits.append((live[p + lo], item, score))
        if not any(len(h[0]) for h in hits):
            return (*[np.zeros(0, np.int64)] * 2, np.zeros(0), *[np.zeros(0, np.int64)] * 2)
        passage, item, score = (np.concatenate(x) for x in zip(*hits, strict=True))
        doc = np.searchsorted(base + count, passage, "right")
        pair, first, back = np.unique(doc * n + item, return_index=True, return_inverse=True)
        best, lowest, highest = np.zeros(len(pair)), np.full(len(pair), 1 << 62), np.zeros(len(pair), np.int64)
        back, passage = back.reshape(-1), passage - base[doc]
        np.maximum.at(best, back, score)
        np.minimum.at(lowest, back, passage)
        np.maximum.at(highest, back, passage)
        return doc[first], item[first], best, lowest, highest

    def _score(self, passage: np.ndarray, term: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of the items that reach their threshold in one of `total` passages, whose terms are given."""
        n = len(self.ids)
        dense = self.common[term] >= 0
        terms = np.zeros((total, len(self.dense)))
        terms[passage[dense], self.common[term[dense]]] = 1
        rare_p, rare_t = passage[~dense], term[~dense]
        many = np.diff(self.top_at)[rare_t]
        at = expand(self.top_at[rare_t], many)
        bound = terms @ self.dense_max + np.bincount(np.repeat(rare_p, many) * self.blocks + self.top_block[at], self.top[at], minlength=total * self.blocks).reshape(total, self.blocks)
        alive = bound >= self.block_threshold * (1 - 1e-9)
        keep = alive.any(axis=1)[rare_p]
        rare_p, rare_t = rare_p[keep], rare_t[keep]
        many = np.diff(self.at)[rare_t]
        at = expand(self.at[rare_t], many)
        p, item, impact = np.repeat(rare_p, many), self.item[at], self.impact[at]
        keep = alive[p, item // BLOCK]
        p, item, impact = p[keep], item[keep], impact[keep]
        order = np.argsort(item // BLOCK, kind="stable")
        p, item, impact = p[order], item[order], impact[order]
        cut = np.searchsorted(item // BLOCK, np.arange(self.blocks + 1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for b in np.flatnonzero(alive.any(axis=0)):
            rows = np.flatnonzero(alive[:, b])
            lo, hi = b * BLOCK, min(n, (b + 1) * BLOCK)
            s = slice(cut[b], cut[b + 1])
            score = terms[rows] @ self.dense[:, lo:hi]
            score = score + np.bincount(np.searchsorted(rows, p[s]) * (hi - lo) + item[s] - lo, impact[s], minlength=len(rows) * (hi - lo)).reshape(len(rows), hi - lo)
            r, c = np.nonzero(score >= self.threshold[lo:hi] * (1 - 1e-9))
            found.append((rows[r], lo + c, score[r, c]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def leaks(self, words: Words) -> list[tuple[int, int, float, float, float]]:
        """(document, item_id, score, question overlap, answer overlap) of the verified items.

        Shingles are looked for from an item's length before the first passage that retrieved it to as much after the last.
        """
        out = []
        for doc, item, score, first, last in zip(*self.located(words), strict=True):
            a, b = words.pointers[doc : doc + 2]
            a, b = max(a, a + first * STRIDE - self.length[item]), min(b, a + last * STRIDE + PASSAGE + self.length[item])
            q, answer = (self._found(side[item], words, a, b) for side in (self.question, self.answer))
            if q >= OVERLAP and answer >= OVERLAP:
                out.append((int(doc), self.ids[item], float(score), q, answer))
        return out

    @staticmethod
    def _found(side: tuple[np.ndarray, int], words: Words, a: int, b: int) -> float:
        """Share of the shingles of one side that stand in the words a..b; 1 where the side has none."""
        wanted, k = side
        at = np.arange(a, max(a, b - k + 1))
        return float(np.isin(wanted, words.spans(at, at + k)).mean()) if len(wanted) else 1.0


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, h, c): c items of the part have the term h; h is null in a row with the part's words."""
    for batch in batches:
        part = np.asarray(batch.column("part").cast(pa.int64()))
        for row, end, data, offsets in chunks(batch.column("t")):
            w = _words(data, offsets)
            pair = np.unique(np.stack([w.doc, w.hashes.view(np.int64)]), axis=1)
            own = part[row:end]
            k, c = np.unique(np.stack([own[pair[0]], pair[1]]), axis=1, return_counts=True)
            null = np.append(np.zeros(len(c), bool), np.ones(end - row, bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(k[0], own)), pa.array(np.append(k[1], own), mask=null), pa.array(np.append(c, w.counts).astype(np.int64))], names=["part", "h", "c"])


def _parted(items: DataFrame) -> Iterator[list[Index]]:
    """The index in parts of about ITEMS_AT_ONCE items, PARTS_AT_ONCE of them at a time; items have part, i and t.

    Statistics of all parts are gathered on the executors.
    """
    counts = frames.checkpointed(frames.map_batches(items.select("part", "t"), _term_counts, "part long, h long, c long"))
    n, total = counts.where("h is null").agg(F.count(F.lit(1)), F.sum("c")).first()
    known = counts.where("h is not null")
    df = known.groupBy("h").agg(F.sum("c").alias("df"))
    df = frames.checkpointed(known.select("part", "h").distinct().join(df, "h"))
    last = items.agg(F.max("part")).first()[0]
    for lo in range(0, last + 1, PARTS_AT_ONCE):
        near = F.col("part").between(lo, lo + PARTS_AT_ONCE - 1)
        texts: dict[int, list] = {}
        for row in items.where(near).collect():  # about ITEMS_AT_ONCE * PARTS_AT_ONCE items
            texts.setdefault(row["part"], []).append((row["i"], row["t"]))
        terms = df.where(near).toArrow()
        part, h, c = (np.asarray(terms.column(x).combine_chunks()) for x in ("part", "h", "df"))
        found = []
        for k in sorted(texts):
            hashes, freq = h[part == k].view(np.uint64), c[part == k]
            order = np.argsort(hashes)
            found.append(Index(sorted(texts[k]), Statistics(n, total / n, hashes[order], freq[order])))
        yield found
    frames.forget(counts, df)


_LEAKS = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"
_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))


def _search(frame: DataFrame, indexes: list[Index], text: str, out: str, schema) -> DataFrame:
    """One pass over the documents with some parts of the index; what they find is added to the lists."""
    shared = frame.sparkSession.sparkContext.broadcast(indexes)  # bounded: see _parted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(out)
            lists = [x or [] for x in batch.column(place).to_pylist()]
            for row, _, data, offsets in chunks(batch.column(text)):
                words = _words(data, offsets)
                for index in shared.value:
                    for doc, item, score, q, a in index.leaks(words):
                        lists[row + doc].append({"item_id": item, "score": score, "question": q, "answer": a})
            yield batch.set_column(place, pa.field(out, _TYPE), pa.array(lists, _TYPE))

    return frames.map_batches(frame, run, schema)


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "leaks", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with one more column `out`: the test items found in each text, by item_id, with BM25 score and overlaps.

    A null or empty text holds no item.  Items with a null id, or a null or wordless text, match nothing; items that are
    equal in id and text count once, also in the statistics; equal ids with different texts are different items.  An item
    without an answer sign has no answer part (overlap 1).  Without items, or without documents, every list is empty.  A
    column of docs named `out`, in any case, is replaced; others keep their values, whatever their names.

    No shuffle of documents; rows are independent.  Items come to the driver PARTS_AT_ONCE parts at a time, each time
    searched in a pass.
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    own = frames.fresh_name([*docs.columns, out], "text")
    found = docs.select(*[docs[f"`{c}`"] for c in kept], docs[text].cast("string").alias(own), F.lit(None).cast(_LEAKS).alias(out))
    schema = found.schema
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    n = items.count()
    pieces = round(n / ITEMS_AT_ONCE)
    if pieces > 1:
        for indexes in _parted(frames.checkpointed(items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(pieces))))):
            found = _search(found, indexes, own, out, schema)
    elif n:  # one part, whose own statistics are those of all items
        found = _search(found, [Index(sorted((r["i"], r["t"]) for r in items.collect()))], own, out, schema)
    return found.drop(own).withColumn(out, F.coalesce(out, F.array().cast(_LEAKS)))
