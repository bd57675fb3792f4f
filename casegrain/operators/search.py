"""Full-text search: tokens, postings, BM25, fuzzy terms, facets and snippets on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.operators.shared import written

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of at most 40 characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.length(t) <= 40))


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf, dl)."""
    t = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("ts"))
    return t.select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, doc_id: str, text: str, query: list[str]) -> DataFrame:
    """(doc_id, score) of documents with any query term.

    Texts are split once: each document's length and its hits are written, and all else is read there.
    """
    terms = sorted(set(query))
    wanted = F.array(*[F.lit(q) for q in terms])
    one = docs.select(F.explode(F.array(F.struct(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("ts")))).alias("d"))  # a generator keeps the split from being repeated
    t = written(one.select("d.doc_id", F.size("d.ts").alias("dl"), F.filter("d.ts", lambda x: F.array_contains(wanted, x)).alias("hits")))
    t = t.withColumn("tf", F.array(*[F.size(_equal("hits", q)) for q in terms]))
    sums = [F.sum(F.when(F.get("tf", F.lit(i)) > 0, 1).otherwise(0)).alias(f"df_{i}") for i in range(len(terms))]
    stats = t.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"), *sums)
    rows = t.where(F.exists("tf", lambda n: n > 0)).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = F.col(f"df_{i}"), F.get("tf", F.lit(i))
        idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.select("doc_id", score.alias("score"))


def _equal(words: str, word: str) -> Column:
    return F.filter(words, lambda x: x == word)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc(F.round("score", 6)), "doc_id").limit(k)


def fuzzy(vocabulary: DataFrame, term: str) -> DataFrame:
    """Terms within one edit (a swap of neighbours is one) of the term or of one of their prefixes."""
    n = len(term)
    swaps = sorted({term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(n - 1)})
    near = F.lit(False)
    for k in (n - 1, n, n + 1):
        head = F.substring("term", 1, k)
        near = near | (F.levenshtein(head, F.lit(term)) <= 1) | head.isin(*swaps)
    return vocabulary.where(near)


def facets(hits: DataFrame, column: str) -> DataFrame:
    """Counts over the returned hits only; empty labels are dropped."""
    return hits.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def snippet(text: Column, term: str, around: int = 40) -> Column:
    """The first hit marked, with some text around it; empty where there is none."""
    at = F.instr(F.lower(text), F.lit(term))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.concat(F.substring(text, start, at - start), F.lit("<b>"), F.substring(text, at, F.lit(len(term))), F.lit("</b>"), F.substring(text, at + len(term), F.lit(around)))).otherwise("")
