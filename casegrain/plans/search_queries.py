"""Registered queries of the full-text index: documents as entries, with a made file name and path."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain.operators import index
from casegrain.plans.registry import query

_TOKENS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND length(x) <= 40)"
_ENTRIES = "(SELECT doc_id, source || '_' || lang || '_report.txt' AS filename, '/' || lang || '/' || source AS entry_path, text AS content, source AS container, doc_id % 6 = 0 AS is_dir FROM documents)"
_F = {f: _TOKENS.format(f) for f in index.FIELDS}


def _entries(t):
    return t("documents").select("doc_id", F.concat_ws("", "source", F.lit("_"), "lang", F.lit("_report.txt")).alias("filename"), F.concat_ws("", F.lit("/"), "lang", F.lit("/"), "source").alias("entry_path"), F.col("text").alias("content"), F.col("source").alias("container"), (F.col("doc_id") % 6 == 0).alias("is_dir"))


def _leaf_sql(name: str, tokens: list[str], fields: list[str]) -> str:
    """A CTE of (doc_id, s): BM25 of a word or phrase over fields, with boosts."""
    parts = []
    for f in fields:
        first = f"len(list_filter(range(1, (len(ts) - {len(tokens) - 1} + 1)::BIGINT), lambda i: " + " AND ".join(f"ts[i + {k}] = '{x}'" for k, x in enumerate(tokens)) + "))"
        idf = " + ".join(f"(SELECT ln(1 + (count(*) - count(*) FILTER (WHERE list_contains(ts, '{x}')) + 0.5) / (count(*) FILTER (WHERE list_contains(ts, '{x}')) + 0.5)) FROM f_{f})" for x in tokens)
        parts.append(f"SELECT doc_id, {index.FIELDS[f]} * ({idf}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(len(ts)) FROM f_{f}))) AS s FROM (SELECT doc_id, len(ts) AS dl, {first} AS tf FROM f_{f}) WHERE tf > 0")
    return f"{name} AS (SELECT doc_id, sum(s) AS s FROM ({' UNION ALL '.join(parts)}) GROUP BY 1)"


_BASE = ", ".join(f"f_{f} AS (SELECT doc_id, {tokens} AS ts FROM {_ENTRIES})" for f, tokens in _F.items())
_ALL = list(index.FIELDS)


@query("x02_multi_field", f"""
WITH {_BASE}, {_leaf_sql("a", ["license"], _ALL)}, {_leaf_sql("b", ["src3"], _ALL)}, {_leaf_sql("c", ["en"], _ALL)}
SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1""")
def multi_field(t):
    text = "license src3 en"
    return index.scores(index.of(_entries(t), text), text).select("doc_id", F.round("score", 6).alias("score"))


@query("x05_must_and_not", f"""
WITH {_BASE}, {_leaf_sql("a", ["license"], _ALL)}, {_leaf_sql("b", ["the"], ["content"])}, {_leaf_sql("c", ["mit"], _ALL)}
SELECT a.doc_id, round(a.s + coalesce(b.s, 0), 6) AS score FROM a LEFT JOIN b USING (doc_id) WHERE a.doc_id NOT IN (SELECT doc_id FROM c)""")
def must_and_not(t):
    text = "+license content:the -mit"
    return index.scores(index.of(_entries(t), text), text).select("doc_id", F.round("score", 6).alias("score"))


@query("x05_phrases", f"""
WITH {_BASE}, {_leaf_sql("a", ["license", "version"], _ALL)}, {_leaf_sql("b", ["the", "and", "the"], _ALL)}
SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def phrases(t):
    text = '"license version" OR the-and-the'
    return index.scores(index.of(_entries(t), text), text).select("doc_id", F.round("score", 6).alias("score"))


@query("x05_and_or_groups", f"""
WITH {_BASE}, {_leaf_sql("a", ["license"], _ALL)}, {_leaf_sql("b", ["version"], _ALL)}, {_leaf_sql("c", ["clown"], _ALL)}, {_leaf_sql("d", ["the"], _ALL)}
SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, a.s + b.s AS s FROM a JOIN b USING (doc_id) UNION ALL SELECT doc_id, c.s + d.s FROM c JOIN d USING (doc_id)) GROUP BY 1""")
def and_or_groups(t):
    text = "license AND version OR (clown AND the)"
    return index.scores(index.of(_entries(t), text), text).select("doc_id", F.round("score", 6).alias("score"))


@query("x04_fuzzy_names", f"""
WITH {_BASE}, {_leaf_sql("a", ["src3"], ["entry_path", "content"])}
SELECT doc_id, round(coalesce(a.s, 0) + CASE WHEN n.doc_id IS NOT NULL THEN 3.0 ELSE 0 END, 6) AS score
FROM a FULL JOIN (SELECT doc_id FROM (SELECT doc_id, unnest(ts) AS term FROM f_filename) WHERE list_bool_or([levenshtein(substr(term, 1, k), 'src3') <= 1 OR substr(term, 1, k) IN ('rsc3', 'scr3', 'sr3c') FOR k IN [3, 4, 5]]) GROUP BY 1) n USING (doc_id)""")
def fuzzy_names(t):
    return index.scores(index.of(_entries(t), "src3"), "src3", fuzzy=True).select("doc_id", F.round("score", 6).alias("score"))


@query("t01_top_without_directories", f"""
WITH {_BASE}, {_leaf_sql("a", ["the"], _ALL)}, f AS (SELECT doc_id, round(s, 6) AS score FROM a ORDER BY 2 DESC, 1 LIMIT 90)
SELECT doc_id, score FROM f WHERE doc_id % 6 <> 0 ORDER BY score DESC, doc_id LIMIT 20""")
def top_without_directories(t):
    return index.top(index.of(_entries(t), "the"), "the", 20).select("doc_id", "score")


@query("x06_marked_hits", """
WITH h AS (SELECT doc_id, text, source || '_' || lang || '_report.txt' AS filename, instr(lower(coalesce(text, '')), 'report') AS p FROM documents)
SELECT doc_id, p > 0 AS content_match, CASE WHEN p > 0 THEN substr(text, greatest(p - 40, 1), p - greatest(p - 40, 1)) || '<b>' || substr(text, p, 6) || '</b>' || substr(text, p + 6, 40)
  ELSE substr(filename, 1, instr(filename, 'report') - 1) || '<b>report</b>' || substr(filename, instr(filename, 'report') + 6, 40) END AS snippet FROM h""")
def marked_hits(t):
    return index.marked(_entries(t), "report").select("doc_id", "content_match", "snippet")


def _annotation_sql(name: str, table: str, limit: int) -> str:
    tokens = _TOKENS.format("txt")
    return f"""{name}_t AS (SELECT id, {tokens} AS ts FROM {table}), {name}_d AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl, count(*) FILTER (WHERE list_contains(ts, 'the')) AS df FROM {name}_t),
  {name} AS (SELECT id, -round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS rank FROM (SELECT id, len(ts) AS dl, len(list_filter(ts, lambda x: x = 'the')) AS tf FROM {name}_t) CROSS JOIN {name}_d WHERE tf > 0 ORDER BY rank, id LIMIT {limit})"""


_NOTES = "(SELECT doc_id AS id, text AS txt FROM documents WHERE lang = 'en')"
_BOOKMARKS = "(SELECT item_id AS id, text AS txt FROM benchmark)"
_ACTIVITY = "(SELECT conv_id * 1000 + turn AS id, text AS txt FROM conversations)"


def _annotations(t):
    return {
        "notes": t("documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "text"),
        "bookmarks": t("benchmark").select(F.col("item_id").alias("id"), "text"),
        "activity_log": t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"),
    }


def _union_sql(limit: int) -> str:
    ctes = ", ".join(_annotation_sql(n, x, limit) for n, x in (("notes", _NOTES), ("bookmarks", _BOOKMARKS), ("activity_log", _ACTIVITY)))
    return f"WITH {ctes} SELECT source, id, rank FROM (SELECT 'notes' AS source, * FROM notes UNION ALL SELECT 'bookmarks', * FROM bookmarks UNION ALL SELECT 'activity_log', * FROM activity_log) ORDER BY rank, source, id LIMIT {limit}"


@query("x12_u06_annotations", _union_sql(50))
def annotation_search(t):
    return index.annotations(_annotations(t), "the").select("source", "id", "rank")


_FILES = "(SELECT url AS path FROM pages)"


@query("x13_t11_everywhere", f"""
SELECT kind, id, score FROM (SELECT CASE WHEN contains(lower(string_split(path, '/')[-1]), 'the') THEN 'name' ELSE 'path' END AS kind, path AS id, (CASE WHEN contains(lower(string_split(path, '/')[-1]), 'the') THEN 100 ELSE 50 END)::BIGINT AS score FROM {_FILES} WHERE contains(lower(path), 'the')
UNION ALL SELECT CASE source WHEN 'activity_log' THEN 'activity' ELSE source END, id::VARCHAR, greatest(1, 80 + round(-10 * rank)::BIGINT) FROM ({_union_sql(30)})) ORDER BY score DESC, kind, id LIMIT 300""")
def search_everywhere(t):
    return index.everywhere(None, t("pages").select(F.col("url").alias("path")), _annotations(t), "the")
