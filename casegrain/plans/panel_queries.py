"""Registered queries of the filters and sorted lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain.functions import scalars as S
from casegrain.operators import duplicates, filters, listings
from casegrain.plans.registry import query

_PATH = r"regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)"
_ENTRIES = rf"(SELECT page_id AS id, {_PATH} AS path, string_split({_PATH}, '/')[-1] AS name, length(coalesce(html, ''))::BIGINT AS size, page_id % 6 = 0 AS is_dir FROM pages)"


def _entries(t):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1)
    return t("pages").select(F.col("page_id").alias("id"), path.alias("path"), S.file_name(path).alias("name"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("size"), (F.col("page_id") % 6 == 0).alias("is_dir"))


def _indexed(t):
    return t("documents").select("doc_id", F.col("lang").alias("container_type"), F.col("source").alias("container"), F.element_at(F.array(*[F.lit(x) for x in ("txt", "PDF", "eml")]), (F.col("doc_id") % 3 + 1).cast("int")).alias("extension"), F.lit("document").alias("category"), F.col("n_chars").alias("size"), (F.col("doc_id") % 4 == 0).alias("is_dir"))


@query("f04_directories_out", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 IN (1, 2) AND n_chars >= 200")
def directories_out(t):
    return _indexed(t).where(filters.search_filter(extensions=["pdf", "EML"], least=200)).select("doc_id")


@query("f05_match_all", "SELECT doc_id FROM documents")
def match_all(t):
    return _indexed(t).where(filters.search_filter(directories=True)).select("doc_id")


@query("f06_entry_predicate", f"""
SELECT id, CASE WHEN n AND e THEN 'Multiple' WHEN e THEN 'Extension' ELSE 'Name' END AS match_type
FROM (SELECT *, regexp_matches(name, '(?is)^.*a.*$') OR regexp_matches(path, '(?is)^.*a.*$') AS n, ends_with(lower(name), '.html') AS e FROM {_ENTRIES} WHERE NOT is_dir AND size BETWEEN 1000 AND 9000) WHERE n OR e""")
def entry_predicate(t):
    return filters.entry_matches(_entries(t), pattern="*A*", extension="HTML", files_only=True, least=1000, most=9000).select("id", "match_type")


@query("f09_by_extension", f"SELECT id, name FROM {_ENTRIES} WHERE NOT is_dir AND lower(string_split(name, '.')[-1]) = 'html'")
def by_extension(t):
    return filters.has_extension(_entries(t), "HTML").select("id", "name")


@query("f11_container_search", """
WITH c AS (SELECT s_suppkey AS id, s_name AS name, md5(s_name) AS md5, sha1(s_name) AS sha1 FROM supplier)
SELECT id, name, 'Name' AS match_type FROM c WHERE contains(lower(name), '00000000') UNION ALL SELECT id, name, 'Hash' FROM c WHERE md5 = (SELECT md5(min(s_name)) FROM supplier)""")
def container_search(t):
    c = t("supplier").select(F.col("s_suppkey").alias("path"), F.col("s_name").alias("name"), F.lit(0).alias("size"), F.md5("s_name").alias("md5"), F.sha1("s_name").alias("sha1"))
    first = t("supplier").agg(F.md5(F.min("s_name")).alias("h")).first()["h"]
    return filters.container_search(c, "00000000", first.upper()).select(F.col("path").alias("id"), "name", "match_type")


@query("f12_result_cap", f"SELECT id FROM {_ENTRIES} ORDER BY path, id LIMIT 25")
def result_cap(t):
    return _entries(t).orderBy("path", "id").limit(25).select("id")


def _activity(t):
    return t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.col("props").alias("description"), F.concat(F.lit("Did "), "event_type").alias("action"), F.col("user_id").cast("string").alias("user"), F.lit(None).cast("string").alias("file_path"), "ts")


@query("f14_activity_panel", """
SELECT event_id AS id, ts FROM events WHERE event_type = 'view' AND (contains(lower(props), '77') OR contains('did view', '77') OR contains(user_id::VARCHAR, '77')) AND ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'""")
def activity_panel(t):
    return filters.activity_panel(_activity(t), "view", " 77 ", "2024-01-03", "2024-01-20").select("id", "ts")


@query("f15_n01_bookmark_panel", """
SELECT p_partkey FROM part WHERE p_partkey % 3 = 1 AND (contains(lower(p_name), 'st') OR contains(lower(p_brand), 'st') OR contains(lower(p_type), 'st') OR list_bool_or([contains(lower(x), 'st') FOR x IN [p_type, 'note ' || p_partkey]]))""")
def bookmark_panel(t):
    b = t("part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.lit(None).cast("string").alias("notes"), F.array(F.col("p_type"), F.concat(F.lit("note "), F.col("p_partkey").cast("string"))).alias("tags"), (F.col("p_partkey") % 3).cast("string").alias("kind"))
    return filters.bookmark_panel(b, "ST", "1").select("p_partkey")


@query("f16_note_panel", "SELECT event_id AS id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 200")
def note_panel(t):
    return filters.note_panel(t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("modified")), "error").limit(200).select("id")


_GROUPS = "(SELECT p_size::BIGINT AS size, lower(p_name) AS name, count(*) AS n, ((count(*) - 1) * p_size)::BIGINT AS waste, count(DISTINCT p_brand) > 1 AS cross_container, 'SizeAndName' AS match_type FROM part WHERE p_size > 0 GROUP BY p_size, lower(p_name) HAVING count(*) > 1)"


def _groups(t):
    files = t("part").select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("container"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"))
    g = duplicates.name_groups(files)
    return g.withColumn("name", F.expr("substring(key, length(cast(size as string)) + 2)")).withColumn("match_type", F.lit("SizeAndName"))


@query("f17_group_panel", f"SELECT size, name, n FROM {_GROUPS} WHERE cross_container AND match_type = 'SizeAndName'")
def group_panel(t):
    return filters.group_panel(_groups(t), "SizeAndName", True).select("size", "name", "n")


for _order, _by in (("count", "n DESC"), ("size", "size DESC"), ("name", "name")):

    @query(f"t07_groups_by_{_order}", f"SELECT size, name, n, waste FROM {_GROUPS} ORDER BY {_by}, size, name LIMIT 30")
    def groups_by(t, order=_order):
        return filters.group_panel(_groups(t), order=order).select("size", "name", "n", "waste").limit(30)


@query("f18_sheet_rows", "SELECT event_id FROM events WHERE contains(lower(event_type), 'err') OR contains(event_id::VARCHAR, 'err') OR contains(lower(props), 'err') OR contains(user_id::VARCHAR, 'err')")
def sheet_rows(t):
    return filters.sheet_rows(t("events"), ["event_id", "event_type", "props", "user_id"], "Err").select("event_id")


@query("f19_discovered_and_tree", f"SELECT id, path FROM {_ENTRIES} WHERE id % 2 = 0 AND contains(lower(path), '1') ORDER BY path, id LIMIT 500")
def discovered_and_tree(t):
    e = _entries(t).withColumn("container_type", F.when(F.col("id") % 2 == 0, "ZIP").otherwise("AD1"))
    return filters.tree(filters.discovered(e, "ZIP"), " 1 ", tie="id").select("id", "path")


@query("f20_key_values", "SELECT event_id FROM events WHERE contains('/' || event_type, 'pur') OR contains(lower(props), 'pur')")
def key_values(t):
    return filters.key_values(t("events").select("event_id", F.concat(F.lit("/"), "event_type").alias("key_path"), F.col("props").alias("preview")), "PUR").select("event_id")


@query("f23_whole_file_hash", "SELECT l_orderkey, arg_max(l_linenumber, l_shipdate::TIMESTAMP + INTERVAL 1 SECOND * l_linenumber) AS line FROM lineitem WHERE l_linenumber > 1 GROUP BY 1")
def whole_file_hash(t):
    h = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.when(F.col("l_linenumber") == 1, 1).alias("segment_index"))
    return h.where(F.col("segment_index").isNull()).groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_shipdate", "l_linenumber")).alias("line"))


@query("f24_not_voided", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey")
def not_voided(t):
    s = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "voided").otherwise("draft").alias("status"))
    return s.where("status <> 'voided'").orderBy("o_orderkey").select("o_orderkey")


@query("f25_columns_by_name", "SELECT s_suppkey::VARCHAR AS id, s_name AS title, s_nationkey::VARCHAR AS country, NULL::VARCHAR AS phone_2 FROM supplier")
def columns_by_name(t):
    return filters.by_name(t("supplier"), {"id": ["uuid", "suppkey"], "title": ["NAME"], "country": ["nation"], "phone_2": ["nothing"]})


@query("t02_page_of_table", """
SELECT event_id, (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM events) > 1000 AS has_more, 500::BIGINT AS page_size FROM events ORDER BY event_id LIMIT 500 OFFSET 500""")
def page_of_table(t):
    return listings.page(t("events").select("event_id"), ["event_id"], number=1, size=9000)


@query("t03_latest_first", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def latest_first(t):
    return listings.latest(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 100)


_CELL = "CASE event_id % 4 WHEN 0 THEN value::VARCHAR WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN event_type ELSE NULL END"


@query("t08_mixed_sheet_sort", f"""
SELECT event_id, row_number() OVER (ORDER BY k, num, txt, event_id) AS rn FROM (SELECT event_id, CASE WHEN try_cast(c AS DOUBLE) IS NOT NULL THEN 1 WHEN c IS NULL THEN 0 ELSE 2 END AS k, coalesce(try_cast(c AS DOUBLE), 0) AS num, lower(coalesce(c, '')) AS txt
  FROM (SELECT event_id, {_CELL.replace("value::VARCHAR", "round(value, 2)::VARCHAR")} AS c FROM events)) ORDER BY k, num, txt, event_id LIMIT 700""")
def mixed_sheet_sort(t):
    k = F.col("event_id") % 4
    cell = F.when(k == 0, F.round("value", 2).cast("string")).when(k == 1, F.col("event_id").cast("string")).when(k == 2, F.col("event_type"))
    return listings.ranked(t("events").select("event_id", cell.alias("c")), listings.sheet_order(F.col("c")) + [F.col("event_id")], 700).select("event_id", "rn")


@query("t09_hash_order", """
SELECT event_id, row_number() OVER (ORDER BY (event_type <> 'view')::INT, algorithm, ts DESC NULLS LAST, event_id) AS rn FROM (SELECT event_id, event_type, ['MD5', 'SHA-1', 'SHA-256'][event_id % 3 + 1] AS algorithm, CASE WHEN event_id % 5 <> 0 THEN ts END AS ts FROM events)
ORDER BY rn LIMIT 500""")
def hash_order(t):
    h = t("events").select("event_id", F.when(F.col("event_type") == "view", "container").otherwise("computed").alias("source"), F.element_at(F.array(*[F.lit(a) for a in ("MD5", "SHA-1", "SHA-256")]), (F.col("event_id") % 3 + 1).cast("int")).alias("algorithm"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("timestamp"))
    return listings.ranked(h, [*listings.hash_order(), F.col("event_id")], 500).select("event_id", "rn")


@query("t10_order_by_coalesce", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY coalesce(CASE WHEN l_linenumber = 1 THEN l_partkey END, CASE WHEN l_linenumber < 4 THEN l_suppkey END, 0), l_orderkey, l_linenumber) AS rn FROM lineitem ORDER BY rn LIMIT 400")
def order_by_coalesce(t):
    a = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.col("l_partkey")).alias("offset"), F.when(F.col("l_linenumber") < 4, F.col("l_suppkey")).alias("line"))
    return listings.ranked(a, [F.coalesce("offset", "line", F.lit(0)), F.col("l_orderkey"), F.col("l_linenumber")], 400).select("l_orderkey", "l_linenumber", "rn")


@query("n05_type_buckets", "SELECT event_type AS kind, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY 1")
def type_buckets(t):
    b = listings.buckets(t("events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id")), "kind", ["id"])
    return b.select("kind", F.array_join(F.transform("rows", lambda r: r["id"].cast("string")), ",").alias("ids"))


@query("n03_file_structs", f"SELECT size, name, list({{'container': p_brand, 'id': p_partkey}} ORDER BY p_brand, p_partkey)::VARCHAR AS files FROM (SELECT p_size::BIGINT AS size, lower(p_name) AS name, p_brand, p_partkey FROM part WHERE p_size > 0) JOIN (SELECT size, name FROM {_GROUPS}) USING (size, name) GROUP BY 1, 2")
def file_structs(t):
    f = t("part").where("p_size > 0").select(F.col("p_size").cast("long").alias("size"), F.lower("p_name").alias("name"), F.struct(F.col("p_brand").alias("container"), F.col("p_partkey").alias("id")).alias("f"))
    g = f.groupBy("size", "name").agg(F.array_sort(F.collect_list("f")).alias("files")).where(F.size("files") > 1)
    shown = F.transform("files", lambda x: F.concat(F.lit("{'container': "), x["container"], F.lit(", 'id': "), x["id"].cast("string"), F.lit("}")))
    return g.select("size", "name", F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")).alias("files"))


@query("n02_counts_by_type", "SELECT ts::DATE AS day, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_type, sum(n)::BIGINT AS total FROM (SELECT ts, event_type, n FROM (SELECT ts::DATE AS ts, event_type, count(*) AS n FROM events GROUP BY 1, 2)) GROUP BY 1")
def counts_by_type(t):
    m = listings.count_map(t("events").select(F.to_date("ts").alias("day"), "event_type"), "day", "event_type")
    pairs = F.transform(F.array_sort(F.map_entries("by_type")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("day", F.array_join(pairs, ",").alias("by_type"), F.aggregate(F.map_values("by_type"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("n04_map_union", """
WITH p AS (SELECT user_id, event_type AS k, event_id % 7 AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)
SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS merged FROM p WHERE rn = 1 GROUP BY 1""")
def map_union(t):
    maps = t("events").select("user_id", F.create_map("event_type", F.col("event_id") % 7).alias("m"), F.col("event_id").alias("source_ordinal"))
    m = listings.map_union(maps, "user_id", "m")
    return m.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("merged"))
