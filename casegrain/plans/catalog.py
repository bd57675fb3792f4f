"""The registered queries of the analytics operators over the driver's tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegrain.functions import scalars as S
from casegrain.operators import duplicates, metrics, reconcile, search, timeline
from casegrain.plans import format_queries, panel_queries, scalar_queries, search_queries, store_queries  # noqa: F401  (they register their queries)
from casegrain.plans.registry import QUERIES, SQL, query  # noqa: F401


def _log(t) -> DataFrame:
    return t("events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("user"), F.col("event_type").alias("action"))


def _files(t) -> DataFrame:
    """Parts as files: size p_size, name p_name, container p_brand."""
    return t("part").select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("container"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"))


def _projects(t) -> tuple[DataFrame, DataFrame]:
    """Two overlapping versions of the customer table, the second with some balances and segments changed."""
    c = t("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"))
    a = c.where("k % 5 <> 0").drop("k")
    b = c.where("k % 7 <> 0").select("name", F.when(F.col("k") % 11 == 0, F.col("balance") + 1).otherwise(F.col("balance")).alias("balance"), F.when(F.col("k") % 13 == 0, "OTHER").otherwise(F.col("segment")).alias("segment"))
    return a, b


_A = "(SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey % 5 <> 0)"
_B = "(SELECT c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 13 = 0 THEN 'OTHER' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0)"

# ---- timeline ----------------------------------------------------------------------------------


@query("a13_timeline_summary", """
WITH d AS (SELECT ts::DATE AS d, count(*) AS c FROM events GROUP BY 1), h AS (SELECT hour(ts)::INT AS h, count(*) AS c FROM events GROUP BY 1)
SELECT count(*) AS total, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts,
       floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60) / 60.0 AS duration_hours,
       (SELECT d FROM d ORDER BY c DESC, d LIMIT 1) AS busiest_day, (SELECT h FROM h ORDER BY c DESC, h LIMIT 1) AS busiest_hour FROM events""")
def a13_timeline_summary(t):
    return timeline.summary(_log(t))


@query("a14_heatmap", """
SELECT g.dow::INT AS dow, k.hour::INT AS hour, count(e.ts) AS n FROM range(7) g(dow) CROSS JOIN range(24) k(hour)
LEFT JOIN events e ON dayofweek(e.ts) = g.dow AND hour(e.ts) = k.hour GROUP BY 1, 2""")
def a14_heatmap(t):
    return timeline.heatmap(_log(t))


@query("a15_daily_activity", "SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users, dayofweek(ts::DATE)::INT AS dow FROM events GROUP BY 1")
def a15_daily_activity(t):
    return timeline.daily(_log(t))


@query("a15_daily_by_type", "SELECT ts::DATE AS day, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2")
def a15_daily_by_type(t):
    return timeline.daily_by_type(_log(t))


@query("a16_type_distribution", "SELECT event_type AS action, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM events GROUP BY 1")
def a16_type_distribution(t):
    return timeline.type_distribution(_log(t))


@query("a17_user_activity", 'SELECT user_id AS "user", count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts::DATE) AS active_days FROM events GROUP BY 1')
def a17_user_activity(t):
    return timeline.users(_log(t))


@query("a17_user_by_type", 'SELECT user_id AS "user", event_type AS action, count(*) AS n FROM events GROUP BY 1, 2')
def a17_user_by_type(t):
    return timeline.users_by_type(_log(t))


@query("a18_trend", """
WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS k FROM d),
     s AS (SELECT count(*) AS days, avg(n) FILTER (WHERE i <= k // 2) AS first_half, avg(n) FILTER (WHERE i > k // 2) AS second_half, avg(n) * 7 AS weekly_avg FROM p)
SELECT *, CASE WHEN days < 2 THEN 'stable' WHEN second_half > 1.2 * first_half THEN 'increasing' WHEN second_half < 0.8 * first_half THEN 'decreasing' ELSE 'stable' END AS trend,
       least(days / 30.0::DOUBLE, 1.0) AS confidence FROM s""")
def a18_trend(t):
    return timeline.trend(_log(t))


@query("a34_peak_periods", """
SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start_ts, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS n, count(*) / 30.0::DOUBLE AS rate
FROM events GROUP BY 1, 2 ORDER BY n DESC, start_ts LIMIT 5""")
def a34_peak_periods(t):
    return timeline.peaks(_log(t))


@query("t06_top_days", "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, day LIMIT 10")
def t06_top_days(t):
    return timeline.daily(_log(t)).select("day", "n").orderBy(F.desc("n"), "day").limit(10)


@query("u05_timeline_union", """
SELECT 'event' AS kind, event_id AS id, ts FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders UNION ALL SELECT 'shipment', l_orderkey, l_shipdate FROM lineitem""")
def u05_timeline_union(t):
    parts = [("event", t("events"), "event_id", "ts"), ("order", t("orders"), "o_orderkey", "o_orderdate"), ("shipment", t("lineitem"), "l_orderkey", "l_shipdate")]
    frames = [d.select(F.lit(k).alias("kind"), F.col(i).alias("id"), F.col(ts).alias("ts")) for k, d, i, ts in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


# ---- duplicates --------------------------------------------------------------------------------


@query("a09_size_groups", "SELECT p_size::BIGINT AS size, count(*) AS n FROM part WHERE p_size > 0 GROUP BY 1 HAVING count(*) > 1")
def a09_size_groups(t):
    return _files(t).where("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("a10_name_groups", """
SELECT p_size::VARCHAR || ':' || lower(p_name) AS "key", p_size::BIGINT AS size, count(*) AS n, ((count(*) - 1) * p_size)::BIGINT AS waste, count(DISTINCT p_brand) > 1 AS cross_container, min(p_brand) AS representative
FROM part WHERE p_size > 0 GROUP BY p_size, lower(p_name) HAVING count(*) > 1""")
def a10_name_groups(t):
    return duplicates.name_groups(_files(t))


@query("a11_size_only_groups", """
WITH s AS (SELECT p_size::BIGINT AS size, lower(p_name) AS name, min(p_brand) AS b FROM part WHERE p_size > 0 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT 'size:' || size AS "key", size, count(*) AS n, ((count(*) - 1) * size)::BIGINT AS waste, min(b) <> max(b) AS cross_container FROM s GROUP BY size HAVING count(*) > 1""")
def a11_size_only_groups(t):
    return duplicates.size_groups(_files(t))


@query("a12_dedup_statistics", """
WITH g AS (SELECT count(*) AS n, (count(*) - 1) * p_size AS waste FROM part WHERE p_size > 0 GROUP BY p_size, lower(p_name) HAVING count(*) > 1)
SELECT (SELECT count(*) FROM part WHERE p_size > 0) AS files, count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS duplicates, coalesce(sum(waste), 0)::BIGINT AS waste,
       ((SELECT count(*) FROM part WHERE p_size > 0) - coalesce(sum(n), 0) + count(*))::BIGINT AS unique_files FROM g""")
def a12_dedup_statistics(t):
    return duplicates.statistics(_files(t))


@query("j15_hash_enrichment", """
WITH h AS (SELECT p_partkey AS k, md5(p_name) AS hash FROM part WHERE p_partkey % 3 <> 0)
SELECT p_size::BIGINT AS size, lower(p_name) AS name, count(*) AS n, CASE WHEN count(hash) = count(*) AND count(DISTINCT hash) = 1 THEN 'ExactHash' ELSE 'SizeAndName' END AS match_type
FROM part LEFT JOIN h ON k = p_partkey WHERE p_size > 0 GROUP BY 1, 2 HAVING count(*) > 1""")
def j15_hash_enrichment(t):
    hashes = t("part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("file_id"), F.md5("p_name").alias("hash"))
    return duplicates.enrich(_files(t), hashes)


@query("t07_groups_by_waste", """
SELECT p_size::BIGINT AS size, lower(p_name) AS name, ((count(*) - 1) * p_size)::BIGINT AS waste FROM part WHERE p_size > 0 GROUP BY p_size, lower(p_name) HAVING count(*) > 1 ORDER BY waste DESC, size, name LIMIT 20""")
def t07_groups_by_waste(t):
    return duplicates.name_groups(_files(t)).select("size", F.substring_index("key", ":", -1).alias("name"), "waste").orderBy(F.desc("waste"), "size", "name").limit(20)


# ---- integrity ---------------------------------------------------------------------------------


@query("s01_content_hashes", "SELECT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256 FROM documents")
def s01_content_hashes(t):
    text = F.coalesce("text", F.lit(""))
    return t("documents").select("doc_id", *[S.content_hash(text, a).alias(a) for a in ("md5", "sha1", "sha256")])


@query("s02_crc32_sha512")
def s02_crc32_sha512(t):
    text = F.coalesce("text", F.lit(""))
    return t("documents").select("doc_id", S.content_hash(text, "crc32").alias("crc32"), S.content_hash(text, "sha512").alias("sha512"))


@query("s05_s07_hash_checks", """
WITH h AS (SELECT doc_id, md5(text) AS a, CASE doc_id % 4 WHEN 0 THEN md5(text) WHEN 1 THEN upper(md5(text)) WHEN 2 THEN sha1(text) ELSE 'zz' END AS b FROM documents)
SELECT doc_id, CASE length(b) WHEN 32 THEN 'MD5' WHEN 40 THEN 'SHA-1' END AS guess,
       CASE WHEN NOT regexp_full_match(b, '[0-9a-fA-F]+') THEN 'Invalid' WHEN a = b THEN 'Exact' WHEN lower(a) = lower(b) THEN 'CaseInsensitive' ELSE 'Mismatch' END AS verdict,
       regexp_full_match(b, '[0-9a-fA-F]{32}') AS valid_md5 FROM h""")
def s05_s07_hash_checks(t):
    k, m = F.col("doc_id") % 4, F.md5("text")
    h = t("documents").select("doc_id", m.alias("a"), F.when(k == 0, m).when(k == 1, F.upper(m)).when(k == 2, F.sha1("text")).otherwise("zz").alias("b"))
    return h.select("doc_id", S.guess_algorithm(F.col("b")).alias("guess"), S.compare_hashes(F.col("a"), F.col("b")).alias("verdict"), S.valid_hash(F.col("b"), F.lit("MD5")).alias("valid_md5"))


@query("j18_verification", """
WITH s AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0), c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE md5(text) END AS h FROM documents),
     o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 2 = 0)
SELECT c.doc_id, CASE WHEN s.h IS NOT NULL THEN lower(s.h) = lower(c.h) WHEN lower(o.h) = lower(c.h) THEN true END AS verified FROM c LEFT JOIN s USING (doc_id) LEFT JOIN o USING (doc_id)""")
def j18_verification(t):
    d = t("documents").select("doc_id", F.md5("text").alias("h"))
    now = d.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("h")).alias("computed"))
    stored, history = d.where("doc_id % 3 <> 0").withColumnRenamed("h", "stored"), d.where("doc_id % 2 = 0").withColumnRenamed("h", "seen")
    j = now.join(stored, "doc_id", "left").join(history, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("stored").isNotNull(), F.lower("stored") == F.lower("computed")).when(F.lower("seen") == F.lower("computed"), True).alias("verified"))


@query("a24_all_passed", "SELECT source, bool_and(n_chars = length(text)) AS all_passed FROM documents GROUP BY 1")
def a24_all_passed(t):
    return t("documents").groupBy("source").agg(F.bool_and(F.col("n_chars") == F.length("text")).alias("all_passed"))


@query("a33_hash_dedupe", "SELECT DISTINCT 'MD5' AS algorithm, lower(md5(text)) AS hash FROM documents WHERE text IS NOT NULL")
def a33_hash_dedupe(t):
    return t("documents").where("text is not null").select(S.normal_algorithm(F.lit("md-5")).alias("algorithm"), F.lower(F.md5("text")).alias("hash")).dropDuplicates(["algorithm", "hash"])


# ---- filters, projections, scalars -------------------------------------------------------------


@query("f01_f05_search_filters", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lower(lang) IN ('en', 'fr') AND n_chars BETWEEN 500 AND 5000 AND source = 'src3'")
def f01_f05_search_filters(t):
    return t("documents").where(F.lower("lang").isin("en", "fr") & F.col("n_chars").between(500, 5000) & (F.col("source") == "src3")).select("doc_id", "lang", "source", "n_chars")


@query("f07_glob_match", r"SELECT p_partkey, regexp_matches(p_name, '(?i)^.*bolt$') AS tail, regexp_matches(p_name, '(?i)^c.*w.*t$') AS parts, contains(lower(p_name), 'old') AS part_of, regexp_matches(p_name, '(?i)^.old .*$') AS one FROM part")
def f07_glob_match(t):
    n = F.col("p_name")
    return t("part").select("p_partkey", S.glob_match(n, "*bolt").alias("tail"), S.glob_match(n, "C*w*t").alias("parts"), S.glob_match(n, "OLD").alias("part_of"), S.glob_match(n, "?old *").alias("one"))


@query("f13_activity_filter", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-02-05' AND props ILIKE '%1%' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10")
def f13_activity_filter(t):
    e = t("events").where("event_type = 'error' AND ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-02-05' AND props ILIKE '%1%'")
    return e.select("event_id", "user_id", "ts").orderBy(F.desc("ts"), "event_id").offset(10).limit(50)


@query("f10_find_by_hash", "SELECT doc_id FROM documents WHERE md5(text) = (SELECT md5(text) FROM documents WHERE doc_id = 7) OR sha1(text) = (SELECT sha1(text) FROM documents WHERE doc_id = 7) ORDER BY doc_id LIMIT 1")
def f10_find_by_hash(t):
    d = t("documents")
    wanted = d.where("doc_id = 7").select(F.md5("text").alias("m"), F.sha1("text").alias("s"))
    return d.join(F.broadcast(wanted), (F.md5("text") == F.col("m")) | (F.sha1("text") == F.col("s")), "left_semi").select("doc_id").orderBy("doc_id").limit(1)


@query("f21_exclusion", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def f21_exclusion(t):
    return t("orders").join(t("customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("s13_s15_path_parts", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS p FROM pages)
SELECT page_id, p AS path, string_split(p, '/')[-1] AS name, regexp_replace(p, '/[^/]*$', '') AS parent, (length(p) - length(replace(p, '/', '')))::INT AS depth FROM p""")
def s13_s15_path_parts(t):
    p = F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1)
    return t("pages").select("page_id", p.alias("path"), S.file_name(p).alias("name"), S.parent_path(p).alias("parent"), S.depth(p).alias("depth"))


@query("s18_human_size", """
SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0::DOUBLE) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0::DOUBLE) ELSE b || ' B' END AS size
FROM (SELECT o_orderkey, (o_orderkey * o_orderkey)::BIGINT AS b FROM orders)""")
def s18_human_size(t):
    return t("orders").select("o_orderkey", S.human_size(F.col("o_orderkey") * F.col("o_orderkey")).alias("size"))


@query("s23_duration_text", """
SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h ' || (s % 3600 // 60) || 'm'
  WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS duration FROM (SELECT o_orderkey, o_orderkey * 37 AS s FROM orders)""")
def s23_duration_text(t):
    return t("orders").select("o_orderkey", S.duration_text(F.col("o_orderkey") * 37).alias("duration"))


@query("s25_json_field", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, NULL::VARCHAR AS k_text FROM events")
def s25_json_field(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), S.json_text(F.col("props"), "k").alias("k_text"))


@query("s32_normalize", r"SELECT doc_id, md5(regexp_replace(lower(trim(text, chr(32))), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS normal FROM documents")
def s32_normalize(t):
    return t("documents").select("doc_id", F.md5(S.normalize(F.col("text"))).alias("normal"))


@query("s29_value_rendering", "SELECT doc_id, CASE WHEN text IS NULL THEN '(NULL)' WHEN length(text) > 256 THEN substr(text, 1, 256) || '... (' || length(text) || ' chars)' ELSE text END AS shown FROM documents")
def s29_value_rendering(t):
    return t("documents").select("doc_id", S.render(F.col("text")).alias("shown"))


@query("m06_path_rebase", "SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'file:///case' || substr(url, length('https://m.') + 1) ELSE url END AS url FROM pages")
def m06_path_rebase(t):
    return t("pages").select("page_id", F.when(F.startswith("url", F.lit("https://m.")), F.concat(F.lit("file:///case"), F.substring("url", F.lit(len("https://m.") + 1), F.length("url")))).otherwise(F.col("url")).alias("url"))


# ---- joins and aggregates of the case store ----------------------------------------------------


@query("j01_tagged", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 1")
def j01_tagged(t):
    return t("labels").where("toxic = 1").join(t("documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", "quality", "toxic")


@query("j02_latest_by_key", """
SELECT c_custkey, o_orderkey, o_orderdate FROM (SELECT c_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
FROM customer JOIN orders ON o_custkey = c_custkey) WHERE rn = 1""")
def j02_latest_by_key(t):
    j = t("orders").join(t("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("c_custkey", "m.o_orderkey", "m.o_orderdate")


@query("j04_a01_hits_per_artifact", "SELECT p_type AS artifact, count(*) AS hits FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def j04_a01_hits_per_artifact(t):
    return t("lineitem").select("l_partkey").join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("artifact")).agg(F.count(F.lit(1)).alias("hits"))


@query("j05_a02_hits_per_group", """
SELECT r_name AS grp, n_name AS artifact, count(*) AS hits FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def j05_a02_hits_per_group(t):
    j = t("orders").select("o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("grp"), F.col("n_name").alias("artifact")).agg(F.count(F.lit(1)).alias("hits"))


@query("j10_reconciliation", """
SELECT a.s_suppkey AS current, b.s_suppkey AS incoming FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_suppkey % 10 = b.s_suppkey % 10""")
def j10_reconciliation(t):
    s = t("supplier")
    a, b = s.select(F.col("s_suppkey").alias("current"), "s_nationkey", (F.col("s_suppkey") % 10).alias("m")), s.select(F.col("s_suppkey").alias("incoming"), "s_nationkey", (F.col("s_suppkey") % 10).alias("m"))
    return a.join(b, ["s_nationkey", "m"]).where("current < incoming").select("current", "incoming")


@query("j10_first_reason", """
WITH o AS (SELECT o_orderkey AS id, o_custkey AS n, o_orderdate::DATE AS d, lower(o_orderstatus) AS f, lower(o_orderpriority) AS l FROM orders)
SELECT a.id AS current, b.id AS incoming, CASE WHEN a.n = b.n THEN 'case number' WHEN a.f = b.f THEN 'date and officer' ELSE 'date and location' END AS reason
FROM o a JOIN o b ON a.id % 2 = 0 AND b.id % 2 = 1 AND (a.n = b.n OR (a.d = b.d AND (a.f = b.f OR a.l = b.l)))""")
def j10_first_reason(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("case_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderstatus").alias("officer"), F.col("o_orderpriority").alias("location"))
    return reconcile.collection_conflicts(o.where("id % 2 = 0"), o.where("id % 2 = 1"))


@query("j11_unlinked", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j11_unlinked(t):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j13_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def j13_correlated_count(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t("customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"))


@query("j09_linkage_by_rank", """
WITH a AS (SELECT s_suppkey AS i, s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier),
     b AS (SELECT c_custkey AS i, c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer)
SELECT a.k, a.i, b.i AS i_right FROM a JOIN b ON a.k = b.k AND a.rn = b.rn""")
def j09_linkage_by_rank(t):
    return reconcile.link_by_rank(t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("i")), t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("i")), "k", "i")


@query("a06_table_counts", " UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS n FROM {x}" for x in ("customer", "documents", "events", "lineitem", "orders", "part", "supplier")))
def a06_table_counts(t):
    out = None
    for name in ("customer", "documents", "events", "lineitem", "orders", "part", "supplier"):
        one = t(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a07_conditional_counts", "SELECT count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS total FROM events")
def a07_conditional_counts(t):
    return t("events").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count(F.lit(1)).alias("total"))


@query("a19_distinct_people", """
WITH u AS (SELECT s_name AS name, 1 AS p FROM supplier UNION ALL SELECT upper(s_name), 2 FROM supplier UNION ALL SELECT c_name, 3 FROM customer)
SELECT name, p::INT AS p FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY p, name) AS rn FROM u WHERE name IS NOT NULL AND name <> '') WHERE rn = 1""")
def a19_distinct_people(t):
    u = t("supplier").select(F.col("s_name").alias("name"), F.lit(1).alias("p")).unionByName(t("supplier").select(F.upper("s_name").alias("name"), F.lit(2).alias("p"))).unionByName(t("customer").select(F.col("c_name").alias("name"), F.lit(3).alias("p")))
    return u.where("name is not null and name <> ''").groupBy(F.lower("name").alias("l")).agg(F.min(F.struct("p", "name")).alias("m")).select("m.name", "m.p")


@query("a20_keyword_category", "SELECT o_orderpriority AS name, CASE WHEN contains(lower(o_orderpriority), 'call') THEN 'Communication' ELSE 'Other' END AS category, count(*) AS n FROM orders GROUP BY 1")
def a20_keyword_category(t):
    return t("orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("category", S.artifact_category(F.col("name")))


@query("a21_container_stats", "SELECT source AS container, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1")
def a21_container_stats(t):
    return t("documents").groupBy(F.col("source").alias("container")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("bytes"))


@query("a22_compression_ratio", "SELECT source, round(count(DISTINCT text) / nullif(count(text), 0)::DOUBLE, 9) AS ratio FROM documents GROUP BY 1")
def a22_compression_ratio(t):
    return t("documents").groupBy("source").agg(F.round(F.count_distinct("text") / F.nullif(F.count("text"), F.lit(0)), 9).alias("ratio"))


@query("a25_quantiles", """
WITH r AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT name, max(n) AS n, round(avg(value), 6) AS mean, max(value) FILTER (WHERE i = floor((n - 1) * 0.5 + 0.5)) AS p50, max(value) FILTER (WHERE i = floor((n - 1) * 0.95::DOUBLE + 0.5)) AS p95,
       max(value) FILTER (WHERE i = floor((n - 1) * 0.99::DOUBLE + 0.5)) AS p99 FROM r GROUP BY 1""")
def a25_quantiles(t):
    return metrics.histogram(t("events").select(F.col("event_type").alias("name"), "value"), ["name"]).withColumn("mean", F.round("mean", 6))


@query("a26_counter_gauge", "SELECT event_type AS name, round(sum(value), 4) AS total, arg_max(value, event_id) AS last FROM events GROUP BY 1")
def a26_counter_gauge(t):
    e = t("events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), "value")
    return metrics.counters(e, ["name"]).join(metrics.gauges(e, ["name"]), "name").withColumn("total", F.round("total", 4))


@query("a28_throughput", "SELECT user_id, round(CASE WHEN count(*) > 0 THEN sum(value) / count(*) ELSE 0 END, 6) AS mean_value FROM events GROUP BY 1")
def a28_throughput(t):
    return t("events").groupBy("user_id").agg(F.round(S.ratio(F.sum("value"), F.count(F.lit(1))), 6).alias("mean_value"))


@query("a29_health", "SELECT count(*) AS issues, CASE WHEN count(*) = 0 THEN 'Healthy' WHEN bool_or(value > 490) THEN 'Unhealthy' ELSE 'Degraded' END AS status FROM events WHERE event_type = 'error'")
def a29_health(t):
    return metrics.health(t("events").where("event_type = 'error'").select(F.when(F.col("value") > 490, "critical").otherwise("warning").alias("severity")))


# ---- reconciliation ----------------------------------------------------------------------------


@query("j07_project_diff", f"""
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' WHEN a.balance IS DISTINCT FROM b.balance OR a.segment IS DISTINCT FROM b.segment THEN 'modified' ELSE 'common' END AS bucket,
       CASE WHEN a.name IS NULL OR b.name IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.balance IS DISTINCT FROM b.balance THEN 'balance' END, CASE WHEN a.segment IS DISTINCT FROM b.segment THEN 'segment' END) END AS changed
FROM {_A} a FULL JOIN {_B} b ON a.name = b.name""")
def j07_project_diff(t):
    return reconcile.diff(*_projects(t), "name", ["balance", "segment"]).select("name", "bucket", "changed")


@query("a23_similarity", f"""
WITH d AS (SELECT a.name AS x, b.name AS y, a.balance IS NOT DISTINCT FROM b.balance AND a.segment IS NOT DISTINCT FROM b.segment AS same FROM {_A} a FULL JOIN {_B} b ON a.name = b.name)
SELECT count(*) FILTER (WHERE x = y AND same) AS common, count(x) AS a, count(y) AS b, round(200.0::DOUBLE * count(*) FILTER (WHERE x = y AND same) / (count(x) + count(y)), 6) AS similarity FROM d""")
def a23_similarity(t):
    return reconcile.similarity(reconcile.diff(*_projects(t), "name", ["balance", "segment"]))


@query("j08_merge_prefer_b", f"SELECT coalesce(b.name, a.name) AS name, CASE WHEN b.name IS NULL THEN a.balance ELSE b.balance END AS balance, CASE WHEN b.name IS NULL THEN a.segment ELSE b.segment END AS segment FROM {_A} a FULL JOIN {_B} b ON a.name = b.name")
def j08_merge_prefer_b(t):
    return reconcile.merge(*_projects(t), "name", ["balance", "segment"], "PreferB")


@query("j08_merge_keep_both", f"""
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN b.balance ELSE a.balance END AS balance, CASE WHEN a.name IS NULL THEN b.segment ELSE a.segment END AS segment FROM {_A} a FULL JOIN {_B} b ON a.name = b.name
UNION ALL SELECT b.name || ' (from B)', b.balance, b.segment FROM {_A} a JOIN {_B} b ON a.name = b.name WHERE a.balance IS DISTINCT FROM b.balance OR a.segment IS DISTINCT FROM b.segment""")
def j08_merge_keep_both(t):
    return reconcile.merge(*_projects(t), "name", ["balance", "segment"], "KeepBoth")


@query("u01_set_operations", f"SELECT 'both' AS part, name FROM (SELECT name FROM {_A} INTERSECT SELECT name FROM {_B}) UNION ALL SELECT 'a', name FROM (SELECT name FROM {_A} EXCEPT SELECT name FROM {_B})")
def u01_set_operations(t):
    a, b = (x.select("name") for x in _projects(t))
    return a.intersect(b).select(F.lit("both").alias("part"), "name").unionByName(a.subtract(b).select(F.lit("a").alias("part"), "name"))


@query("u02_first_wins", f"SELECT name, balance, segment, 0 AS source_ordinal FROM {_A} UNION ALL SELECT name, balance, segment, 1 FROM {_B} WHERE name NOT IN (SELECT name FROM {_A})")
def u02_first_wins(t):
    return reconcile.first_wins(list(_projects(t)), ["name"], "balance")


@query("u04_insert_or_ignore", f"SELECT * FROM {_A} UNION ALL SELECT * FROM {_B} WHERE name NOT IN (SELECT name FROM {_A})")
def u04_insert_or_ignore(t):
    return reconcile.insert_or_ignore(*_projects(t), ["name"])


@query("w03_newest_wins", """
SELECT user_id, event_type, ts FROM (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def w03_newest_wins(t):
    return reconcile.newest_wins(t("events").withColumn("source_ordinal", F.col("event_id")), "user_id", "ts").select("user_id", "event_type", "ts")


@query("w04_field_merge", """
SELECT user_id::VARCHAR AS username, min(ts) AS first_access, max(ts) AS last_access, arg_min(event_type, event_id) FILTER (WHERE event_type <> 'view') AS display_name, arg_min(props, event_id) AS hostname FROM events GROUP BY 1""")
def w04_field_merge(t):
    e = t("events").select(F.col("user_id").cast("string").alias("username"), F.col("ts").alias("first_access"), F.col("ts").alias("last_access"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("display_name"), F.col("props").alias("hostname"), F.col("event_id").alias("source_ordinal"))
    return reconcile.merge_users(e)


@query("m01_upsert", f"SELECT coalesce(a.name, b.name) AS name, coalesce(b.balance, a.balance) AS balance, coalesce(b.segment, a.segment) AS segment FROM {_A} a FULL JOIN {_B} b ON a.name = b.name")
def m01_upsert(t):
    return reconcile.upsert(*_projects(t), "name", ["balance", "segment"])


@query("m04_status_machine", """
WITH s AS (SELECT o_custkey AS k, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'P' THEN 'complete' ELSE 'locked' END AS status FROM orders), b AS (SELECT *, lag(status) OVER (PARTITION BY k ORDER BY seq) AS before FROM s)
SELECT k, seq, status, before, before IS NULL OR (before || '>' || status) IN ('draft>complete', 'draft>locked', 'complete>locked') AS valid FROM b""")
def m04_status_machine(t):
    s = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "P", "complete").otherwise("locked").alias("status"))
    return reconcile.transitions(s, "k", {("draft", "complete"), ("draft", "locked"), ("complete", "locked")})


@query("m07_recent_list", "SELECT user_id, event_id, rn::INT AS rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def m07_recent_list(t):
    return t("events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("rn <= 10").select("user_id", "event_id", "rn")


# ---- search ------------------------------------------------------------------------------------

_TERMS = ["the", "clown", "password", "license"]
_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND length(x) <= 40)"


@query("x01_vocabulary", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def x01_vocabulary(t):
    return search.postings(t("documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("t01_bm25_top_k", f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
     h AS (SELECT doc_id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) WHERE term IN ('the', 'clown', 'password', 'license') GROUP BY ALL),
     f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
     r AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN f USING (term) CROSS JOIN s GROUP BY 1)
SELECT doc_id, round(score, 6) AS score FROM r ORDER BY round(score, 6) DESC, doc_id LIMIT 100""")
def t01_bm25_top_k(t):
    return search.top_k(search.bm25(t("documents"), "doc_id", "text", _TERMS), 100).withColumn("score", F.round("score", 6))


@query("a08_facets", f"""
SELECT source AS label, count(*) AS n FROM (SELECT source FROM documents WHERE list_contains({_TOKENS}, 'clown') ORDER BY doc_id LIMIT 50) WHERE source <> '' GROUP BY 1""")
def a08_facets(t):
    return search.facets(t("documents").where(F.array_contains(search.tokens(F.col("text")), "clown")).orderBy("doc_id").limit(50), "source")


@query("x04_fuzzy_terms", f"""
WITH v AS (SELECT DISTINCT unnest({_TOKENS}) AS term FROM documents),
     c AS (SELECT term, unnest([substr(term, 1, 4), substr(term, 1, 5), substr(term, 1, 6)]) AS head FROM v)
SELECT DISTINCT term FROM c WHERE levenshtein(head, 'clown') <= 1 OR head IN ('lcown', 'colwn', 'clwon', 'clonw')""")
def x04_fuzzy_terms(t):
    return search.fuzzy(search.postings(t("documents"), "doc_id", "text").select("term").distinct(), "clown")


@query("x06_snippet", """
WITH h AS (SELECT doc_id, text, instr(lower(text), 'clown') AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(p - 40, 1), p - greatest(p - 40, 1)) || '<b>' || substr(text, p, 5) || '</b>' || substr(text, p + 5, 40) ELSE '' END AS snippet FROM h""")
def x06_snippet(t):
    return t("documents").where("text is not null").select("doc_id", search.snippet(F.col("text"), "clown").alias("snippet"))


@query("x07_categories")
def x07_categories(t):
    spark = t("nation").sparkSession
    rows = [(e,) for names in S.CATEGORIES.values() for e in names.split()] + [("zzz",)]
    return spark.createDataFrame(rows, "ext string").select("ext", S.category(F.col("ext")).alias("category"), S.text_eligible(S.category(F.col("ext"))).alias("eligible"))


@query("x11_likely_text", r"SELECT doc_id, length(regexp_replace(substr(coalesce(text, ''), 1, 1024), '[^\x20-\x7E\s]', '', 'g')) > 0.85 * least(length(coalesce(text, '')), 1024) AS likely FROM documents")
def x11_likely_text(t):
    head = F.substring(F.coalesce("text", F.lit("")), 1, 1024)
    return t("documents").select("doc_id", (F.length(F.regexp_replace(head, r"[^\x20-\x7E\s]", "")) > 0.85 * F.length(head)).alias("likely"))


@query("x14_index_stats", "SELECT count(*) AS docs, count(text) AS content_docs, sum(n_chars)::BIGINT AS bytes FROM documents")
def x14_index_stats(t):
    return t("documents").agg(F.count(F.lit(1)).alias("docs"), F.count("text").alias("content_docs"), F.sum("n_chars").alias("bytes"))


# ---- nested, paging ----------------------------------------------------------------------------


@query("n03_grouped_structs", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def n03_grouped_structs(t):
    return t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l")).select("o_custkey", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("orders"))


@query("t02_paged_read", "SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id LIMIT 500 OFFSET 200")
def t02_paged_read(t):
    total = t("documents").agg(F.count(F.lit(1)).alias("total"))
    return t("documents").select("doc_id", "n_chars").orderBy("doc_id").offset(200).limit(500).crossJoin(F.broadcast(total))  # one row


@query("t08_sheet_sort", "SELECT event_id, rn FROM (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 100")
def t08_sheet_sort(t):
    return t("events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(100).select("event_id", F.row_number().over(Window.orderBy(F.desc("value"), "event_id")).cast("long").alias("rn"))


@query("w01_first_turn", "SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations GROUP BY 1")
def w01_first_turn(t):
    return t("conversations").groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by("text", "turn").alias("text"))
