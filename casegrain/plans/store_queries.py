"""Registered queries of the joins, merges, state machines and aggregates of the case store."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain.functions import scalars as S
from casegrain.operators import custody, discovery, duplicates, maintenance, metrics, reconcile, timeline
from casegrain.plans.registry import query


@query("j03_verified_hashes", "SELECT l.l_orderkey, l.l_linenumber, md5(p.p_name) AS hash, l.l_returnflag = 'N' AS passed FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey")
def verified_hashes(t):
    hashes = t("part").select("p_partkey", F.md5("p_name").alias("hash"))
    v = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "N").alias("passed"))
    return v.join(hashes, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "hash", "passed")


@query("j06_a05_artifact_types", "SELECT p_type AS type, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_type IS NOT NULL AND p_type <> '' GROUP BY 1")
def artifact_types(t):
    j = t("lineitem").select("l_partkey").join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return metrics.type_counts(j, "p_type").withColumnRenamed("name", "type")


@query("j11_linked_data", """
SELECT c.c_custkey AS collection, o.o_orderkey AS item, l.l_partkey AS file, CASE WHEN c.c_custkey IS NULL THEN 'unlinked' ELSE 'linked' END AS state
FROM (SELECT * FROM orders) o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1) l ON l.l_orderkey = o.o_orderkey""")
def linked_data(t):
    collections = t("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("collection"))
    items = t("orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("collection_id"))
    files = t("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("file"))
    return reconcile.linked_data(collections, items, files)


@query("j12_m08_cascade", """
SELECT 'orders' AS tab, count(*) AS n FROM orders WHERE o_custkey % 10 <> 3 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 10 <> 3
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)""")
def cascade(t):
    tables = {name: t(name) for name in ("customer", "orders", "lineitem")}
    gone = t("customer").where("c_custkey % 10 = 3").select("c_custkey")
    kept = reconcile.delete_cascade(tables, gone, [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")])
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), "n") for name, df in kept.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("j16_sibling_prefix", """
WITH z AS (SELECT p_partkey, p_brand AS dir, lower(split_part(p_name, ' ', 1)) AS stem FROM part WHERE p_partkey % 2 = 0), u AS (SELECT p_brand AS dir, lower(p_name) AS stem FROM part WHERE p_partkey % 2 = 1)
SELECT p_partkey FROM z WHERE EXISTS (SELECT 1 FROM u WHERE u.dir = z.dir AND starts_with(u.stem, z.stem))""")
def sibling_prefix(t):
    z = t("part").where("p_partkey % 2 = 0").select("p_partkey", F.col("p_brand").alias("folder"), F.substring_index("p_name", " ", 1).alias("stem"))
    u = t("part").where("p_partkey % 2 = 1").select(F.col("p_brand").alias("folder"), F.col("p_name").alias("stem"))
    return discovery.with_sibling(z, u).select("p_partkey")


_T = "(SELECT 'n' || (o_orderkey % 500) AS name, o_orderkey AS v FROM orders WHERE o_orderkey % 3 = 0)"
_S = "(SELECT 'n' || (o_orderkey % 700) AS name, o_orderkey AS v FROM orders WHERE o_orderkey % 3 <> 0)"


def _named(t):
    o = t("orders").select(F.col("o_orderkey").alias("v"))
    name = lambda n: F.concat(F.lit("n"), (F.col("v") % n).cast("string")).alias("name")
    return o.where("v % 3 = 0").select(name(500), "v"), o.where("v % 3 <> 0").select(name(700), "v")


@query("j17_sync_overwrite", f"SELECT name, v FROM {_T} WHERE name NOT IN (SELECT name FROM {_S}) UNION ALL SELECT name, max(v) FROM {_S} GROUP BY 1")
def sync_overwrite(t):
    return reconcile.sync_by_name(*_named(t), "name", "v", True)


@query("j17_sync_add_missing", f"SELECT name, v FROM {_T} UNION ALL SELECT name, min(v) FROM {_S} WHERE name NOT IN (SELECT name FROM {_T}) GROUP BY 1")
def sync_add_missing(t):
    return reconcile.sync_by_name(*_named(t), "name", "v", False)


@query("j07_diff_repeated_keys", f"""
WITH b AS (SELECT name, max(v) AS v FROM {_S} GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, a.v AS a_v, b.v AS b_v, CASE WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' WHEN a.v % 50 <> b.v % 50 THEN 'modified' ELSE 'common' END AS bucket
FROM {_T} a FULL JOIN b ON a.name = b.name""")
def diff_repeated_keys(t):
    a, b = (x.withColumn("w", F.col("v") % 50) for x in _named(t))
    d = reconcile.diff(a.withColumn("full", F.col("v")), b.withColumn("full", F.col("v")), "name", ["w", "full"], "v")
    left, right = F.col("name_row_a"), F.col("name_row_b")
    same = left["w"].eqNullSafe(right["w"])
    return d.select("name", left["full"].alias("a_v"), right["full"].alias("b_v"), F.when(F.col("bucket").isin("only_a", "only_b"), F.col("bucket")).when(same, "common").otherwise("modified").alias("bucket"))


@query("u04_ignore_repeats", f"SELECT name, v FROM {_T} UNION ALL SELECT name, min(v) FROM {_S} WHERE name NOT IN (SELECT name FROM {_T}) GROUP BY 1")
def ignore_repeats(t):
    return reconcile.insert_or_ignore(*_named(t), ["name"], "v")


@query("m01_upsert_repeats", f"WITH a AS (SELECT name, max(v) AS v FROM {_T} GROUP BY 1), b AS (SELECT name, max(v) AS v FROM {_S} GROUP BY 1) SELECT coalesce(b.name, a.name) AS name, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.name = b.name")
def upsert_repeats(t):
    a, b = _named(t)
    return reconcile.upsert(a.groupBy("name").agg(F.max("v").alias("v")), b, "name", ["v"], "v")


@query("u03_hash_history", """
SELECT path, algorithm, min(src)::INT AS src FROM (SELECT l_orderkey AS path, l_returnflag AS algorithm, 0 AS src FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT l_orderkey, l_returnflag, 1 FROM lineitem) GROUP BY ALL""")
def hash_history(t):
    h = t("lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("algorithm"), "l_linenumber")
    parts = [h.where("l_linenumber % 2 = 0").select("path", "algorithm", F.lit(0).alias("src")), h.select("path", "algorithm", F.lit(1).alias("src"))]
    return reconcile.union_distinct(parts, ["path", "algorithm"])


@query("u07_loaded_paths", "SELECT o_custkey AS path FROM orders UNION SELECT c_custkey FROM customer")
def loaded_paths(t):
    return reconcile.all_paths([t("orders").select(F.col("o_custkey").alias("path")), t("customer").select(F.col("c_custkey").alias("path"))], "path")


@query("u05_chronological", "SELECT kind, id, ts, row_number() OVER (ORDER BY ts, kind, id) AS rn FROM (SELECT 'event' AS kind, event_id AS id, ts FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders) ORDER BY rn LIMIT 500")
def chronological(t):
    from casegrain.operators import listings

    parts = [t("events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "ts"), t("orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))]
    return listings.ranked(parts[0].unionByName(parts[1]), [F.col("ts"), F.col("kind"), F.col("id")], 500)


@query("m03_st05_sessions", """
SELECT user_id AS session_id, min(ts) AS started_at, max(ts) FILTER (WHERE event_type = 'purchase') AS ended_at, (floor(epoch(max(ts) FILTER (WHERE event_type = 'purchase'))) - floor(epoch(min(ts))))::BIGINT AS duration_seconds,
       coalesce(CASE WHEN user_id % 2 = 0 AND count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'done' END, 'started') AS summary FROM events GROUP BY 1""")
def sessions(t):
    e = t("events")
    started = e.groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("started_at")).withColumn("summary", F.lit("started"))
    ends = e.where("event_type = 'purchase'").select(F.col("user_id").alias("session_id"), F.col("ts").alias("ended_at"), F.when(F.col("user_id") % 2 == 0, "done").alias("summary"))
    return custody.end_sessions(started, ends)


_ACTS = ("create", "edit", "lock", "amend", "void", "edit", "amend")
_LOG = f"(SELECT o_custkey AS id, o_orderkey AS seq, ({list(_ACTS)!r})[o_orderkey % 7 + 1] AS action, o_orderpriority AS actor FROM orders)"
_STATE = f"""l AS (SELECT *, min(seq) FILTER (WHERE action = 'create') OVER w AS made FROM {_LOG} WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     s AS (SELECT *, CASE WHEN made IS NULL THEN NULL WHEN bool_or(action = 'void' AND made IS NOT NULL) OVER w THEN 'voided' WHEN bool_or(action = 'lock' AND made IS NOT NULL) OVER w THEN 'locked' ELSE 'draft' END AS before
           FROM l WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     x AS (SELECT id, seq, action, actor, before, CASE action WHEN 'create' THEN before IS NULL WHEN 'void' THEN before IS NOT NULL WHEN 'amend' THEN coalesce(before IN ('draft', 'locked'), false) ELSE coalesce(before = 'draft', false) END AS allowed FROM s)"""


def _custody_log(t):
    action = F.element_at(F.array(*[F.lit(a) for a in _ACTS]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), action.alias("action"), F.col("o_orderpriority").alias("actor"))


@query("m04_custody_actions", f"WITH {_STATE} SELECT id, seq, action, before, allowed, CASE WHEN NOT allowed THEN before ELSE CASE action WHEN 'create' THEN 'draft' WHEN 'edit' THEN 'draft' WHEN 'lock' THEN 'locked' WHEN 'void' THEN 'voided' ELSE before END END AS after FROM x")
def custody_actions(t):
    return custody.run_actions(_custody_log(t)).drop("actor")


@query("m04_custody_audit", f"WITH {_STATE} SELECT id, seq, CASE action WHEN 'lock' THEN 'locked' WHEN 'amend' THEN 'amended' ELSE 'voided' END AS action, 'COC item ' || CASE action WHEN 'lock' THEN 'locked' WHEN 'amend' THEN 'amended' ELSE 'voided' END || ' by ' || actor AS summary FROM x WHERE allowed AND action IN ('lock', 'amend', 'void')")
def custody_audit(t):
    return custody.audit(_custody_log(t))


@query("m04_amendments", """
WITH c AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'notes' WHEN o_orderkey % 3 = 1 THEN 'model' ELSE 'status' END AS field, o_orderpriority AS new_value FROM orders)
SELECT id, seq, field, coalesce(lag(new_value) OVER (PARTITION BY id, field ORDER BY seq), 'first') AS old_value, new_value FROM c WHERE field IN ('notes', 'model') AND id % 7 <> 0""")
def custody_amendments(t):
    k = F.col("o_orderkey") % 3
    changes = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.when(k == 0, "notes").when(k == 1, "model").otherwise("status").alias("field"), F.lit("first").alias("old_value"), F.col("o_orderpriority").alias("new_value"))
    statuses = t("orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("status", F.when(F.col("id") % 7 == 0, "voided").otherwise("locked"))
    return custody.amendments(changes, statuses, ["notes", "model"])


@query("a03_category_counts", "SELECT p_brand AS category, p_type AS artifact_type, count(*) AS n FROM part GROUP BY 1, 2")
def category_counts(t):
    return t("part").groupBy(F.col("p_brand").alias("category"), F.col("p_type").alias("artifact_type")).agg(F.count(F.lit(1)).alias("n"))


@query("a04_fallback_chain", "SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1")
def fallback_chain(t):
    counts = lambda table, column: lambda: metrics.type_counts(table(), column)
    missing = lambda: t("part").select(F.col("no_such_column"))
    return metrics.first_non_empty([counts(missing, "no_such_column"), counts(lambda: t("part").where("p_size < 0"), "p_type"), counts(lambda: t("part"), "p_type")])


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


@query("a06_all_counts", " UNION ALL ".join([f"SELECT '{x}' AS name, count(*) AS n FROM {x}" for x in _TABLES] + [
    "SELECT 'events:' || event_type, count(*) FROM events GROUP BY event_type", "SELECT 'orders:' || o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus",
    "SELECT 'documents without text', count(*) FROM documents WHERE text IS NULL OR text = ''", "SELECT 'labels toxic', count(*) FROM labels WHERE toxic = 1"]))
def all_counts(t):
    parts = [metrics.table_count(t(x), x) for x in _TABLES]
    parts += [metrics.counts_by(t("events"), "event_type", "events:"), metrics.counts_by(t("orders"), "o_orderstatus", "orders:")]
    parts += [metrics.table_count(t("documents").where("text is null or text = ''"), "documents without text"), metrics.table_count(t("labels").where("toxic = 1"), "labels toxic")]
    return metrics.stacked(parts)


@query("a11_size_only_category", "SELECT size, n, 'mixed' AS category FROM (SELECT size, count(*) AS n FROM (SELECT p_size::BIGINT AS size FROM part WHERE p_size > 0 GROUP BY p_size, lower(p_name) HAVING count(*) = 1) GROUP BY 1) WHERE n > 1")
def size_only_category(t):
    files = t("part").select(F.col("p_brand").alias("container"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"))
    return duplicates.size_groups(files).select("size", "n", F.lit("mixed").alias("category"))


def _log(t):
    return t("events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("user"), F.col("event_type").alias("action"))


@query("a13_per_session", "SELECT count(*) AS activities, (SELECT count(DISTINCT user_id) FROM events WHERE user_id % 2 = 0) AS sessions, round(count(*) / greatest((SELECT count(DISTINCT user_id) FROM events WHERE user_id % 2 = 0), 1)::DOUBLE, 6) AS mean_per_session FROM events")
def per_session(t):
    return timeline.per_session(_log(t), t("events").where("user_id % 2 = 0").select(F.col("user_id").alias("session_id")).distinct())


@query("a14_heatmap_max", "SELECT max(n) AS most, sum(n)::BIGINT AS total, count(*) AS filled FROM (SELECT count(*) AS n FROM events GROUP BY dayofweek(ts), hour(ts))")
def heatmap_max(t):
    return timeline.heatmap(_log(t)).agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("filled"))


@query("a18_trend_by_type", """
WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), p AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS k FROM d), c AS (SELECT ts::DATE AS day, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2)
SELECT action, round(sum(n) FILTER (WHERE i <= k // 2) / (any_value(k) // 2)::DOUBLE, 6) AS first_half, round(sum(n) FILTER (WHERE i > k // 2) / (any_value(k) - any_value(k) // 2)::DOUBLE, 6) AS second_half FROM c JOIN p USING (day) GROUP BY 1""")
def trend_by_type(t):
    out = timeline.trend_by_type(_log(t))
    return out.select("action", F.round("first_half", 6).alias("first_half"), F.round("second_half", 6).alias("second_half"))


@query("a22_ratio_of_sizes", "SELECT source, round(sum(octet_length(encode(text))) / nullif(sum(n_chars), 0)::DOUBLE, 9) AS ratio FROM documents GROUP BY 1")
def ratio_of_sizes(t):
    d = t("documents").select("source", F.octet_length("text").alias("stored"), F.col("n_chars").alias("plain"))
    return metrics.compression(d, "source", "stored", "plain").withColumn("ratio", F.round("ratio", 9))


@query("a25_last_samples", """
WITH w AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS age FROM events), r AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM w WHERE age <= 50),
     a AS (SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1)
SELECT a.name, a.n, a.mean, max(value) FILTER (WHERE i = floor((r.n - 1) * 0.5 + 0.5)) AS p50, max(value) FILTER (WHERE i = floor((r.n - 1) * 0.95::DOUBLE + 0.5)) AS p95, max(value) FILTER (WHERE i = floor((r.n - 1) * 0.99::DOUBLE + 0.5)) AS p99
FROM a JOIN r USING (name) GROUP BY ALL""")
def last_samples(t):
    s = t("events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), "value")
    return metrics.histogram(s, ["name"], window=50).withColumn("mean", F.round("mean", 6))


_OPS = "(SELECT event_id AS seq, event_type AS type, ['start', 'complete', 'bytes', 'cache', 'error'][event_id % 5 + 1] AS what, event_id % 3 = 0 AS good, round(value, 3) AS amount FROM events)"


@query("a27_operation_metrics", f"""
SELECT 'operations_started_total' AS series, type || '/' AS labels, count(*)::DOUBLE AS total FROM {_OPS} WHERE what = 'start' GROUP BY 2
UNION ALL SELECT 'operations_completed_total', type || '/' || CASE WHEN good THEN 'success' ELSE 'error' END, count(*) FROM {_OPS} WHERE what = 'complete' GROUP BY 2
UNION ALL SELECT 'bytes_processed_total', type || '/', round(sum(amount), 3) FROM {_OPS} WHERE what = 'bytes' GROUP BY 2
UNION ALL SELECT 'cache_accesses_total', type || '/' || CASE WHEN good THEN 'hit' ELSE 'miss' END, count(*) FROM {_OPS} WHERE what = 'cache' GROUP BY 2
UNION ALL SELECT 'errors_total', type || '/', count(*) FROM {_OPS} WHERE what = 'error' GROUP BY 2
UNION ALL SELECT 'active_operations', type || '/', sum(CASE what WHEN 'start' THEN 1 ELSE -1 END) FROM {_OPS} WHERE what IN ('start', 'complete') GROUP BY 2
UNION ALL SELECT 'operation_duration_seconds', type || '/', round(sum(amount), 3) FROM {_OPS} WHERE what = 'complete' GROUP BY 2""")
def operation_metrics(t):
    what = F.element_at(F.array(*[F.lit(x) for x in ("start", "complete", "bytes", "cache", "error")]), (F.col("event_id") % 5 + 1).cast("int"))
    ops = t("events").select(F.col("event_type").alias("type"), what.alias("what"), (F.col("event_id") % 3 == 0).alias("good"), F.round("value", 3).alias("amount"))
    return metrics.operation_series(ops).withColumn("total", F.round("total", 3))


@query("a28_rates", f"""
SELECT type, round(sum(amount) FILTER (WHERE what = 'bytes') / 60.0 / 1048576, 9) AS mb_per_second, round(coalesce(sum(amount) FILTER (WHERE what = 'complete') * 1000 / nullif(count(*) FILTER (WHERE what = 'complete'), 0), 0), 6) AS mean_ms FROM {_OPS} GROUP BY 1""")
def rates(t):
    what = F.element_at(F.array(*[F.lit(x) for x in ("start", "complete", "bytes", "cache", "error")]), (F.col("event_id") % 5 + 1).cast("int"))
    ops = t("events").select(F.col("event_type").alias("type"), what.alias("what"), F.round("value", 3).alias("amount"))
    out = metrics.rates(ops, seconds=60.0)
    return out.select("type", F.round("mb_per_second", 9).alias("mb_per_second"), F.round("mean_ms", 6).alias("mean_ms"))


@query("a30_performance_summary", """
WITH c AS (SELECT user_id AS component, count(*) FILTER (WHERE event_type = 'view') AS renders, avg(value) FILTER (WHERE event_type = 'view') AS mean FROM events GROUP BY 1)
SELECT count(*) FILTER (WHERE event_type = 'view') AS renders, count(*) FILTER (WHERE event_type = 'click') AS effects, round(coalesce(avg(value) FILTER (WHERE event_type = 'view'), 0), 6) AS mean_render, round(coalesce(avg(value) FILTER (WHERE event_type = 'click'), 0), 6) AS mean_effect,
       (SELECT component FROM c WHERE renders > 0 ORDER BY round(mean, 9) DESC, component LIMIT 1) AS slowest, (SELECT component FROM c WHERE renders > 0 ORDER BY renders DESC, component LIMIT 1) AS most_rendered FROM events""")
def performance_summary(t):
    e = t("events").select(F.when(F.col("event_type") == "view", "render").when(F.col("event_type") == "click", "effect").otherwise("action").alias("type"), F.col("user_id").alias("component"), F.col("value").alias("duration"))
    out = metrics.performance(e)
    return out.withColumn("mean_render", F.round("mean_render", 6)).withColumn("mean_effect", F.round("mean_effect", 6))


@query("a32_merge_totals", "SELECT count(*) AS projects, sum(n)::BIGINT AS files, sum(b)::BIGINT AS bytes FROM (SELECT count(*) AS n, sum(n_chars) AS b FROM documents WHERE lang IN ('en', 'de') GROUP BY lang)")
def merge_totals(t):
    p = t("documents").groupBy(F.col("lang").alias("project")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"))
    return metrics.totals(p, ["en", "de"], ["files", "bytes"])


@query("a31_segment_sets", """
WITH n AS (SELECT 'set' || (l_orderkey % 97) AS stem, l_linenumber AS number, (l_quantity)::BIGINT AS size FROM lineitem)
SELECT stem, count(DISTINCT number) AS parts, sum(size)::BIGINT AS size, min(number)::INT AS first, max(number)::INT AS last, min(number) <= 1 AND max(number) - min(number) + 1 = count(DISTINCT number) AS complete FROM n GROUP BY 1""")
def segment_sets(t):
    from casegrain.sources import readers

    path = F.concat(F.lit("/x/set"), (F.col("l_orderkey") % 97).cast("string"), F.lit(".E"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    return readers.segments(t("lineitem").select(path.alias("path"), F.col("l_quantity").cast("long").alias("size")))


_LIST = "(SELECT p_partkey AS id, p_brand AS dir, p_size::BIGINT AS size, 'Case' || (p_partkey % 40) || ['.E01', '.E02', '.zip', '_Advanced.ufd', '.ufdx', '.docx'][p_partkey % 6 + 1] AS name FROM part)"


@query("sc03_discovered_containers", f"""
SELECT dir || '/' || name AS path, CASE WHEN p = 'E01' THEN 'EnCase (E01)' WHEN p = 'ufd' THEN 'UFED (UFD)' WHEN EXISTS (SELECT 1 FROM {_LIST} u WHERE ends_with(u.name, '.ufd') AND u.dir = l.dir AND starts_with(lower(u.name), lower(regexp_extract(l.name, '^(.*)\\.zip$', 1)))) THEN 'UFED' ELSE 'ZIP' END AS container_type
FROM (SELECT DISTINCT dir, name, regexp_extract(name, '\\.([^.]+)$', 1) AS p FROM {_LIST}) l WHERE p IN ('E01', 'zip', 'ufd')""")
def discovered_containers(t):
    ends = F.array(*[F.lit(e) for e in (".E01", ".E02", ".zip", "_Advanced.ufd", ".ufdx", ".docx")])
    name = F.concat(F.lit("Case"), (F.col("p_partkey") % 40).cast("string"), F.element_at(ends, (F.col("p_partkey") % 6 + 1).cast("int")))
    files = t("part").select(F.concat("p_brand", F.lit("/"), name).alias("path"), F.col("p_size").cast("long").alias("size"))
    return discovery.containers(files).select("path", "container_type")


@query("sc12_container_kinds", "SELECT p_partkey, ['ad1', 'l01', 'archive', 'ewf', 'raw', NULL][p_partkey % 6 + 1] AS kind FROM part")
def container_kinds(t):
    heads = ["ADSEGMENTEDFILE", "LVF\t\r\n", "PK\x03\x04", "EVF\t\r\n", "", "plain"]
    names = ["x.bin", "x.L01", "x.dat", "x.E01", "x.dd", "x.txt"]
    k = (F.col("p_partkey") % 6 + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), k)
    return t("part").select("p_partkey", discovery.container_kind(pick(names), pick(heads).cast("binary")).alias("kind"))


@query("x08_x11_index_text", "SELECT doc_id, length(t) > 0 AND (octet_length(encode(t)) < 100000) AND length(regexp_replace(substr(t, 1, 1024), '[^\\x20-\\x7E\\s]', '', 'g')) > 0.85 * least(length(t), 1024) AS likely FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def index_text(t):
    return t("documents").select("doc_id", S.likely_text(F.coalesce("text", F.lit(""))).alias("likely"))


@query("sk13_integrity", """
SELECT 'null key' AS "check", 'orders' AS subject, count(*) AS n FROM orders WHERE o_orderkey IS NULL UNION ALL SELECT 'null key', 'lineitem', count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL
UNION ALL SELECT 'repeated key', 'orders', count(*) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'repeated key', 'lineitem', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'no parent', 'lineitem.l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def integrity(t):
    tables = {"orders": (t("orders"), ["o_orderkey"]), "lineitem": (t("lineitem"), ["l_orderkey", "l_linenumber"])}
    return maintenance.integrity(tables, [("lineitem", "l_orderkey", "orders", "o_orderkey")])


@query("j09_linked_evidence", """
SELECT p_partkey AS i, p_partkey AS j, CASE p_partkey % 3 WHEN 0 THEN 'evidence_file_id' WHEN 1 THEN 'item_number' ELSE 'serial_number' END AS method,
       CASE p_partkey % 3 WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM part""")
def linked_evidence(t):
    k, n = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    items = t("part").select(F.col("p_partkey").alias("i"), F.when(k == 0, F.concat(F.lit("/e/"), n)).otherwise("").alias("file_id"), F.when(k == 1, F.concat(F.lit(" IT  "), n)).otherwise("").alias("item_number"), F.when(k == 2, F.concat(F.lit("s"), n)).otherwise("").alias("serial"), F.lit("").alias("description"))
    files = t("part").select(F.col("p_partkey").alias("j"), F.concat(F.lit("/e/"), n).alias("path"), F.when(k == 1, F.concat(F.lit("it "), n)).alias("evidence_number"), F.when(k == 2, F.concat(F.lit("S"), n)).alias("serial"), F.lit("").alias("filename"))
    return reconcile.link_evidence(items, files)


@query("j11_customers_without_late_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def customers_without_late_orders(t):
    late = t("orders").where("o_orderstatus = 'P'")
    return t("customer").join(late, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")
