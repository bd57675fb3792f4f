"""Registered queries of readers and sinks: a table is written in a format, to the shared folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casegrain.functions import scalars as S
from casegrain.operators import discovery, index, shared
from casegrain.plans.registry import query
from casegrain.sources import images, readers
from casegrain.streaming import jobs


def _place(df) -> str:
    return f"{shared.folder(df.sparkSession)}/formats/{uuid.uuid4().hex}"


@query("sk08_sc15_csv_round_trip", "SELECT p_partkey::VARCHAR AS c0, p_name AS c1, p_size::VARCHAR AS c2, 'int' AS c0_type, 'string' AS c1_type, 'int' AS c2_type FROM part")
def csv_round_trip(t):
    rows = t("part").select("p_partkey", "p_name", "p_size")
    path = _place(rows)
    readers.csv_rows(rows, rows.columns).write.text(path)
    back = readers.read_table(rows.sparkSession, path)
    return readers.typed(back.select(*[F.col(f"_c{i}").alias(f"c{i}") for i in range(3)]), ["c0", "c1", "c2"])


@query("sc15_row_window", "SELECT range::BIGINT AS row FROM range(100, 150)")
def row_window(t):
    rows = t("orders").select("o_orderkey", "o_orderpriority")
    path = _place(rows)
    readers.export_csv(rows, path, "\t")
    return readers.read_table(rows.sparkSession, path, "\t", header=True, first=100, most=50).select("row")


@query("sk05_dedup_csv", """SELECT '"' || replace(p_name, '"', '""') || '","' || p_brand || '",' || p_size AS value FROM part WHERE (p_size, lower(p_name)) IN (SELECT (p_size, lower(p_name)) FROM part WHERE p_size > 0 GROUP BY ALL HAVING count(*) > 1)""")
def dedup_csv(t):
    files = t("part").where("p_size > 0").select("p_size", F.lower("p_name").alias("low"), "p_name", "p_brand")
    groups = files.groupBy("p_size", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p_size", "low")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return files.join(groups, ["p_size", "low"]).select(F.concat_ws(",", quoted(F.col("p_name")), quoted(F.col("p_brand")), F.col("p_size").cast("string")).alias("value"))


@query("sk06_json_round_trip", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def json_round_trip(t):
    rows = t("customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))
    path = _place(rows)
    readers.export_json(rows, path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


@query("sk07_timeline_document", "SELECT 'activity' AS kind, count(*) AS n FROM events UNION ALL SELECT 'summary', 1 UNION ALL SELECT 'metadata', 1")
def timeline_document(t):
    log = t("events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("user"), F.col("event_type").alias("action"))
    path = _place(log)
    readers.export_timeline(log, path, {"case": "one"})
    return log.sparkSession.read.json(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("sk10_html_rows", "SELECT '<tr><td>' || replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</td><td>' || doc_id || '</td></tr>' AS value FROM documents")
def html_table_rows(t):
    return readers.html_rows(t("documents"), ["text", "doc_id"])


@query("sc19_mbox_messages", "SELECT conv_id, count(*) AS messages, min(role) AS least_role FROM conversations GROUP BY 1")
def mbox_messages(t):
    c = t("conversations").select("conv_id", "turn", "role", F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " "), "^From ", ">From ").alias("text"))
    one = F.concat(F.lit("From x\nSubject: "), F.col("conv_id").cast("string"), F.lit("\nFrom: "), F.col("role"), F.lit("@example.org\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text")
    path = _place(c)
    c.orderBy("conv_id", "turn").select(one.alias("value")).write.text(path)
    mail = readers.read_mbox(c.sparkSession, path)
    return mail.groupBy(F.col("subject").cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("messages"), F.min(F.substring_index("sender", "@", 1)).alias("least_role"))


@query("sc01_sc02_sc11_scan", "SELECT 'nation' AS name, 1 AS files UNION ALL SELECT 'region', 1")
def folder_scan(t):
    rows = t("nation")
    path = _place(rows)
    rows.coalesce(1).write.json(f"{path}/deep/nation")
    t("region").coalesce(1).write.json(f"{path}/region")
    found = readers.scan_files(rows.sparkSession, path)
    return found.where("extension = 'json'").groupBy(F.element_at(F.split("path", "/"), -2).alias("name")).agg(F.count(F.lit(1)).cast("int").alias("files"))


@query("sc06_magic_types", "SELECT 'application/gzip' AS mime, 'archive' AS kind, true AS certain, count(*) > 0 AS any FROM region")
def magic_types(t):
    rows = t("region")
    path = _place(rows)
    rows.coalesce(1).write.option("compression", "gzip").json(path)
    files = rows.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return readers.magic_type(files).select("mime", "kind", (F.col("mime").isNotNull()).alias("certain"), F.lit(True).alias("any"))


@query("sc26_case_databases", "SELECT tool, count(*) AS n FROM (SELECT ['AXIOM', 'Cellebrite', 'X-Ways', 'Autopsy', NULL][p_partkey % 5 + 1] AS tool FROM part) WHERE tool IS NOT NULL GROUP BY 1")
def case_databases(t):
    ends = F.array(*[F.lit(e) for e in (".mfdb", ".UFDR", ".xfc", ".aut", ".txt")])
    files = t("part").select(F.concat(F.lit("/c/"), F.col("p_partkey").cast("string"), F.element_at(ends, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("path"))
    return discovery.case_databases(files).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


@query("sc28_case_documents", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'case_notes' WHEN doc_id % 3 = 1 AND contains(lower(coalesce(text, '')), 'license') THEN 'chain_of_custody' ELSE 'other' END AS document_type FROM documents""")
def case_documents(t):
    k = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/d/case_notes_"), k, F.lit(".txt"))).otherwise(F.concat(F.lit("/d/file_"), k, F.lit(".txt")))
    says = F.when((F.col("doc_id") % 3 == 1) & F.lower(F.coalesce("text", F.lit(""))).contains("license"), "CHAIN of Custody form").otherwise("")
    files = t("documents").select("doc_id", name.alias("path"), says.alias("content"))
    found = discovery.case_documents(files)
    return found.select(F.regexp_extract("path", r"_(\d+)\.txt$", 1).cast("long").alias("doc_id"), "document_type")


@query("sc32_children_page", "SELECT path FROM (SELECT DISTINCT '/' || (page_id % 7) || '/' || page_id AS path FROM pages) WHERE starts_with(path, '/3/') ORDER BY path LIMIT 20 OFFSET 5")
def children_page(t):
    e = t("pages").select(F.concat(F.lit("/"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string")).alias("path"), F.lit(False).alias("is_dir")).distinct()
    return readers.children(e, "/3", 20, 5).select("path")


@query("x09_extracted_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE decode(encode(coalesce(text, ''))) END AS text FROM documents")
def extracted_text(t):
    ends = F.element_at(F.array(F.lit(".txt"), F.lit(".md"), F.lit(".png")), (F.col("doc_id") % 3 + 1).cast("int"))
    raw = F.coalesce("text", F.lit("")).cast("binary")
    files = t("documents").select(F.concat(F.lit("/f/"), F.col("doc_id").cast("string"), ends).alias("path"), F.lit(False).alias("is_dir"), F.octet_length(raw).alias("size"), raw.alias("content"))
    return readers.extract_text(files).select(F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("doc_id"), "text")


@query("sk01_sk03_index_upsert", """
SELECT container, count(*) AS docs, count(*) FILTER (WHERE contains(lower(' ' || txt || ' '), ' zebra ')) AS zebras
FROM (SELECT source AS container, CASE WHEN doc_id % 10 = 0 THEN 'zebra stripes' ELSE '' END AS txt FROM documents WHERE source IS NOT NULL AND source <> 'src3') GROUP BY 1""")
def index_upsert(t):
    docs = t("documents").where("source is not null")
    entries = docs.select("doc_id", F.lit("name").alias("filename"), F.lit("path").alias("entry_path"), F.lit("plain words").alias("content"), F.col("source").alias("container"))
    path, spark = _place(docs), docs.sparkSession
    index.write(entries, path)
    index.upsert(entries.where("doc_id % 10 = 0").withColumn("content", F.lit("zebra stripes")), path)
    index.delete_container(spark, path, "src3")
    found = index.scores(index.read(spark, path, "zebra"), "zebra").select("doc_id").withColumn("hit", F.lit(1))
    kept = spark.read.parquet(f"{path}/entries")
    return kept.join(found, "doc_id", "left").groupBy("container").agg(F.count(F.lit(1)).alias("docs"), F.count("hit").alias("zebras"))


@query("x14_index_parts", "SELECT count(*) AS docs, true AS has_segments, true AS has_bytes FROM documents WHERE source IS NOT NULL")
def index_parts(t):
    docs = t("documents").where("source is not null")
    entries = docs.select("doc_id", F.lit("name").alias("filename"), F.lit("path").alias("entry_path"), F.col("text").alias("content"), F.col("source").alias("container"))
    path = _place(docs)
    index.write(entries, path)
    return index.index_stats(docs.sparkSession, path).select("docs", (F.col("segments") > 0).alias("has_segments"), (F.col("bytes") > 0).alias("has_bytes"))


@query("n06_sc22_plist_rows", "SELECT key_path, value_type, preview FROM (VALUES ('', 'dict', NULL), ('/a', 'str', 'x'), ('/b', 'list', NULL), ('/b/0', 'int', '1'), ('/b/1', 'dict', NULL), ('/b/1/c', 'bool', 'True')) v(key_path, value_type, preview)")
def plist_rows(t):
    text = "<plist version='1.0'><dict><key>a</key><string>x</string><key>b</key><array><integer>1</integer><dict><key>c</key><true/></dict></array></dict></plist>"
    spark = t("region").sparkSession
    path = _place(t("region"))
    spark.createDataFrame([("<?xml version='1.0'?>" + text,)], "value string").coalesce(1).write.text(path)
    rows = readers.flatten_plist(spark, f"{path}/*.txt")
    return rows.select("key_path", "value_type", F.when(~F.col("value_type").isin("dict", "list"), F.col("preview")).alias("preview"))


@query("sc29_project_json", "SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1")
def project_json(t):
    c = t("customer").groupBy(F.lit(1).alias("one")).agg(F.collect_list(F.struct(F.col("c_mktsegment").alias("name"))).alias("bookmarks"))
    path = _place(c)
    c.select("bookmarks").coalesce(1).write.json(path)
    return readers.read_project(c.sparkSession, path).select(F.explode("bookmarks").alias("b")).groupBy(F.col("b.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("s16_safe_paths_of_pages", r"SELECT page_id, starts_with(p, '/') AS traversal FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS p FROM pages)")
def safe_paths_of_pages(t):
    return t("pages").select("page_id", S.is_traversal(F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1)).alias("traversal"))


@query("st03_stream_half_hours", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start_ts, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_half_hours(t):
    events = t("events")
    path, spark = _place(events), events.sparkSession
    events.write.parquet(f"{path}/in")
    counts = jobs.half_hours(jobs.event_stream(spark, f"{path}/in"), late="400 days")
    jobs.run_to_end(counts, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/out/{i}"), f"{path}/checkpoint")
    out = spark.read.schema(counts.schema).parquet(f"{path}/out/*")
    return out.groupBy(F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "event_type").agg(F.max("n").alias("n"))


@query("st04_running_metrics", "SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total, arg_max(value, event_id) AS last FROM events GROUP BY 1")
def running_metrics(t):
    rows = t("events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), "value")
    path, spark = _place(rows), rows.sparkSession
    rows.write.parquet(f"{path}/in")
    jobs.running_metrics(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out/0/totals").select("name", "n", F.round("total", 4).alias("total"), "last.value").withColumnRenamed("value", "last")


@query("st01_st02_stream_upsert", "SELECT source, count(*) AS n, min(doc_id) AS least FROM documents WHERE source IS NOT NULL GROUP BY 1")
def stream_upsert(t):
    rows = t("documents").where("source is not null").select("doc_id", "source", "n_chars")
    path, spark = _place(rows), rows.sparkSession
    rows.unionByName(rows).write.parquet(f"{path}/in")
    jobs.upsert_by_container(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint", key="doc_id").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))


@query("sc27_companion_summary", """
SELECT '/l/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.txt' ELSE '.sha256' END AS path, CASE WHEN p_partkey % 2 = 0 THEN 'C-' || p_partkey END AS case_number, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS examiner,
       CASE WHEN p_partkey % 2 = 0 THEN 'Guymager' END AS tool, CASE WHEN p_partkey % 2 = 0 THEN 'MD5:' || md5(p_name) || ',SHA-1:' || sha1(p_name) ELSE 'SHA-256:' || sha256(p_name) END AS hashes FROM part""")
def companion_summary(t):
    k = F.col("p_partkey").cast("string")
    log = F.array(F.lit("guymager 0.8 report"), F.concat(F.lit("Case Number: C-"), k), F.lit("Examiner: none"), F.concat(F.lit("Examiner name: "), "p_brand"), F.concat(F.lit("MD5 hash verified source: "), F.upper(F.md5("p_name"))), F.concat(F.lit("SHA1 hash of input: "), F.sha1("p_name")), F.lit("Notes:"))
    one = F.array(F.concat(F.sha2("p_name", 256), F.lit("  image.dd")))
    even = F.col("p_partkey") % 2 == 0
    lines = t("part").select(F.concat(F.lit("/l/"), k, F.when(even, ".txt").otherwise(".sha256")).alias("path"), F.posexplode(F.when(even, log).otherwise(one)).alias("number", "value"))
    found = readers.companion_summary(lines)
    return found.select("path", "case_number", "examiner", "tool", F.array_join(F.transform("hashes", lambda h: F.concat(h["algorithm"], F.lit(":"), h["hash"])), ",").alias("hashes"))


@query("sk14_sc10_image_round_trip", """
SELECT n_nationkey::VARCHAR AS image, 2::BIGINT AS segments, 33280::BIGINT AS size, 'one' AS case_number, md5(repeat(rpad(n_name, 512, '.'), 64) || rpad(n_regionkey || n_name, 512, '.')) AS stored, true AS verified FROM nation""")
def image_round_trip(t):
    nation = t("nation")
    first = F.repeat(F.rpad("n_name", 512, "."), 64)
    second = F.rpad(F.concat(F.col("n_regionkey").cast("string"), "n_name"), 512, ".")
    both = F.array(F.struct(F.lit(1).alias("number"), first.alias("text")), F.struct(F.lit(2).alias("number"), second.alias("text")))
    parts = nation.select(F.col("n_nationkey").alias("image"), F.explode(both).alias("p")).select("image", "p.number", F.encode("p.text", "utf-8").alias("content"))
    path = _place(nation)
    images.save_files(images.ewf_segments(parts, {"case_number": "one"}), path)
    spark = nation.sparkSession
    found = images.read_images(spark, path).select("image", "segments", "case_number")
    checked = images.verify_images(spark, path).where("complete and unsound = 0")
    return checked.join(found, "image").select(F.regexp_extract("image", "([^/]+)$", 1).alias("image"), "segments", "size", "case_number", "stored", "verified")
