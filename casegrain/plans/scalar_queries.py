"""Registered queries of the scalar functions that the first catalog doesn't hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain.functions import digests
from casegrain.functions import scalars as S
from casegrain.plans.registry import query

_CUBE = "(o_orderkey * o_orderkey * 997)::BIGINT"


def _size_sql(tail: str) -> str:
    units = (("TB", 1 << 40), ("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10))
    return "CASE " + " ".join(f"WHEN b >= {n} THEN printf('%.2f {u}', b / {n}.0::DOUBLE){tail}" for u, n in units) + " ELSE b || ' bytes' END"


@query("s18_size_variants", f"""
SELECT o_orderkey, {_size_sql(" || ' (' || b || ' bytes)'")} AS long_text, {_size_sql("")} AS compact,
       CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0::DOUBLE) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0::DOUBLE)
            WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0::DOUBLE) ELSE b || ' B' END AS short_text
FROM (SELECT o_orderkey, {_CUBE} AS b FROM orders)""")
def size_variants(t):
    b = (F.col("o_orderkey") * F.col("o_orderkey") * 997).cast("long")
    return t("orders").select("o_orderkey", S.size_text(b).alias("long_text"), S.size_compact(b).alias("compact"), S.human_size(b).alias("short_text"))


@query("s04_algorithm_names", """
WITH a AS (SELECT event_id, [' md5', 'SHA-1', 'sha256 ', 'Sha-512', 'blake3', 'BLAKE2', 'xxhash3', 'XXH64', 'crc-32', 'sha3', ''][event_id % 11 + 1] AS raw FROM events)
SELECT event_id, CASE lower(trim(raw)) WHEN 'md5' THEN 'MD5' WHEN 'sha-1' THEN 'SHA-1' WHEN 'sha256' THEN 'SHA-256' WHEN 'sha-512' THEN 'SHA-512' WHEN 'blake3' THEN 'BLAKE3'
  WHEN 'blake2' THEN 'BLAKE2b' WHEN 'xxhash3' THEN 'XXH3' WHEN 'xxh64' THEN 'XXH64' WHEN 'crc-32' THEN 'CRC32' END AS algorithm FROM a""")
def algorithm_names(t):
    names = [" md5", "SHA-1", "sha256 ", "Sha-512", "blake3", "BLAKE2", "xxhash3", "XXH64", "crc-32", "sha3", ""]
    raw = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 11 + 1).cast("int"))
    return t("events").select("event_id", S.algorithm_name(raw).alias("algorithm"))


@query("s02_crc32_names", """
WITH tab AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, [x::BIGINT FOR x IN range(8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) AS c FROM range(256) r(i))),
     b AS (SELECT c_custkey, [('0x' || substr(hex(c_name), (2 * k + 1)::INT, 2))::BIGINT FOR k IN range(length(c_name))] AS bytes FROM customer),
     r AS (SELECT c_custkey, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(crc[xor(c, x) % 256 + 1], c // 256))) AS crc FROM b, tab)
SELECT c_custkey, printf('%08x', crc) AS crc32 FROM r""")
def crc32_names(t):
    return t("customer").select("c_custkey", S.content_hash(F.col("c_name"), "crc32").alias("crc32"))


@query("s03_more_digests")
def more_digests(t):
    text = F.coalesce("text", F.lit("")).cast("binary")
    return t("documents").select("doc_id", *[digests.digest(text, a).alias(a) for a in ("blake2b", "blake3", "xxh64", "xxh3")])


@query("s08_combined_segments", "SELECT source AS \"set\", count(*) AS segments, sha256(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def combined_segments(t):
    parts = t("documents").select(F.col("source").alias("set"), F.col("doc_id").alias("number"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return digests.combined(parts, "set", "number", "content", "sha256")


_LINE = "[[('MD5 checksum:    ' || md5(p_name) || ' : verified')], [('SHA1 hash: ' || upper(sha1(p_name)))], [('Case Number: ' || p_partkey)], [('no pair here')], [(' : empty key')]][p_partkey % 5 + 1][1]"


@query("s09_s10_companion_lines", rf"""
WITH l AS (SELECT p_partkey, {_LINE} AS v FROM part),
     f AS (SELECT *, regexp_extract(v, '\b([a-fA-F0-9]{{32,128}})\b', 1) AS h, upper(regexp_extract(v, '(?i)\b(MD5|SHA-?1|SHA-?256|SHA-?512)\b', 1)) AS a FROM l)
SELECT p_partkey, CASE WHEN trim(regexp_extract(v, '^([^:]+):(.+)$', 1)) <> '' THEN trim(regexp_extract(v, '^([^:]+):(.+)$', 1)) END AS "key",
       CASE WHEN trim(regexp_extract(v, '^([^:]+):(.+)$', 1)) <> '' THEN trim(regexp_extract(v, '^([^:]+):(.+)$', 2)) END AS value,
       nullif(h, '') AS hash, CASE a WHEN 'MD5' THEN 'MD5' WHEN 'SHA1' THEN 'SHA-1' END AS algorithm, contains(lower(v), 'verif') AS verified FROM f""")
def companion_lines(t):
    from casegrain.sources import readers

    k = F.col("p_partkey")
    kinds = [F.concat(F.lit("MD5 checksum:    "), F.md5("p_name"), F.lit(" : verified")), F.concat(F.lit("SHA1 hash: "), F.upper(F.sha1("p_name"))), F.concat(F.lit("Case Number: "), k.cast("string")), F.lit("no pair here"), F.lit(" : empty key")]
    lines = t("part").select("p_partkey", F.element_at(F.array(*kinds), (k % 5 + 1).cast("int")).alias("value"))
    return readers.companion_lines(lines, "p_partkey")


_NAMES = "['COC-' || o_orderkey || '.pdf', 'evidence_intake_' || o_orderkey || '.docx', 'case_notes.txt', 'property-receipt.pdf', 'IMG_' || o_orderkey || '.JPG', '2024-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' EV-' || (o_orderkey % 100) || '.pdf', 'README']"


@query("s11_s13_document_names", rf"""
WITH n AS (SELECT o_orderkey, ({_NAMES})[o_orderkey % 7 + 1] AS name FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(name, '(?i)^coc[_\-]') THEN 'chain_of_custody' WHEN regexp_matches(name, '(?i)evidence[-_]intake') THEN 'evidence_intake' WHEN regexp_matches(name, '(?i)case[-_]notes?') THEN 'case_notes'
       WHEN regexp_matches(name, '(?i)property[-_]receipt') THEN 'evidence_receipt' ELSE 'other' END AS document_type,
       nullif(regexp_extract(name, '(\d{{2,4}}[-_]?\d{{2,6}})', 1), '') AS case_number,
       CASE WHEN regexp_extract(name, '(?i)(?:EV|E|ITEM)[-_]?(\d+)', 1) <> '' THEN 'E' || regexp_extract(name, '(?i)(?:EV|E|ITEM)[-_]?(\d+)', 1) END AS evidence_id,
       lower(regexp_extract(name, '\.([^./]+)$', 1)) AS extension FROM n""")
def document_names(t):
    k = F.col("o_orderkey").cast("string")
    kinds = [F.concat(F.lit("COC-"), k, F.lit(".pdf")), F.concat(F.lit("evidence_intake_"), k, F.lit(".docx")), F.lit("case_notes.txt"), F.lit("property-receipt.pdf"), F.concat(F.lit("IMG_"), k, F.lit(".JPG")), F.concat(F.lit("2024-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit(" EV-"), (F.col("o_orderkey") % 100).cast("string"), F.lit(".pdf")), F.lit("README")]
    name = F.element_at(F.array(*kinds), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return t("orders").select("o_orderkey", S.document_type(name).alias("document_type"), S.case_number(name).alias("case_number"), S.evidence_id(name).alias("evidence_id"), S.extension(name).alias("extension"))


@query("s14_path_functions", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS p FROM pages), q AS (SELECT page_id, ' ' || p || '/./x//' AS raw, list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM p)
SELECT page_id, '/' || array_to_string(list_append(parts, 'x'), '/') AS normal, '/' || array_to_string(list_append(parts, 'x'), '/') || '/leaf' AS joined,
       CASE WHEN len(parts) = 0 THEN '/' ELSE '/' || array_to_string(parts, '/') END AS up FROM q""")
def path_functions(t):
    raw = F.concat(F.lit(" "), F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1), F.lit("/./x//"))
    return t("pages").select("page_id", S.normal_path(raw).alias("normal"), S.join_path(raw, F.lit("/leaf/")).alias("joined"), S.normal_path(F.concat(raw, F.lit("/.."))).alias("up"))


@query("s16_path_safety", r"""
WITH n AS (SELECT p_partkey, ['../' || p_name, 'a/../' || p_name, '/' || p_name, 'C:' || p_name, p_name || '..txt', 'x%2E%2e' || p_name, ' .' || p_name || '?. ', 'a\b<' || p_name || '>'][p_partkey % 8 + 1] AS name FROM part)
SELECT p_partkey, p_partkey % 8 IN (0, 1, 2, 3, 5) AS traversal,
       regexp_replace(regexp_replace(regexp_replace(name, '[<>:"|?*]', '', 'g'), '[/\\]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS safe FROM n""")
def path_safety(t):
    n = F.col("p_name")
    kinds = [F.concat(F.lit("../"), n), F.concat(F.lit("a/../"), n), F.concat(F.lit("/"), n), F.concat(F.lit("C:"), n), F.concat(n, F.lit("..txt")), F.concat(F.lit("x%2E%2e"), n), F.concat(F.lit(" ."), n, F.lit("?. ")), F.concat(F.lit("a\\b<"), n, F.lit(">"))]
    name = F.element_at(F.array(*kinds), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t("part").select("p_partkey", S.is_traversal(name).alias("traversal"), S.safe_name(name).alias("safe"))


@query("s17_segment_names", r"""
WITH n AS (SELECT l_orderkey, l_linenumber, 'set' || (l_orderkey % 97) || ['.E', '.ex', '.', '.txt'][l_orderkey % 4 + 1] || CASE WHEN l_orderkey % 4 = 3 THEN '' ELSE lpad(l_linenumber::VARCHAR, CASE WHEN l_orderkey % 4 = 2 THEN 3 ELSE 2 END, '0') END AS name FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 <> 3 THEN 'set' || (l_orderkey % 97) END AS stem, CASE WHEN l_orderkey % 4 <> 3 THEN l_linenumber::INT END AS number, l_orderkey % 4 <> 3 AS is_segment FROM n""")
def segment_names(t):
    from casegrain.sources import readers

    k = F.col("l_orderkey") % 4
    width = F.when(k == 2, F.lpad(F.col("l_linenumber").cast("string"), 3, "0")).otherwise(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    name = F.concat(F.lit("set"), (F.col("l_orderkey") % 97).cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".E", ".ex", ".", ".txt")]), (k + 1).cast("int")), F.when(k == 3, "").otherwise(width))
    return t("lineitem").select("l_orderkey", "l_linenumber", *readers.segment_parts(name))


@query("s19_hex", "SELECT doc_id, lower(hex(substr(text, 1, 12))) AS plain, rtrim(regexp_replace(hex(substr(text, 1, 12)), '(..)', '\\1 ', 'g')) AS spaced, substr(text, 1, 12) AS back FROM documents")
def hex_round_trip(t):
    head = F.substring("text", 1, 12)
    spaced = S.hex_text(head, spaced=True, upper=True)
    return t("documents").select("doc_id", S.hex_text(head).alias("plain"), spaced.alias("spaced"), S.parse_hex(spaced).cast("string").alias("back"))


_TIMES = "[strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), strftime(ts, '%Y-%m-%d %H:%M:%S'), strftime(ts, '%Y/%m/%d %H:%M:%S'), strftime(ts, '%d/%m/%Y %H:%M:%S'), strftime(ts, '%Y-%m-%d'), strftime(ts, '%d-%m-%Y'), 'never']"


@query("s20_time_texts", f"""
WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts, event_id % 7 AS k FROM events)
SELECT event_id, CASE WHEN k IN (0, 1, 2, 3) THEN ts WHEN k IN (4, 5) THEN date_trunc('day', ts)::TIMESTAMP END AS parsed FROM (SELECT *, ({_TIMES})[k + 1] AS raw FROM e)""")
def time_texts(t):
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy"]
    texts = F.array(*[F.date_format("ts", f) for f in forms], F.lit("never"))
    return t("events").select("event_id", S.parse_time(F.element_at(texts, (F.col("event_id") % 7 + 1).cast("int"))).cast("timestamp_ntz").alias("parsed"))


@query("s21_epochs", """
SELECT event_id, to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC' AS from_seconds, date_trunc('millisecond', ts) AS from_millis, (floor(epoch(ts)))::BIGINT AS seconds, date_trunc('second', ts) AS from_filetime FROM events""")
def epochs(t):
    ts = F.col("ts").cast("timestamp")
    seconds, millis = F.unix_seconds(ts), F.unix_millis(ts)
    ticks = (seconds + 11_644_473_600) * 10_000_000
    ntz = lambda c: c.cast("timestamp_ntz")
    return t("events").select("event_id", ntz(F.timestamp_seconds(seconds)).alias("from_seconds"), ntz(F.timestamp_millis(millis)).alias("from_millis"), seconds.alias("seconds"), ntz(S.filetime(ticks)).alias("from_filetime"))


@query("s25_json_text", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 5 = 4 THEN 'a "quoted" ' || event_type END AS k_text FROM events""")
def json_text(t):
    kinds = [F.to_json(F.struct(F.col("event_type").alias("k"))), F.lit('{"k": ""}'), F.lit('{"k": 12}'), F.lit('{"k": "cut'), F.to_json(F.struct(F.concat(F.lit('a "quoted" '), F.col("event_type")).alias("k")))]
    doc = F.element_at(F.array(*kinds), (F.col("event_id") % 5 + 1).cast("int"))
    return t("events").select("event_id", S.json_text(doc, "k").alias("k_text"))


@query("s26_json_rows", "SELECT conv_id, turn, role, length(coalesce(text, '')) AS n, 'none' AS note FROM conversations")
def json_rows(t):
    c = t("conversations").select("conv_id", F.struct("turn", "role", "text").alias("one"))
    docs = c.groupBy("conv_id").agg(F.to_json(F.collect_list("one")).alias("doc"))
    rows = docs.select("conv_id", F.explode(F.from_json("doc", "array<struct<turn: bigint, role: string, text: string, note: string>>")).alias("r"))
    return rows.select("conv_id", "r.turn", "r.role", F.length(F.coalesce("r.text", F.lit(""))).cast("long").alias("n"), F.coalesce("r.note", F.lit("none")).alias("note"))


@query("s27_value_at_path", "SELECT event_id, event_type AS inner_text, user_id::VARCHAR AS first, NULL::VARCHAR AS missing FROM events")
def value_at_path(t):
    doc = F.to_json(F.struct(F.array(F.col("user_id").cast("string"), F.lit("x")).alias("a"), F.struct(F.array(F.struct(F.col("event_type").alias("c d"))).alias("list")).alias("b")))
    return t("events").select("event_id", S.at_path(doc, "b/list/0/c d").alias("inner_text"), S.at_path(doc, "a/0").alias("first"), S.at_path(doc, "a/9").alias("missing"))


@query("s28_encoding_names", "SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'UTF-8' WHEN 2 THEN 'UTF-16 LE' WHEN 3 THEN 'UTF-16 BE' WHEN 4 THEN 'ASCII' WHEN 5 THEN 'Latin-1' ELSE 'Encoding-' || (event_id % 8) END AS encoding FROM events")
def encoding_names(t):
    return t("events").select("event_id", S.encoding_name(F.col("event_id") % 8).alias("encoding"))


@query("s29_blob_rendering", r"""
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE substr(text, 1, 9) END AS b FROM documents), h AS (SELECT doc_id, hex(b) AS h FROM b)
SELECT doc_id, CASE WHEN h IS NULL THEN '(NULL)' ELSE '[BLOB] ' || rtrim(regexp_replace(lower(substr(h, 1, 64)), '(..)', '\1 ', 'g')) || CASE WHEN length(h) > 64 THEN ' ... (' ELSE ' (' END || (length(h) // 2) || ' bytes)' END AS shown FROM h""")
def blob_rendering(t):
    blob = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.substring("text", 1, 9)).cast("binary")
    return t("documents").select("doc_id", S.render_bytes(blob).alias("shown"))


@query("s30_cell_types", """
SELECT event_id, ['int', 'float', 'bool', 'empty', 'string', 'int'][event_id % 6 + 1] AS kind FROM events""")
def cell_types(t):
    kinds = [F.col("event_id").cast("string"), F.concat((F.col("event_id") % 100).cast("string"), F.lit(".5")), F.lit("TRUE"), F.lit(""), F.col("event_type"), F.concat(F.lit("-"), F.col("user_id").cast("string"))]
    return t("events").select("event_id", S.cell_type(F.element_at(F.array(*kinds), (F.col("event_id") % 6 + 1).cast("int"))).alias("kind"))


_LAT, _LON = "((o_orderkey % 1440) / 8.0 - 90)::DOUBLE", "((o_orderkey % 2880) / 8.0 - 180)::DOUBLE"


def _dms_sql(x: str) -> str:
    return f"""floor(abs({x}))::INT || '°' || floor((abs({x}) - floor(abs({x}))) * 60)::INT || '''' || printf('%.2f', (abs({x}) - floor(abs({x})) - floor((abs({x}) - floor(abs({x}))) * 60) / 60) * 3600) || '"'"""


@query("s31_gps_texts", f"""
SELECT o_orderkey, printf('%.6f, %.6f', lat, lon) AS decimal_text, {_dms_sql("lat")} || CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || '  ' || {_dms_sql("lon")} || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END AS dms
FROM (SELECT o_orderkey, {_LAT} AS lat, {_LON} AS lon FROM orders)""")
def gps_texts(t):
    lat, lon = (F.col("o_orderkey") % 1440) / 8 - 90, (F.col("o_orderkey") % 2880) / 8 - 180
    return t("orders").select("o_orderkey", S.gps_decimal(lat, lon).alias("decimal_text"), S.gps_dms(lat, lon, F.when(lat < 0, "S").otherwise("N"), F.when(lon < 0, "W").otherwise("E")).alias("dms"))


@query("s33_column_letters", """
SELECT o_orderkey, CASE WHEN i < 26 THEN chr((65 + i)::INT) WHEN i < 702 THEN chr((65 + (i - 26) // 26)::INT) || chr((65 + i % 26)::INT) ELSE chr((65 + (i - 702) // 676)::INT) || chr((65 + (i - 702) // 26 % 26)::INT) || chr((65 + (i - 702) % 26)::INT) END AS letters
FROM (SELECT o_orderkey, o_orderkey % 2000 AS i FROM orders)""")
def column_letters(t):
    return t("orders").select("o_orderkey", S.column_letter(F.col("o_orderkey") % 2000).alias("letters"))


@query("m06_rebase_under", """
WITH p AS (SELECT page_id, '/case/old' || regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS p FROM pages)
SELECT page_id, CASE WHEN p = '/case/old' THEN '/mnt/new' WHEN starts_with(p, '/case/old/') THEN '/mnt/new' || substr(p, length('/case/old') + 1) ELSE p END AS path FROM p""")
def rebase_under(t):
    return t("pages").select("page_id", S.rebase(F.concat(F.lit("/case/old"), F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1)), "/case/old/", "/mnt/new").alias("path"))


@query("sk11_csv_fields", """SELECT doc_id, CASE WHEN contains(t, ',') OR contains(t, '"') OR contains(t, chr(10)) THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS field FROM (SELECT doc_id, replace(text, chr(13), ' ') AS t FROM documents)""")
def csv_fields(t):
    return t("documents").select("doc_id", S.csv_field(F.replace("text", F.lit("\r"), F.lit(" "))).alias("field"))


@query("sc05_container_types", """
WITH n AS (SELECT p_partkey, 'Disk' || p_partkey || ['.E01', '.l01', '.zip', '.tar.gz', ' logical.tar', '.ufdx', '.001', '.gz', '.docx'][p_partkey % 9 + 1] AS name FROM part)
SELECT p_partkey, ['EnCase (E01)', 'L01', 'ZIP', 'TAR.GZ', 'TAR (Logical)', NULL, 'Raw Image', 'GZIP', NULL][p_partkey % 9 + 1] AS container_type FROM n""")
def container_types(t):
    ends = [".E01", ".l01", ".zip", ".tar.gz", " logical.tar", ".ufdx", ".001", ".gz", ".docx"]
    name = F.concat(F.lit("Disk"), F.col("p_partkey").cast("string"), F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("p_partkey") % 9 + 1).cast("int")))
    return t("part").select("p_partkey", S.container_type(name).alias("container_type"))


_EXT = "['PDF', 'xlsx', 'ppt', 'eml', 'py', 'json', 'md', 'html', 'jpg', 'mp3', 'mkv', '7z', 'sqlite', 'dll', 'e01', 'hiv', 'zzz']"


@query("x07_categories_of_parts", f"""
WITH e AS (SELECT p_partkey, p_partkey % 17 AS k, ({_EXT})[p_partkey % 17 + 1] AS ext FROM part)
SELECT p_partkey, ['document', 'spreadsheet', 'presentation', 'email', 'code', 'config', 'text', 'markup', 'image', 'audio', 'video', 'archive', 'database', 'executable', 'forensic', 'registry', 'other'][k + 1] AS category, k IN (0, 1, 3, 4, 5, 6, 7) AS eligible FROM e""")
def categories_of_parts(t):
    names = ["PDF", "xlsx", "ppt", "eml", "py", "json", "md", "html", "jpg", "mp3", "mkv", "7z", "sqlite", "dll", "e01", "hiv", "zzz"]
    kind = S.category(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 17 + 1).cast("int")))
    return t("part").select("p_partkey", kind.alias("category"), S.text_eligible(kind).alias("eligible"))


_ARTIFACTS = ["Email Messages", "Chat Log", "Google Drive", "Browser History", "PDF Documents", "Pictures", "User Login", "Device Identifiers", "File System Info", "GPS Points", "Installed Programs", "Registry Keys", "Misc"]


@query("a20_all_rules", f"""
SELECT ({_ARTIFACTS!r})[p_partkey % 13 + 1] AS name, ['Email & Calendar', 'Communication', 'Cloud', 'Web', 'Documents', 'Media', 'User Accounts', 'Identifiers', 'File System', 'Location', 'Applications', 'System', 'Other'][p_partkey % 13 + 1] AS category, count(*) AS n
FROM part GROUP BY ALL""")
def all_rules(t):
    name = F.element_at(F.array(*[F.lit(a) for a in _ARTIFACTS]), (F.col("p_partkey") % 13 + 1).cast("int"))
    return t("part").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("category", S.artifact_category(F.col("name")))
