"""Readers of semi-structured files, and the exports.  Paths are read by Spark only; file bytes go through Arrow."""

from __future__ import annotations

import email
import email.policy
import io
import json
import plistlib
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.functions import scalars as S
from casegrain.sources import formats, xls

# First bytes of some file types.
MAGIC = (("25504446", "application/pdf", "document"), ("504B0304", "application/zip", "archive"), ("1F8B", "application/gzip", "archive"), ("377ABCAF271C", "application/x-7z-compressed", "archive"), ("526172211A07", "application/vnd.rar", "archive"), ("89504E470D0A1A0A", "image/png", "image"), ("FFD8FF", "image/jpeg", "image"), ("47494638", "image/gif", "image"), ("53514C69746520666F726D6174203300", "application/vnd.sqlite3", "database"), ("7F454C46", "application/x-elf", "executable"), ("4D5A", "application/x-dosexec", "executable"), ("455646090D0AFF00", "application/x-ewf", "forensic"), ("4144534547", "application/x-ad1", "forensic"))
SEGMENT = r"(?i)^(.*)\.(?:e|ex|l|lx|s|ad|a)?(\d{1,3})$"


def scan_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, name, extension, size, modified, category of every file; contents are not read.  Files named ._* are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = S.file_name(F.col("path"))
    return files.select("path", name.alias("name"), S.extension(name).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(~F.startswith("name", F.lit("._"))).withColumn("category", S.category(F.col("extension")))


def magic_type(files: DataFrame) -> DataFrame:
    """mime and kind of binaryFile rows by their first bytes; null where unknown."""
    head = F.hex(F.substring("content", 1, 16))
    mime, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for prefix, m, k in reversed(MAGIC):
        hit = head.startswith(prefix)
        mime, kind = F.when(hit, m).otherwise(mime), F.when(hit, k).otherwise(kind)
    return files.select("path", mime.alias("mime"), kind.alias("kind"))


# What a ZIP file is by the names of office documents.
OFFICE = {"docx": "document", "xlsx": "spreadsheet", "pptx": "presentation", "odt": "document", "ods": "spreadsheet", "odp": "presentation"}


def magic_detail(files: DataFrame) -> DataFrame:
    """magic_type with confidence, and its special cases by name: office documents among ZIP files, and text without a signature.

    Confidence is high for signatures of four bytes and more, medium for shorter ones and special cases, low for text.
    """
    name, found = S.extension(S.file_name(F.col("path"))), magic_type(files).withColumnRenamed("path", "own_path")
    rows = files.join(found, files["path"] == found["own_path"])
    office = F.lit(None).cast("string")
    for extension, kind in OFFICE.items():
        office = F.when(name == extension, kind).otherwise(office)
    short = F.hex(F.substring("content", 1, 2)).isin("4D5A") | F.hex(F.substring("content", 1, 3)).isin("FFD8FF", "1F8B08")
    text = F.col("mime").isNull() & S.likely_text(F.col("content").cast("string"))
    special = (F.col("mime") == "application/zip") & office.isNotNull()
    return rows.select("path", F.when(text, "text/plain").otherwise(F.col("mime")).alias("mime"), F.when(special, office).when(text, "text").otherwise(F.col("kind")).alias("kind"), F.when(special | short, "medium").when(text, "low").when(F.col("mime").isNotNull(), "high").alias("confidence"))


def segment_parts(name: Column) -> tuple[Column, Column, Column]:
    """stem, number and is_segment of a file name; null stem and number where it is no segment."""
    number = F.regexp_extract(name, SEGMENT, 2).try_cast("int")
    return F.when(number.isNotNull(), F.regexp_extract(name, SEGMENT, 1)).alias("stem"), number.alias("number"), number.isNotNull().alias("is_segment")


def segments(files: DataFrame) -> DataFrame:
    """Multi-part sets: stem, parts, total size, and whether a part is missing."""
    name = S.file_name(F.col("path"))
    parts = files.select(F.regexp_extract(name, SEGMENT, 1).alias("stem"), F.regexp_extract(name, SEGMENT, 2).try_cast("int").alias("number"), "size").where("number is not null")
    out = parts.groupBy("stem").agg(F.count_distinct("number").alias("parts"), F.sum("size").alias("size"), F.min("number").alias("first"), F.max("number").alias("last"))
    return out.withColumn("complete", (F.col("first") <= 1) & (F.col("last") - F.col("first") + 1 == F.col("parts")))


def read_table(spark: SparkSession, path: str, separator: str = ",", header: bool = False, first: int = 0, most: int | None = None) -> DataFrame:
    """A CSV or TSV with every cell as text and its row number, 0, 1, ... in file order; `first` and `most` choose a window of rows.

    Type a column's cells with `typed`.  Rows are numbered by the counts of the parts before theirs.
    """
    rows = spark.read.option("sep", separator).option("header", str(header).lower()).option("escape", '"').option("multiLine", "true").csv(path)
    rows = numbered(rows, "row")
    return rows if not first and most is None else rows.where((F.col("row") >= first) & (F.lit(most is None) | (F.col("row") < first + (most or 0))))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with contiguous numbers in the order in which they are read; only a count of each part comes to the driver."""
    at = rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r["_part"]: r["count"] for r in at.groupBy("_part").count().collect()}  # a row a part
    before, starts = 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    table = rows.sparkSession.createDataFrame(starts, "_number int, _start long")
    return at.join(F.broadcast(table), at["_part"] == table["_number"]).withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_number", "_start")


def typed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("*", *[S.cell_type(F.col(c)).alias(f"{c}_type") for c in columns])


_MAIL = "path string, number long, subject string, sender string, recipients string, sent string, body string, attachments array<string>"


def _message(raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body = m.get_body(preferencelist=("plain", "html"))
    try:
        text = body.get_content() if body else ""
    except (LookupError, ValueError):
        text = ""
    return {"subject": m["subject"], "sender": m["from"], "recipients": m["to"], "sent": m["date"], "body": text, "attachments": [a.get_filename() or "" for a in m.iter_attachments()]}


def _per_file(spark: SparkSession, path: str, rows_of, schema: str) -> DataFrame:
    columns = [f.split()[0] for f in schema.replace(", ", ",").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, raw in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([{"path": p} | r for r in rows_of(bytes(raw))], columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, lambda raw: [{"number": 0} | _message(raw)], _MAIL)


def read_msg(spark: SparkSession, path: str) -> DataFrame:
    """Outlook messages; files that are none give no row."""
    return _per_file(spark, path, lambda raw: [{"number": 0} | found] if (found := formats.outlook_message(raw)) else [], _MAIL)


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mbox files; one starts at each line that begins with "From "."""

    def rows(raw: bytes) -> list[dict]:
        parts = (b"\n" + raw).split(b"\nFrom ")[1:]
        return [{"number": i} | _message(p.partition(b"\n")[2]) for i, p in enumerate(parts)]

    return _per_file(spark, path, rows, _MAIL)


def list_archive(spark: SparkSession, path: str) -> DataFrame:
    """Entries of ZIP, TAR (plain or compressed) and ISO 9660 files; other files give none."""

    def rows(raw: bytes) -> list[dict]:
        data = io.BytesIO(raw)
        if found := list(formats.iso_entries(raw)):
            return found
        if zipfile.is_zipfile(data):
            with zipfile.ZipFile(data) as z:
                return [{"entry": i.filename.rstrip("/"), "size": i.file_size, "is_dir": i.is_dir()} for i in z.infolist()]
        try:
            data.seek(0)
            with tarfile.open(fileobj=data) as t:
                return [{"entry": m.name, "size": m.size, "is_dir": m.isdir()} for m in t]
        except tarfile.TarError:
            return []

    return _per_file(spark, path, rows, "path string, entry string, size long, is_dir boolean")


def flatten_plist(spark: SparkSession, path: str) -> DataFrame:
    """(key_path, value_type, preview) of every value, depth first."""

    def walk(v: object, at: str) -> Iterator[dict]:
        yield {"key_path": at, "value_type": type(v).__name__, "preview": str(v)[:100]}
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from walk(x, f"{at}/{k}")

    return _per_file(spark, path, lambda raw: list(walk(plistlib.loads(raw), "")), "path string, key_path string, value_type string, preview string")


def companion_lines(lines: DataFrame, *kept: str) -> DataFrame:
    """key, value, hash, algorithm and verified of each line (value) of an acquisition log; key and value are null unless both are there.

    The algorithm is the one that the line names, else the one of the hash's length.
    """
    v = F.col("value")
    key, text = F.trim(F.regexp_extract(v, r"^([^:]+):(.+)$", 1)), F.trim(F.regexp_extract(v, r"^([^:]+):(.+)$", 2))
    found = F.nullif(F.regexp_extract(v, r"\b([a-fA-F0-9]{32,128})\b", 1), F.lit(""))
    named = S.algorithm_name(F.regexp_extract(v, r"(?i)\b(MD5|SHA-?1|SHA-?256|SHA-?512)\b", 1))
    both = (key != "") & (text != "")
    return lines.select(*kept, F.when(both, key).alias("key"), F.when(both, text).alias("value"), found.alias("hash"), F.coalesce(named, S.guess_algorithm(found)).alias("algorithm"), F.lower(v).contains("verif").alias("verified"))


# What acquisition logs call a case's facts.
LOG_KEYS = {
    "case_number": ("case number", "case", "case_number"),
    "evidence_number": ("evidence number", "evidence", "evidence_number"),
    "description": ("unique description", "description"),
    "examiner": ("examiner", "examiner name"),
    "notes": ("notes", "note", "comments"),
    "started": ("acquisition started", "start time", "started"),
    "finished": ("acquisition finished", "end time", "finished", "completed"),
    "verification_started": ("verification started",),
    "verification_finished": ("verification finished",),
    "device": ("source", "source device", "input", "input device"),
    "tool": ("tool", "program", "software", "created by"),
}


def companion_summary(lines: DataFrame) -> DataFrame:
    """path, the facts of LOG_KEYS, and hashes of acquisition logs, from (path, number, value) lines.

    The last line of a fact counts; a tool that no line names is told by what the lines mention (dc3dd, dcfldd, Guymager).
    Hashes are (algorithm, hash) in lower case, distinct and sorted: a line's own algorithm, else that of the file's
    extension, else that of the hash's length.
    """
    rows = companion_lines(lines, "path", "number", F.col("value").alias("line"))
    low = F.lower("key")
    last = lambda names: F.max(F.when(low.isin(*names), F.struct("number", "value")))["value"]
    says = F.lower("line")
    mentioned = F.max(F.when(says.contains("dc3dd"), "dc3dd").when(says.contains("dcfldd"), "dcfldd").when(says.contains("guymager"), "Guymager"))
    named = S.algorithm_name(F.regexp_extract(F.col("line"), r"(?i)\b(MD5|SHA-?1|SHA-?256|SHA-?512)\b", 1))
    algorithm = F.coalesce(named, S.algorithm_name(S.extension(F.col("path"))), S.guess_algorithm(F.col("hash")))
    hashes = F.array_sort(F.collect_set(F.when(F.col("hash").isNotNull(), F.struct(algorithm.alias("algorithm"), F.lower("hash").alias("hash")))))
    facts = {name: last(names) for name, names in LOG_KEYS.items()}
    facts["tool"] = F.coalesce(facts["tool"], mentioned)
    return rows.groupBy("path").agg(*[c.alias(name) for name, c in facts.items()], hashes.alias("hashes"))


def companion_log(lines: DataFrame) -> DataFrame:
    """Hashes and key: value pairs of acquisition logs, from (value) lines."""
    v = F.col("value")
    found = F.regexp_extract(v, r"\b([a-fA-F0-9]{32,128})\b", 1)
    named = F.regexp_extract(F.upper(v), r"\b(MD5|SHA-?1|SHA-?256|SHA-?512)\b", 1)
    return lines.select(F.trim(F.regexp_extract(v, r"^([^:]+):(.+)$", 1)).alias("key"), F.trim(F.regexp_extract(v, r"^([^:]+):(.+)$", 2)).alias("text"), F.nullif(found, F.lit("")).alias("hash"), F.coalesce(F.nullif(named, F.lit("")), S.guess_algorithm(found)).alias("algorithm"), F.lower(v).contains("verif").alias("verified"))


def read_project(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def children(entries: DataFrame, parent: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a folder's entries, folders first."""
    return entries.where(S.parent_path(F.col("path")) == parent).orderBy(F.desc("is_dir"), "path").offset(offset).limit(limit)


def export_csv(rows: DataFrame, path: str, separator: str = ",") -> None:
    rows.write.mode("overwrite").option("sep", separator).option("escape", '"').option("header", "true").csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def sqlite_overview(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, lambda raw: list(formats.sqlite_overview(raw)), "path string, name string, kind string, n_rows long, n_columns long")


def sqlite_columns(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, lambda raw: list(formats.sqlite_columns(raw)), "path string, table string, position long, column string, type string, not_null boolean, default string, primary_key long, indexes array<string>, ddl string")


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Cells of XLSX, XLS and ODS workbooks; `select distinct sheet` lists the sheets, a where on row and column reads a range."""

    def rows(raw: bytes) -> list[dict]:
        if raw[:4] == b"\xd0\xcf\x11\xe0":
            return list(xls.xls_cells(raw, sheet))
        found = formats.ods_cells(raw) if b"opendocument.spreadsheet" in raw[:200] else formats.xlsx_cells(raw, sheet)
        return [c for c in found if sheet in (None, c["sheet"])]

    return _per_file(spark, path, rows, "path string, sheet string, row long, column long, type string, text string")


def read_exif(spark: SparkSession, path: str) -> DataFrame:
    names = [*formats.EXIF_TAGS.values()]
    schema = "path string, " + ", ".join(f"{n} string" for n in names) + ", latitude double, longitude double"
    return _per_file(spark, path, lambda raw: [found] if (found := formats.exif(raw)) is not None else [], schema)


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, lambda raw: [found] if (found := formats.program(raw)) is not None else [], "path string, format string, bits long, machine string, entry long, sections array<string>")


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, lambda raw: list(formats.partitions(raw)), "path string, number long, scheme string, type string, start long, size long, label string, filesystem string")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, lambda raw: list(formats.registry_hive(raw)), "path string, key string, name string, type string, data string")


#: The largest file whose text is extracted, and the longest text, in bytes.
MOST_FILE, MOST_TEXT = 10 * 1024 * 1024, 256 * 1024
# Extensions of files that are text as they are.
PLAIN = frozenset("txt log md rst tex json xml yaml yml toml ini cfg conf env csv tsv html htm xhtml css scss less svg py js ts jsx tsx rs c cpp h java go rb php swift kt cs sh bat ps1 vbs pl r m sql readme changelog license".split())


def _file_text(raw: bytes, extension: str) -> str:
    if extension in PLAIN:
        return raw.decode("utf-8", "replace")
    if extension == "docx":
        return formats.docx_text(raw)
    if extension == "pdf":
        return formats.pdf_text(raw)
    if extension == "rtf":
        return formats.rtf_text(raw)
    if extension in ("eml", "mbox"):
        m = _message(raw)
        return f"Subject: {m['subject'] or ''}\nFrom: {m['sender'] or ''}\n{m['body'] or ''}"
    if extension == "plist":
        try:
            return repr(plistlib.loads(raw))
        except (plistlib.InvalidFileException, ValueError):
            return raw.decode("utf-8", "replace")
    head = raw[:1024]
    likely = head and sum(33 <= b <= 126 or b in b" \t\n\r\x0c" for b in head) > 0.85 * len(head)
    return raw.decode("utf-8", "replace") if likely and len(raw) < 100_000 else ""


def extract_text(files: DataFrame) -> DataFrame:
    """path and text of entries (path, is_dir, size, content) by extension.

    Directories, files of categories without text and those over MOST_FILE have an empty text; a text is cut at MOST_TEXT
    bytes, at a character's end.  Null contents are empty.
    """
    extension = S.extension(S.file_name(F.col("path")))
    open_ = ~F.col("is_dir") & S.text_eligible(S.category(extension)) & (F.col("size") <= MOST_FILE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [_file_text(bytes(raw), ext) if raw is not None else "" for raw, ext in zip(batch["raw"], batch["extension"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "text": [t.encode()[:MOST_TEXT].decode("utf-8", "ignore") for t in texts]})

    return files.select("path", extension.alias("extension"), F.when(open_, F.col("content")).alias("raw")).mapInPandas(run, "path string, text string")


def export_timeline(log: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """One JSON document as lines of parts: a metadata object, a summary object, then an object an activity, in order of time."""
    from casegrain.operators import timeline

    spark = log.sparkSession
    head = spark.createDataFrame([(0, json.dumps({"kind": "metadata"} | metadata))], "part int, value string") if metadata else None
    summary = timeline.summary(log).select(F.lit(1).alias("part"), F.to_json(F.struct(F.lit("summary").alias("kind"), "*")).alias("value"))
    rows = log.orderBy("ts", "id").select(F.lit(2).alias("part"), F.to_json(F.struct(F.lit("activity").alias("kind"), "id", "ts", "user", "action")).alias("value"))
    for frame, mode in ((head, "overwrite"), (summary, "append"), (rows, "append")):
        if frame is not None:
            frame.select("part", "value").write.mode(mode).partitionBy("part").text(path)


def html_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """value: a table row of HTML for each row, texts escaped; nulls are empty."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    cells = [F.concat(F.lit("<td>"), escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def csv_rows(rows: DataFrame, columns: list[str], separator: str = ",") -> DataFrame:
    """value: a line for each row, fields quoted only where they must be."""
    return rows.select(F.concat_ws(separator, *[F.coalesce(S.csv_field(F.col(c).cast("string")), F.lit("")) for c in columns]).alias("value"))
