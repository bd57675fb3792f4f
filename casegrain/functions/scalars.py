"""Scalar functions as Column expressions; nulls give nulls unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File categories by extension.
CATEGORIES = {
    "document": "pdf doc docx odt rtf pages",
    "spreadsheet": "xls xlsx ods csv tsv",
    "presentation": "ppt pptx odp key",
    "email": "eml msg mbox pst ost",
    "code": "py js ts jsx tsx rs c cpp h java go rb php swift kt cs sh bat ps1 vbs pl r m sql",
    "config": "json xml yaml yml toml ini cfg conf env plist reg",
    "text": "txt log md rst tex readme changelog license",
    "markup": "html htm xhtml svg css scss less",
    "image": "jpg jpeg png gif bmp ico tiff tif webp heic heif raw cr2 nef arw",
    "audio": "mp3 wav flac aac ogg wma m4a",
    "video": "mp4 avi mkv mov wmv flv webm",
    "archive": "zip 7z rar tar gz bz2 xz zst",
    "database": "db sqlite sqlite3 mdb accdb dbf",
    "executable": "exe dll so dylib a o sys drv msi",
    "forensic": "e01 l01 ad1 dd dmg iso img mem vmdk vhd vhdx",
    "registry": "dat hiv",
}
# Categories whose files hold text.
TEXT_CATEGORIES = ("text", "code", "config", "markup", "email", "document", "spreadsheet")
# Artifact categories, first match wins.
ARTIFACTS = (
    ("Email & Calendar", ("email", "mbox", "mail")),
    ("Communication", ("chat", "message", "sms", "call", "contact")),
    ("Cloud", ("cloud", "google", "dropbox", "onedrive", "icloud")),
    ("Web", ("web", "browser", "history", "bookmark", "cookie", "download")),
    ("Documents", ("document", "pdf", "csv", "text", "office")),
    ("Media", ("picture", "photo", "image", "video", "media", "audio")),
    ("User Accounts", ("user", "account", "login")),
    ("Identifiers", ("identifier", "device")),
    ("File System", ("file system", "filesystem")),
    ("Location", ("gps", "location", "geo")),
    ("Applications", ("app", "install", "program")),
    ("System", ("registry", "system", "log")),
)
# Case-document name patterns, in order.
DOCUMENT_TYPES = (
    ("chain_of_custody", r"(?i)[_\-]coc[_\-]|^coc[_\-]|chain.*custody|coc[-_]?\d+|custody[-_]form|evidence[-_]custody|^coc\.pdf$"),
    ("evidence_intake", r"(?i)intake[-_]form|evidence[-_]intake|submission[-_]form|evidence[-_]submit|request[-_]form"),
    ("case_notes", r"(?i)(case|examiner|lab|investigation)[-_]notes?"),
    ("evidence_receipt", r"(?i)(evidence|property|item)[-_]receipt"),
)
# Patterns of case numbers and evidence ids.
CASE_NUMBER, EVIDENCE_ID = r"(\d{2,4}[-_]?\d{2,6})", r"(?i)(?:EV|E|ITEM)[-_]?(\d+)"
# Hexadecimal digits of each digest.
HASH_LENGTHS = {"MD5": 32, "SHA-1": 40, "SHA-256": 64, "SHA-512": 128}
# Time formats, in order.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy")


# Names of hash algorithms, and what else they are called.
ALGORITHMS = {
    "MD5": ("md5",),
    "SHA-1": ("sha1", "sha-1"),
    "SHA-256": ("sha256", "sha-256"),
    "SHA-512": ("sha512", "sha-512"),
    "BLAKE3": ("blake3",),
    "BLAKE2b": ("blake2", "blake2b"),
    "XXH3": ("xxh3", "xxhash3"),
    "XXH64": ("xxh64", "xxhash64"),
    "CRC32": ("crc32", "crc-32"),
}
# Text encodings by code.
ENCODINGS = {1: "UTF-8", 2: "UTF-16 LE", 3: "UTF-16 BE", 4: "ASCII", 5: "Latin-1"}
# Display types of containers by the end of a file's name; the first that fits counts.
CONTAINER_TYPES = (
    (".e01", "EnCase (E01)"),
    (".ex01", "EnCase (Ex01)"),
    (".l01", "L01"),
    (".lx01", "Lx01"),
    (".ad1", "AD1"),
    (".aff", "AFF"),
    (".aff4", "AFF4"),
    (".dd", "Raw Image"),
    (".raw", "Raw Image"),
    (".img", "Raw Image"),
    (".001", "Raw Image"),
    (".ufd", "UFED (UFD)"),
    (".ufdr", "UFED (UFDR)"),
    (".7z", "7-Zip"),
    (".zip", "ZIP"),
    (".vmdk", "VMDK"),
    (".vhd", "VHD"),
    (".vhdx", "VHDX"),
    (".qcow2", "QCOW2"),
    (".iso", "ISO 9660"),
    (".dmg", "DMG"),
    (".rar", "RAR"),
    (".r00", "RAR"),
    (".tar.gz", "TAR.GZ"),
    (".tgz", "TAR.GZ"),
    (".tar.xz", "TAR.XZ"),
    (".txz", "TAR.XZ"),
    (".tar.bz2", "TAR.BZ2"),
    (".tbz2", "TAR.BZ2"),
    (".tar.zst", "TAR.ZSTD"),
    (".tar.lz4", "TAR.LZ4"),
    (".tar", "TAR"),
    (".gz", "GZIP"),
    (".xz", "XZ"),
    (".bz2", "BZIP2"),
    (".zst", "ZSTD"),
    (".zstd", "ZSTD"),
    (".lz4", "LZ4"),
    (".vdi", "VDI"),
    (".sparsebundle", "Apple Sparse Image"),
    (".sparseimage", "Apple Sparse Image"),
    (".s01", "SMART"),
    (".s02", "SMART"),
    (".bin", "BIN/CUE"),
    (".cue", "BIN/CUE"),
)


def content_hash(c: Column, algorithm: str) -> Column:
    """Lower-case hex digest; md5, sha1, sha256, sha512 or crc32."""
    kind = algorithm.lower().replace("-", "")
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256), "sha512": lambda x: F.sha2(x, 512), "crc32": lambda x: F.lpad(F.lower(F.hex(F.crc32(x))), 8, "0")}[kind](c)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def category(ext: Column) -> Column:
    out = F.lit("other")
    for kind, names in reversed(CATEGORIES.items()):
        out = F.when(F.lower(ext).isin(*names.split()), kind).otherwise(out)
    return out


def text_eligible(kind: Column) -> Column:
    return kind.isin(*TEXT_CATEGORIES)


def artifact_category(name: Column) -> Column:
    out = F.lit("Other")
    for kind, words in reversed(ARTIFACTS):
        found = F.lit(False)
        for w in words:
            found = found | F.lower(name).contains(w)
        out = F.when(found, kind).otherwise(out)
    return out


def document_type(name: Column) -> Column:
    out = F.lit("other")
    for kind, pattern in reversed(DOCUMENT_TYPES):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def case_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, CASE_NUMBER, 1), F.lit(""))


def evidence_id(name: Column) -> Column:
    found = F.regexp_extract(name, EVIDENCE_ID, 1)
    return F.when(found != "", F.concat(F.lit("E"), found))


def guess_algorithm(h: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, n in HASH_LENGTHS.items():
        out = F.when(F.length(F.trim(h)) == n, name).otherwise(out)
    return out


def valid_hash(h: Column, algorithm: Column) -> Column:
    out = F.lit(False)
    for name, n in HASH_LENGTHS.items():
        out = F.when(normal_algorithm(algorithm) == name.replace("-", ""), h.rlike(f"^[0-9a-fA-F]{{{n}}}$")).otherwise(out)
    return out


def normal_algorithm(a: Column) -> Column:
    return F.upper(F.replace(a, F.lit("-"), F.lit("")))


def compare_hashes(a: Column, b: Column) -> Column:
    """Exact, CaseInsensitive, Mismatch, or Invalid where either is no hexadecimal text."""
    x, y = F.trim(a), F.trim(b)
    good = lambda c: c.rlike("^[0-9a-fA-F]+$")
    return F.when(~good(x) | ~good(y), "Invalid").when(x == y, "Exact").when(F.lower(x) == F.lower(y), "CaseInsensitive").otherwise("Mismatch")


def glob_match(text: Column, pattern: str) -> Column:
    """Case-insensitive * and ?; a pattern without either matches as a substring."""
    if not set("*?") & set(pattern):
        return F.lower(text).contains(pattern.lower())
    regex = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in pattern)
    return text.rlike(f"(?is)^{regex}$")


def human_size(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / size, 1))).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    d, h, m, s = F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(seconds < 60, F.format_string("%ds", seconds)).when(d > 0, F.format_string("%dd %dh %dm", d, h, m)).when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).otherwise(F.format_string("%dm %ds", m, s))


def parse_time(text: Column) -> Column:
    """RFC 3339, then seven formats, day before month; null where none fits."""
    rfc = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), text.try_cast("timestamp"))
    return F.coalesce(rfc, *[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def filetime(ticks: Column) -> Column:
    """100 ns ticks since 1601 as a timestamp."""
    return F.timestamp_micros((ticks / 10).cast("long") - 11_644_473_600_000_000)


def json_text(doc: Column, key: str) -> Column:
    """A non-empty string value of a JSON object, else null (also where the value is no string, or the JSON is malformed)."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), f"$.{key}", "variant"))
    return F.when(kind == "STRING", F.nullif(F.get_json_object(doc, f"$.{key}"), F.lit("")))


def parent_path(p: Column) -> Column:
    return F.regexp_replace(p, r"/[^/]*$", "")


def file_name(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def depth(p: Column) -> Column:
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def normalize(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def cell_type(c: Column) -> Column:
    """int, float, bool, empty or string, tried in this order."""
    return F.when(c.isNull() | (c == ""), "empty").when(c.try_cast("bigint").isNotNull() & c.rlike(r"^[+-]?\d+$"), "int").when(c.try_cast("double").isNotNull() & c.rlike(r"^[+-]?[\d.]+([eE][+-]?\d+)?$"), "float").when(F.lower(c).isin("true", "false"), "bool").otherwise("string")


def render(c: Column, most: int = 256) -> Column:
    """Display text: (NULL), or cut with its length named."""
    n = F.length(c)
    return F.when(c.isNull(), "(NULL)").when(n > most, F.concat(F.substring(c, 1, most), F.lit("... ("), n.cast("string"), F.lit(" chars)"))).otherwise(c)


def rebase(path: Column, old: str, new: str) -> Column:
    old, new = old.rstrip("/"), new.rstrip("/")
    return F.when(path == old, new).when(path.startswith(old + "/"), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def csv_field(c: Column) -> Column:
    """Quoted only where it holds a comma, a quote or a line end."""
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def algorithm_name(a: Column) -> Column:
    """The display name of an algorithm under any of its names; null for others."""
    out = F.lit(None).cast("string")
    for name, others in ALGORITHMS.items():
        out = F.when(F.lower(F.trim(a)).isin(*others), name).otherwise(out)
    return out


def container_type(name: Column) -> Column:
    """Display type of a container by its file name; null for other files, and for .ufdx, which only points at others."""
    low, out = F.lower(name), F.lit(None).cast("string")
    for end, kind in reversed(CONTAINER_TYPES):
        out = F.when(low.endswith(end), F.when(low.contains("logical"), "TAR (Logical)").otherwise(kind) if end == ".tar" else kind).otherwise(out)
    return out


def encoding_name(code: Column) -> Column:
    out = F.concat(F.lit("Encoding-"), code.cast("string"))
    for k, name in ENCODINGS.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def _sized(n: Column, plain: str, tail: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(plain))
    for unit, size in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30), ("TB", 1 << 40)):
        out = F.when(n >= size, F.concat(F.format_string(f"%.2f {unit}", F.bround(n.cast("double") / size, 2)), tail)).otherwise(out)
    return out


def size_text(n: Column) -> Column:
    """Two decimals and the bytes: 1.43 MB (1500000 bytes)."""
    return _sized(n, " bytes", F.concat(F.lit(" ("), n.cast("string"), F.lit(" bytes)")))


def size_compact(n: Column) -> Column:
    """Two decimals: 1.43 MB."""
    return _sized(n, " bytes", F.lit(""))


def normal_path(p: Column) -> Column:
    """With a leading slash, without empty, `.` and `..` parts (each `..` takes the part before it, never the root)."""
    parts = F.filter(F.split(F.trim(p), "/"), lambda x: (x != "") & (x != "."))
    up = lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def join_path(base: Column, name: Column) -> Column:
    b, n = normal_path(base), F.regexp_replace(name, "^/+|/+$", "")
    return F.when(b == "/", F.concat(F.lit("/"), n)).otherwise(F.concat(b, F.lit("/"), n))


def is_traversal(name: Column) -> Column:
    """Whether a file name leaves its folder: `..` parts, absolute paths, drive letters, NUL, and their URL-encoded forms."""
    parts = name.rlike(r"^\.\.$|^\.\.[/\\]|/\.\./|\\\.\.|/\.\.$")
    return F.contains(name, F.lit("\x00")) | parts | name.rlike(r"^[/\\]|^[A-Za-z]:") | F.lower(name).rlike("%2e%2e|%2f|%5c")


def safe_name(name: Column) -> Column:
    """Separators become _, control and reserved characters go, and so do dots and spaces at the ends."""
    clean = F.regexp_replace(name, r'[\x00-\x1f\x7f<>:"|?*]', "")
    return F.regexp_replace(F.regexp_replace(clean, r"[/\\]", "_"), r"^[. ]+|[. ]+$", "")


def hex_text(c: Column, spaced: bool = False, upper: bool = False) -> Column:
    """Bytes as hexadecimal digits, with a space between bytes if wanted."""
    out = F.hex(c) if upper else F.lower(F.hex(c))
    return F.rtrim(F.regexp_replace(out, "(..)", "$1 ")) if spaced else out


def parse_hex(c: Column) -> Column:
    """Bytes of hexadecimal digits, spaces and line ends aside; null where it is none, or has half a byte."""
    bare = F.regexp_replace(c, "[ \n\r]", "")
    return F.when(bare.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(bare))


def render_bytes(c: Column, most: int = 32) -> Column:
    """Display text of a blob: its first bytes and its size."""
    n = F.octet_length(c)
    shown = F.concat(F.lit("[BLOB] "), hex_text(F.substring(c, 1, most), spaced=True))
    return F.when(c.isNull(), "(NULL)").otherwise(F.concat(shown, F.when(n > most, " ... (").otherwise(" ("), n.cast("string"), F.lit(" bytes)")))


def column_letter(i: Column) -> Column:
    """A, B, ... Z, AA, ... ZZ, AAA, ... of 0, 1, ...; null below 0."""
    letter = lambda n: F.char(65 + n)
    one, two = i, i - 26
    three = i - 26 - 26 * 26
    return F.when(i < 0, None).when(i < 26, letter(one)).when(two < 26 * 26, F.concat(letter(F.floor(two / 26)), letter(two % 26))).otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))


def gps_decimal(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f, %.6f", lat, lon)


def gps_dms(lat: Column, lon: Column, lat_ref: Column, lon_ref: Column) -> Column:
    """Degrees, minutes and seconds of two signed decimals, each with its reference letter."""

    def one(x: Column, ref: Column) -> Column:
        a = F.abs(x)
        d = F.floor(a)
        m = F.floor((a - d) * 60)
        return F.concat(F.format_string("%d\u00b0%d'%.2f\"", d, m, (a - d - m / 60) * 3600), ref)

    return F.concat(one(lat, lat_ref), F.lit("  "), one(lon, lon_ref))


def at_path(doc: Column, path: str) -> Column:
    """The value at a/b/0 of a JSON text, as text: keys of objects, places of lists; null where there is none."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("/") if p)
    return F.get_json_object(doc, f"${steps}")


def likely_text(c: Column) -> Column:
    """More than 85 % printable ASCII among the first 1024 characters, and less than 100,000 bytes; empty is none."""
    head = F.substring(c, 1, 1024)
    return (F.length(c) > 0) & (F.octet_length(c) < 100_000) & (F.length(F.regexp_replace(head, r"[^\x20-\x7E\s]", "")) > 0.85 * F.length(head))
