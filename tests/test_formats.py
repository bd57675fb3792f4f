"""Readers of file formats against files made here, streaming jobs batch by batch, reports, and the index in its folder."""

import io
import sqlite3
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from casegrain.functions import digests
from casegrain.operators import custody, discovery, grammar, index, maintenance, metrics, reconcile, reports
from casegrain.sources import formats, readers
from casegrain.streaming import jobs


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content binary")


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.db")
    db.executescript("create table t (id integer primary key, name text not null default 'x'); create index i on t(name); create view v as select 1 as one; insert into t(name) values ('a'), ('b')")
    db.commit()
    db.close()
    (tmp_path / "b.db").write_bytes(b"no database")
    got = {(r.name, r.kind): (r.n_rows, r.n_columns) for r in readers.sqlite_overview(spark, str(tmp_path)).collect()}
    assert got["t", "table"] == (2, 2) and got["v", "view"] == (None, 1) and got["user_version", "pragma"] == (0, None)
    columns = readers.sqlite_columns(spark, str(tmp_path)).orderBy("position").collect()
    assert [(c.column, c.type, c.not_null, c.default, c.primary_key, c.indexes) for c in columns] == [("id", "INTEGER", False, None, 1, ["i"]), ("name", "TEXT", True, "'x'", 0, ["i"])]


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    xlsx = zipped({
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="AB1"><v>2.5</v></c></row><row r="3"><c r="A3"><v>7</v></c><c t="b"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    })
    (tmp_path / "a.xlsx").write_bytes(xlsx)
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    got = sorted((r.sheet, r.row, r.column, r.type, r.text) for r in readers.read_workbook(spark, str(tmp_path)).collect())
    assert got == [("One", 0, 0, "string", "bc"), ("One", 0, 27, "float", "2.5"), ("One", 2, 0, "int", "7"), ("One", 2, 1, "bool", "true"), ("One", 2, 2, "string", "in")]
    ods = zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": '<d xmlns:t="t" xmlns:o="o" xmlns:x="x"><t:table t:name="S"><t:table-row t:number-rows-repeated="2"><t:table-cell/></t:table-row><t:table-row><t:table-cell t:number-columns-repeated="2" o:value-type="float" o:value="3"><x:p>3</x:p></t:table-cell></t:table-row></t:table></d>'})
    assert [(c["row"], c["column"], c["type"], c["text"]) for c in formats.ods_cells(ods)] == [(2, 0, "int", "3"), (2, 1, "int", "3")]


def test_texts(spark):
    docx = zipped({"word/document.xml": '<w:d xmlns:w="w"><w:t>Hello &amp;</w:t><w:t>you</w:t></w:d>'})
    pdf = b"%PDF\n1 0 obj <</Length 9 /Filter /FlateDecode>>\nstream\n" + zlib.compress(rb"BT (Hi \(you\)) Tj ET BT [(a) 3 (b)] TJ ET") + b"\nendstream"
    rows = [("/a.docx", docx), ("/b.rtf", rb"{\rtf1 {\fonttbl x}Plain \b text}"), ("/c.pdf", pdf), ("/d.eml", b"Subject: S\nFrom: a@b\n\nbody\n"), ("/e.txt", "ü".encode()), ("/f.png", b"text"), ("/g.txt", None), ("/h.txt", ("é" * 200_000).encode())]
    frame = files(spark, rows).select("path", F.lit(False).alias("is_dir"), F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"), "content")
    got = {r.path: r.text for r in readers.extract_text(frame).collect()}
    assert got["/a.docx"] == "Hello & you " and got["/b.rtf"] == "1 Plain text" and got["/c.pdf"] == "Hi (you)\nab"
    assert got["/d.eml"].startswith("Subject: S\nFrom: a@b\nbody") and (got["/e.txt"], got["/f.png"], got["/g.txt"]) == ("ü", "", "")
    assert got["/h.txt"] == "é" * (readers.MOST_TEXT // 2)
    assert readers.extract_text(frame.withColumn("is_dir", F.lit(True))).where("text <> ''").count() == 0


def test_exif_and_programs():
    make = b"Cam\x00"
    ifd = struct.pack("<H", 2) + struct.pack("<HHI4s", 0x010F, 2, 4, make) + struct.pack("<HHII", 0x8825, 4, 1, 38) + struct.pack("<I", 0)
    gps = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"S\x00\x00\x00") + struct.pack("<HHII", 2, 5, 3, 92) + struct.pack("<HHI4s", 3, 2, 2, b"E\x00\x00\x00") + struct.pack("<HHII", 4, 5, 3, 92) + struct.pack("<I", 0)
    tiff = b"II*\x00" + struct.pack("<I", 8) + ifd + gps + struct.pack("<IIIIII", 10, 1, 30, 1, 36, 1)
    found = formats.exif(b"\xff\xd8\xff\xe1\x00\x00Exif\x00\x00" + tiff)
    assert found["make"] == "Cam" and abs(found["latitude"] + 10.51) < 1e-9 and abs(found["longitude"] - 10.51) < 1e-9
    assert formats.exif(b"\xff\xd8no") is None and formats.exif(b"II*\x00\xff\xff\xff\xff") is None
    elf = bytearray(64 + 2 * 64 + 16)
    elf[:6] = b"\x7fELF\x02\x01"
    struct.pack_into("<H", elf, 18, 62)
    struct.pack_into("<QQQ", elf, 24, 4096, 0, 64)
    struct.pack_into("<HHH", elf, 58, 64, 2, 1)
    struct.pack_into("<I", elf, 128, 1)
    struct.pack_into("<Q", elf, 128 + 24, 192)
    elf[192:200] = b"\x00.names\x00"
    assert formats.program(bytes(elf)) == {"format": "ELF", "bits": 64, "machine": "x86-64", "entry": 4096, "sections": ["", ".names"]}
    pe = bytearray(64 + 24 + 112 + 40)
    pe[:2] = b"MZ"
    struct.pack_into("<I", pe, 60, 64)
    pe[64:68] = b"PE\x00\x00"
    struct.pack_into("<HHIIIHH", pe, 68, 0x8664, 1, 0, 0, 0, 112, 0)
    struct.pack_into("<H", pe, 88, 0x20B)
    struct.pack_into("<I", pe, 104, 4660)
    pe[200:205] = b".text"
    assert formats.program(bytes(pe)) == {"format": "PE", "bits": 64, "machine": "x86-64", "entry": 4660, "sections": [".text"]}
    assert formats.program(b"MZ") is None and formats.program(b"plain") is None


def test_partitions():
    image = bytearray(512 * 40)
    image[510:512] = b"\x55\xaa"
    image[450] = 7
    struct.pack_into("<II", image, 454, 2, 10)
    image[1027:1035] = b"NTFS    "
    assert [(p["scheme"], p["type"], p["start"], p["size"], p["filesystem"]) for p in formats.partitions(bytes(image))] == [("MBR", "NTFS/exFAT", 1024, 5120, "NTFS")]
    gpt = bytearray(512 * 40)
    gpt[512:520] = b"EFI PART"
    struct.pack_into("<QII", gpt, 512 + 72, 2, 2, 128)
    gpt[1024:1040] = bytes(range(16))
    struct.pack_into("<QQ", gpt, 1024 + 32, 10, 19)
    gpt[1024 + 56 : 1024 + 62] = "abc".encode("utf-16-le")
    assert [(p["scheme"], p["type"], p["start"], p["size"], p["label"]) for p in formats.partitions(bytes(gpt))] == [("GPT", "03020100-0504-0706-0809-0a0b0c0d0e0f", 5120, 5120, "abc")]
    assert list(formats.partitions(b"\x00" * 600)) == [] and formats.filesystem(b"\x00" * 1080 + b"\x53\xef") == "ext"


def test_registry():
    hive = bytearray(4096 + 512)
    hive[:4] = b"regf"
    struct.pack_into("<I", hive, 36, 32)

    def key(at, name, values=0, n=0):
        p = 4096 + at + 4
        hive[p : p + 2] = b"nk"
        struct.pack_into("<H", hive, p + 2, 0x20)
        struct.pack_into("<II", hive, p + 36, n, values)
        struct.pack_into("<H", hive, p + 72, len(name))
        hive[p + 76 : p + 76 + len(name)] = name
        return p

    p = key(32, b"ROOT")
    struct.pack_into("<I", hive, p + 20, 1)
    struct.pack_into("<I", hive, p + 28, 160)
    hive[4096 + 164 : 4096 + 166] = b"lf"
    struct.pack_into("<HI", hive, 4096 + 166, 1, 200)
    key(200, b"Sub", 320, 1)
    struct.pack_into("<I", hive, 4096 + 324, 340)
    q = 4096 + 344
    hive[q : q + 2] = b"vk"
    struct.pack_into("<HIIIH", hive, q + 2, 3, 0x80000004, 77, 4, 1)
    hive[q + 20 : q + 23] = b"num"
    assert list(formats.registry_hive(bytes(hive))) == [{"key": "ROOT", "name": None, "type": None, "data": None}, {"key": "ROOT/Sub", "name": "num", "type": "REG_DWORD", "data": "77"}]
    assert list(formats.registry_hive(b"none")) == []


def test_numbers_follow_the_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,1\n" * 3 + '"q ""z"", and\nmore",2\n')
    got = readers.read_table(spark, str(tmp_path)).orderBy("row").collect()
    assert [r.row for r in got] == [0, 1, 2, 3] and got[3]["_c0"] == 'q "z", and\nmore'
    assert [r.row for r in readers.read_table(spark, str(tmp_path), first=1, most=2).collect()] == [1, 2]


def test_upsert_keeps_what_other_batches_wrote(spark, tmp_path):
    """A container that spans two batches keeps the rows of both, and repeated keys take the later batch's row."""
    source, target = tmp_path / "in", str(tmp_path / "t")
    batches = [[(1, "a", "x"), (2, "a", "y")], [(3, "a", "z"), (1, "a", "new"), (4, "b", "w")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc_id long, source string, text string").parquet(str(source))
        jobs.upsert_by_container(stream, target, str(tmp_path / "c"), key="doc_id").awaitTermination()
        assert i or spark.read.parquet(target).count() == 2
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(target).collect()) == [(1, "new"), (2, "y"), (3, "z"), (4, "w")]


def test_running_metrics(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "t")
    for rows in ([("a", i, float(i)) for i in range(5)], [("a", 9, 9.0), ("b", 1, 1.0)]):
        spark.createDataFrame(rows, "name string, seq long, value double").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("name string, seq long, value double").parquet(str(source))
        jobs.running_metrics(stream, target, str(tmp_path / "c"), history=3).awaitTermination()
    totals = {r.name: (r.n, r.total, r["last"].value) for r in spark.read.parquet(f"{target}/1/totals").collect()}
    assert totals == {"a": (6, 19.0, 9.0), "b": (1, 1.0, 1.0)}
    assert sorted((r.name, r.seq) for r in spark.read.parquet(f"{target}/1/samples").collect()) == [("a", 3), ("a", 4), ("a", 9), ("b", 1)]


def test_discovered_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.E01").write_bytes(b"x")
    seen = []
    for name in ("b.txt", "c.zip"):
        (tmp_path / "in" / name).write_bytes(b"y")
        jobs.discover_containers(jobs.discover(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), lambda df: seen.append(sorted(r.name for r in df.collect()))).awaitTermination()
    assert seen == [["a.E01"], ["c.zip"]]


def test_job(spark):
    job = jobs.Job(spark, "parts")
    assert job.run([lambda: spark.range(3).count(), lambda: job.cancel(), lambda: 1 / 0]) == [3, None] and job.progress() == 2 / 3
    job = jobs.Job(spark, "none")
    assert job.run([]) == [] and job.progress() == 1.0


def test_siblings_and_later_parts(spark):
    paths = ["/a/x.zip", "/a/X_Advanced.ufd", "/a/y.zip", "/b/x.zip", "/a/d.E01", "/a/d.E02", "/a/._d.E01", "/a/p.ufdx", "/a/x.zip"]
    got = {r.path: r.container_type for r in discovery.containers(spark.createDataFrame([(p, 1) for p in paths], "path string, size long")).collect()}
    assert got == {"/a/x.zip": "UFED", "/a/X_Advanced.ufd": "UFED (UFD)", "/a/y.zip": "ZIP", "/b/x.zip": "ZIP", "/a/d.E01": "EnCase (E01)"}


def test_reconcile_with_repeated_and_null_keys(spark):
    row = lambda *rows: spark.createDataFrame(list(rows), "k string, v long, o long")
    a, b = row(("x", 1, 0), ("x", 2, 1), (None, 3, 2)), row(("x", 2, 0), ("x", 1, 5), (None, 3, 1), ("y", 9, 2))
    got = sorted((r.k or "", r.bucket) for r in reconcile.diff(a, b, "k", ["v"], "o").collect())
    assert got == [("", "common"), ("x", "common"), ("x", "modified"), ("y", "only_b")]
    assert sorted((r.k or "", r.v) for r in reconcile.insert_or_ignore(a, row(("y", 1, 1), ("y", 2, 0), (None, 5, 0)), ["k"], "o").collect()) == [("", 3), ("", 5), ("x", 1), ("x", 2), ("y", 2)]
    assert sorted((r.k or "", r.v) for r in reconcile.upsert(row(("x", 1, 0), (None, 2, 0)), row(("x", None, 9), (None, 8, 1), (None, 7, 0)), "k", ["v"], "o").collect()) == [("", 8), ("x", 1)]
    named = a.select(F.col("k").alias("a"), "v")
    assert reconcile.diff(named, named.limit(0), "a", ["v"]).where("bucket = 'only_a'").count() == 3


def test_custody_refuses(spark):
    log = spark.createDataFrame([("i", n, a, "z") for n, a in enumerate(["edit", "create", "create", "edit", "lock", "edit", "amend", "void", "amend"])], "id string, seq long, action string, actor string")
    assert [r.allowed for r in custody.run_actions(log).orderBy("seq").collect()] == [False, True, False, True, True, False, True, True, False]
    assert custody.current(log).count() == 0 and [r.action for r in custody.audit(log).orderBy("seq").collect()] == ["locked", "amended", "voided"]


def test_grammar():
    leaf = grammar.Leaf
    assert grammar.parse('a "B c" f:d') == grammar.Clauses((("should", leaf(("a",))), ("should", leaf(("b", "c"))), ("should", leaf(("d",), "f"))))
    assert grammar.parse("+a -b") == grammar.Clauses((("must", leaf(("a",))), ("not", leaf(("b",)))))
    assert grammar.parse("a AND b OR c").items[0][1].items == (("must", leaf(("a",))), ("must", leaf(("b",))))
    assert grammar.parse("(a b") == grammar.parse("(a b)") and grammar.parse("") == grammar.Clauses(()) and grammar.parse('"') == grammar.Clauses(())
    assert grammar.parse("NOT a").items == (("not", leaf(("a",))),)


def test_index_in_its_folder(spark, tmp_path):
    rows = [(i, f"report {i}.txt", f"/x/{i}", "blue whale song" if i % 2 else "red fox", f"c{i % 3}", False) for i in range(12)]
    entries = spark.createDataFrame(rows, "doc_id long, filename string, entry_path string, content string, container string, is_dir boolean")
    folder = str(tmp_path / "index")
    index.write(entries, folder)
    ids = lambda q: {r.doc_id for r in index.scores(index.read(spark, folder, q), q).collect()}
    assert ids('"whale song"') == {1, 3, 5, 7, 9, 11} and ids('"song whale"') == set() and ids("fox -report") == set() and ids("") == set(range(12))
    plan = index.read(spark, folder, "fox").postings._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    index.upsert(entries.where("doc_id = 3").withColumn("content", F.lit("green bird")), folder)
    assert ids("whale") == {1, 5, 7, 9, 11} and ids("bird") == {3}
    index.delete_container(spark, folder, "c1")
    assert ids("whale") == {5, 9, 11}
    index.rebuild(spark, folder)
    assert ids("whale") == {5, 9, 11} and index.index_stats(spark, folder).first().docs == 8
    best = index.top(index.read(spark, folder, "whale"), "whale", 2).collect()
    assert [r.doc_id for r in best] == [5, 9]


def test_digests(spark):
    import hashlib

    import xxhash

    d = spark.createDataFrame([(b"abc",), (b"",), (None,)], "c binary")
    got = d.select(*[digests.digest(F.col("c"), a).alias(a) for a in ("blake2b", "xxh64", "xxh3")]).collect()
    assert [tuple(r) for r in got] == [(hashlib.blake2b(x).hexdigest(), xxhash.xxh64(x).hexdigest(), xxhash.xxh3_128(x).hexdigest()) for x in (b"abc", b"")] + [(None, None, None)]
    parts = spark.createDataFrame([("s", 2, b"b"), ("s", 1, b"a"), ("t", 1, None)], "k string, n int, c binary")
    assert {r.k: (r.segments, r.digest) for r in digests.combined(parts, "k", "n", "c", "md5").collect()} == {"s": (2, hashlib.md5(b"ab").hexdigest()), "t": (1, hashlib.md5(b"").hexdigest())}


def test_histogram_of_one_long_series(spark):
    rows = spark.range(5000).select(F.lit("a").alias("name"), F.col("id").alias("seq"), (F.col("id") % 97).cast("double").alias("value"))
    values = sorted(float(i % 97) for i in range(5000))
    at = lambda v, p: v[int((len(v) - 1) * p + 0.5)]
    r = metrics.histogram(rows, ["name"]).first()
    assert (r.n, r.p50, r.p95, r.p99) == (5000, at(values, 0.5), at(values, 0.95), at(values, 0.99))
    last = sorted(float(i % 97) for i in range(4990, 5000))
    r = metrics.histogram(rows, ["name"], window=10).first()
    assert (r.n, r.p50) == (5000, at(last, 0.5)) and metrics.histogram(rows.limit(0), ["name"]).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([("a|b", "<x>"), (None, "y")], "one string, two string")
    md, page = reports.markdown("T", {"k": "v"}, {"Rows": rows}), reports.html("T", {"k": "v"}, {"Rows": rows})
    assert "| a\\|b | <x> |" in md and "- **k:** v" in md and "<td>&lt;x&gt;</td>" in page and "<td></td>" in page


def test_first_non_empty(spark):
    with pytest.raises(ValueError):
        metrics.first_non_empty([lambda: spark.table("no_such_table")])
    assert metrics.first_non_empty([lambda: spark.table("no_such_table"), lambda: spark.range(0), lambda: spark.range(2)]).count() == 2


def test_upkeep(spark, tmp_path):
    for i in range(3):
        spark.range(i, i + 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    maintenance.snapshot(spark, str(tmp_path / "t"), str(tmp_path / "s"))
    assert maintenance.compact(spark, str(tmp_path / "t"), str(tmp_path / "c")) == 1
    assert spark.read.parquet(str(tmp_path / "s")).count() == spark.read.parquet(str(tmp_path / "c")).count() == 6


def test_magic_detail(spark):
    rows = [("/a.docx", b"PK\x03\x04x"), ("/b.zip", b"PK\x03\x04x"), ("/c.txt", b"plain text"), ("/d", b"MZ\x00\x01"), ("/e", b"\x00\x01\x02"), ("/f.pdf", b"%PDF-1")]
    got = {r.path: (r.kind, r.confidence) for r in readers.magic_detail(files(spark, rows)).collect()}
    assert got == {"/a.docx": ("document", "medium"), "/b.zip": ("archive", "high"), "/c.txt": ("text", "low"), "/d": ("executable", "medium"), "/e": (None, None), "/f.pdf": ("document", "high")}


def test_reports_as_files(spark):
    rows = spark.createDataFrame([("a|b (c)", "<x>"), (None, "\u6f22")], "one string, two string")
    words = formats.docx_text(reports.docx("T & U", {"k": "v"}, {"Rows": rows}))
    assert words.startswith("T & U k: v Rows one two a|b (c) <x> ")
    raw = reports.pdf("T", {"k": "v" * 300}, {"Rows": rows})
    assert "(c)" in formats.pdf_text(raw) and "?" in formats.pdf_text(raw) and raw.startswith(b"%PDF-") and raw.endswith(b"%%EOF\n")
    start = int(raw.split(b"startxref\n")[1].split()[0])
    assert raw[start : start + 4] == b"xref" and raw[int(raw[start:].split(b"\n")[3].split()[0]) :].startswith(b"1 0 obj")


def test_iso(spark, tmp_path):
    image = bytearray(2048 * 22)

    def record(name, start, size, folder=False):
        n = 33 + len(name) + (len(name) + 1) % 2
        out = bytearray(n)
        out[0] = n
        struct.pack_into("<I", out, 2, start)
        struct.pack_into("<I", out, 10, size)
        out[25], out[32] = 2 * folder, len(name)
        out[33 : 33 + len(name)] = name
        return bytes(out)

    image[16 * 2048 + 1 : 16 * 2048 + 6] = b"CD001"
    image[16 * 2048 + 156 : 16 * 2048 + 190] = record(b"\x00", 20, 2048, True)[:34]
    top = record(b"\x00", 20, 2048, True) + record(b"\x01", 20, 2048, True) + record(b"SUB", 21, 2048, True) + record(b"A.TXT;1", 30, 77)
    image[20 * 2048 : 20 * 2048 + len(top)] = top
    low = record(b"\x00", 21, 2048, True) + record(b"B;1", 31, 5) + record(b"UP", 20, 2048, True)
    image[21 * 2048 : 21 * 2048 + len(low)] = low
    (tmp_path / "x.iso").write_bytes(bytes(image))
    got = [(r.entry, r.size, r.is_dir) for r in readers.list_archive(spark, str(tmp_path / "x.iso")).collect()]
    assert got == [("SUB", 0, True), ("A.TXT", 77, False), ("SUB/B", 5, False), ("SUB/UP", 0, True)]


def test_msg(spark, tmp_path):
    """A compound file with small streams in the mini stream and a long one in sectors of its own."""
    utf = lambda t: t.encode("utf-16-le")
    body = utf("long body " * 400)
    small = [("__substg1.0_0037001F", utf("Hello")), ("__substg1.0_0C1F001E", b"a@b"), ("__substg1.0_007D001F", utf("To: c\r\nDate: Mon, 1 Jan 2024 10:00:00 +0000\r\n")), ("__substg1.0_3707001F", utf("file.txt"))]
    stored, starts = b"", []
    for _, data in small:
        starts.append(len(stored) // 64)
        stored += data.ljust(-(-len(data) // 64) * 64, b"\x00")
    links = []
    for _, data in small:
        n = -(-len(data) // 64)
        links += [len(links) + k + 1 for k in range(n - 1)] + [0xFFFFFFFE]

    def entry(name, kind, left, right, child, start, size):
        out = bytearray(128)
        out[: 2 * len(name)] = utf(name)
        struct.pack_into("<H", out, 64, 2 * len(name) + 2)
        out[66] = kind
        struct.pack_into("<III", out, 68, left, right, child)
        struct.pack_into("<IQ", out, 116, start, size)
        return bytes(out)

    none = 0xFFFFFFFF
    n_small, n_body = -(-len(stored) // 512), -(-len(body) // 512)
    first_small, first_body = 5, 5 + n_small
    folder = entry("Root Entry", 5, none, none, 1, first_small, len(stored))
    folder += entry(small[0][0], 2, none, 2, none, starts[0], len(small[0][1])) + entry(small[1][0], 2, none, 3, none, starts[1], len(small[1][1]))
    folder += entry(small[2][0], 2, none, 4, none, starts[2], len(small[2][1])) + entry("__substg1.0_1000001F", 2, none, 5, none, first_body, len(body))
    folder += entry("__attach_version1.0_#00000000", 1, none, none, 6, 0, 0) + entry(small[3][0], 2, none, none, none, starts[3], len(small[3][1])) + bytes(128)
    chains = [0xFFFFFFFD, 2, 0xFFFFFFFE, 0xFFFFFFFE, 0xFFFFFFFF]  # this table, two of entries, mini links, none
    fat = chains + [first_small + k + 1 for k in range(n_small - 1)] + [0xFFFFFFFE] + [first_body + k + 1 for k in range(n_body - 1)] + [0xFFFFFFFE]
    header = bytearray(512)
    header[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    struct.pack_into("<HH", header, 30, 9, 6)
    for at, value in ((44, 1), (48, 1), (56, 4096), (60, 3), (68, 0xFFFFFFFE)):
        struct.pack_into("<I", header, at, value)
    struct.pack_into("<109I", header, 76, 0, *[none] * 108)
    pack = lambda values: struct.pack(f"<{len(values)}I", *values).ljust(512, b"\xff")
    raw = bytes(header) + pack(fat) + folder + pack(links) + bytes(512) + stored.ljust(n_small * 512, b"\x00") + body.ljust(n_body * 512, b"\x00")
    (tmp_path / "m.msg").write_bytes(raw)
    (tmp_path / "n.msg").write_bytes(b"none")
    r = readers.read_msg(spark, str(tmp_path)).collect()
    assert [(x.subject, x.sender, x.sent, x.body, x.attachments) for x in r] == [("Hello", "a@b", "Mon, 1 Jan 2024 10:00:00 +0000", "long body " * 400, ["file.txt"])]
