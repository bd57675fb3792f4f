import mailbox
import plistlib
import zipfile
from datetime import datetime
from email.message import EmailMessage

from pyspark.sql import functions as F

from casegrain.functions import scalars as S
from casegrain.operators import duplicates, metrics, reconcile, timeline
from casegrain.sources import readers
from casegrain.streaming import jobs


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.content_hash(lit("abc"), "md5")) == "900150983cd24fb0d6963f7d28e17f72"
    assert one(spark, S.content_hash(lit("abc"), "crc32")) == "352441c2"
    for a, b, want in (("AB", "ab", "CaseInsensitive"), (" ab ", "ab", "Exact"), ("ab", "abc", "Mismatch"), ("zz", "ab", "Invalid")):
        assert one(spark, S.compare_hashes(lit(a), lit(b))) == want
    assert [one(spark, S.glob_match(lit(t), p)) for t, p in (("A.LOG", "*.log"), ("abz", "a*z"), ("zab", "a*z"), ("my.log.1", "log"), ("a.txt", "?.txt"))] == [True, True, False, True, True]
    names = {"25-049_COC_x.pdf": "chain_of_custody", "evidence_intake_form.pdf": "evidence_intake", "case_notes.txt": "case_notes", "property_receipt.pdf": "evidence_receipt", "holiday.pdf": "other"}
    assert {n: one(spark, S.document_type(lit(n))) for n in names} == names
    assert one(spark, S.case_number(lit("25-049_COC_x.pdf"))) == "25-049"
    assert one(spark, S.evidence_id(lit("item-12.jpg"))) == "E12"
    assert one(spark, S.artifact_category(lit("Chrome Web History"))) == "Web"
    assert [one(spark, S.cell_type(lit(v))) for v in ("7", "1.5", "TRUE", "", "x")] == ["int", "float", "bool", "empty", "string"]
    assert [one(spark, S.duration_text(lit(s))) for s in (5, 65, 3700, 90000)] == ["5s", "1m 5s", "1h 1m 40s", "1d 1h 0m"]
    assert one(spark, S.parse_time(lit("02/01/2024 03:04:05")).cast("string")) == "2024-01-02 03:04:05"
    assert one(spark, S.parse_time(lit("nonsense"))) is None
    assert one(spark, S.json_text(lit('{"k": 5}'), "k")) is None and one(spark, S.json_text(lit('{"k": "v"}'), "k")) == "v"
    assert one(spark, S.json_text(lit("{"), "k")) is None
    assert one(spark, S.rebase(lit("/a/b/c"), "/a/b", "/z")) == "/z/c" and one(spark, S.rebase(lit("/a/bc"), "/a/b", "/z")) == "/a/bc"


def test_timeline_fixture(spark):
    rows = [(1, datetime(2024, 1, 7, 10, 5), "u1", "open"), (2, datetime(2024, 1, 7, 10, 29, 59, 900000), "u1", "hash"), (3, datetime(2024, 1, 7, 10, 30), "u2", "open"), (4, datetime(2024, 1, 8, 9), "u1", "open"), (5, None, "u3", "open")]
    log = spark.createDataFrame(rows, "id int, ts timestamp_ntz, user string, action string")
    s = timeline.summary(log).first()
    assert (s.total, s.users, s.busiest_hour, round(s.duration_hours, 4)) == (5, 3, 10, 22.9167)
    assert [(r.start_ts.hour, r.n) for r in timeline.peaks(log).collect()] == [(10, 2), (10, 1), (9, 1)]
    assert timeline.trend(log).first().trend == "decreasing"
    assert sum(r.n for r in timeline.heatmap(log).collect()) == 4
    empty = log.where("false")
    assert timeline.summary(empty).first().total == 0 and timeline.trend(empty).first().trend == "stable"


def test_dedup_fixture(spark):
    rows = [(1, "A", "a.pdf", 1000), (2, "B", "A.PDF", 1000), (3, "A", "b.txt", 1000), (4, "B", "c.txt", 1000), (5, "A", "e", 0), (6, "A", "u", 7)]
    files = spark.createDataFrame(rows, "file_id int, container string, name string, size long")
    g = duplicates.name_groups(files).collect()
    assert [(r["key"], r["n"], r["waste"], r["cross_container"]) for r in g] == [("1000:a.pdf", 2, 1000, True)]
    assert [(r["key"], r["n"]) for r in duplicates.size_groups(files).collect()] == [("size:1000", 2)]
    assert duplicates.statistics(files).first().unique_files == 4


def test_diff_and_merge_fixture(spark):
    a = spark.createDataFrame([("n1", "x"), ("n2", "y"), ("n3", "z")], "name string, v string")
    b = spark.createDataFrame([("n1", "x"), ("n2", "Y"), ("n4", "w")], "name string, v string")
    d = reconcile.diff(a, b, "name", ["v"])
    assert {r["name"]: r["bucket"] for r in d.collect()} == {"n1": "common", "n2": "modified", "n3": "only_a", "n4": "only_b"}
    assert round(reconcile.similarity(d).first().similarity, 2) == 33.33
    assert reconcile.similarity(reconcile.diff(a.where("false"), b.where("false"), "name", ["v"])).first().similarity == 100
    merged = {s: {r["name"]: r["v"] for r in reconcile.merge(a, b, "name", ["v"], s).collect()} for s in ("PreferA", "PreferB", "KeepBoth", "Manual")}
    assert merged["PreferA"]["n2"] == "y" and merged["PreferB"]["n2"] == "Y" and merged["KeepBoth"]["n2 (from B)"] == "Y" and "n2" not in merged["Manual"]


def test_children_follow_merged_parents(spark):
    parents = spark.createDataFrame([("e1", "/p", 0), ("e2", "/p", 1)], "id string, path string, source_ordinal int")
    hashes = spark.createDataFrame([("h", "e2")], "id string, file_id string")
    assert reconcile.remap_children(parents, hashes, "path", "id", "file_id").first()["file_id"] == "e1"


def test_quantiles(spark):
    rows = [("a", float(i)) for i in (1, 2)] + [("b", float(i)) for i in range(1, 11)]
    got = {r["name"]: (r.p50, r.p95, r.p99) for r in metrics.histogram(spark.createDataFrame(rows, "name string, value double"), ["name"]).collect()}
    assert got["a"][0] == 2 and got["b"] == (6, 10, 10)


def test_readers(spark, tmp_path):
    (tmp_path / "x.e01").write_bytes(b"EVF\x09\x0d\x0a\xff\x00....")
    (tmp_path / "x.e02").write_bytes(b"..")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.txt", "hello")
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Hi", "a@b.c", "d@e.f"
    m.set_content("body")
    (tmp_path / "m.eml").write_bytes(bytes(m))
    box = mailbox.mbox(tmp_path / "m.mbox")
    box.add(m), box.add(m), box.flush()
    (tmp_path / "p.plist").write_bytes(plistlib.dumps({"a": [1, "b"]}))
    (tmp_path / "t.csv").write_text('1,x\n2.5,"y, z"\n')
    found = {r["name"]: r["category"] for r in readers.scan_files(spark, str(tmp_path)).collect()}
    assert found["x.e01"] == "forensic" and found["m.eml"] == "email"
    kinds = {r.path.rsplit("/", 1)[-1]: r.kind for r in readers.magic_type(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert kinds["z.zip"] == "archive" and kinds["x.e01"] == "forensic"
    s = readers.segments(readers.scan_files(spark, str(tmp_path))).first()
    assert (s.stem, s.parts, s.complete) == ("x", 2, True)
    assert [r.entry for r in readers.list_archive(spark, str(tmp_path / "z.zip")).collect()] == ["d/a.txt"]
    assert readers.read_eml(spark, str(tmp_path / "m.eml")).first().subject == "Hi"
    assert readers.read_mbox(spark, str(tmp_path / "m.mbox")).count() == 2
    assert ("/a/1", "str", "b") in {tuple(r)[1:] for r in readers.flatten_plist(spark, str(tmp_path / "p.plist")).collect()}
    cells = readers.typed(readers.read_table(spark, str(tmp_path / "t.csv")), ["_c0", "_c1"]).orderBy("row").collect()
    assert [(r["_c0_type"], r["_c1"]) for r in cells] == [("int", "x"), ("float", "y, z")]
    log = spark.createDataFrame([("MD5 checksum: 900150983cd24fb0d6963f7d28e17f72 : verified",)], "value string")
    r = readers.companion_log(log).first()
    assert r.algorithm == "MD5" and r.verified


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(folder))
    seen = {}
    jobs.run_to_end(jobs.half_hours(jobs.event_stream(spark, str(folder))), lambda b, _: seen.update({(r.start_ts, r.event_type): r.n for r in b.collect()}), str(tmp_path / "c"))
    assert sum(seen.values()) == events.count()
    stream = spark.readStream.schema("event_id long, event_type string").parquet(str(folder)).withColumnRenamed("event_type", "source")
    for k in ("k1", "k2"):  # a batch that runs again gives the same table
        jobs.upsert_by_container(stream, str(tmp_path / "t"), str(tmp_path / k)).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "t")).count() == events.count()


def test_collection_conflicts_move_no_pairs(spark):
    """Each pair is made once, by its first reason, and not grouped; ids of several rows still give one row a pair."""
    columns = "id string, case_number string, date string, officer string, location string"
    current = spark.createDataFrame([(f"a{i}", f"C{i % 3}", "2024-01-02", f"o{i % 2}", "x") for i in range(8)], columns)
    incoming = spark.createDataFrame([(f"b{i}", f"c{i % 4}", "2024-01-02", f"O{i % 3}", "X") for i in range(8)], columns)
    want = sorted((f"a{i}", f"b{j}", "case number" if i % 3 == j % 4 else "date and officer" if i % 2 == j % 3 else "date and location") for i in range(8) for j in range(8))
    got = reconcile.collection_conflicts(current, incoming)
    assert sorted(map(tuple, got.collect())) == want
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    more = incoming.unionByName(spark.createDataFrame([("b1", "c0", "2024-01-02", "O1", "X"), (None, "c0", "2024-01-02", "O1", "X")], columns))
    first = {(a, b): r for a, b, r in want} | {(f"a{i}", "b1"): "case number" for i in (0, 3, 6)}
    got = reconcile.collection_conflicts(current.unionByName(current.limit(3)), more)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, r) for (a, b), r in first.items())


def test_collection_conflicts_and_linked_evidence(spark):
    """Pairs that match by a later key are found, with the first reason; passes are ordered and greedy."""
    columns = "id string, case_number string, date string, officer string, location string"
    current = spark.createDataFrame([("a", "C1", "2024-01-02T10:00", "Ann", "X"), ("b", "", "2024-01-03", "Bo", "Y"), ("c", None, None, None, None)], columns)
    incoming = spark.createDataFrame([("a", "c1", "2024-01-02", "ann", "x"), ("p", "c1", "2024-01-02", "ANN", "x"), ("q", "", "2024-01-03T01", "bO", "y"), ("r", None, "2024-01-03", None, "y"), ("s", "", "", "", "")], columns)
    got = sorted(map(tuple, reconcile.collection_conflicts(current, incoming).collect()))
    assert got == [("a", "p", "case number"), ("b", "q", "date and officer"), ("b", "r", "date and location")]
    items = spark.createDataFrame([(0, "/e/1", "", "", ""), (1, "", "IT 2 ", "", ""), (2, "", "it  2", "S9", ""), (3, "", "", "", "the Disk.img of desk"), (4, "", "", "", "disk.img"), (5, "", "", "", "disk"), (6, "/e/1", "", "", ""), (7, "", "", "", "nothing")], "i int, file_id string, item_number string, serial string, description string")
    files = spark.createDataFrame([(0, "/e/1", "it 2", "", "x.ad1"), (1, "/e/2", "it 2", "s9", "y.ad1"), (2, "/e/3", None, "s9", "z.ad1"), (3, "/e/4", None, None, "disk.img"), (4, "/e/5", None, None, "disk.img"), (5, "/e/6", None, None, "old disk.raw")], "j int, path string, evidence_number string, serial string, filename string")
    got = sorted(map(tuple, reconcile.link_evidence(items, files).collect()))
    assert got == [(0, 0, "evidence_file_id", "high"), (1, 1, "item_number", "medium"), (2, 2, "serial_number", "high"), (3, 3, "filename", "low"), (4, 4, "filename", "low"), (5, 5, "filename", "low"), (6, 0, "evidence_file_id", "high")]
