"""Evidence images made here and read back, FAT volumes built by hand, BLAKE3 against published digests."""

import hashlib
import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casegrain.functions import blake3, digests
from casegrain.sources import images

# Published test vectors; the input of n bytes is 0, 1, ... 250, 0, 1, ...
BLAKE3 = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
}


def test_blake3(spark, monkeypatch):
    made = lambda n: bytes(i % 251 for i in range(n))
    assert blake3.digests([made(n) for n in BLAKE3]) == list(BLAKE3.values())
    assert blake3.digests([b"abc"]) == ["6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"] and blake3.digests([]) == []
    sizes = [3073, 0, 64, 65, 5 * 1024, 31744, 7 * 1024 + 1]
    together = blake3.digests([made(n) for n in sizes])
    assert together == [blake3.digests([made(n)])[0] for n in sizes] and len(set(together)) == len(sizes)
    rows = spark.createDataFrame([(b"abc",), (None,), (b"",)], "c binary")
    got = [r[0] for r in rows.select(digests.digest(F.col("c"), "blake3")).collect()]
    assert got == [blake3.digests([b"abc"])[0], None, BLAKE3[0]]


def fat_image(bits: int = 12) -> bytes:
    """A volume with /A.TXT, /Long file name.data, /SUB/b.bin over two clusters of a folder, a deleted file, a folder loop."""
    sector, per, reserved, table, roots = 512, 1, 1, 3 if bits == 12 else 20, 16
    total = 400 if bits == 12 else 5000
    raw = bytearray(total * sector)
    raw[:3] = b"\xeb\x3c\x90"
    struct.pack_into("<HBHBHHBH", raw, 11, sector, per, reserved, 1, roots, total, 0xF8, table)
    raw[54:62], raw[510:512] = b"FAT%d   " % bits, b"\x55\xaa"
    root, data = (reserved + table) * sector, (reserved + table) * sector + roots * 32

    def link(c: int, to: int) -> None:
        if bits == 16:
            struct.pack_into("<H", raw, reserved * sector + 2 * c, to)
        else:
            at = reserved * sector + c * 3 // 2
            old = int.from_bytes(raw[at : at + 2], "little")
            raw[at : at + 2] = ((old & 0x000F | to << 4) if c % 2 else (old & 0xF000 | to)).to_bytes(2, "little")

    def entry(name: bytes, attribute: int, cluster: int, size: int) -> bytes:
        return struct.pack("<11sB8xHHHHI", name, attribute, 0, 10 << 11 | 30 << 5 | 4, 44 << 9 | 2 << 5 | 29, cluster, size)

    def long(text: str) -> bytes:
        pieces = [text[i : i + 13] for i in range(0, len(text), 13)]
        out = b""
        for i in reversed(range(len(pieces))):
            chars = (pieces[i] + "\x00").ljust(13, "￿")[:13].encode("utf-16-le")
            out += bytes([i + 1 | (0x40 if i == len(pieces) - 1 else 0)]) + chars[:10] + b"\x0f\x00\x00" + chars[10:22] + b"\x00\x00" + chars[22:]
        return out

    top = entry(b"MYVOLUME   ", 8, 0, 0) + entry(b"A       TXT", 0x20, 9, 700) + long("Long file name.data") + entry(b"LONGFI~1DAT", 0x20, 8, 5) + entry(b"\xe5ONE    TXT", 0x20, 7, 1) + entry(b"SUB        ", 0x10, 2, 0)
    raw[root : root + len(top)] = top
    sub = entry(b".          ", 0x10, 2, 0) + entry(b"..         ", 0x10, 0, 0) + b"".join(entry(b"F%-7dBIN" % i, 0x20, 9, i) for i in range(14)) + entry(b"LAST    BIN", 0x20, 9, 3) + entry(b"AGAIN      ", 0x10, 2, 0)
    raw[data : data + 512], raw[data + 3 * 512 : data + 3 * 512 + len(sub) - 512] = sub[:512], sub[512:]
    end = (1 << bits) - 1
    link(2, 5)
    link(5, end)
    return bytes(raw)


@pytest.mark.parametrize("bits", [12, 16])
def test_volume_files(spark, tmp_path, bits):
    volume = fat_image(bits)
    (tmp_path / "bare.dd").write_bytes(volume)
    disk = bytearray(2048) + volume
    disk[446:462] = struct.pack("<4xB3xII", 1, 4, len(volume) // 512)
    disk[510:512] = b"\x55\xaa"
    cut = 3 * 512 + 100
    (tmp_path / "parts.001").write_bytes(bytes(disk[:cut]))
    (tmp_path / "parts.002").write_bytes(bytes(disk[cut:]))
    (tmp_path / "other.raw").write_bytes(b"\x00" * 3 + b"NTFS    " + bytes(600))
    (tmp_path / "empty.img").write_bytes(b"")
    (tmp_path / "note.txt").write_bytes(b"x")
    rows = images.list_images(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.image.rsplit("/", 1)[1], []).append((r.partition, r.entry, r.size, r.is_dir))
    files = [("/A.TXT", 700, False), ("/Long file name.data", 5, False), ("/SUB", 0, True)] + [(f"/SUB/F{i}.BIN", i, False) for i in range(14)] + [("/SUB/LAST.BIN", 3, False), ("/SUB/AGAIN", 0, True)]
    assert by["bare"] == [(0, *f) for f in files] and by["parts"] == [(1, *f) for f in files]
    assert by["other"] == [(0, None, None, None)] and set(by) == {"bare", "parts", "other"}
    assert {r.modified for r in rows if r.entry} == {datetime(2024, 2, 29, 10, 30, 8)}


def test_ewf(spark, tmp_path):
    volume = fat_image()
    noise = b"".join(hashlib.sha256(struct.pack("<I", i)).digest() for i in range(4 * 1024))  # four chunks that don't compress
    medium = volume + bytes(-len(volume) % images.CHUNK) + noise + b"end".ljust(512, b"!")
    cuts = [0, 5 * images.CHUNK, 9 * images.CHUNK, len(medium)]
    parts = [("a", i + 1, medium[x:y]) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))] + [("b", 1, None), ("c", 1, bytes(512))]
    rows = spark.createDataFrame(parts, "image string, number long, content binary")
    assert images.save_files(images.ewf_segments(rows, {"case_number": "C 1", "examiner": "Zoë\tX", "notes": "n"}), str(tmp_path)) == 5
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.E01", "a.E02", "a.E03", "b.E01", "c.E01"]
    info = {r.image.rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    a = info["a"]
    assert (a.segments, a.size, a.complete, a.sound_heads, a.case_number, a.examiner, a.description) == (3, len(medium), True, True, "C 1", "Zoë X", None)
    assert (a.md5, a.sha1) == (hashlib.md5(medium).hexdigest(), hashlib.sha1(medium).hexdigest())
    assert (info["b"].size, info["b"].complete, info["c"].size) == (0, True, 512)
    chunks = images.read_chunks(spark, str(tmp_path)).where(F.col("image").endswith("/a")).orderBy("place").collect()
    assert b"".join(r.content for r in chunks) == medium and all(r.sound for r in chunks)
    m = images.EwfMedia([str(tmp_path / f"a.E0{i}") for i in (3, 1, 2)])
    assert all(m.read(x, n) == medium[x : x + n] for x, n in ((0, 10), (images.CHUNK - 3, 7), (len(medium) - 5, 50), (4 * images.CHUNK, 5 * images.CHUNK)))
    entries = [r.entry for r in images.list_images(spark, str(tmp_path)).collect() if r.image.endswith("/a")]
    assert entries[:3] == ["/A.TXT", "/Long file name.data", "/SUB"]
    state = {r.image.rsplit("/", 1)[1]: (r.verified, r.unsound) for r in images.verify_images(spark, str(tmp_path)).collect()}
    assert state["a"] == (True, 0) and state["c"] == (True, 0) and state["b"] == (None, None)

    damaged = bytearray((tmp_path / "a.E02").read_bytes())
    at = next(place for kind, place, _, _ in images.sections(images._open(str(tmp_path / "a.E02"))) if kind == "sectors")
    damaged[at + 1000] ^= 0xFF
    (tmp_path / "a.E02").write_bytes(bytes(damaged))
    a = next(r for r in images.verify_images(spark, str(tmp_path)).collect() if r.image.endswith("/a"))
    assert (a.verified, a.unsound, a.complete) == (False, 1, True)
    (tmp_path / "a.E03").unlink()
    assert not next(r.complete for r in images.read_images(spark, str(tmp_path)).collect() if r.image.endswith("/a"))


def test_damaged_ewf(tmp_path):
    """Whatever byte is wrong or missing, an image is read to its end, and what differs is told."""
    medium = b"".join(hashlib.sha256(bytes([i])).digest() for i in range(256)) + bytes(images.CHUNK)
    raw = images.segment_file(1, medium, 2, len(medium), True, hashlib.md5(medium).hexdigest(), hashlib.sha1(medium).hexdigest(), {"notes": "n"})
    path = tmp_path / "x.E01"
    for at in [*range(0, len(raw), 97), *range(13, 13 + 90)]:
        for made in (raw[:at], raw[:at] + bytes([raw[at] ^ 0xFF]) + raw[at + 1 :]):
            path.write_bytes(made)
            m = images.EwfMedia([str(path)])
            chunks = [m.chunk(k) for k in range(min(m.chunks, m.of_segment[-1]))]
            assert len(m.read(0, 100)) <= 100
            if len(made) < len(raw) and at > 20:
                assert not m.complete
            assert b"".join(c for c, _ in chunks) == medium or not all(ok for _, ok in chunks) or not m.complete or m.size != len(medium) or not m.sound
            list(images.volume_files(m))


def test_ewf_names():
    assert [images.extension_of(n) for n in (1, 99, 100, 101, 775, 776)] == ["E01", "E99", "EAA", "EAB", "EZZ", "FAA"]
    with pytest.raises(ValueError):
        images.segment_file(1, b"x", 1, 1, True, "", "", {})


def ad1_image(step: int = 65536) -> list[bytes]:
    """/disk (folder) with a.txt and two folders below, the second over the segments' border; an item links back to the first."""
    space = bytearray(step - 512 + 4000)
    space[:16] = b"ADLOGICALIMAGE\x00\x00"
    struct.pack_into("<Q", space, 0x224 - 512, 1000)

    def item(at, name, follows=0, child=0, detail=0, size=0, kind=0x31):
        struct.pack_into("<QQQQQII", space, at, follows, child, detail, 0, size, kind, len(name.encode()))
        space[at + 48 : at + 48 + len(name.encode())] = name.encode()

    def detail(at, follows, category, key, value):
        struct.pack_into("<QIII", space, at, follows, category, key, len(value))
        space[at + 20 : at + 20 + len(value)] = value

    edge = step - 512 - 30  # an item over the border
    item(1000, "disk", child=2000, follows=5000, kind=5)
    item(2000, "a.txt", follows=3000, detail=2500, size=70)
    detail(2500, 2600, 5, 8, b"20240229T103008.500000")
    detail(2600, 2500, 1, 0x5001, b"0123456789abcdef0123456789abcdef")  # the chain meets itself
    item(3000, "sub", follows=edge, child=4000, kind=5)
    item(4000, "deep \u00e9", size=5)
    item(edge, "far", child=edge + 200, kind=5)
    item(edge + 200, "b", follows=1 << 40, size=6)  # goes on nowhere
    item(5000, "second", follows=1000, size=1)  # goes back to the first
    out = []
    for k, at in enumerate(range(0, len(space), step - 512)):
        head = bytearray(512)
        head[:16] = b"ADSEGMENTEDFILE\x00"
        struct.pack_into("<II", head, 0x18, k + 1, 2)
        struct.pack_into("<I", head, 0x22, step // 65536)
        out.append(bytes(head) + bytes(space[at : at + step - 512]))
    return out


def test_logical(spark, tmp_path):
    for k, raw in enumerate(ad1_image()):
        (tmp_path / f"case.ad{k + 1}").write_bytes(raw)
    (tmp_path / "none.ad1").write_bytes(b"ADCRYPT\x00")
    (tmp_path / "lost.ad2").write_bytes(b"x")  # no first segment
    tree = "rec\r\n\tcl\t1\r\nentry\r\n\tp\t1\tn\tDocs\tid\t1\tcid\t1\r\n\t\tn\ta.txt\tid\t2\tls\t512\tbe\t0 512\tcid\t0\twr\t1709202608\tha\tabc\r\n\t\tp\t1\tn\tSub\tcid\t1\r\n\t\t\tn\tdeep\tls\tx\r\n\tn\tlast\tls\t7\r\n\tbad\r\nsub\r\n\tn\tno file\r\n".encode("utf-16-le")
    for name, body in (("packed", zlib.compress(tree)), ("plain", tree)):
        data = bytes(48) + body
        head = struct.pack("<16sQQ40x", b"ltree", 13 + 76 + len(data), 76 + len(data))
        end = struct.pack("<16sQQ40x", b"done", 13 + 76 + len(data), 76)
        raw = b"LVF\x09\x0d\x0a\xff\x00\x01\x01\x00\x00\x00" + b"".join(h + struct.pack("<I", zlib.adler32(h)) + d for h, d in ((head, data), (end, b"")))
        (tmp_path / f"{name}.L01").write_bytes(raw)
    by = {}
    for r in images.list_images(spark, str(tmp_path)).collect():
        by.setdefault((r.kind, r.image.rsplit("/", 1)[1]), []).append((r.entry, r.size, r.is_dir, r.modified, r.md5))
    assert by.pop(("ad1", "case")) == [
        ("/disk", 0, True, None, None),
        ("/disk/a.txt", 70, False, datetime(2024, 2, 29, 10, 30, 8, 500000), "0123456789abcdef0123456789abcdef"),
        ("/disk/sub", 0, True, None, None),
        ("/disk/sub/deep \u00e9", 5, False, None, None),
        ("/disk/far", 0, True, None, None),
        ("/disk/far/b", 6, False, None, None),
        ("/second", 1, False, None, None),
    ]
    l01 = [("/Docs", 0, True, None, None), ("/Docs/a.txt", 512, False, datetime(2024, 2, 29, 10, 30, 8), "abc"), ("/Docs/Sub", 0, True, None, None), ("/Docs/Sub/deep", 0, False, None, None), ("/last", 7, False, None, None)]
    assert by == {("l01", "packed"): l01, ("l01", "plain"): l01}
