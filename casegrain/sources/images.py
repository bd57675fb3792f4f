"""Evidence images: EWF (E01) and raw media in segments, the files of FAT volumes on them, and E01 files of given media.

Nothing is read whole: section heads, two table entries and a chunk at a time, directories, and the places of the allocation
table that their chains need.  Paths may be local or of any file system that pyarrow opens.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import datetime
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.functions import digests
from casegrain.sources import formats, logical

# Fixed values of the format: its signature, lengths of the file's and the sections' heads, of the volume and table heads.
SIGNATURE = b"EVF\x09\x0d\x0a\xff\x00"
FILE_HEAD, SECTION_HEAD, VOLUME, TABLE_HEAD = 13, 76, 1052, 24
# What the letters of the header's columns stand for.
FIELDS = {"c": "case_number", "n": "evidence_number", "a": "description", "e": "examiner", "t": "notes", "av": "version", "ov": "platform", "m": "acquired", "u": "system_date"}
SECTOR, CHUNK = 512, 32768
#: Chunks that one table lists, chunks that a reader keeps, chunks in a batch of rows.
TABLE_MOST, KEPT, BATCH = 16375, 64, 64
#: A volume that speaks of larger chunks is damaged.
LARGEST_CHUNK = 128 << 20
#: Entries in a batch of rows.
ROWS = 10000


def local(path: str) -> str:
    return path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _system(path: str) -> tuple[pa.fs.FileSystem, str]:
    path = local(path)
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _open(path: str) -> pa.NativeFile:
    system, place = _system(path)
    return system.open_input_file(place)


def sections(file: pa.NativeFile) -> Iterator[tuple[str, int, int, bool]]:
    """(type, place of the data, its size within the file, the head's checksum is right) of a segment file, in order."""
    at, size = FILE_HEAD, file.size()
    while at + SECTION_HEAD <= size:
        head = file.read_at(SECTION_HEAD, at)
        kind = head[:16].rstrip(b"\x00").decode("ascii", "replace")
        follows, length = struct.unpack_from("<QQ", head, 16)
        most = size - at - SECTION_HEAD
        yield kind, at + SECTION_HEAD, max(0, min(most, (length or follows - at) - SECTION_HEAD)), zlib.adler32(head[:72]) == struct.unpack_from("<I", head, 72)[0]
        if kind in ("done", "next") or follows <= at:
            return
        at = follows


def _fields(packed: bytes) -> dict[str, str]:
    """The header's columns by name; none of a damaged header."""
    try:
        raw = zlib.decompress(packed)
    except zlib.error:
        return {}
    text = raw.decode("utf-16", "replace") if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else raw.decode("latin-1")
    lines = text.replace("\r", "").split("\n") + [""] * 4
    names, values = lines[2].split("\t"), lines[3].split("\t")
    return {FIELDS[n]: v for n, v in zip(names, values, strict=False) if n in FIELDS}


class RawMedia:
    """Segments of a raw image, one after the other."""

    def __init__(self, paths: list[str]):
        self.files = [_open(p) for p in paths]
        self.starts = [0]
        for f in self.files:
            self.starts.append(self.starts[-1] + f.size())
        self.size = self.starts[-1]

    def read(self, at: int, n: int) -> bytes:
        out, end = [], min(at + n, self.size)
        while at < end:
            k = bisect_right(self.starts, at) - 1
            step = min(end, self.starts[k + 1]) - at
            out.append(self.files[k].read_at(step, at - self.starts[k]))
            at += step
        return b"".join(out)


class EwfMedia:
    """The medium of EWF segment files, whatever their order; files without the signature are left aside.

    Without a volume section that can be true (chunks of 128 MB at most) the medium is empty and not complete.
    """

    def __init__(self, paths: list[str]):
        found = []
        for path in paths:
            file = _open(path)
            head = file.read_at(FILE_HEAD, 0)
            if head[:8] == SIGNATURE and len(head) == FILE_HEAD:
                found.append((struct.unpack_from("<H", head, 9)[0], file))
        found.sort(key=lambda x: x[0])
        self.segments = [n for n, _ in found]
        self.fields: dict[str, str] = {}
        self.md5 = self.sha1 = None
        self.complete, self.sound = False, True
        self.chunk_size, self.bytes_per_sector, self.sectors, self.chunks = CHUNK, SECTOR, 0, 0
        self.tables: list[tuple[int, pa.NativeFile, int, int, int, int]] = []  # first chunk, file, its place, entries, base, end
        known, seen = 0, 0
        self.of_segment = [0]  # first chunk of each segment
        for _, file in found:
            end = 0
            for kind, at, size, sound in sections(file):
                self.sound &= sound
                if kind in ("header", "header2") and not self.fields:
                    self.fields = _fields(file.read_at(size, at))
                elif kind in ("volume", "disk") and not seen:
                    chunks, per_chunk, sector, sectors = struct.unpack_from("<IIIQ", file.read_at(24, at).ljust(24, b"\x00"), 4)
                    if 0 < per_chunk * sector <= LARGEST_CHUNK and sectors <= chunks * per_chunk:
                        seen, self.chunks, self.bytes_per_sector, self.sectors = 1, chunks, sector, sectors
                        self.chunk_size = per_chunk * sector
                elif kind == "sectors":
                    end = at + size
                elif kind == "table":
                    n, base = struct.unpack("<I4xQ", file.read_at(16, at).ljust(16, b"\x00"))
                    self.tables.append((known, file, at + TABLE_HEAD, n, base, end))
                    known += n
                elif kind == "digest":
                    md5, sha1 = struct.unpack("16s20s", file.read_at(36, at).ljust(36, b"\x00"))
                    self.md5, self.sha1 = md5.hex(), sha1.hex() if any(sha1) else None
                elif kind == "hash" and self.md5 is None:
                    self.md5 = file.read_at(16, at).hex()
                elif kind == "done":
                    self.complete = True
            self.of_segment.append(known)
        self.size = self.sectors * self.bytes_per_sector
        self.complete &= bool(seen) and self.segments == list(range(1, len(found) + 1)) and known == self.chunks
        self._first = [t[0] for t in self.tables]
        self._kept: dict[int, bytes] = {}

    def chunk(self, k: int) -> tuple[bytes, bool]:
        """A chunk's bytes, and whether its checksum is right; zeros where it can't be read."""
        length = max(0, min(self.chunk_size, self.size - k * self.chunk_size))
        first, file, at, n, base, end = self.tables[bisect_right(self._first, k) - 1]
        if not 0 <= k - first < n:
            return bytes(length), False
        wanted = 2 if k - first + 1 < n else 1
        raw = file.read_at(4 * wanted, at + 4 * (k - first))
        if len(raw) < 4 * wanted:
            return bytes(length), False
        entries = struct.unpack(f"<{wanted}I", raw)
        start = base + (entries[0] & 0x7FFFFFFF)
        stop = base + (entries[1] & 0x7FFFFFFF) if len(entries) > 1 else end
        data = file.read_at(min(max(0, stop - start), 2 * self.chunk_size), start) if start < file.size() else b""
        if entries[0] >> 31:
            packed = zlib.decompressobj()
            try:
                raw = packed.decompress(data, self.chunk_size + 1)  # one more, so that the checksum is met
            except zlib.error:
                return bytes(length), False
            return raw[:length].ljust(length, b"\x00"), packed.eof and len(raw) == length
        raw, check = data[:length], data[length : length + 4]
        return raw.ljust(length, b"\x00"), len(check) == 4 and zlib.adler32(raw) == struct.unpack("<I", check)[0]

    def read(self, at: int, n: int) -> bytes:
        out, end = [], min(at + n, self.size)
        while at < end and self.tables:
            k, place = divmod(at, self.chunk_size)
            if k not in self._kept:
                if len(self._kept) >= KEPT:
                    self._kept.pop(next(iter(self._kept)))
                self._kept[k] = self.chunk(k)[0]
            step = self._kept[k][place : place + end - at]
            out.append(step)
            at += max(1, len(step))
        return b"".join(out)


class _Fat:
    """A FAT12, FAT16 or FAT32 volume at a place of a medium."""

    def __init__(self, media, at: int):
        self.media, boot = media, media.read(at, SECTOR)
        sector, per_cluster, reserved, tables, roots, small, _, table = struct.unpack_from("<HBHBHHBH", boot, 11)
        large, table32, _, _, top = struct.unpack_from("<IIHHI", boot, 32)
        if not (sector and per_cluster and tables):
            raise ValueError("no FAT volume")
        table, self.cluster = table or table32, sector * per_cluster
        before = reserved + tables * table + -(-roots * 32 // sector)
        self.clusters = max(0, ((small or large) - before) // per_cluster)
        self.bits = 12 if self.clusters < 4085 else 16 if self.clusters < 65525 else 32
        self.table, self.data = at + reserved * sector, at + before * sector
        self.root = (at + (reserved + tables * table) * sector, roots * 32)
        self.top = top if self.bits == 32 else 0

    def _next(self, c: int) -> int:
        if self.bits == 12:
            pair = int.from_bytes(self.media.read(self.table + c * 3 // 2, 2), "little")
            return pair >> 4 if c % 2 else pair & 0xFFF
        return int.from_bytes(self.media.read(self.table + c * self.bits // 8, self.bits // 8), "little") & 0x0FFFFFFF

    def _entries(self, c: int) -> Iterator[bytes]:
        """Directory entries of a chain of clusters; cluster 0 is the fixed root."""
        if not c:
            raw = self.media.read(*self.root)
            yield from (raw[i : i + 32] for i in range(0, len(raw) - 31, 32))
            return
        steps = 0
        while 2 <= c < self.clusters + 2 and steps <= self.clusters:  # a chain that meets itself ends
            raw = self.media.read(self.data + (c - 2) * self.cluster, self.cluster)
            yield from (raw[i : i + 32] for i in range(0, len(raw) - 31, 32))
            c, steps = self._next(c), steps + 1

    def files(self) -> Iterator[dict]:
        """Files and folders that are not deleted, each folder's in its order; a folder met twice is listed once."""
        todo, seen = [("", self.top)], {self.top}
        while todo:
            parent, cluster = todo.pop()
            long: list[str] = []
            for e in self._entries(cluster):
                if e[0] == 0:
                    break
                if e[0] == 0xE5 or (e[11] & 0x08 and e[11] != 0x0F):  # deleted, or the volume's name
                    long = []
                    continue
                if e[11] == 0x0F:
                    long.append((e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", "replace"))
                    continue
                name = "".join(reversed(long)).split("\x00")[0] if long else _short(e)
                long = []
                if name in (".", ".."):
                    continue
                high, when, day, low, size = struct.unpack_from("<HHHHI", e, 20)
                path, folder = f"{parent}/{name}", bool(e[11] & 0x10)
                yield {"entry": path, "size": 0 if folder else size, "is_dir": folder, "modified": _moment(day, when)}
                below = low | (high << 16 if self.bits == 32 else 0)
                if folder and below not in seen and below >= 2:
                    seen.add(below)
                    todo.append((path, below))


def _short(e: bytes) -> str:
    stem, extension = (b"\xe5" + e[1:8] if e[0] == 5 else e[:8]).decode("cp437").rstrip(), e[8:11].decode("cp437").rstrip()
    stem, extension = stem.lower() if e[12] & 0x08 else stem, extension.lower() if e[12] & 0x10 else extension
    return f"{stem}.{extension}" if extension else stem


def _moment(day: int, time: int) -> datetime | None:
    try:
        return datetime(1980 + (day >> 9), day >> 5 & 15, day & 31, time >> 11, time >> 5 & 63, (time & 31) * 2)
    except ValueError:
        return None


def volume_files(media) -> Iterator[dict]:
    """partition, filesystem and entries of the FAT volumes of a medium; other file systems give one row without an entry."""
    none = {"entry": None, "size": None, "is_dir": None, "modified": None}
    for p in formats.partitions(media.read(0, 2 * CHUNK)):
        kind = formats.filesystem(media.read(p["start"], 2 * CHUNK))
        own = {"partition": p["number"], "filesystem": kind}
        if kind in ("FAT12", "FAT16", "FAT32"):
            try:
                yield from (own | f for f in _Fat(media, p["start"]).files())
                continue
            except (ValueError, struct.error):
                pass
        yield own | none


# Extensions (lower case) of the files of a kind of container, and of its first file where they need one.
KINDS = (
    ("ad1", "^ad[0-9]+$", "ad1"),
    ("l01", "^l[0-9]{2}$", "l01"),
    ("raw", "^([0-9]{3}|dd|raw|img|bin)$", None),
    ("ewf", "^(e[0-9]{2}|[e-z][a-z]{2})$", "e01"),
)


def image_sets(spark: SparkSession, path: str) -> DataFrame:
    """image (path without extension), kind (ad1, l01, ewf, raw) and paths of the containers among files, from their names.

    The sets of AD1, L01 and EWF are those with a first file (.ad1, .l01, .e01); .001 to .999, or one .dd, .raw, .img or
    .bin, is raw.  The files themselves are not read.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind, first = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, start in reversed(KINDS):
        kind, first = F.when(extension.rlike(pattern), name).otherwise(kind), F.when(extension.rlike(pattern), F.lit(start)).otherwise(first)
    sets = listing.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("image"), kind.alias("kind"), "path", extension.alias("e"), first.alias("first")).where("kind is not null")
    family = F.when((F.col("kind") == "raw") & ~F.col("e").rlike("^[0-9]"), F.col("e"))  # a.dd and a.img are two images
    sets = sets.groupBy("image", "kind", family.alias("family")).agg(F.array_sort(F.collect_list("path")).alias("paths"), F.max(F.col("first").isNull() | (F.col("e") == F.col("first"))).alias("whole"))
    return sets.where("whole").select("image", "kind", "paths")


def _entries(kind: str, paths: list[str]) -> Iterator[dict]:
    if kind == "ad1":
        return logical.ad1_entries([_open(p) for p in paths])
    if kind == "l01":
        return logical.l01_entries([_open(p) for p in paths], sections)
    return volume_files(EwfMedia(paths) if kind == "ewf" else RawMedia(paths))


def _per_image(sets: DataFrame, rows_of: Callable[[str, list[str]], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of each set's image, ROWS at a time."""
    columns = [f.split()[0] for f in schema.replace(", ", ",").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows = rows_of(r.kind, list(r.paths))
                while some := list(islice(rows, ROWS)):
                    yield pd.DataFrame([{"image": r.image, "kind": r.kind} | row for row in some], columns=columns, dtype="object")

    return sets.mapInPandas(run, schema)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """A row an EWF image: segments, media size, case fields, stored hashes; complete where no segment or chunk is missing."""

    def rows(_: str, paths: list[str]) -> Iterator[dict]:
        m = EwfMedia(paths)
        given = {k: m.fields.get(k) for k in ("case_number", "evidence_number", "examiner", "description", "notes")}
        yield {"segments": len(m.segments), "size": m.size, "chunks": m.chunks, "complete": m.complete, "sound_heads": m.sound, "md5": m.md5, "sha1": m.sha1} | given

    schema = "image string, segments long, size long, chunks long, complete boolean, sound_heads boolean, md5 string, sha1 string, case_number string, evidence_number string, examiner string, description string, notes string"
    return _per_image(image_sets(spark, path).where("kind = 'ewf'"), rows, schema)


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Entries of AD1 and L01 containers and of the FAT volumes of EWF and raw images (see volume_files), an image a task at most."""
    schema = "image string, kind string, partition long, filesystem string, entry string, size long, is_dir boolean, modified timestamp_ntz, md5 string"
    return _per_image(image_sets(spark, path), _entries, schema)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(image, place, content, sound) of the media of EWF images, a segment a task at most, BATCH chunks in memory."""
    schema = "image string, place long, content binary, sound boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                m = EwfMedia(list(r.paths))
                if r.segment >= len(m.segments):
                    continue
                low, high = m.of_segment[r.segment : r.segment + 2]
                for lo in range(low, min(high, m.chunks), BATCH):
                    rows = [(r.image, k * m.chunk_size, *m.chunk(k)) for k in range(lo, min(high, m.chunks, lo + BATCH))]
                    yield pd.DataFrame(rows, columns=["image", "place", "content", "sound"])

    sets = image_sets(spark, path).where("kind = 'ewf'")
    each = sets.select("image", "paths", F.explode(F.sequence(F.lit(0), F.size("paths") - 1)).alias("segment"))
    return each.repartition("image", "segment").mapInPandas(run, schema)


def verify_images(spark: SparkSession, path: str, algorithm: str = "md5") -> DataFrame:
    """image, size, stored and computed hash, verified (null where none is stored) and unsound chunks of EWF images."""
    chunks = read_chunks(spark, path)
    computed = digests.combined(chunks, "image", "place", "content", algorithm).select("image", F.col("digest").alias("computed"))
    unsound = chunks.groupBy("image").agg(F.count_if(~F.col("sound")).alias("unsound"))
    found = read_images(spark, path).select("image", "size", "complete", F.col(algorithm).alias("stored"))
    return found.join(computed, "image", "left").join(unsound, "image", "left").withColumn("verified", F.col("stored") == F.col("computed"))


def extension_of(segment: int) -> str:
    """E01 to E99, then EAA to ZZZ."""
    if segment < 100:
        return f"E{segment:02d}"
    first, rest = divmod(segment - 100, 26 * 26)
    if first > 21:
        raise ValueError(f"no extension for segment {segment}")
    return chr(69 + first) + chr(65 + rest // 26) + chr(65 + rest % 26)


def segment_file(segment: int, raw: bytes, chunks: int, size: int, last: bool, md5: str, sha1: str, fields: dict[str, str]) -> bytes:
    """An EWF segment file: heads in the first, chunks compressed where that is shorter, hashes in the last."""
    if (size % SECTOR) or (not last and len(raw) % CHUNK):
        raise ValueError("media are whole sectors, segments but the last whole chunks")
    out = bytearray(SIGNATURE + struct.pack("<BHH", 1, segment, 0))

    def section(kind: str, data: bytes = b"", ends: bool = False) -> None:
        at = len(out)
        head = struct.pack("<16sQQ40x", kind.encode(), at if ends else at + SECTION_HEAD + len(data), SECTION_HEAD + len(data))
        out.extend(head + struct.pack("<I", zlib.adler32(head)) + data)

    summed = lambda data: data + struct.pack("<I", zlib.adler32(data))
    volume = struct.pack("<B3xIIIQ", 1, chunks, CHUNK // SECTOR, SECTOR, size // SECTOR) + struct.pack("<12xB3x4x4x4xB3xI4x", 1, 1, CHUNK // SECTOR)
    volume = summed((volume + hashlib.md5(md5.encode()).digest()).ljust(VOLUME - 4, b"\x00"))
    if segment == 1:
        letters = {v: k for k, v in FIELDS.items()}
        names = [n for n in FIELDS.values() if n in fields]
        text = "\n".join(["1", "main", "\t".join(letters[n] for n in names), "\t".join(" ".join(fields[n].split()) for n in names), "", ""])
        section("header2", zlib.compress(text.encode("utf-16")))
        section("header", zlib.compress(text.replace("\n", "\r\n").encode("latin-1", "replace")))
        section("volume", volume)
    else:
        section("data", volume)
    for low in range(0, len(raw), CHUNK * TABLE_MOST):
        group = raw[low : low + CHUNK * TABLE_MOST]
        stored, entries, base = bytearray(), [], len(out) + SECTION_HEAD
        for at in range(0, len(group), CHUNK):
            plain = group[at : at + CHUNK]
            packed = zlib.compress(plain, 6)
            entries.append(len(stored) | (0x80000000 if len(packed) < len(plain) else 0))
            stored += packed if len(packed) < len(plain) else summed(plain)
        section("sectors", bytes(stored))
        table = summed(struct.pack("<I4xQ4x", len(entries), base)) + summed(struct.pack(f"<{len(entries)}I", *entries))
        section("table", table)
        section("table2", table)
    if last:
        section("digest", summed(bytes.fromhex(md5) + bytes.fromhex(sha1) + bytes(40)))
        section("hash", summed(bytes.fromhex(md5) + bytes(16)))
    section("done" if last else "next", ends=True)
    return bytes(out)


def ewf_segments(parts: DataFrame, fields: dict[str, str] | None = None, image: str = "image", number: str = "number", content: str = "content") -> DataFrame:
    """(image, segment, name, file): the EWF segment files of media given in parts numbered from 1 without gaps.

    A part makes a segment: whole chunks of 32 KiB, the last one whole sectors; a null part is empty.  Files are made a row
    at a time; the hashes of a medium need its parts in order, in one stream a medium (see digests.combined).
    """
    own, given = dict(fields or {}), F.coalesce(F.col(content), F.lit(b""))
    parts = parts.select(F.col(image).cast("string").alias("image"), F.col(number).cast("long").alias("number"), given.alias("content"))
    length = F.octet_length("content")
    totals = parts.groupBy("image").agg(F.sum(length).alias("bytes"), F.sum(F.ceil(length / CHUNK)).alias("chunks"), F.max("number").alias("parts"))
    for a in ("md5", "sha1"):
        totals = totals.join(digests.combined(parts, "image", "number", "content", a).select("image", F.col("digest").alias(a)), "image")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                made = segment_file(r.number, bytes(r.content), r.chunks, r.bytes, r.number == r.parts, r.md5, r.sha1, own)
                yield pd.DataFrame([(r.image, r.number, f"{r.image}.{extension_of(r.number)}", made)], columns=["image", "segment", "name", "file"])

    return parts.join(totals, "image").mapInPandas(run, "image string, segment long, name string, file binary")


def save_files(rows: DataFrame, folder: str, name: str = "name", file: str = "file") -> int:
    """Write a file a row under a folder, on the executors; how many.  A file appears under its name when it is whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        system, place = _system(folder)
        system.create_dir(place, recursive=True)
        for batch in batches:
            for n, data in zip(batch[name], batch[file], strict=True):
                part = f"{place}/.{n}.{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(part) as out:
                    out.write(bytes(data))
                system.move(part, f"{place}/{n}")
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select(name, file).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
