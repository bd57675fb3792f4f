"""Parsers of file formats, from bytes to rows: databases, workbooks, office texts, images, programs, disks.

Each takes the bytes of one file and yields dicts; `readers` runs them on the executors.  Damaged files give no rows, or the
rows before the damage.  SQLite needs a file: its bytes go to a temporary one of the worker, which is removed at once.
"""

from __future__ import annotations

import io
import os
import re
import sqlite3
import struct
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager


@contextmanager
def _database(raw: bytes) -> Iterator[sqlite3.Connection]:
    fd, path = tempfile.mkstemp(suffix=".db")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(raw)
        connection = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
        try:
            yield connection
        finally:
            connection.close()
    finally:
        os.unlink(path)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_overview(raw: bytes) -> Iterator[dict]:
    """name, kind (table or view), rows and columns of each table and view but the system's; pragmas as kind pragma."""
    try:
        with _database(raw) as db:
            for name, kind in db.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY type, name").fetchall():
                rows = db.execute(f"SELECT count(*) FROM {_quoted(name)}").fetchone()[0] if kind == "table" else None
                yield {"name": name, "kind": kind, "n_rows": rows, "n_columns": len(db.execute(f"PRAGMA table_info({_quoted(name)})").fetchall())}
            for pragma in ("page_size", "page_count", "user_version"):
                yield {"name": pragma, "kind": "pragma", "n_rows": db.execute(f"PRAGMA {pragma}").fetchone()[0], "n_columns": None}
    except sqlite3.DatabaseError:
        return


def sqlite_columns(raw: bytes) -> Iterator[dict]:
    """table, position, column, type, not_null, default, primary_key (its place in the key, or 0), indexes and ddl."""
    try:
        with _database(raw) as db:
            for table, ddl in db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
                indexes = [r[1] for r in db.execute(f"PRAGMA index_list({_quoted(table)})").fetchall()]
                for position, column, kind, not_null, default, key in db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall():
                    yield {"table": table, "position": position, "column": column, "type": kind, "not_null": bool(not_null), "default": default, "primary_key": key, "indexes": sorted(indexes), "ddl": ddl}
    except sqlite3.DatabaseError:
        return


def _sheet_cells(xml: bytes, shared: list[str]) -> Iterator[tuple[int, int, str, str]]:
    """(row, column, type, text) of the cells of a sheet, counted from 0."""
    at = 0
    for _, row in ET.iterparse(io.BytesIO(xml), events=("end",)):
        if not row.tag.endswith("}row"):
            continue
        number, place = int(row.get("r", at + 1)) - 1, 0
        for cell in row:
            letters = re.match("[A-Z]+", cell.get("r", ""))
            if letters:
                place = 0
                for c in letters[0]:
                    place = place * 26 + ord(c) - 64
                place -= 1
            value = next((v.text or "" for v in cell if v.tag.endswith("}v")), None)
            kind = cell.get("t", "n")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter() if t.tag.endswith("}t"))
            if value is not None:
                if kind == "s":
                    kind, value = "string", shared[int(value)]
                elif kind == "b":
                    kind, value = "bool", "true" if value == "1" else "false"
                elif kind == "n":
                    kind = "int" if re.fullmatch(r"-?\d+", value) else "float"
                else:
                    kind = "error" if kind == "e" else "string"
                yield number, place, kind, value
            place += 1
        at = number + 1
        row.clear()


def xlsx_cells(raw: bytes, sheet: str | None = None) -> Iterator[dict]:
    """sheet, row, column (from 0), type and text of every cell of a workbook, or of one sheet."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            shared: list[str] = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in item.iter() if t.tag.endswith("}t")) for item in ET.fromstring(z.read("xl/sharedStrings.xml"))]
            targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            for s in ET.fromstring(z.read("xl/workbook.xml")).iter():
                if s.tag.endswith("}sheet") and sheet in (None, s.get("name")):
                    link = next(v for k, v in s.attrib.items() if k.endswith("}id"))
                    path = targets[link].lstrip("/")
                    for row, column, kind, text in _sheet_cells(z.read(path if path.startswith("xl/") else f"xl/{path}"), shared):
                        yield {"sheet": s.get("name"), "row": row, "column": column, "type": kind, "text": text}
    except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration, IndexError):
        return


def ods_cells(raw: bytes) -> Iterator[dict]:
    """The same of an OpenDocument spreadsheet; repeated empty rows and columns are stepped over."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            root = ET.fromstring(z.read("content.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return
    local = lambda e, name: next((v for k, v in e.attrib.items() if k.endswith("}" + name)), None)
    for table in (e for e in root.iter() if e.tag.endswith("}table")):
        row = 0
        for r in (e for e in table.iter() if e.tag.endswith("}table-row")):
            times = int(local(r, "number-rows-repeated") or 1)
            cells, column = [], 0
            for c in r:
                again = int(local(c, "number-columns-repeated") or 1)
                text = "\n".join("".join(p.itertext()) for p in c if p.tag.endswith("}p"))
                kind = local(c, "value-type")
                if kind:
                    value = local(c, "value") or text
                    typed = {"float": "int" if re.fullmatch(r"-?\d+", value) else "float", "boolean": "bool"}.get(kind, "string")
                    shown = value if typed in ("int", "float") else (local(c, "boolean-value") or text) if typed == "bool" else text
                    cells += [(column + i, typed, shown) for i in range(again)]
                column += again
            for i in range(times if cells else 0):
                yield from ({"sheet": local(table, "name"), "row": row + i, "column": k, "type": t, "text": x} for k, t, x in cells)
            row += times


def docx_text(raw: bytes) -> str:
    """The texts of a document's runs, each with a space after it."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            root = ET.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return ""
    return "".join((t.text or "") + " " for t in root.iter() if t.tag.endswith("}t"))


def rtf_text(raw: bytes) -> str:
    """What stands in the outermost group, the letters of control words (and a space after each) left out; their numbers stay."""
    depth, out = 0, []
    for m in re.finditer(r"[{}]|\\[A-Za-z]* ?|[^{}\\]+", raw.decode("utf-8", "replace")):
        piece = m[0]
        if piece == "{":
            depth += 1
        elif piece == "}":
            depth -= 1
        elif piece[0] != "\\" and depth <= 1:
            out.append(piece)
    return "".join(out)


def pdf_text(raw: bytes) -> str:
    """The strings that a PDF's (plain or deflated) content streams show; a page's fonts must use Latin codes.

    Lines end at each text object.  Encrypted files and other filters give nothing.
    """
    import zlib

    out = []
    for m in re.finditer(rb"<<(?P<head>.*?)>>\s*stream\r?\n(?P<body>.*?)\r?\nendstream", raw, re.DOTALL):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in m["head"]:
            continue
        for text in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.DOTALL):
            shown = re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ", text, re.DOTALL)
            strings = [a or b"".join(re.findall(rb"\(((?:[^()\\]|\\.)*)\)", b)) for a, b in shown]
            line = b"".join(strings)
            line = re.sub(rb"\\([0-7]{1,3})", lambda o: bytes([int(o[1], 8) & 255]), line)
            out.append(re.sub(rb"\\(.)", rb"\1", line).decode("latin-1"))
    return "\n".join(out)


# Tags of the image file directory that are read, by number.
EXIF_TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "modified", 0x9003: "taken", 0x9004: "digitized", 0xA434: "lens", 0x0112: "orientation"}


def exif(raw: bytes) -> dict | None:
    """Tags by name, and latitude and longitude in signed degrees, of a JPEG or TIFF; null where it has none."""
    at = raw.find(b"Exif\x00\x00") + 6 if raw[:2] == b"\xff\xd8" else 0
    tiff = raw[at:]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or at == 5:
        return None

    def values(kind: int, count: int, place: int) -> object:
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1) * count
        start = place if size <= 4 else struct.unpack_from(order + "I", tiff, place)[0]
        if kind == 2:
            return tiff[start : start + count].split(b"\x00")[0].decode("utf-8", "replace")
        if kind in (5, 10):
            pairs = struct.unpack_from(order + ("II" if kind == 5 else "ii") * count, tiff, start)
            return [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        found = struct.unpack_from(order + {3: "H", 4: "I", 9: "i"}.get(kind, "B") * count, tiff, start)
        return found[0] if count == 1 else list(found)

    def directory(start: int) -> dict[int, object]:
        n = struct.unpack_from(order + "H", tiff, start)[0]
        return {tag: values(kind, count, start + 10 + 12 * i) for i in range(n) for tag, kind, count in [struct.unpack_from(order + "HHI", tiff, start + 2 + 12 * i)]}

    try:
        first = directory(struct.unpack_from(order + "I", tiff, 4)[0])
        every = first | (directory(first[0x8769]) if 0x8769 in first else {})
        gps = directory(first[0x8825]) if 0x8825 in first else {}
    except struct.error:
        return None
    out = {name: str(every[tag]) for tag, name in EXIF_TAGS.items() if tag in every}
    for name, ref, value, minus in (("latitude", 1, 2, "S"), ("longitude", 3, 4, "W")):
        if len(gps.get(value) or []) == 3:
            d, m, s = gps[value]
            out[name] = (d + m / 60 + s / 3600) * (-1 if gps.get(ref) == minus else 1)
    return out


# Machines of program headers.
MACHINES = {("PE", 0x014C): "x86", ("PE", 0x8664): "x86-64", ("PE", 0xAA64): "ARM64", ("ELF", 3): "x86", ("ELF", 62): "x86-64", ("ELF", 40): "ARM", ("ELF", 183): "ARM64", ("Mach-O", 7): "x86", ("Mach-O", 0x01000007): "x86-64", ("Mach-O", 0x0100000C): "ARM64"}


def program(raw: bytes) -> dict | None:
    """format, bits, machine, entry and section names of a PE, ELF or Mach-O file; null for others and damaged ones."""
    try:
        if raw[:4] == b"\x7fELF":
            wide, order = raw[4] == 2, "<" if raw[5] == 1 else ">"
            machine = struct.unpack_from(order + "H", raw, 18)[0]
            entry, _, table = struct.unpack_from(order + ("QQQ" if wide else "III"), raw, 24)
            size, n, names = struct.unpack_from(order + "HHH", raw, 58 if wide else 46)
            field = lambda i, k: struct.unpack_from(order + ("Q" if wide else "I"), raw, table + i * size + k)[0]
            strings = field(names, 24 if wide else 16) if n else 0
            label = lambda i: raw[strings + struct.unpack_from(order + "I", raw, table + i * size)[0] :].split(b"\x00", 1)[0].decode("latin-1")
            return {"format": "ELF", "bits": 64 if wide else 32, "machine": MACHINES.get(("ELF", machine), hex(machine)), "entry": entry, "sections": [label(i) for i in range(n)]}
        if raw[:2] == b"MZ":
            at = struct.unpack_from("<I", raw, 60)[0]
            if raw[at : at + 4] != b"PE\x00\x00":
                return None
            machine, n, _, _, _, optional, _ = struct.unpack_from("<HHIIIHH", raw, at + 4)
            wide = struct.unpack_from("<H", raw, at + 24)[0] == 0x20B
            entry = struct.unpack_from("<I", raw, at + 40)[0]
            labels = [raw[at + 24 + optional + 40 * i :][:8].rstrip(b"\x00").decode("latin-1") for i in range(n)]
            return {"format": "PE", "bits": 64 if wide else 32, "machine": MACHINES.get(("PE", machine), hex(machine)), "entry": entry, "sections": labels}
        magic = {b"\xce\xfa\xed\xfe": ("<", 32), b"\xcf\xfa\xed\xfe": ("<", 64), b"\xfe\xed\xfa\xce": (">", 32), b"\xfe\xed\xfa\xcf": (">", 64)}.get(raw[:4])
        if magic:
            order, bits = magic
            machine, _, _, n = struct.unpack_from(order + "IIII", raw, 4)
            at, labels = 32 if bits == 64 else 28, []
            for _ in range(n):
                command, size = struct.unpack_from(order + "II", raw, at)
                if command in (1, 25):
                    labels.append(raw[at + 8 : at + 24].rstrip(b"\x00").decode("latin-1"))
                at += max(size, 8)
            return {"format": "Mach-O", "bits": bits, "machine": MACHINES.get(("Mach-O", machine), hex(machine)), "entry": 0, "sections": labels}
    except (struct.error, IndexError):
        return None
    return None


# Partition types of a master boot record.
MBR_TYPES = {0x01: "FAT12", 0x04: "FAT16", 0x05: "Extended", 0x06: "FAT16", 0x07: "NTFS/exFAT", 0x0B: "FAT32", 0x0C: "FAT32", 0x0E: "FAT16", 0x0F: "Extended", 0x82: "Linux swap", 0x83: "Linux", 0xAF: "HFS+", 0xEE: "GPT"}
SECTOR = 512


def filesystem(raw: bytes, at: int = 0) -> str | None:
    """The file system that starts at a place of an image, by its signature."""
    here = lambda place, n: raw[at + place : at + place + n]
    signs = (("NTFS", 3, b"NTFS    "), ("exFAT", 3, b"EXFAT   "), ("FAT32", 82, b"FAT32   "), ("FAT16", 54, b"FAT16   "), ("FAT12", 54, b"FAT12   "), ("ext", 1080, b"\x53\xef"), ("HFS+", 1024, b"H+"), ("HFSX", 1024, b"HX"), ("APFS", 32, b"NXSB"), ("ISO 9660", 32769, b"CD001"))
    return next((name for name, place, sign in signs if here(place, len(sign)) == sign), None)


def partitions(raw: bytes) -> Iterator[dict]:
    """number, scheme, type, start, size (bytes), label and filesystem of an image's partitions; one row of scheme none where it is a bare file system."""
    if raw[SECTOR : SECTOR + 8] == b"EFI PART":
        table, n, size = struct.unpack_from("<QII", raw, SECTOR + 72)
        for i in range(n):
            entry = raw[table * SECTOR + i * size :][:size]
            if len(entry) < 128:
                return
            if entry[:16] != bytes(16):
                first, last = struct.unpack_from("<QQ", entry, 32)
                kind = "-".join(x.hex() for x in (entry[3::-1], entry[5:3:-1], entry[7:5:-1], entry[8:10], entry[10:16]))
                yield {"number": i + 1, "scheme": "GPT", "type": kind, "start": first * SECTOR, "size": (last - first + 1) * SECTOR, "label": entry[56:128].decode("utf-16-le", "replace").rstrip("\x00"), "filesystem": filesystem(raw, first * SECTOR)}
        return
    bare = filesystem(raw)
    if bare:
        yield {"number": 0, "scheme": "none", "type": None, "start": 0, "size": len(raw), "label": None, "filesystem": bare}
    elif raw[510:512] == b"\x55\xaa":
        for i in range(4):
            kind, = raw[446 + 16 * i + 4 : 446 + 16 * i + 5]
            first, n = struct.unpack_from("<II", raw, 446 + 16 * i + 8)
            if kind and n:
                yield {"number": i + 1, "scheme": "MBR", "type": MBR_TYPES.get(kind, f"0x{kind:02x}"), "start": first * SECTOR, "size": n * SECTOR, "label": None, "filesystem": filesystem(raw, first * SECTOR)}


def registry_hive(raw: bytes) -> Iterator[dict]:
    """key path, value name, type and data (text) of a registry hive's values; a key without values has one row of nulls."""
    if raw[:4] != b"regf":
        return
    base = 4096
    cell = lambda at: base + at + 4
    todo = [(struct.unpack_from("<I", raw, 36)[0], "")]
    seen: set[int] = set()
    while todo:
        at, above = todo.pop()
        p = cell(at)
        if at in seen or raw[p : p + 2] != b"nk":
            continue
        seen.add(at)
        flags, = struct.unpack_from("<H", raw, p + 2)
        n_sub, = struct.unpack_from("<I", raw, p + 20)
        lists, = struct.unpack_from("<I", raw, p + 28)
        n_values, values = struct.unpack_from("<II", raw, p + 36)
        size, = struct.unpack_from("<H", raw, p + 72)
        name = raw[p + 76 : p + 76 + size].decode("latin-1" if flags & 0x20 else "utf-16-le", "replace")
        path = f"{above}/{name}" if above else name
        for i in range(n_values):
            q = cell(struct.unpack_from("<I", raw, cell(values) + 4 * i)[0])
            long, = struct.unpack_from("<H", raw, q + 2)
            length, place, kind, named = struct.unpack_from("<IIIH", raw, q + 4)
            label = raw[q + 20 : q + 20 + long].decode("latin-1" if named & 1 else "utf-16-le", "replace")
            data = raw[q + 8 : q + 8 + (length & 0x7FFFFFFF)] if length & 0x80000000 else raw[cell(place) : cell(place) + length]
            yield {"key": path, "name": label or "(Default)", "type": {1: "REG_SZ", 2: "REG_EXPAND_SZ", 3: "REG_BINARY", 4: "REG_DWORD", 7: "REG_MULTI_SZ", 11: "REG_QWORD"}.get(kind, str(kind)), "data": _registry_text(kind, data)}
        if not n_values:
            yield {"key": path, "name": None, "type": None, "data": None}
        todo += [(child, path) for child in reversed(_subkeys(raw, cell, lists, n_sub))]


def _registry_text(kind: int, data: bytes) -> str:
    if kind in (1, 2, 7):
        return data.decode("utf-16-le", "replace").rstrip("\x00").replace("\x00", "\n")
    if kind in (4, 11):
        return str(int.from_bytes(data, "little"))
    return data.hex()


def _subkeys(raw: bytes, cell: Callable[[int], int], lists: int, n: int) -> list[int]:
    if not n:
        return []
    p = cell(lists)
    kind, count = raw[p : p + 2], struct.unpack_from("<H", raw, p + 2)[0]
    if kind in (b"lf", b"lh"):
        return [struct.unpack_from("<I", raw, p + 4 + 8 * i)[0] for i in range(count)]
    if kind == b"li":
        return [struct.unpack_from("<I", raw, p + 4 + 4 * i)[0] for i in range(count)]
    if kind == b"ri":
        return [k for i in range(count) for k in _subkeys(raw, cell, struct.unpack_from("<I", raw, p + 4 + 4 * i)[0], n)]
    return []


SECTOR_ISO = 2048


def iso_entries(raw: bytes) -> Iterator[dict]:
    """entry, size and is_dir of an ISO 9660 image, folders before what they hold; names without version numbers."""
    if raw[16 * SECTOR_ISO + 1 : 16 * SECTOR_ISO + 6] != b"CD001":
        return
    place = lambda record: struct.unpack_from("<I4xI", record, 2)
    todo, seen = [("", *place(raw[16 * SECTOR_ISO + 156 : 16 * SECTOR_ISO + 190]))], set()
    while todo:
        above, start, size = todo.pop(0)
        if start in seen:
            continue
        seen.add(start)
        data, at = raw[start * SECTOR_ISO : start * SECTOR_ISO + size], 0
        while at + 33 < len(data):
            length = data[at]
            if not length:  # records don't cross sectors
                at = (at // SECTOR_ISO + 1) * SECTOR_ISO
                continue
            record = data[at : at + length]
            at += length
            name = record[33 : 33 + record[32]]
            if name in (b"\x00", b"\x01"):
                continue
            path, is_dir = above + name.decode("latin-1").split(";")[0].rstrip("."), bool(record[25] & 2)
            begin, n = place(record)
            yield {"entry": path, "size": 0 if is_dir else n, "is_dir": is_dir}
            if is_dir:
                todo.append((path + "/", begin, n))


def compound_streams(raw: bytes) -> dict[str, bytes]:
    """Streams of a compound file (OLE) by path; a damaged chain ends where it breaks."""
    if raw[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return {}
    shift, mini_shift = struct.unpack_from("<HH", raw, 30)
    size, mini = 1 << shift, 1 << mini_shift
    n_fat, first, cutoff, first_mini, first_difat = (struct.unpack_from("<I", raw, at)[0] for at in (44, 48, 56, 60, 68))
    sector = lambda i: raw[(i + 1) * size : (i + 2) * size]
    end = 0xFFFFFFFA
    table = list(struct.unpack_from("<109I", raw, 76))
    while first_difat < end and len(table) < n_fat:
        more = struct.unpack(f"<{size // 4}I", sector(first_difat))
        table, first_difat = table + list(more[:-1]), more[-1]
    fat = [x for i in table[:n_fat] if i < end for x in struct.unpack(f"<{len(sector(i)) // 4}I", sector(i)[: len(sector(i)) // 4 * 4])]

    def chain(i: int, links: list[int]) -> list[int]:
        out, seen = [], set()
        while i < min(end, len(links)) and i not in seen:
            seen.add(i)
            out.append(i)
            i = links[i]
        return out

    joined = lambda i: b"".join(sector(k) for k in chain(i, fat))
    entries = joined(first)
    rows = []
    for at in range(0, len(entries) - 127, 128):
        e = entries[at : at + 128]
        used, = struct.unpack_from("<H", e, 64)
        left, right, child = struct.unpack_from("<III", e, 68)
        rows.append((e[: max(0, used - 2)].decode("utf-16-le", "replace"), e[66], left, right, child, *struct.unpack_from("<IQ", e, 116)))
    if not rows:
        return {}
    small = joined(rows[0][5])
    links = [x for i in chain(first_mini, fat) for x in struct.unpack(f"<{size // 4}I", sector(i).ljust(size, b"\xff"))]
    out: dict[str, bytes] = {}
    todo, seen = [(rows[0][4], "")], set()
    while todo:
        i, above = todo.pop()
        if i >= len(rows) or i in seen:
            continue
        seen.add(i)
        name, kind, left, right, child, start, length = rows[i]
        todo += [(left, above), (right, above)]
        if kind == 1:
            todo.append((child, f"{above}{name}/"))
        elif kind == 2:
            data = b"".join(small[k * mini : (k + 1) * mini] for k in chain(start, links)) if length < cutoff else joined(start)
            out[above + name] = data[:length]
    return out


# Property streams of an Outlook message.
MSG_STREAMS = {"0037": "subject", "0C1A": "sender_name", "0C1F": "sender", "0E04": "recipients", "1000": "body", "007D": "headers"}


def outlook_message(raw: bytes) -> dict | None:
    """subject, sender, recipients, sent (of the headers), body and attachment names of an MSG file; null for other files."""
    streams = compound_streams(raw)
    found: dict[str, str] = {}
    attachments: dict[str, str] = {}
    for path, data in streams.items():
        m = re.fullmatch(r"(?:(__attach_version1\.0_[^/]*)/)?__substg1\.0_([0-9A-F]{4})(001E|001F)", path)
        if m is None:
            continue
        text = data.decode("utf-16-le" if m[3] == "001F" else "cp1252", "replace").rstrip("\x00")
        if m[1]:
            if m[2] == "3707" or (m[2] == "3704" and m[1] not in attachments):
                attachments[m[1]] = text
        elif m[2] in MSG_STREAMS:
            found[MSG_STREAMS[m[2]]] = text
    if not found:
        return None
    sent = re.search(r"(?im)^date:\s*(.+?)\s*$", found.get("headers", ""))
    return {"subject": found.get("subject"), "sender": found.get("sender") or found.get("sender_name"), "recipients": found.get("recipients"), "sent": sent[1] if sent else None, "body": found.get("body", ""), "attachments": [attachments[k] for k in sorted(attachments)]}
