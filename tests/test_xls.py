"""XLS workbooks built record by record."""

import struct

from casegrain.sources import readers, xls


def record(kind, data=b""):
    return struct.pack("<HH", kind, len(data)) + data


def compound(stream):
    """A compound file with one long stream, Workbook."""
    stream = stream.ljust(max(4096, -(-len(stream) // 512) * 512), b"\x00")
    n = len(stream) // 512
    header = bytearray(512)
    header[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    struct.pack_into("<HH", header, 30, 9, 6)
    for at, value in ((44, 1), (48, 1), (56, 4096), (60, 0xFFFFFFFE), (68, 0xFFFFFFFE)):
        struct.pack_into("<I", header, at, value)
    struct.pack_into("<109I", header, 76, 0, *[0xFFFFFFFF] * 108)

    def entry(name, kind, child, start, size):
        out = bytearray(128)
        out[: 2 * len(name)] = name.encode("utf-16-le")
        struct.pack_into("<H", out, 64, 2 * len(name) + 2)
        out[66] = kind
        struct.pack_into("<III", out, 68, 0xFFFFFFFF, 0xFFFFFFFF, child)
        struct.pack_into("<IQ", out, 116, start, size)
        return bytes(out)

    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [k + 3 for k in range(n - 1)] + [0xFFFFFFFE]
    folder = entry("Root Entry", 5, 1, 0xFFFFFFFE, 0) + entry("Workbook", 2, 0xFFFFFFFF, 2, len(stream)) + bytes(256)
    return bytes(header) + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + folder + stream


def workbook():
    shared = struct.pack("<II", 3, 3) + struct.pack("<HB", 2, 0) + b"ab" + struct.pack("<HBH", 4, 9, 1) + "w\u00e9".encode("utf-16-le")
    rest = bytes([0]) + b"xy" + bytes(4) + struct.pack("<HB", 1, 0) + b"z"  # a text goes on narrow, its format run follows
    start = record(0x0809, bytes(16))
    names = [("One", 0), ("Chart", 2), ("Tw\u00f6", 0)]
    tail = record(0x00FC, shared) + record(0x003C, rest) + record(0x000A)
    cell = lambda row, column, data: struct.pack("<HHH", row, column, 0) + data
    one = record(0x0809, bytes(16)) + record(0x00FD, cell(0, 0, struct.pack("<I", 1))) + record(0x0203, cell(0, 1, struct.pack("<d", 2.5))) + record(0x027E, cell(0, 2, struct.pack("<I", 12345 << 2 | 3)))
    one += record(0x00BD, struct.pack("<HH", 1, 3) + struct.pack("<HI", 0, 7 << 2 | 2) + struct.pack("<HI", 0, 0xFFFFFFFF & (-5 << 2 | 2)) + struct.pack("<H", 4))
    one += record(0x0809, bytes(16)) + record(0x0203, cell(9, 9, struct.pack("<d", 1))) + record(0x000A)  # a chart inside
    one += record(0x0205, cell(2, 0, b"\x01\x00")) + record(0x0205, cell(2, 1, b"\x07\x01")) + record(0x0006, cell(3, 0, struct.pack("<d", -4.0)) + bytes(8)) + record(0x0006, cell(3, 1, bytes(6) + b"\xff\xff") + bytes(8)) + record(0x0207, struct.pack("<HB", 2, 0) + b"hi") + record(0x000A)
    two = record(0x0809, bytes(16)) + record(0x0204, cell(5, 6, struct.pack("<HB", 3, 0) + b"old")) + record(0x00FD, cell(0, 0, struct.pack("<I", 99))) + record(0x000A)
    head = lambda places: start + b"".join(record(0x0085, struct.pack("<IBBBB", at, 0, kind, len(n), 0) + n.encode("latin-1")) for (n, kind), at in zip(names, places, strict=True)) + tail
    base = len(head([0, 0, 0]))
    return head([base, 0, base + len(one)]) + one + two


ONE = [(0, 0, "string", "w\u00e9xy"), (0, 1, "float", "2.5"), (0, 2, "float", "123.45"), (1, 3, "int", "7"), (1, 4, "int", "-5"), (2, 0, "bool", "true"), (2, 1, "error", "#DIV/0!"), (3, 0, "int", "-4"), (3, 1, "string", "hi")]


def test_xls(spark, tmp_path):
    raw = compound(workbook())
    (tmp_path / "a.xls").write_bytes(raw)
    (tmp_path / "b.xls").write_bytes(raw[:700])
    got = sorted((r.sheet, r.row, r.column, r.type, r.text) for r in readers.read_workbook(spark, f"{tmp_path}/a.xls").collect())
    assert got == [("One", *c) for c in ONE] + [("Tw\u00f6", 5, 6, "string", "old")]
    assert readers.read_workbook(spark, f"{tmp_path}/b.xls").count() == 0 and readers.read_workbook(spark, str(tmp_path), "One").count() == len(ONE)
    assert list(xls.xls_cells(b"")) == []


def test_damaged_xls():
    """Any shorter workbook, and any wrong byte of it, is read to an end."""
    stream = workbook()
    for at in range(0, len(stream), 5):
        list(xls.xls_cells(compound(stream[:at])))
        list(xls.xls_cells(compound(stream[:at] + bytes([stream[at] ^ 0xFF]) + stream[at + 1 :])))
