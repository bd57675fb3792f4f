"""Cells of XLS workbooks (BIFF8 records in the Workbook stream of a compound file)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from casegrain.sources.formats import compound_streams

# Numbers of the records that are read.
BOF, EOF, CONTINUE, SHEET, STRINGS, SHARED = 0x0809, 0x000A, 0x003C, 0x0085, 0x00FC, 0x00FD
NUMBER, RK, MANY_RK, LABEL, BOOLEAN, FORMULA, FORMULA_TEXT = 0x0203, 0x027E, 0x00BD, 0x0204, 0x0205, 0x0006, 0x0207
# Codes of errors in cells.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, data and its continuations) of the records from a place on."""
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        pieces, at = [stream[at + 4 : at + 4 + n]], at + 4 + n
        while at + 4 <= len(stream) and struct.unpack_from("<H", stream, at)[0] == CONTINUE:
            n = struct.unpack_from("<H", stream, at + 2)[0]
            pieces.append(stream[at + 4 : at + 4 + n])
            at += 4 + n
        yield kind, pieces


class _Pieces:
    """Reads on over continuations; the characters of a text say anew in each whether they are wide."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.k, self.at = pieces, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.k < len(self.pieces):
            step = self.pieces[self.k][self.at : self.at + n - len(out)]
            out, self.at = out + step, self.at + len(step)
            if len(out) < n:
                self.k, self.at = self.k + 1, 0
        if len(out) < n:
            raise ValueError("record ends early")
        return out

    def text(self, wide_length: bool = True) -> str:
        n, = struct.unpack("<H", self.take(2)) if wide_length else self.take(1)
        flags, = self.take(1)
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while n:
            while self.k < len(self.pieces) and self.at >= len(self.pieces[self.k]):
                self.k, self.at = self.k + 1, 0
                wide = self.take(1)[0] & 1
            if self.k >= len(self.pieces):
                raise ValueError("record ends early")
            here = min(n, max(1, (len(self.pieces[self.k]) - self.at) // (2 if wide else 1)))
            out.append(self.take(here * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= here
        self.take(4 * runs + extra)
        return "".join(out)


def _rk(value: int) -> float:
    number = float((value - (1 << 32) if value >> 31 else value) >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def _cells(stream: bytes, at: int, shared: list[str]) -> Iterator[tuple[int, int, str, object]]:
    """(row, column, type, value) of one sheet; charts inside it are passed over."""
    depth, place = 0, None
    for kind, pieces in _records(stream, at):
        data = pieces[0]
        depth += (kind == BOF) - (kind == EOF)
        if depth < 1:
            return
        if depth > 1:
            continue
        if kind == FORMULA_TEXT and place:
            yield *place, "string", _Pieces(pieces).text()
            place = None
        if kind not in (SHARED, NUMBER, RK, MANY_RK, LABEL, BOOLEAN, FORMULA):
            continue
        row, column = struct.unpack_from("<HH", data)
        if kind == SHARED:
            k, = struct.unpack_from("<I", data, 6)
            if k < len(shared):
                yield row, column, "string", shared[k]
        elif kind == NUMBER:
            yield row, column, "number", struct.unpack_from("<d", data, 6)[0]
        elif kind == RK:
            yield row, column, "number", _rk(struct.unpack_from("<I", data, 6)[0])
        elif kind == MANY_RK:
            for i in range((len(data) - 6) // 6):
                yield row, column + i, "number", _rk(struct.unpack_from("<I", data, 6 + 6 * i)[0])
        elif kind == LABEL:
            yield row, column, "string", _Pieces([data[6:], *pieces[1:]]).text()
        elif kind == BOOLEAN:
            yield row, column, *_flag(data[6], data[7])
        elif data[12:14] != b"\xff\xff":
            yield row, column, "number", struct.unpack_from("<d", data, 6)[0]
        elif data[6] == 0:
            place = row, column  # its text is the next record
        elif data[6] in (1, 2):
            yield row, column, *_flag(data[8], data[6] == 2)


def _flag(value: int, error: bool) -> tuple[str, object]:
    return ("error", ERRORS.get(value, "#ERROR!")) if error else ("bool", bool(value))


def xls_cells(raw: bytes, sheet: str | None = None) -> Iterator[dict]:
    """sheet, row, column (from 0), type and text of every cell that isn't empty of a workbook, or of one sheet.

    Other and encrypted files give none; a damaged sheet ends where it is damaged.  Whole numbers have no decimal point.
    """
    streams = compound_streams(raw)
    stream = next((s for name, s in streams.items() if name.rsplit("/", 1)[-1] == "Workbook"), b"")
    shared: list[str] = []
    sheets: list[tuple[str, int]] = []
    try:
        for kind, pieces in _records(stream):
            if kind == SHEET:
                at, _, form = struct.unpack_from("<IBB", pieces[0])
                if form == 0:  # a sheet of cells
                    sheets.append((_Pieces([pieces[0][6:]]).text(wide_length=False), at))
            elif kind == STRINGS:
                reader = _Pieces(pieces)
                n, = struct.unpack_from("<4xI", reader.take(8))
                shared.extend(reader.text() for _ in range(n))
            elif kind == EOF:
                break
    except (ValueError, IndexError, struct.error):
        pass
    for name, at in sheets:
        if sheet in (None, name):
            try:
                for row, column, kind, value in _cells(stream, at, shared):
                    text = f"{value:.15g}" if kind == "number" else str(value).lower() if kind == "bool" else str(value)
                    kind = ("int" if text.lstrip("-").isdigit() else "float") if kind == "number" else kind
                    yield {"sheet": name, "row": row, "column": column, "type": kind, "text": text}
            except (ValueError, IndexError, struct.error):
                continue
