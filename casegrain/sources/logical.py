"""Entries of logical evidence containers: AD1 (a linked tree over segments) and L01 (a tree as text in a section).

Both yield entry (path), size, is_dir, modified and md5, each folder before what is in it.  Damaged places end the branch
they stand in, and an item that is met again is not followed, so a container never makes the listing fail or go on for ever.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa

# Fixed values of AD1: signatures, the margin before the first address, places in the heads, an item and its metadata.
AD1_FILE, AD1_LOGICAL, MARGIN, FRAGMENT = b"ADSEGMENTEDFILE\x00", b"ADLOGICALIMAGE\x00\x00", 512, 65536
SEGMENT_INDEX, FRAGMENTS, FIRST_ITEM = 0x18, 0x22, 0x224
ITEM, DETAIL = "<QQQQQII", "<QIII"
FOLDER = 5
MD5, MODIFIED = (1, 0x5001), (5, 8)
# The longest name and value that are read of an item.
LONGEST_NAME, LONGEST_VALUE = 65536, 4096

# Fixed values of L01: its signature, the head of the tree's section, the tree's part with the files.
L01_FILE = b"LVF\x09\x0d\x0a\xff\x00"
TREE_HEAD, TREE_PART = 48, "entry"


class _Addresses:
    """The address space of AD1 segments: what follows the margin of each, one after the other."""

    def __init__(self, files: list[pa.NativeFile]):
        heads = [(f.read_at(64, 0), f) for f in files]
        found = sorted(((struct.unpack_from("<I", h, SEGMENT_INDEX)[0], f) for h, f in heads if h[:16] == AD1_FILE and len(h) == 64), key=lambda x: x[0])
        self.files = [f for _, f in found]
        self.step = struct.unpack_from("<I", self.files[0].read_at(4, FRAGMENTS))[0] * FRAGMENT - MARGIN if found else 0
        self.logical = bool(found) and self.step > 0 and self.files[0].read_at(16, MARGIN) == AD1_LOGICAL

    def read(self, at: int, n: int) -> bytes:
        out = b""
        while n > 0:
            k, place = divmod(at, self.step)
            if k >= len(self.files):
                break
            here = min(n, self.step - place)
            piece = self.files[k].read_at(here, place + MARGIN)
            out += piece
            if len(piece) < here:
                break
            at, n = at + here, n - here
        return out


def ad1_entries(files: list[pa.NativeFile]) -> Iterator[dict]:
    """Entries of the segments of one AD1 container; none where the first segment or its signatures are missing."""
    space = _Addresses(files)
    if not space.logical:
        return
    first, = struct.unpack("<Q", space.files[0].read_at(8, FIRST_ITEM))
    head, todo, seen = struct.calcsize(ITEM), [("", first)], set()
    while todo:
        parent, at = todo.pop()
        raw = space.read(at, head) if at and at not in seen else b""
        if len(raw) < head:
            continue
        seen.add(at)
        follows, child, detail, _, size, kind, length = struct.unpack(ITEM, raw)
        name = space.read(at + head, min(length, LONGEST_NAME)).decode("utf-8", "replace").strip("\x00")
        path, values = f"{parent}/{name}", _details(space, detail)
        yield {"entry": path, "size": 0 if kind == FOLDER else size, "is_dir": kind == FOLDER, "modified": _moment(values.get(MODIFIED)), "md5": values.get(MD5)}
        todo += [(parent, follows), (path, child)]  # what is inside comes first


def _details(space: _Addresses, at: int) -> dict[tuple[int, int], str]:
    found, seen, head = {}, set(), struct.calcsize(DETAIL)
    while at and at not in seen:
        seen.add(at)
        raw = space.read(at, head)
        if len(raw) < head:
            break
        follows, category, key, length = struct.unpack(DETAIL, raw)
        if (category, key) in (MD5, MODIFIED):
            found[category, key] = space.read(at + head, min(length, LONGEST_VALUE)).decode("utf-8", "replace").strip("\x00 ")
        at = follows
    return found


def _moment(text: str | None) -> datetime | None:
    for form in ("%Y%m%dT%H%M%S.%f", "%Y%m%dT%H%M%S"):
        try:
            return datetime.strptime(text or "", form)
        except ValueError:
            pass
    return None


def l01_entries(files: list[pa.NativeFile], sections: Callable) -> Iterator[dict]:
    """Entries of the segments of one L01 container: lines of tab-separated names and values, as deep as their leading tabs."""
    for file in files:
        if file.read_at(8, 0) != L01_FILE:
            continue
        for kind, at, size, _ in sections(file):
            if kind == "ltree":
                yield from _tree(file.read_at(size, at)[TREE_HEAD:])
                return


def _tree(raw: bytes) -> Iterator[dict]:
    try:
        raw = zlib.decompress(raw)
    except zlib.error:  # stored as it is
        pass
    inside, folders = False, []
    for line in raw.decode("utf-16-le", "replace").lstrip("﻿").replace("\r", "").split("\n"):
        body = line.lstrip("\t")
        depth = len(line) - len(body)
        if not depth:
            inside = body == TREE_PART
            continue
        if not inside:
            continue
        cells = body.split("\t")
        values = dict(zip(cells[::2], cells[1::2], strict=False))
        if "n" not in values:
            continue
        folder = values.get("cid") == "1" or values.get("p") == "1"
        folders = folders[: depth - 1]
        path = "".join(f"/{x}" for x in (*folders, values["n"]))
        folders += [""] * (depth - 1 - len(folders)) + [values["n"]]
        yield {"entry": path, "size": 0 if folder else _whole(values.get("ls")) or 0, "is_dir": folder, "modified": _second(values.get("wr")), "md5": values.get("ha") or None}


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def _second(text: str | None) -> datetime | None:
    try:
        return datetime.fromtimestamp(n, UTC).replace(tzinfo=None) if (n := _whole(text)) else None
    except (ValueError, OverflowError, OSError):
        return None
