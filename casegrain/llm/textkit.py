"""Vectorised word hashing over Arrow string columns, and small helpers all operators share.

Everything works on the UTF-8 bytes of a whole Arrow batch at once: no Python string is made for a
word.  A word is a maximal run of bytes other than space and 0x09-0x0D.  A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: Texts are handled in pieces of about this many bytes, so that the 8-byte work arrays stay small.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _MIX_A
    x ^= x >> U64(27)
    x *= _MIX_B
    x ^= x >> U64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


#: The longest powers so far of each base; those of a longer text than this are not kept.
_KEPT: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_KEPT_LENGTH = 1 << 21


def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """At least 2**bits powers of base and of its inverse mod 2**64."""
    n, inverse = 1 << bits, pow(base, -1, 1 << 64)
    if base in _KEPT and len(_KEPT[base][0]) >= n:
        return _KEPT[base]

    def run(b: int) -> np.ndarray:
        out = np.full(n, U64(b))
        out[0] = 1
        return np.cumprod(out, dtype=U64)

    found = run(base), run(inverse)
    if n <= _KEPT_LENGTH:
        _KEPT[base] = found
    return found


def _range_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of codes[start:end] for each pair, whatever its place (prefix sums of a polynomial mod 2**64)."""
    power, inverse = _powers(base, max(10, int(len(codes)).bit_length()))
    total = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * power[: len(codes)], dtype=U64, out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


class Words:
    """The words of some documents: byte ranges, 64-bit hashes, and pointers of each document into them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        self.data, self.offsets = data, offsets
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        solid = np.zeros(n + 2, dtype=bool)
        solid[1:-1] = ~SPACE[data]
        self.starts = np.flatnonzero(solid[1:-1] & (edge[:-1] | ~solid[:-2]))
        self.ends = np.flatnonzero(solid[1:-1] & (edge[1:] | ~solid[2:])) + 1
        self.pointers = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.pointers)
        self._lower = lower
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            parts = [np.zeros(0, U64)]
            # a word's hash depends on its own bytes only: a long text is met in pieces, a longer word alone
            at = 0
            while at < len(self.starts):
                end = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + CHUNK_BYTES, "right")))
                lo = self.starts[at]
                data = self.data[lo : self.ends[end - 1]]
                codes = _BYTE_CODE[LOWER[data] if self._lower else data]
                parts.append(_range_hash(codes, self.starts[at:end] - lo, self.ends[at:end] - lo, _BYTE_BASE))
                at = end
            self._hashes = np.concatenate(parts)
        return self._hashes

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def within(self) -> np.ndarray:
        """The place of each word in its document."""
        return np.arange(len(self.starts)) - np.repeat(self.pointers[:-1], self.counts)

    def ngrams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; where the document ends sooner, the value means nothing."""
        at = np.arange(len(self.starts))
        return _range_hash(self.hashes, at, np.minimum(at + n, len(at)), _WORD_BASE)

    def spans(self, starts: np.ndarray, ends: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
        """Hash of the words start..end for each pair; an odd base of another value gives a hash of its own."""
        return _range_hash(self.hashes, starts, ends, base)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of whole texts of about `size` bytes (more where one text is longer): first row, end row, bytes, offsets."""
    data, offsets = buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_chunks(texts: pa.Array, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    for row, end, data, offsets in chunks(texts, size):
        yield row, end, Words(data, offsets, lower)


def ids(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """int64 values (0 for null) and a mask of the nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.int64())
    null = np.asarray(column.is_null())
    return np.asarray(column.cast(pa.int64()).fill_null(0)), null


def distinct_shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct n-word shingles (a shorter text: the whole as one): hashes sorted within the document, pointers."""
    return weighed_shingles(words, n)[:2]


def weighed_shingles(words: Words, n: int, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As distinct_shingles, and for each shingle the sum of its words' levels (an integer for each word; 0 without)."""
    doc, within = words.doc, words.within
    grams = words.ngrams(n)
    room = np.repeat(words.counts, words.counts) - within >= n
    total = np.zeros(len(doc) + 1, np.int64)
    if levels is not None:
        np.cumsum(levels, out=total[1:])
    weight = (total[n:] - total[:-n])[room[: max(0, len(doc) + 1 - n)]]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    h = grams[room]
    d = doc[room]
    if len(short):
        h = np.concatenate([h, words.spans(words.pointers[short], words.pointers[short + 1])])
        d = np.concatenate([d, short])
        weight = np.concatenate([weight, total[words.pointers[short + 1]] - total[words.pointers[short]]])
    order = np.lexsort((h, d))
    h, d, weight = h[order], d[order], weight[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(len(words.counts) + 1)), weight[keep]


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each start and length, one after the other."""
    if not len(starts):
        return np.zeros(0, np.int64)
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
