"""BLAKE3 of many values at once: numpy runs each step over the 1,024-byte chunks of all values together."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Fixed values of the published algorithm.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK, BLOCK, ROUNDS = 1024, 64, 7
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8

_IV = np.array(IV, np.uint32)[:, None]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _mix(a, b, c, d, x, y):
    a = a + b + x
    d = _turned(d ^ a, 16)
    c = c + d
    b = _turned(b ^ c, 12)
    a = a + b + y
    d = _turned(d ^ a, 8)
    c = c + d
    return a, _turned(b ^ c, 7), c, d


def _compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """chain (8, n) and words (16, n) of n blocks; the new chain."""
    n = chain.shape[1]
    a, b, c = chain[:4], chain[4:], np.repeat(_IV[:4], n, axis=1)
    d = np.stack([counter & 0xFFFFFFFF, counter >> 32, length, flags]).astype(np.uint32)
    for turn in range(ROUNDS):
        if turn:
            words = words[list(ORDER)]
        a, b, c, d = _mix(a, b, c, d, words[0:8:2], words[1:8:2])
        b, c, d = np.roll(b, -1, axis=0), np.roll(c, -2, axis=0), np.roll(d, -3, axis=0)
        a, b, c, d = _mix(a, b, c, d, words[8:16:2], words[9:16:2])
        b, c, d = np.roll(b, 1, axis=0), np.roll(c, 2, axis=0), np.roll(d, 3, axis=0)
    return np.concatenate([a ^ c, b ^ d])


def digests(values: Sequence[bytes]) -> list[str]:
    """Lower-case hex digests of 32 bytes.  What is held at once is the values again, padded to whole chunks."""
    if not len(values):
        return []
    size = np.array([len(v) for v in values], np.int64)
    count = np.maximum(1, -(-size // CHUNK))
    base = np.cumsum(count) - count
    data = np.zeros(int(count.sum()) * CHUNK, np.uint8)
    for at, value in zip(base * CHUNK, values, strict=True):
        data[at : at + len(value)] = np.frombuffer(value, np.uint8)
    words = data.view("<u4").reshape(-1, CHUNK // BLOCK, 16)
    own = np.repeat(np.arange(len(values)), count)
    counter = np.arange(len(own)) - base[own]
    left = np.clip(size[own] - counter * CHUNK, 0, CHUNK)
    blocks = np.maximum(1, -(-left // BLOCK))
    chain = np.repeat(_IV, len(own), axis=1)
    for b in range(int(blocks.max())):
        at = np.flatnonzero(blocks > b)
        last = blocks[at] == b + 1
        flags = CHUNK_START * (b == 0) + CHUNK_END * last + ROOT * (last & (count[own[at]] == 1))
        chain[:, at] = _compress(chain[:, at], words[at, b].T, counter[at], np.clip(left[at] - b * BLOCK, 0, BLOCK), flags)
    while count.max() > 1:  # neighbours meet; an odd last one goes up as it is
        base, place = np.cumsum(count) - count, np.arange(len(own))
        place = place - base[own]
        first = np.flatnonzero((place % 2 == 0) & (place + 1 < count[own]))
        flags = PARENT + ROOT * (count[own[first]] == 2)
        zero = np.zeros(len(first), np.int64)
        met = _compress(np.repeat(_IV, len(first), axis=1), np.concatenate([chain[:, first], chain[:, first + 1]]), zero, zero + BLOCK, flags)
        chain[:, first] = met
        kept = place % 2 == 0
        chain, own, count = chain[:, kept], own[kept], -(-count // 2)
    return [row.tobytes().hex() for row in np.ascontiguousarray(chain.T).astype("<u4")]
