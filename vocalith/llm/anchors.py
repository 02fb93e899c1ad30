"""Anchors of byte strings: the smallest hash of the K-byte strings inside each window of SPAN bytes.

Equal windows have equal anchors wherever they stand, so all places of a repeated SPAN-byte string meet under its
anchor.  Consecutive windows with one anchor form a run; a text has a run every dozen bytes or so.
"""

from __future__ import annotations

import numpy as np

SPAN = 50
K = 16
#: Bytes that are hashed at a time, and the longest run.
CHUNK = 1 << 20
LONGEST = 1 << 12
#: Odd multipliers of the hash, from its first two and last roundings of the golden ratio.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-byte strings of a byte array."""
    n = len(data) - K + 1
    eight = np.empty(len(data) - 7, np.uint64)
    for i in range(8):
        part = data[i : i + (len(data) - i) // 8 * 8].view("<u8")
        eight[i::8] = part[: len(eight[i::8])]
    h = eight[:n] * _M1
    h ^= h >> np.uint64(29)
    h += eight[K - 8 :]
    h *= _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    h ^= h >> np.uint64(29)
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    m, reach = h, 1
    while 2 * reach <= width:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def spread(minima: np.ndarray) -> np.ndarray:
    """Minima are small numbers; a bijection spreads them over all of the range, and so over all buckets."""
    a = minima * _M2
    a ^= a >> np.uint64(32)
    return a * _M1


def runs(texts: list[bytes]):
    """(text, start, count, anchor) arrays: `count` windows from byte `start` of a text share the anchor."""
    out = [[], [], [], []]
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop])
            stop += 1
        for o, x in zip(out, _chunk(texts[at:stop], at), strict=True):
            o.append(x)
        at = stop
    kinds = (np.int32, np.int64, np.int32, np.uint64)
    return tuple(np.concatenate([np.zeros(0, k), *x]).astype(k, copy=False) for x, k in zip(out, kinds, strict=True))


def _chunk(texts: list[bytes], first: int):
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    if n.sum() < SPAN:
        return [np.zeros(0, np.int64)] * 4
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(n)
    m = window_minima(hashes(data), SPAN - K + 1)
    windows = np.maximum(n - SPAN + 1, 0)
    inside = np.zeros(len(m) + 1, np.int8)  # windows that end within their text
    has = windows > 0
    np.add.at(inside, (ends - n)[has], 1)
    np.add.at(inside, (ends - n + windows)[has], -1)
    valid = np.cumsum(inside[:-1]).astype(bool)
    new = valid.copy()
    new[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
    new[(ends - n)[has]] = True
    begin = np.flatnonzero(new)
    owner = np.searchsorted(ends, begin, side="right")
    stop = np.minimum(np.append(begin[1:], len(m)), (ends - n + windows)[owner])
    count = stop - begin
    if (count > LONGEST).any():
        parts = -(-count // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, owner, left = np.repeat(begin, parts) + nth * LONGEST, np.repeat(owner, parts), np.repeat(count, parts) - nth * LONGEST
        count = np.minimum(left, LONGEST)
    return owner + first, begin - (ends - n)[owner], count, spread(m[begin])
