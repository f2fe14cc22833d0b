"""Reproducible pseudo-random draws: a function of seed and row keys, not of partitions."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 32
#: Digests that are computed together, so that their words stay in the processor's cache.
TOGETHER = 1 << 14
#: Bytes of a digest's text that fit into one block of MD5.
ONE_BLOCK = 55


def _digest(seed: int, keys: tuple) -> Column:
    parts = [F.lit(str(seed))] + [
        (k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys
    ]
    return F.md5(F.concat_ws(":", *parts))


def draw(seed: int, *keys) -> Column:
    """Whole number in [0, 2^32) fixed by the seed and the keys."""
    return F.conv(F.substring(_digest(seed, keys), 1, 8), 16, 10).cast("bigint")


def wide_draw(seed: int, *keys) -> Column:
    """Whole number in [0, 2^60) fixed by the seed and the keys, for places in tables of any size."""
    return F.conv(F.substring(_digest(seed, keys), 1, 15), 16, 10).cast("bigint")


def uniform(seed: int, *keys) -> Column:
    """Number in [0, 1) fixed by the seed and the keys."""
    return draw(seed, *keys) / F.lit(float(DRAW_RANGE))


def stem_of_draws(seed: int, *keys) -> Column:
    """What ``draw`` of the same keys and one more, a whole number, makes its digest of, up to the number; for ``draws_along``."""
    return F.concat_ws(":", F.lit(str(seed)), *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys])


def draws_along(stems: list[bytes], counts: np.ndarray) -> np.ndarray:
    """For each stem its draws with the numbers from 0 up to its count, one stem after the other: as ``draw``, many at a time."""
    counts = np.asarray(counts, dtype=np.int64)
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
    size = np.array([len(s) + 1 for s in stems], dtype=np.int64)
    short = size + np.char.str_len(np.maximum(counts - 1, 0).astype(str)) <= ONE_BLOCK if len(stems) else np.zeros(0, bool)
    width = int(size[short].max()) if short.any() else 1
    heads = np.frombuffer(b"".join(((s + b":") if ok else b"").ljust(width, b"\0") for s, ok in zip(stems, short, strict=True)), np.uint8).reshape(-1, width)
    for at in np.flatnonzero(~short):
        first, begun = ends[at] - counts[at], hashlib.md5(stems[at] + b":")
        for i in range(counts[at]):
            whole = begun.copy()
            whole.update(b"%d" % i)
            out[first + i] = int.from_bytes(whole.digest()[:4], "big")
    row = np.repeat(np.flatnonzero(short), counts[short])
    place = np.arange(len(out)) if short.all() else np.flatnonzero(np.repeat(short, counts))
    for first in range(0, len(row), TOGETHER):
        some, to = row[first : first + TOGETHER], place[first : first + TOGETHER]
        out[to] = _heads_of_md5(heads[some], size[some], to - (ends - counts)[some])
    return out


_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [np.uint32(int(abs(np.sin(i + 1.0)) * 2.0**32)) for i in range(64)]
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16, 32)), *((3 * i + 5) % 16 for i in range(32, 48)), *(7 * i % 16 for i in range(48, 64))]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _heads_of_md5(heads: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """First 32 bits of the MD5 digest of each head, ``size`` bytes of it, with its number's digits behind; one block each."""
    n, most = len(numbers), int(numbers.max(initial=0))
    digits = np.ones(n, dtype=np.int64)
    for k in range(1, len(str(most))):
        digits += numbers >= 10**k
    used = -(-(int((size + digits).max()) + 1) // 4)
    text = np.zeros((n, 4 * used), dtype=np.uint8)
    text[:, : heads.shape[1]] = heads[:, : 4 * used]
    every, left = np.arange(n), numbers
    for k in range(len(str(most))):  # from the last digit on
        own = every if k == 0 else np.flatnonzero(digits > k)
        text[own, (size + digits)[own] - 1 - k] = 48 + left[own] % 10
        left = left // 10
    text[every, size + digits] = 0x80
    words: list = [*np.ascontiguousarray(text.view("<u4").T), *[None] * (14 - used), ((size + digits) * 8).astype(np.uint32), None]
    a, b, c, d = (np.full(n, x) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps leave the first word as it is
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        if words[_WORDS[i]] is not None:
            f += words[_WORDS[i]]
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=t)
        f >>= np.uint32(32 - _SHIFTS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + _START[0]).byteswap()
