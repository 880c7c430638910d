"""Words of whole Arrow batches of text, found and hashed with numpy over the UTF-8 bytes.

A word is a longest run of bytes that are no separators; ASCII letters count as lower case.  A
word's 64-bit hash is a sum over its bytes of a random number for the byte times a power for its
place, mixed with its length, so it doesn't depend on where the word stands.

What is held for a text beside its bytes is 5 bytes a byte of marks and lower-cased copies, 24 for
each word, and a bounded block of hashing; the batch is looked at ``CHUNK`` bytes at a time, or one
longer text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(0x5EED)
_TABLE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTES = _LOWER.tobytes()

#: Words between ASCII white space.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Words of ASCII letters and digits and everything beyond ASCII.
MARKS = np.zeros(256, bool)
MARKS[:0x80] = True
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

#: Bytes looked at together; a longer document is looked at alone.
CHUNK = 1 << 20
#: Bytes hashed together, at most: what is held for them stays in a core's cache.
NEAR = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of each ordered pair."""
    return mix(a * _U(0xD6E8FEB86659FD93) + mix(b))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 4096), _BASE, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p)
    return _powers


@dataclass
class Words:
    """Words of documents ``lo`` to ``hi`` - 1 of a batch, in order."""

    lo: int
    hi: int
    data: np.ndarray  # lower-cased bytes
    start: np.ndarray  # of each word in data
    end: np.ndarray
    hash: np.ndarray  # uint64
    first: np.ndarray  # of each document, the index of its first word; and one more at the end


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string or binary column; null as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def groups(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of documents of ``most`` bytes together, or of one longer document."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def scan(column, separators: np.ndarray = BLANKS, most: int = CHUNK) -> Iterator[Words]:
    """The words of each document of a string column."""
    off, raw = buffers(column)
    for lo, hi in groups(off, most):
        yield words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], separators, lo, hi)


def words(raw: np.ndarray, off: np.ndarray, separators: np.ndarray, lo: int = 0, hi: int | None = None) -> Words:
    hi = lo + len(off) - 1 if hi is None else hi
    n, given = len(raw), raw.tobytes()
    data = np.frombuffer(given.translate(_LOWER_BYTES), np.uint8)
    if not n:
        e = np.zeros(0, np.int64)
        return Words(lo, hi, data, e, e, np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64))
    apart = np.frombuffer(given.translate(separators.tobytes()), bool)
    del given
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, apart[:-1]
    after[-1], after[:-1] = True, apart[1:]
    inner = off[(off > 0) & (off < n)]
    before[inner] = True
    after[inner - 1] = True
    inside = ~apart
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    h = _hashes(data, start, end)
    return Words(lo, hi, data, start, end, h, np.searchsorted(start, off, "left"))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The words' hashes, ``NEAR`` bytes at a time: what is held grows with the words, not their bytes."""
    total = np.zeros(len(start), np.uint64)
    step = min(CHUNK, NEAR)
    lo = 0
    while lo < len(start):
        at = int(start[lo])
        hi = int(np.searchsorted(end, at + step, "right"))
        if hi <= lo:  # one word of more than a step
            factor = _U(1)
            for at in range(at, int(end[lo]), step):
                own = data[at : min(at + step, int(end[lo]))]
                with np.errstate(over="ignore"):
                    total[lo] += factor * (_TABLE[own] * powers(step + 1)[: len(own)]).sum(dtype=np.uint64)
                    factor *= powers(step + 1)[step]
            lo += 1
            continue
        begin, stop = (start[lo:hi] - at).astype(np.int32), (end[lo:hi] - at).astype(np.int32)
        size = int(stop[-1])
        # a byte's place in its word; bytes between words have some place too, and are left out of the sums
        place = np.arange(size, dtype=np.int32)
        place -= np.repeat(begin, np.diff(begin, append=np.int32(size)))
        sums = np.zeros(size + 1, np.uint64)
        part = _TABLE.take(data[at : at + size])
        part *= powers(int((stop - begin).max()) + 1).take(place, mode="clip")
        np.cumsum(part, out=sums[1:])
        total[lo:hi] = sums[stop] - sums[begin]
        lo = hi
    return mix(total + (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407))


def hash_words(items: list[bytes]) -> np.ndarray:
    """The hashes of given words, each a bytes value without separators; "" gives 0."""
    out = np.zeros(len(items), np.uint64)
    full = [i for i, x in enumerate(items) if x]
    if full:
        raw = np.frombuffer(b"".join(items[i] for i in full), np.uint8)
        off = np.cumsum([0] + [len(items[i]) for i in full])
        out[full] = words(raw, off, np.zeros(256, bool)).hash
    return out
