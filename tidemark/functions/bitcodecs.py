"""Bit-level codecs as Arrow kernels over blocks of a series.

Every codec is a pair of functions, numbers to bytes and back; ``encode_blocks`` and
``decode_blocks`` apply one to each (series, block) group of a table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemark.errors import CodecError


class BitWriter:
    def __init__(self):
        self._acc, self._n, self._out = 0, 0, bytearray()

    def write(self, value: int, width: int) -> None:
        """The low ``width`` bits, highest first."""
        self._acc = self._acc << width | value & (1 << width) - 1
        self._n += width
        if self._n >= 512:
            keep = self._n % 8
            self._out += (self._acc >> keep).to_bytes((self._n - keep) // 8, "big")
            self._acc, self._n = self._acc & (1 << keep) - 1, keep

    def bytes(self) -> bytes:
        pad = -self._n % 8
        return bytes(self._out) + (self._acc << pad).to_bytes((self._n + pad) // 8, "big")


class BitReader:
    def __init__(self, data: bytes):
        self._data, self._at, self._acc, self._n = data, 0, 0, 0

    def read(self, width: int) -> int:
        while self._n < width:
            part = self._data[self._at : self._at + 64]
            if not part:
                raise CodecError("the block ends early")
            self._at += len(part)
            self._acc = self._acc << 8 * len(part) | int.from_bytes(part, "big")
            self._n += 8 * len(part)
        self._n -= width
        out = self._acc >> self._n
        self._acc &= (1 << self._n) - 1
        return out


def _head(n: int) -> bytes:
    return int(n).to_bytes(4, "little")


def _count(data: bytes) -> int:
    if len(data) < 4:
        raise CodecError("the block has no head")
    return int.from_bytes(data[:4], "little")


_AS_BITS = {"f4": np.uint32, "f8": np.uint64, "i4": np.uint32, "i8": np.uint64}


def _bits_of(values: np.ndarray, kind: str) -> tuple[list[int], int]:
    return np.ascontiguousarray(values, kind).view(_AS_BITS[kind]).tolist(), int(kind[1]) * 8


# ---- XOR of neighbours: two public schemes


def gorilla_encode(values: np.ndarray, kind: str = "f8") -> bytes:
    """XOR with the value before: 0 for none, 10 inside the window before, 11 with a new window."""
    bits, width = _bits_of(values, kind)
    lead_bits, size_bits = 5, 6 if width == 64 else 5
    out, before, lead, trail = BitWriter(), 0, -1, 0
    for i, b in enumerate(bits):
        if not i:
            out.write(b, width)
            before = b
            continue
        x, before = b ^ before, b
        if not x:
            out.write(0, 1)
            continue
        l, t = min(width - x.bit_length(), 31), (x & -x).bit_length() - 1
        if lead >= 0 and l >= lead and t >= trail:
            out.write(0b10, 2)
            out.write(x >> trail, width - lead - trail)
        else:
            lead, trail = l, t
            n = width - l - t
            out.write(0b11, 2)
            out.write(l, lead_bits)
            out.write(n - 1, size_bits)
            out.write(x >> t, n)
    return _head(len(bits)) + out.bytes()


def gorilla_decode(data: bytes, kind: str = "f8") -> np.ndarray:
    n, width = _count(data), int(kind[1]) * 8
    size_bits = 6 if width == 64 else 5
    r, out, before, lead, trail = BitReader(data[4:]), [], 0, 0, 0
    for i in range(n):
        if not i:
            before = r.read(width)
        elif r.read(1):
            if r.read(1):
                lead = r.read(5)
                trail = width - lead - (r.read(size_bits) + 1)
            before ^= r.read(width - lead - trail) << trail
        out.append(before)
    return np.array(out, _AS_BITS[kind]).view(kind)


# The leading-zero counts that the scheme's three bits stand for
_LEADS = [0, 8, 12, 16, 18, 20, 22, 24]
_TRAIL_OVER = 6


def chimp_encode(values: np.ndarray, kind: str = "f8") -> bytes:
    """XOR with the value before, in four cases: none; many trailing zeros; leading zeros as before; new ones."""
    bits, width = _bits_of(values, kind)
    out, before, lead = BitWriter(), 0, -1
    for i, b in enumerate(bits):
        if not i:
            out.write(b, width)
            before = b
            continue
        x, before = b ^ before, b
        if not x:
            out.write(0b00, 2)
            lead = -1
            continue
        zeros, t = width - x.bit_length(), (x & -x).bit_length() - 1
        k = max(j for j, v in enumerate(_LEADS) if v <= zeros)
        if t > _TRAIL_OVER:
            n = width - _LEADS[k] - t
            out.write(0b01, 2)
            out.write(k, 3)
            out.write(n, 6 if width == 64 else 5)
            out.write(x >> t, n)
            lead = -1
        elif k == lead:
            out.write(0b10, 2)
            out.write(x, width - _LEADS[k])
        else:
            lead = k
            out.write(0b11, 2)
            out.write(k, 3)
            out.write(x, width - _LEADS[k])
    return _head(len(bits)) + out.bytes()


def chimp_decode(data: bytes, kind: str = "f8") -> np.ndarray:
    n, width = _count(data), int(kind[1]) * 8
    r, out, before, lead = BitReader(data[4:]), [], 0, -1
    for i in range(n):
        if not i:
            before = r.read(width)
            out.append(before)
            continue
        case = r.read(2)
        if case == 0b00:
            lead = -1
        elif case == 0b01:
            k = r.read(3)
            size = r.read(6 if width == 64 else 5)
            before ^= r.read(size) << width - _LEADS[k] - size
            lead = -1
        else:
            if case == 0b11:
                lead = r.read(3)
            before ^= r.read(width - _LEADS[lead])
        out.append(before)
    return np.array(out, _AS_BITS[kind]).view(kind)


# ---- integers in words

# Values in a word and bits of each, by selector
_WORDS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]


def _zigzag(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def _unzigzag(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)


def simple8b_encode(values: np.ndarray, kind: str = "i8") -> bytes:
    """Zigzag numbers, as many as fit in each 64-bit word: 4 bits of selector, 60 of payload."""
    u = _zigzag(values)
    if len(u) and int(u.max()) >= 1 << 60:
        raise CodecError("a value needs more than 60 bits")
    # for each selector, where a word of it may begin: so many numbers of that width, and no wider one, follow
    size, n = _lengths(u), len(u)
    fits = np.full(n + 1, len(_WORDS) - 1)
    for s in range(len(_WORDS) - 1, -1, -1):
        many, width = _WORDS[s]
        if many <= n:
            wide = np.concatenate([[0], np.cumsum(size > width)])
            fits[: n - many + 1][wide[many:] == wide[: n - many + 1]] = s
    begin, at, steps, chosen = [], 0, [m for m, _ in _WORDS], fits.tolist()
    while at < n:
        begin.append(at)
        at += steps[chosen[at]]
    begin = np.array(begin, np.int64)
    selector = fits[begin] if len(begin) else np.zeros(0, np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector).tolist():
        many, width = _WORDS[s]
        if width:
            own = np.flatnonzero(selector == s)
            shift = np.arange(many, dtype=np.uint64) * np.uint64(width)
            words[own] |= np.bitwise_or.reduce(u[begin[own, None] + np.arange(many)] << shift, 1)
    return _head(n) + words.astype("<u8").tobytes()


def simple8b_decode(data: bytes, kind: str = "i8") -> np.ndarray:
    n, parts = _count(data), []
    for word in np.frombuffer(data[4:], "<u8"):
        many, width = _WORDS[int(word >> np.uint64(60))]
        shift = np.arange(many, dtype=np.uint64) * np.uint64(width)
        parts.append((word >> shift if width else np.zeros(many, np.uint64)) & np.uint64((1 << width) - 1))
    u = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if len(u) != n:
        raise CodecError("the block's words hold another number of values")
    return _unzigzag(u).astype(kind)


# ---- blocks of eight with a predictor


class _Fire:
    """A forecast that learns how much of the last difference to repeat."""

    def __init__(self, width: int, shift: int = 2):
        self.width, self.shift, self.acc, self.step = width, shift, 0, 0

    def guess(self, last: int) -> int:
        return last + ((self.acc >> self.shift) * self.step >> self.width)

    def learn(self, last: int, value: int, guess: int) -> None:
        sign = (value > guess) - (value < guess)
        self.acc += sign * self.step
        limit = 1 << self.width + self.shift
        self.acc = max(-limit, min(limit, self.acc))
        self.step = value - last


class _Last:
    def guess(self, last: int) -> int:
        return last

    def learn(self, last: int, value: int, guess: int) -> None:
        pass


def _wrap(x: int, width: int) -> int:
    half = 1 << width - 1
    return (x + half) % (1 << width) - half


def sprintz_encode(values: np.ndarray, kind: str = "i8", predictor: str = "delta") -> bytes:
    """Residuals of a predictor, zigzag, in blocks of eight of the width that the largest needs.

    Floats go by their bits.  All arithmetic is modulo the type's width.
    """
    width = int(kind[1]) * 8
    own = np.ascontiguousarray(values, kind).view(f"i{kind[1]}").tolist()
    model, last, out = (_Fire(width) if predictor == "fire" else _Last()), 0, BitWriter()
    for lo in range(0, len(own), 8):
        codes = []
        for v in own[lo : lo + 8]:
            g = _wrap(model.guess(last), width)
            e = _wrap(v - g, width)
            codes.append(e << 1 if e >= 0 else (-e << 1) - 1)
            model.learn(last, v, g)
            last = v
        size = max(c.bit_length() for c in codes)
        out.write(size, 7)
        for c in codes:
            out.write(c, size)
    return _head(len(own)) + bytes([predictor == "fire"]) + out.bytes()


def sprintz_decode(data: bytes, kind: str = "i8") -> np.ndarray:
    n, width = _count(data), int(kind[1]) * 8
    model, last, out, r = (_Fire(width) if data[4] else _Last()), 0, [], BitReader(data[5:])
    for lo in range(0, n, 8):
        size = r.read(7)
        for _ in range(min(8, n - lo)):
            c = r.read(size) if size else 0
            e = -((c + 1) >> 1) if c & 1 else c >> 1
            g = _wrap(model.guess(last), width)
            v = _wrap(g + e, width)
            model.learn(last, v, g)
            last = v
            out.append(v)
    return np.array(out, f"i{kind[1]}").view(kind)


# ---- Booleans, and values on a grid


def gorilla_bool_encode(values: np.ndarray, kind: str = "b1") -> bytes:
    """The first value, then a bit for each: whether it differs from the one before."""
    v = np.asarray(values, bool)
    return _head(len(v)) + np.packbits(np.concatenate([v[:1], v[1:] ^ v[:-1]])).tobytes()


def gorilla_bool_decode(data: bytes, kind: str = "b1") -> np.ndarray:
    n = _count(data)
    if len(data) != 4 + -(-n // 8):
        raise CodecError("a block of another length")
    return np.bitwise_xor.accumulate(np.unpackbits(np.frombuffer(data, np.uint8, offset=4), count=n)).astype(bool) if n else np.zeros(0, bool)


#: Steps that are tried for a block's grid: powers of ten, and their halves and quarters.
_STEPS = [m * 10.0**-k for k in range(10) for m in (1.0, 0.5, 0.25)]


def quantized_encode(values: np.ndarray, kind: str = "f8", step: float | None = None) -> bytes:
    """Steps above the least value, as differences in words of 60 bits; the head has the least value and the step.

    The step is the largest one tried that gives every value back to the bit, unless one is given.  A
    block that no step gives back raises ``CodecError``: such values want another encoding.
    """
    v = np.ascontiguousarray(values, kind).astype(float)
    low = float(v.min()) if len(v) else 0.0
    for s in [step] if step else _STEPS:
        index = np.round((v - low) / s)
        if not np.all(np.abs(index) < 2.0**52):
            continue
        back = _on_grid(index.astype(np.int64), low, s, kind)
        if np.array_equal(back.view(f"u{kind[1]}"), np.ascontiguousarray(values, kind).view(f"u{kind[1]}")):
            return np.array([low, s], "<f8").tobytes() + simple8b_encode(np.diff(index.astype(np.int64), prepend=0))
    raise CodecError("the values lie on no grid")


def _on_grid(index: np.ndarray, low: float, step: float, kind: str) -> np.ndarray:
    """Grid values, rounded to the decimals that the step has, so that 0.1 and 3 steps of it are as they are written."""
    places = max(0, int(np.ceil(-np.log10(step) - 1e-9))) + 2
    return np.round(low + index * step, places).astype(kind)


def quantized_decode(data: bytes, kind: str = "f8") -> np.ndarray:
    if len(data) < 20:
        raise CodecError("the block has no head")
    low, step = np.frombuffer(data, "<f8", 2).tolist()
    return _on_grid(np.cumsum(simple8b_decode(data[16:])), low, step, kind)


CODECS = {
    "gorilla_bool": (gorilla_bool_encode, gorilla_bool_decode), "quantized": (quantized_encode, quantized_decode),
    "gorilla": (gorilla_encode, gorilla_decode), "chimp": (chimp_encode, chimp_decode), "simple8b": (simple8b_encode, simple8b_decode), "sprintz": (sprintz_encode, sprintz_decode),
    "sprintz_fire": (lambda v, k: sprintz_encode(v, k, "fire"), sprintz_decode),
}
_KINDS = {"float": "f4", "double": "f8", "int": "i4", "bigint": "i8", "boolean": "b1"}
_ONLY = {"simple8b": ("int", "bigint"), "gorilla_bool": ("boolean",), "quantized": ("float", "double")}


def _kind(codec: str, df: DataFrame, value: str) -> str:
    name = df.schema[value].dataType.simpleString()
    if name not in _ONLY.get(codec, ("float", "double", "int", "bigint")):
        raise CodecError(f"{codec} doesn't encode {name}")
    return _KINDS[name]


def encode_blocks(rows: DataFrame, by: list[str], value: str, seq: str, codec: str) -> DataFrame:
    """(by..., points, code): the values of each group, in the order of ``seq``, as one binary.

    ``by`` should name a series and its block, so that a group has a block's points and no more.
    """
    import pyarrow as pa

    kind = _kind(codec, rows, value)
    encode = CODECS[codec][0]
    kinds = [rows.schema[b].dataType.simpleString() for b in by]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(seq)
        own = table.column(value).to_numpy(zero_copy_only=False)
        cols = {b: table.column(b).slice(0, 1) for b in by}
        return pa.table(cols | {"points": pa.array([len(own)], pa.int64()), "code": pa.array([encode(own, kind)], pa.binary())})

    slim = rows.where(rows[value].isNotNull()).select(*by, seq, value)
    return slim.groupBy(*by).applyInArrow(run, ", ".join(f"`{b}` {k}" for b, k in zip(by, kinds)) + ", points long, code binary")


def decode_blocks(blocks: DataFrame, by: list[str], value: str, spark_type: str, codec: str) -> DataFrame:
    """(by..., place, value): the values of each block, with their places from 0."""
    import pyarrow as pa

    kind, decode = _KINDS[spark_type], CODECS[codec][1]
    kinds = [blocks.schema[b].dataType.simpleString() for b in by]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                own = decode(b.column(len(by))[i].as_py(), kind)
                keys = [b.column(j).take(pa.array(np.full(len(own), i))) for j in range(len(by))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(len(own))), pa.array(own)], names=[*by, "place", value])

    return blocks.select(*by, "code").mapInArrow(run, ", ".join(f"`{b}` {k}" for b, k in zip(by, kinds)) + f", place long, `{value}` {spark_type}")


def xor_profile(rows: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """(by..., seq, lead, trail, same): zeros around the XOR of each number's bits with the one before in its group."""
    import pyarrow as pa

    kinds = [rows.schema[b].dataType.simpleString() for b in [*by, seq]]
    kind = _kind("xor", rows, value)
    width = int(kind[1]) * 8

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(seq)
        bits = np.ascontiguousarray(table.column(value).to_numpy(), kind).view(_AS_BITS[kind]).astype(np.uint64)
        x = bits[1:] ^ bits[:-1]
        low = np.where(x == 0, width, np.bitwise_count((x & -x) - np.uint64(1)).astype(np.int64)).astype(np.int32)
        out = {c: table.column(c).slice(1) for c in [*by, seq]}
        return pa.table(out | {"lead": pa.array((width - _lengths(x)).astype(np.int32)), "trail": pa.array(low), "same": pa.array(x == 0)})

    slim = rows.where(rows[value].isNotNull()).select(*by, seq, value)
    return slim.groupBy(*by).applyInArrow(run, ", ".join(f"`{b}` {k}" for b, k in zip([*by, seq], kinds)) + ", lead int, trail int, same boolean")


def _lengths(x: np.ndarray) -> np.ndarray:
    """The number of bits that each number needs; 0 for 0."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return np.bitwise_count(x).astype(np.int64)
