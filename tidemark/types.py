"""Value types, encodings and compressions, and which go together."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

import pyarrow as pa
from pyspark.sql import types as T

from tidemark.errors import TypeMismatch, Unsupported


class DataType(Enum):
    """Types of measurements, with their Spark types."""

    BOOLEAN = "boolean"
    INT32 = "int"
    INT64 = "bigint"
    FLOAT = "float"
    DOUBLE = "double"
    TEXT = "string"
    TIMESTAMP = "timestamp"  # stored as epoch milliseconds
    DATE = "date"
    BLOB = "binary"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def floating(self) -> bool:
        return self in (DataType.FLOAT, DataType.DOUBLE)

    @classmethod
    def of(cls, kind: T.DataType) -> DataType:
        """The type of a Spark column."""
        for own, spark in _SPARK.items():
            if kind == spark:
                return own
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return cls.TIMESTAMP
        if isinstance(kind, (T.ByteType, T.ShortType)):
            return cls.INT32
        raise Unsupported(f"no measurement type for {kind.simpleString()}")


_SPARK = {
    DataType.BOOLEAN: T.BooleanType(), DataType.INT32: T.IntegerType(), DataType.INT64: T.LongType(), DataType.FLOAT: T.FloatType(),
    DataType.DOUBLE: T.DoubleType(), DataType.TEXT: T.StringType(), DataType.TIMESTAMP: T.LongType(), DataType.DATE: T.DateType(), DataType.BLOB: T.BinaryType(),
}


class Encoding(Enum):
    PLAIN = "PLAIN"
    DICTIONARY = "DICTIONARY"
    RLE = "RLE"
    DELTA_OF_DELTA = "DELTA_OF_DELTA"
    ZIGZAG = "ZIGZAG"
    GORILLA = "GORILLA"
    CHIMP128 = "CHIMP128"
    SIMPLE8B = "SIMPLE8B"
    SPRINTZ = "SPRINTZ"
    QUANTIZED = "QUANTIZED"
    DICTIONARY_RLE = "DICTIONARY_RLE"

    @classmethod
    def parse(cls, name: str) -> Encoding | None:
        """By name or alias, whatever the case; None if unknown."""
        key = name.strip().upper().replace("-", "_").replace(" ", "_")
        return _ALIASES.get(key) or cls.__members__.get(key)

    @classmethod
    def for_type(cls, kind: DataType) -> Encoding:
        return _DEFAULT[kind]

    @classmethod
    def for_import(cls, kind: DataType) -> Encoding:
        """The default for columns that come in as Arrow."""
        return _IMPORT.get(kind, _DEFAULT[kind])

    @property
    def compression(self) -> Compression:
        """What the encoding's bytes compress best with."""
        return Compression.LZ4 if self in (Encoding.CHIMP128, Encoding.GORILLA) else Compression.ZSTD


# Other names of encodings
_ALIASES = {
    "DICT": Encoding.DICTIONARY, "DOD": Encoding.DELTA_OF_DELTA, "DELTAOFDELTA": Encoding.DELTA_OF_DELTA, "CHIMP": Encoding.CHIMP128,
    "SIMPLE_8B": Encoding.SIMPLE8B, "DICT_RLE": Encoding.DICTIONARY_RLE, "DICTIONARYRLE": Encoding.DICTIONARY_RLE, "QUANTISED": Encoding.QUANTIZED,
}
_DEFAULT = {
    DataType.BOOLEAN: Encoding.RLE, DataType.INT32: Encoding.SIMPLE8B, DataType.DATE: Encoding.SIMPLE8B, DataType.INT64: Encoding.SIMPLE8B, DataType.TIMESTAMP: Encoding.DELTA_OF_DELTA,
    DataType.FLOAT: Encoding.CHIMP128, DataType.DOUBLE: Encoding.CHIMP128, DataType.TEXT: Encoding.DICTIONARY, DataType.BLOB: Encoding.PLAIN,
}
_IMPORT = {DataType.INT32: Encoding.DELTA_OF_DELTA, DataType.INT64: Encoding.DELTA_OF_DELTA, DataType.FLOAT: Encoding.GORILLA, DataType.DOUBLE: Encoding.GORILLA}


class Hint(Enum):
    """What a column holds, for choosing its encoding."""

    TIMESTAMP = Encoding.DELTA_OF_DELTA, "timestamp"
    COUNTER = Encoding.DELTA_OF_DELTA, "counter"
    SMALL_DELTAS = Encoding.DELTA_OF_DELTA, "small_deltas"
    FLOAT = Encoding.GORILLA, "float"
    BOOL = Encoding.RLE, "bool"
    REPETITIVE = Encoding.DICTIONARY, "repetitive"
    CATEGORICAL = Encoding.DICTIONARY, "categorical"
    UNIQUE = Encoding.PLAIN, "unique"
    UNKNOWN = Encoding.PLAIN, "unknown"

    @property
    def encoding(self) -> Encoding:
        return self.value[0]


class Compression(Enum):
    """Compressions, with Parquet's names for them."""

    UNCOMPRESSED = "uncompressed"
    SNAPPY = "snappy"
    GZIP = "gzip"
    LZ4 = "lz4_raw"
    ZSTD = "zstd"

    @property
    def parquet(self) -> str:
        return self.value

    @classmethod
    def parse(cls, name: str) -> Compression | None:
        key = name.strip().upper()
        return cls.__members__.get({"NONE": "UNCOMPRESSED", "LZ4_RAW": "LZ4", "GZ": "GZIP", "ZSTANDARD": "ZSTD"}.get(key, key))


class Category(Enum):
    """The role of a table's column."""

    TAG = "tag"
    FIELD = "field"
    TIME = "time"


@dataclass(frozen=True)
class Lit:
    """A typed literal: only compared with columns of its own type."""

    kind: DataType
    value: object

    @classmethod
    def boolean(cls, v: bool) -> Lit:
        return cls(DataType.BOOLEAN, bool(v))

    @classmethod
    def int32(cls, v: int) -> Lit:
        if not -(1 << 31) <= v < 1 << 31:
            raise TypeMismatch(f"{v} is no 32-bit integer")
        return cls(DataType.INT32, int(v))

    @classmethod
    def int64(cls, v: int) -> Lit:
        if not -(1 << 63) <= v < 1 << 63:
            raise TypeMismatch(f"{v} is no 64-bit integer")
        return cls(DataType.INT64, int(v))

    @classmethod
    def float32(cls, v: float) -> Lit:
        return cls(DataType.FLOAT, float(v))

    @classmethod
    def float64(cls, v: float) -> Lit:
        return cls(DataType.DOUBLE, float(v))

    @classmethod
    def text(cls, v: str) -> Lit:
        return cls(DataType.TEXT, str(v))


def from_arrow(kind: pa.DataType) -> DataType:
    """The measurement type of an Arrow column: narrower numbers are promoted."""
    checks = (
        (DataType.BOOLEAN, (pa.types.is_boolean,)),
        (DataType.INT64, (pa.types.is_int64, pa.types.is_uint64)),
        (DataType.INT32, (pa.types.is_int8, pa.types.is_int16, pa.types.is_int32, pa.types.is_uint8, pa.types.is_uint16, pa.types.is_uint32)),
        (DataType.FLOAT, (pa.types.is_float16, pa.types.is_float32)),
        (DataType.DOUBLE, (pa.types.is_float64,)),
        (DataType.INT64, (pa.types.is_timestamp, pa.types.is_date)),
        (DataType.TEXT, (pa.types.is_string, pa.types.is_large_string)),
    )
    for own, tests in checks:
        if any(t(kind) for t in tests):
            return own
    raise Unsupported(f"no measurement type for Arrow's {kind}")


def to_arrow(kind: DataType) -> pa.DataType:
    out = {
        DataType.BOOLEAN: pa.bool_(), DataType.INT32: pa.int32(), DataType.INT64: pa.int64(), DataType.FLOAT: pa.float32(), DataType.DOUBLE: pa.float64(),
        DataType.TEXT: pa.string(), DataType.TIMESTAMP: pa.timestamp("ms"), DataType.DATE: pa.date32(),
    }.get(kind)
    if out is None:
        raise Unsupported(f"{kind.name} has no Arrow form")
    return out
