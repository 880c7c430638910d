"""Schemas, tablets and records: what goes in, checked before it becomes a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.errors import InvalidState, NotFound, SchemaError, TypeMismatch
from tidemark.types import Category, Compression, DataType, Encoding


@dataclass(frozen=True)
class MeasurementSchema:
    name: str
    kind: DataType
    encoding: Encoding | None = None
    compression: Compression = Compression.ZSTD
    props: dict = field(default_factory=dict)
    category: Category = Category.FIELD

    def __post_init__(self):
        if self.encoding is None:
            object.__setattr__(self, "encoding", Encoding.for_type(self.kind))

    def field(self) -> T.StructField:
        """A nullable Spark field; encoding, compression, category and properties are its metadata."""
        meta = {"encoding": self.encoding.name, "compression": self.compression.name, "category": self.category.value, **self.props}
        return T.StructField(self.name, self.kind.spark, True, meta)

    @classmethod
    def of(cls, f: T.StructField) -> MeasurementSchema:
        meta = dict(f.metadata or {})
        encoding = Encoding.parse(str(meta.pop("encoding", ""))) if "encoding" in meta else None
        compression = Compression.parse(str(meta.pop("compression", "ZSTD"))) or Compression.ZSTD
        category = Category(meta.pop("category", "field"))
        return cls(f.name, DataType.of(f.dataType), encoding, compression, meta, category)


class TableSchema:
    """Columns that are tags, fields or the time, with look-up by name."""

    def __init__(self, name: str, columns: list[MeasurementSchema]):
        self.name, self.columns = name, list(columns)
        self._place = {c.name: i for i, c in enumerate(self.columns)}
        if len(self._place) != len(self.columns):
            raise SchemaError("two columns have one name")

    def validate(self) -> None:
        if not self.names(Category.FIELD):
            raise SchemaError("a table needs a field")

    def names(self, category: Category) -> list[str]:
        return [c.name for c in self.columns if c.category is category]

    def sorted_names(self, category: Category) -> list[str]:
        return sorted(self.names(category))

    def index(self, name: str) -> int:
        if name not in self._place:
            raise NotFound(f"column {name!r}")
        return self._place[name]

    def column(self, name: str) -> MeasurementSchema:
        return self.columns[self.index(name)]

    def struct(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    @classmethod
    def of(cls, name: str, struct: T.StructType) -> TableSchema:
        return cls(name, [MeasurementSchema.of(f) for f in struct])

    def project(self, df: DataFrame, *categories: Category) -> DataFrame:
        """The columns of some categories only: others aren't read."""
        return df.select(*[c.name for c in self.columns if c.category in categories])


# What Python values a type takes
_PYTHON = {
    DataType.BOOLEAN: (bool,), DataType.INT32: (int,), DataType.INT64: (int,), DataType.TIMESTAMP: (int,), DataType.FLOAT: (float, int), DataType.DOUBLE: (float, int),
    DataType.TEXT: (str,), DataType.DATE: (date,),
}
_RANGE = {DataType.INT32: 31, DataType.INT64: 63, DataType.TIMESTAMP: 63}


def check_value(schema: MeasurementSchema, v):
    """The value, or TypeMismatch; None is no value."""
    if v is None:
        return None
    kinds = _PYTHON.get(schema.kind)
    bad = kinds is None or not isinstance(v, kinds) or (isinstance(v, bool) and schema.kind is not DataType.BOOLEAN)
    if bad or (schema.kind in _RANGE and not -(1 << _RANGE[schema.kind]) <= v < 1 << _RANGE[schema.kind]):
        raise TypeMismatch(f"{schema.name} takes {schema.kind.name}, not {v!r}")
    return float(v) if schema.kind.floating else v


class Tablet:
    """A batch of rows of one device: times, and a nullable column for each measurement.

    ``aligned`` tablets take strictly increasing times only.  A row is checked whole before any of it
    is added.
    """

    def __init__(self, device: str, schemas: list[MeasurementSchema], max_rows: int = 1024, aligned: bool = False):
        if max_rows < 1:
            raise InvalidState("a tablet holds a row at least")
        self.device, self.schemas, self.max_rows, self.aligned = device, list(schemas), max_rows, aligned
        self.times: list[int] = []
        self.rows: list[tuple] = []

    def __len__(self) -> int:
        return len(self.rows)

    @property
    def full(self) -> bool:
        return len(self.rows) >= self.max_rows

    def add_row(self, time: int, values: list) -> None:
        self.add_rows([time], [values])

    def add_rows(self, times: list[int], rows: list[list]) -> None:
        """All of them, or none."""
        if len(times) != len(rows):
            raise InvalidState("times and rows differ in number")
        if len(self.rows) + len(rows) > self.max_rows:
            raise InvalidState(f"the tablet holds {self.max_rows} rows")
        last = self.times[-1] if self.times else None
        checked = []
        for t, values in zip(times, rows):
            if len(values) != len(self.schemas):
                raise InvalidState(f"{len(values)} values for {len(self.schemas)} measurements")
            if self.aligned and last is not None and t <= last:
                raise InvalidState(f"time {t} doesn't come after {last}")
            last = t
            checked.append(tuple(check_value(s, v) for s, v in zip(self.schemas, values)))
        self.times += times
        self.rows += checked

    def clear(self) -> None:
        self.times, self.rows = [], []

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The wide form: device_id, ts, a column for each measurement."""
        struct = T.StructType([T.StructField("device_id", T.StringType(), False), T.StructField("ts", T.LongType(), False), *[s.field() for s in self.schemas]])
        return spark.createDataFrame([(self.device, t, *r) for t, r in zip(self.times, self.rows)], struct)


@dataclass
class Record:
    """A time and a device with some values by measurement; None is no value."""

    time: int
    device: str
    values: dict = field(default_factory=dict)

    def add(self, measurement: str, value) -> Record:
        self.values[measurement] = value
        return self
