"""Writing series, and conversion from and to Arrow."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import InvalidState, NotFound, SchemaError
from tidemark.model import MeasurementSchema, Record, Tablet, check_value
from tidemark.operators.stats import aggregates
from tidemark.types import Compression, DataType, Encoding, from_arrow, to_arrow

#: Milliseconds in a unit, or units in a millisecond
_UNITS = {"s": (1000, 1), "ms": (1, 1), "us": (1, 1000), "ns": (1, 1_000_000)}


@dataclass(frozen=True)
class Config:
    """How Arrow data is taken in and files are written."""

    time: str = "timestamp"
    device: str = "device_id"
    compression: Compression = Compression.LZ4
    float_encoding: Encoding = Encoding.GORILLA
    use_hints: bool = True
    files: int | None = None

    @classmethod
    def default(cls) -> Config:
        return cls()

    @classmethod
    def fast(cls) -> Config:
        return cls(compression=Compression.SNAPPY)

    @classmethod
    def balanced(cls) -> Config:
        return cls(compression=Compression.ZSTD, float_encoding=Encoding.CHIMP128)

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


# ---- long and wide


def to_long(wide: DataFrame, measurements: list[str], device: str = "device_id", time: str = "ts", seq: str | None = None) -> DataFrame:
    """(device, time, measurement, value): a row for each value that isn't null.

    All measurements are cast to one type that holds them: text if any is text, else double, long, int or Boolean.
    """
    kinds = {DataType.of(wide.schema[m].dataType) for m in measurements}
    common = common_type(kinds)
    rest = [seq] if seq else []
    cols = [F.struct(F.lit(m).alias("measurement"), F.col(m).cast(common.spark).alias("value")) for m in measurements]
    return wide.select(F.col(device), F.col(time), *rest, F.inline(F.array(*cols))).where("value is not null")


def common_type(kinds: set[DataType]) -> DataType:
    if len(kinds) == 1:
        return next(iter(kinds))
    if DataType.TEXT in kinds:
        return DataType.TEXT
    if kinds & {DataType.FLOAT, DataType.DOUBLE}:
        return DataType.DOUBLE
    return DataType.INT64 if DataType.INT64 in kinds or DataType.TIMESTAMP in kinds else DataType.INT32


def millis(col: str | F.Column, unit: str) -> F.Column:
    """A count of ``unit``s as whole milliseconds, towards the past."""
    times, parts = _UNITS[unit]
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("long") * times if parts == 1 else F.floor(c.cast("long") / F.lit(parts).cast("decimal(10,0)")).cast("long")


# ---- Arrow


def schemas_of(schema: pa.Schema, config: Config = Config()) -> list[MeasurementSchema]:
    """Measurements of an Arrow schema; a field's metadata may name its encoding."""
    out = []
    for f in schema:
        if f.name in (config.time, config.device):
            continue
        kind = from_arrow(f.type)
        hint = (f.metadata or {}).get(b"encoding", b"").decode() if config.use_hints else ""
        encoding = Encoding.parse(hint) if hint else None
        if encoding is None:
            encoding = config.float_encoding if kind.floating else Encoding.for_import(kind)
        out.append(MeasurementSchema(f.name, kind, encoding, config.compression))
    return out


def from_arrow_table(spark: SparkSession, table: pa.Table, config: Config = Config()) -> DataFrame:
    """The wide form of an Arrow table: times as epoch milliseconds, narrower numbers promoted.

    Rows without a device are left out; a null time is 0.  A number that doesn't fit raises.
    """
    for need in (config.time, config.device):
        if need not in table.column_names:
            raise SchemaError(f"the table has no column {need!r}")
    t = table.schema.field(config.time).type
    measurements = schemas_of(table.schema, config)
    if pa.types.is_timestamp(t):
        table = table.set_column(table.column_names.index(config.time), config.time, table.column(config.time).cast(pa.int64()))
        unit = t.unit
    elif pa.types.is_int64(t):
        unit = "ms"
    else:
        raise SchemaError(f"no time: {t}")
    for m in measurements:
        own = table.schema.field(m.name).type
        if pa.types.is_timestamp(own) or pa.types.is_date(own):
            table = table.set_column(table.column_names.index(m.name), m.name, table.column(m.name).cast(pa.timestamp("ms")).cast(pa.int64()))
        elif own != to_arrow(m.kind):
            table = table.set_column(table.column_names.index(m.name), m.name, table.column(m.name).cast(to_arrow(m.kind)))
    df = spark.createDataFrame(table)
    return normalized(df, measurements, unit, config)


def normalized(df: DataFrame, measurements: list[MeasurementSchema], unit: str = "ms", config: Config = Config()) -> DataFrame:
    """The wide form of any DataFrame with a device and a count of ``unit``s as its time."""
    cols = [F.col(m.name).cast(m.kind.spark).alias(m.name, metadata=m.field().metadata) for m in measurements]
    return df.where(F.col(config.device).isNotNull()).select(F.col(config.device).alias("device_id"), F.coalesce(millis(config.time, unit), F.lit(0)).alias("ts"), *cols)


def to_arrow_schema(measurements: list[MeasurementSchema]) -> pa.Schema:
    meta = lambda m: {b"encoding": m.encoding.name.encode()}
    return pa.schema([pa.field("timestamp", pa.timestamp("ms"), False), pa.field("device_id", pa.string(), False), *[pa.field(m.name, to_arrow(m.kind), True, meta(m)) for m in measurements]])


def to_arrow_table(wide: DataFrame, measurements: list[MeasurementSchema]) -> pa.Table:
    """A wide DataFrame that fits the driver, by device and time."""
    for m in measurements:
        if m.name not in wide.columns:
            raise NotFound(f"measurement {m.name!r}")
    rows = wide.select(F.col("ts").alias("timestamp"), F.col("device_id").cast("string"), *[m.name for m in measurements]).orderBy("device_id", "timestamp").toArrow()
    return rows.cast(to_arrow_schema(measurements))


def record_batches(wide: DataFrame, measurements: list[MeasurementSchema], devices: list[str]):
    """One Arrow table for each device, fetched one after another."""
    for d in devices:
        yield to_arrow_table(wide.where(F.col("device_id") == d), measurements)


# ---- writer


@dataclass
class SeriesWriter:
    """Collects records and tablets of registered series, and appends them to one dataset.

    Every flush adds files; nothing that was written before is lost, and ``seq`` goes on after the
    largest one that is stored, so rows of later writers come later.  There is one writer at a time.
    Files are grouped by device and sorted by measurement and time, so that Parquet's statistics prune
    by both; a long series goes on in the next file.  A dataset has ``points``, with a value column for
    each type (all but a row's own are null, and cost nothing in Parquet), and ``series``, the registered
    series with type, encoding and compression.  ``Series.open`` reads it; ``catalog`` lists it.
    """

    spark: SparkSession
    path: str
    config: Config = field(default_factory=Config)
    _series: dict = field(default_factory=dict)
    _tablets: dict = field(default_factory=dict)
    _told: list = field(default_factory=list)
    _seq: int = 0
    closed: bool = False

    def register_timeseries(self, device: str, schema: MeasurementSchema) -> None:
        own = self._series.setdefault(device, {})
        if schema.name in own and own[schema.name].kind is not schema.kind:
            raise SchemaError(f"{device}.{schema.name} is {own[schema.name].kind.name}")
        own[schema.name] = schema

    def register_device(self, device: str, schemas: list[MeasurementSchema]) -> None:
        for s in schemas:
            self.register_timeseries(device, s)

    def has_measurement(self, device: str, measurement: str) -> bool:
        return measurement in self._series.get(device, {})

    def write_record(self, record: Record) -> None:
        if self.closed:
            raise InvalidState("the writer is closed")
        if record.device not in self._series:
            raise SchemaError(f"device {record.device!r} isn't registered")
        own = self._series[record.device]
        unknown = [m for m in record.values if m not in own]
        if unknown:
            raise SchemaError(f"measurement {unknown[0]!r} of {record.device!r} isn't registered")
        checked = [(m, check_value(own[m], v)) for m, v in record.values.items()]
        for m, v in checked:
            if v is not None:
                self._add(record.device, own[m], record.time, v)

    def write_tablet(self, tablet: Tablet) -> None:
        if self.closed:
            raise InvalidState("the writer is closed")
        for s in tablet.schemas:
            self.register_timeseries(tablet.device, s)
        for t, row in zip(tablet.times, tablet.rows):
            for s, v in zip(tablet.schemas, row):
                if v is not None:
                    self._add(tablet.device, s, t, v)

    def _add(self, device: str, schema: MeasurementSchema, time: int, value) -> None:
        self._tablets.setdefault(schema.kind, []).append((device, schema.name, time, value, self._seq))
        self._seq += 1

    def flush(self) -> None:
        """Append what has been collected, and the series that were registered since the last time."""
        rows = [(*row[:3], row[4], *(row[3] if k is kind else None for k in COLUMN)) for kind, own in self._tablets.items() for row in own]
        if rows:
            # seq follows the order of writing, whatever the type
            rows.sort(key=lambda r: r[3])
            after = last_seq(self.spark, f"{self.path}/points")
            points = self.spark.createDataFrame([(*r[:3], after + 1 + n, *r[4:]) for n, r in enumerate(rows)], points_schema())
            append(points, f"{self.path}/points", self.config, [m for own in self._series.values() for m in own.values()])
        new = [(d, m.name, m.kind.name, m.encoding.name, m.compression.name) for d, own in self._series.items() for m in own.values() if (d, m) not in self._told]
        if new:
            self.spark.createDataFrame(new, SERIES).coalesce(1).write.mode("append").parquet(f"{self.path}/series")
            self._told = [*self._told, *((d, m) for d, own in self._series.items() for m in own.values())]
        self._tablets.clear()

    def close(self) -> None:
        self.flush()
        self.closed = True


#: The value column of each type in a writer's dataset
COLUMN = {DataType.BOOLEAN: "boolean", DataType.INT32: "int32", DataType.INT64: "int64", DataType.FLOAT: "float", DataType.DOUBLE: "double", DataType.TEXT: "text", DataType.TIMESTAMP: "timestamp", DataType.DATE: "date", DataType.BLOB: "blob"}
#: Bytes of rows that a file gets when they are sorted for it, and of a row besides its text or blob
FILE_BYTES, ROW_BYTES = 1 << 27, 1 << 7
SERIES = "device_id string, measurement string, kind string, encoding string, compression string"


def points_schema() -> T.StructType:
    own = [T.StructField(c, k.spark) for k, c in COLUMN.items()]
    return T.StructType([T.StructField("device_id", T.StringType()), T.StructField("measurement", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), *own])


def _stored(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p)


def last_seq(spark: SparkSession, path: str) -> int:
    """The largest ``seq`` of a Parquet folder, -1 if there's none: from the files' footers alone."""
    if not _stored(spark, path):
        return -1
    found = spark.read.option("aggregatePushdown", "true").parquet(path).agg(F.max("seq")).first()[0]
    return -1 if found is None else found


def _files(long: DataFrame) -> int:
    """How many files of FILE_BYTES long rows take: ROW_BYTES for each, and the bytes of its text or blob."""
    texts = [c for c, kind in long.dtypes if kind in ("string", "binary") and c not in ("device_id", "measurement")]
    each = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(ROW_BYTES))
    return max(1, math.ceil((long.agg(F.sum(each.cast("long"))).first()[0] or 0) / FILE_BYTES))


def append(long: DataFrame, path: str, config: Config = Config(), schemas: list[MeasurementSchema] = (), follow: bool = False) -> None:
    """Append long rows, grouped by device and sorted, in one shuffle by ranges.

    A file holds about FILE_BYTES of rows, or with ``config.files`` that part of them, so a device of any
    length is in as many files as it takes, one after another in time.  The price is two more looks at
    ``long``: its size is counted and the ranges are found before rows are moved.

    With ``follow``, ``seq`` counts from after the largest one that is stored.  Parquet's own encodings
    follow ``schemas``: a column of which some measurement wants a dictionary or runs gets a dictionary,
    and others the format's second version, which packs differences of whole numbers.
    """
    if follow:
        after = last_seq(long.sparkSession, path)
        long = long.withColumn("seq", F.col("seq") + F.lit(after + 1))
    order = [c for c in ("device_id", "measurement", "ts", "seq") if c in long.columns]
    dealt = long.repartitionByRange(config.files or _files(long), *order)
    out = dealt.sortWithinPartitions("device_id", "measurement", "ts").write.mode("append").option("compression", config.compression.parquet)
    if schemas:
        out = out.option("parquet.writer.version", "v2")
        words = {Encoding.DICTIONARY, Encoding.RLE, Encoding.DICTIONARY_RLE}
        for kind in {m.kind for m in schemas}:
            out = out.option(f"parquet.enable.dictionary#{COLUMN[kind]}", str(any(m.encoding in words for m in schemas if m.kind is kind)).lower())
    out.parquet(path)


def open_points(spark: SparkSession, path: str) -> DataFrame:
    """(device_id, measurement, ts, value, seq) of a writer's dataset, or of any long Parquet folder.

    The value column has the type of the dataset's series, or where they differ one that holds them all
    (text if any is text, else double, long or int): ``open_kind`` reads the series of one type as they are.
    """
    if not _stored(spark, f"{path}/points"):
        return spark.read.parquet(path)
    kinds = {DataType[r.kind] for r in spark.read.parquet(f"{path}/series").select("kind").distinct().collect()}  # a row for each type
    if len(kinds) == 1:
        return open_kind(spark, path, next(iter(kinds)))
    common = common_type(kinds)
    value = F.coalesce(*[F.col(COLUMN[k]).cast(common.spark) for k in COLUMN if k in kinds])
    return spark.read.schema(points_schema()).parquet(f"{path}/points").select("device_id", "measurement", "ts", value.alias("value"), "seq")


def open_kind(spark: SparkSession, path: str, kind: DataType) -> DataFrame:
    """The points of one type of a writer's dataset; filters on all columns reach the files."""
    own = COLUMN[kind]
    return spark.read.schema(points_schema()).parquet(f"{path}/points").where(F.col(own).isNotNull()).select("device_id", "measurement", "ts", F.col(own).alias("value"), "seq")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row for each registered series of a writer's dataset: type, encoding and compression as registered
    last, how many points it has, and its bounds of time; a series without points has 0 and nulls."""
    points = spark.read.schema(points_schema()).parquet(f"{path}/points") if _stored(spark, f"{path}/points") else spark.createDataFrame([], points_schema())
    told = spark.read.parquet(f"{path}/series").withColumn("_at", F.struct(F.col("_metadata.file_modification_time").alias("t"), "encoding", "compression"))
    told = told.groupBy("device_id", "measurement").agg(*[F.max_by(c, "_at").alias(c) for c in ("kind", "encoding", "compression")])
    met = points.groupBy("device_id", "measurement").agg(F.count(F.lit(1)).alias("points"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return told.join(met, ["device_id", "measurement"], "left").withColumn("points", F.coalesce("points", F.lit(0)))


def manifest_of(long: DataFrame) -> DataFrame:
    """Bounds and statistics of each series of a long table."""
    return long.groupBy("device_id", "measurement").agg(*aggregates(DataType.of(long.schema["value"].dataType)))


@dataclass
class WriteOptions:
    """A measurement's encoding and compression, named or chosen from its values."""

    kind: DataType | None = None
    encoding: Encoding = Encoding.GORILLA
    compression: Compression = Compression.ZSTD
    blocks: int = 8

    def data_type(self, kind: DataType) -> WriteOptions:
        return replace(self, kind=kind)

    def with_encoding(self, e: Encoding) -> WriteOptions:
        return replace(self, encoding=e)

    def with_compression(self, c: Compression) -> WriteOptions:
        return replace(self, compression=c)

    def compression_recommended(self) -> WriteOptions:
        return replace(self, compression=self.encoding.compression)

    def analyze_encoding(self, pattern: str) -> WriteOptions:
        """The encoding for a pattern that the analyzer has found."""
        by = {"Quantized": Encoding.QUANTIZED, "HighRepetition": Encoding.DICTIONARY_RLE}
        return replace(self, encoding=by.get(pattern, Encoding.CHIMP128))

    def analyze_and_recommend(self, pattern: str) -> WriteOptions:
        return self.analyze_encoding(pattern).compression_recommended()

    def miniblock_config(self, blocks: int) -> WriteOptions:
        return replace(self, blocks=blocks)

    def build(self, name: str) -> MeasurementSchema:
        if self.kind is None:
            raise InvalidState("a measurement needs a data type")
        return MeasurementSchema(name, self.kind, self.encoding, self.compression, {"blocks": self.blocks})
