"""Series of points, and the fluent scan over them.

A dataset is a long table: device, measurement, time, value, and a sequence number that keeps the
order in which points were written.  Points without a value aren't stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidState, NotFound
from tidemark.operators import predicates as P
from tidemark.operators import split
from tidemark.types import DataType


@dataclass(frozen=True)
class Series:
    """A long table and the names of its columns."""

    df: DataFrame
    device: str = "device_id"
    measurement: str = "measurement"
    time: str = "ts"
    value: str = "value"
    seq: str = "seq"

    @classmethod
    def open(cls, spark, path: str, **names: str) -> Series:
        """A dataset that a SeriesWriter has written, or any Parquet folder of the long layout."""
        from tidemark.sources.series import open_points

        return cls(open_points(spark, path), **names)

    @staticmethod
    def file_size(spark, path: str) -> int:
        """Bytes of a dataset's files, from the store's listing: no file is read."""
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
        return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    def cached(self) -> Series:
        """The same series, kept in memory and on disk from its first use on."""
        return replace(self, df=self.df.persist())

    def clear_cache(self) -> None:
        self.df.unpersist()

    @property
    def kind(self) -> DataType:
        return DataType.of(self.df.schema[self.value].dataType)

    @property
    def points(self) -> DataFrame:
        return self.df.where(F.col(self.value).isNotNull())

    # ---- what there is

    def devices(self) -> DataFrame:
        return self.df.select(self.device).distinct()

    def measurements(self, device) -> DataFrame:
        """The device's measurements; no row if it is unknown."""
        return self.df.where(F.col(self.device) == device).select(self.measurement).distinct()

    def info(self) -> DataFrame:
        """One row: devices, series, points, first and last time."""
        return self.df.agg(
            F.countDistinct(self.device).alias("devices"),
            F.countDistinct(self.device, self.measurement).alias("series"),
            F.count(self.value).alias("points"),
            F.min(self.time).alias("start"),
            F.max(self.time).alias("end"),
        )

    def catalog(self) -> DataFrame:
        """A row for each series: its number of points and its bounds of time."""
        return self.points.groupBy(self.device, self.measurement).agg(F.count(F.lit(1)).alias("points"), F.min(self.time).alias("start"), F.max(self.time).alias("end"))

    # ---- points of one series

    def _where(self, device, measurement) -> DataFrame:
        return self.points.where((F.col(self.device) == device) & (F.col(self.measurement) == measurement))

    def check(self, device, measurement) -> None:
        """Raise NotFound unless the series exists: a look at one row."""
        if self.df.where(F.col(self.device) == device).isEmpty():
            raise NotFound(f"device {device!r}")
        if self.df.where((F.col(self.device) == device) & (F.col(self.measurement) == measurement)).isEmpty():
            raise NotFound(f"measurement {measurement!r} of device {device!r}")

    def read(self, device, measurement, check: bool = False) -> DataFrame:
        if check:
            self.check(device, measurement)
        return self._where(device, measurement)

    def read_time_range(self, device, measurement, low, high) -> DataFrame:
        """Both ends are inclusive; an inverted range is empty."""
        return self._where(device, measurement).where(F.col(self.time).between(low, high))

    def count(self, device, measurement) -> DataFrame:
        return self._where(device, measurement).agg(F.count(F.lit(1)).alias("points"))

    def get(self, device, measurement, index: int) -> DataFrame:
        """The point at a place in the order of writing, from 0; no row beyond the end."""
        ranked = split.placed(self._where(device, measurement), [self.device, self.measurement], self.seq, "_n")
        return ranked.where(F.col("_n") == index).drop("_n")

    def iterate(self, device, measurement) -> Iterator[tuple]:
        """(time, value) in the order of writing, fetched partition by partition."""
        for r in self._where(device, measurement).orderBy(self.seq).select(self.time, self.value).toLocalIterator():
            yield r[0], r[1]

    # ---- whole devices

    def read_device(self, device) -> DataFrame:
        return self.points.where(F.col(self.device) == device)

    def wide(self, measurements: list[str], device=None) -> DataFrame:
        """A row for each device and time, a column for each measurement, null where there's no point.

        Of several points at a time, the one written last counts.
        """
        rows = self.points if device is None else self.read_device(device)
        last = [F.max_by(F.when(F.col(self.measurement) == m, F.col(self.value)), F.when(F.col(self.measurement) == m, F.col(self.seq))).alias(m) for m in measurements]
        return rows.where(F.col(self.measurement).isin(*measurements)).groupBy(self.device, self.time).agg(*last)

    def align(self, measurements: list[str], how: str = "outer", device=None) -> DataFrame:
        """``wide`` with all times ("outer") or those that all measurements have ("inner")."""
        out = self.wide(measurements, device)
        return out if how == "outer" else out.where(" AND ".join(f"`{m}` IS NOT NULL" for m in measurements))

    # ---- scans

    def scan(self) -> ScanBuilder:
        return ScanBuilder(self)

    def query(self) -> QueryNoDevice:
        return QueryNoDevice(self)


@dataclass
class ScanBuilder:
    """Collects a device, a measurement and predicates, and gives one filtered DataFrame."""

    series: Series
    _device: object = None
    _measurement: str | None = None
    _parts: list = field(default_factory=list)

    def device(self, d) -> ScanBuilder:
        self._device = d
        return self

    def measurement(self, m: str) -> ScanBuilder:
        self._measurement = m
        return self

    def time_range(self, low, high) -> ScanBuilder:
        self._parts.append(P.time_range(low, high))
        return self

    def where_value(self, op: str, arg=None) -> ScanBuilder:
        if self._measurement is None:
            raise InvalidState("where_value needs a measurement first")
        self._parts.append(P.Value(self._measurement, op, arg))
        return self

    def where_predicate(self, p) -> ScanBuilder:
        self._parts.append(p)
        return self

    def predicate(self):
        return P.And(list(self._parts)).simplify()

    def condition(self) -> Column:
        s = self.series
        return P.condition(self.predicate(), F.col(s.time), {self._measurement: (F.col(s.value), s.kind)})

    def execute(self, check: bool = False) -> DataFrame:
        if self._device is None:
            raise InvalidState("a scan needs a device")
        if self._measurement is None:
            raise InvalidState("a scan needs a measurement")
        rows = self.series.read(self._device, self._measurement, check)
        return rows.where(self.condition()) if self._parts else rows


@dataclass(frozen=True)
class QueryNoDevice:
    """A query before its device is named: only that can follow."""

    series: Series

    def device(self, d) -> QueryDevice:
        return QueryDevice(self.series, d)


@dataclass(frozen=True)
class QueryDevice:
    series: Series
    _device: object

    def measurement(self, m: str) -> QueryMeasurement:
        return QueryMeasurement(self.series, self._device, m)

    def execute_batch(self, measurements: list[str]) -> DataFrame:
        """All of the device's measurements, side by side."""
        return self.series.wide(measurements, self._device)


@dataclass(frozen=True)
class QueryMeasurement:
    series: Series
    _device: object
    _measurement: str

    def execute(self) -> DataFrame:
        return self.series.read(self._device, self._measurement).select(self.series.time, self.series.value)

    def to_arrow(self):
        """The series as an Arrow table in the order of writing; for results that fit the driver."""
        s = self.series
        return s.read(self._device, self._measurement).orderBy(s.seq).select(s.time, s.value).toArrow()
