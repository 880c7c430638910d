"""The stateless operators over a stream, and running statistics of its series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import predicates as P
from tidemark.types import DataType


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files, new ones as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scan(points: DataFrame, predicate, measurement: str, time: str = "ts", value: str = "value") -> DataFrame:
    """Points that hold a predicate: no state."""
    kind = DataType.of(points.schema[value].dataType)
    return points.where(F.col("measurement") == measurement).where(P.condition(predicate, F.col(time), {measurement: (F.col(value), kind)}))


def running_statistics(points: DataFrame, by: list[str], every: str, late: str, time: str = "ts", value: str = "value", slide: str | None = None) -> DataFrame:
    """Statistics of each series and window of time; a window is final once ``late`` has gone by."""
    own = points.where(F.col(value).isNotNull()).withWatermark(time, late)
    window = F.window(time, every, slide) if slide else F.window(time, every)
    return own.groupBy(*by, window).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def sink(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "append"):
    """Write a stream as Parquet, each row once; by default all that is there now, then stop."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def epoch_millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp, towards the past."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1000).cast("decimal(10,0)")).cast("long")
