"""Mergeable statistics of series, blocks of points, and pruning of blocks.

One aggregation gives partial statistics for any grouping; merging them is another aggregation over
the partial rows, so blocks roll up to series and series to the whole with the same result as over
the points themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import predicates as P
from tidemark.operators import split
from tidemark.types import DataType

#: Points of a mini-block at least, and mini-blocks of a page at most
LEAST_POINTS, MOST_BLOCKS = 250, 8


def aggregates(kind: DataType, value: str = "value", time: str = "ts", seq: str = "seq") -> list[Column]:
    """``n``, ``start``, ``end``, ``first``, ``last`` and, by type, ``total``, ``low`` and ``high``.

    First and last go by the order of writing, not by time.  Integers of 32 bits are summed as 64,
    those of 64 bits as doubles; Booleans' total is how often they are true; NaN is in no minimum and
    no maximum; text has neither.
    """
    v = F.col(value)
    out = [F.count(v).alias("n"), F.min(F.when(v.isNotNull(), F.col(time))).alias("start"), F.max(F.when(v.isNotNull(), F.col(time))).alias("end")]
    order = F.when(v.isNotNull(), F.col(seq))
    out += [F.min_by(v, order).alias("first"), F.max_by(v, order).alias("last"), F.min(order).alias("first_seq"), F.max(order).alias("last_seq")]
    if kind is DataType.BOOLEAN:
        return [*out, F.sum(v.cast("long")).alias("total")]
    if kind in (DataType.TEXT, DataType.BLOB):
        return out
    own = F.when(~F.isnan(v), v) if kind.floating else v
    if kind is DataType.DATE:
        return [*out, F.min(own).alias("low"), F.max(own).alias("high")]
    total = F.sum(v.cast("long")) if kind is DataType.INT32 else F.sum(v.cast("double"))
    return [*out, total.alias("total"), F.min(own).alias("low"), F.max(own).alias("high")]


def merges(columns: list[str]) -> list[Column]:
    """Partial statistics put together: the earliest first and the latest last stay."""
    how = {
        "n": F.sum("n"), "start": F.min("start"), "end": F.max("end"), "first": F.min_by("first", "first_seq"), "last": F.max_by("last", "last_seq"),
        "first_seq": F.min("first_seq"), "last_seq": F.max("last_seq"), "total": F.sum("total") if "total" in columns else None, "low": F.min("low") if "low" in columns else None, "high": F.max("high") if "high" in columns else None,
    }
    return [how[c].alias(c) for c in columns if how.get(c) is not None]


def statistics(points: DataFrame, by: list[str], kind: DataType, value: str = "value", time: str = "ts", seq: str = "seq") -> DataFrame:
    return points.groupBy(*by).agg(*aggregates(kind, value, time, seq))


def merge(partial: DataFrame, by: list[str]) -> DataFrame:
    return partial.groupBy(*by).agg(*merges([c for c in partial.columns if c not in by]))


def blocks_of(points: DataFrame, by: list[str], rows: int, seq: str = "seq", block: str = "block") -> DataFrame:
    """Points with the number of their block: ``rows`` points each, in the order of writing."""
    return split.placed(points, by, seq, "_place").withColumn(block, F.floor(F.col("_place") / rows).cast("int")).drop("_place")


def mini_blocks(points: DataFrame, by: list[str], seq: str = "seq", block: str = "mini_block") -> DataFrame:
    """Points with the number of their mini-block.

    A page of fewer than 250 points is one; up to 8 near-equal ones otherwise, of at least 250 points
    where 8 would hold fewer; the first ones get the remainder.
    """
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_total")).select(*[F.col(b).alias(f"_of_{b}") for b in by], "_total")
    met = split.placed(points, by, seq, "_place")
    met = met.join(sizes, [met[b].eqNullSafe(sizes[f"_of_{b}"]) for b in by]).drop(*[f"_of_{b}" for b in by])
    total, place = F.col("_total"), F.col("_place")
    eighth = F.floor(total / MOST_BLOCKS)
    number = F.when(total < LEAST_POINTS, 1).when(eighth < LEAST_POINTS, F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.floor(total / LEAST_POINTS)))).otherwise(MOST_BLOCKS)
    small, more = F.floor(total / number), total % number
    edge = more * (small + 1)
    return met.withColumn(block, F.when(place < edge, F.floor(place / (small + 1))).otherwise(more + F.floor((place - edge) / small)).cast("int")).drop("_place", "_total")


def manifest(points: DataFrame, by: list[str], kind: DataType, rows: int, value: str = "value", time: str = "ts", seq: str = "seq") -> DataFrame:
    """A row of statistics for each block of each series."""
    return statistics(blocks_of(points, by, rows, seq), [*by, "block"], kind, value, time, seq)


def prune(blocks: DataFrame, predicate, measurement: str, kind: DataType) -> DataFrame:
    """The blocks of a manifest that can hold a match; a block without bounds stays."""
    bounds = (F.col("low"), F.col("high"), kind) if "low" in blocks.columns else (None, None, kind)
    return blocks.where(P.block_condition(predicate, F.col("start"), F.col("end"), {measurement: bounds}))


def violations(points: DataFrame, by: list[str], time: str = "ts", seq: str = "seq") -> DataFrame:
    """Points whose time isn't later than that of the point written before: an aligned batch has none."""
    return split.lagged(points, by, seq, time, "previous").where(F.col(time) <= F.col("previous"))
