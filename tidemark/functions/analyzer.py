"""What pattern a series' values have, and which encoding and compression suit it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.types import Encoding

# The thresholds of the patterns
SAME, SPAN = 1e-10, 0.05
REPEATED, FEW = 0.5, 256
DRIFT_MEAN, DRIFT_MOST = 1.0, 10.0


def quantization(rows: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """(by..., n, low, step): the grid that a series' values lie on; step null where there's none.

    The step is the least difference of neighbours over 1e-10 (1 where all are equal).  All such
    differences and all values above the least must be within 0.05 of whole steps.  A series needs
    three values.
    """
    w = Window.partitionBy(*by).orderBy(seq)
    d = rows.where(rows[value].isNotNull()).select(*by, seq, F.col(value).alias("_v"))
    d = d.withColumn("_d", F.abs(F.col("_v") - F.lag("_v").over(w)))
    grid = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.min(F.when(F.col("_d") > SAME, F.col("_d"))).alias("_step"))
    grid = grid.withColumn("_step", F.coalesce("_step", F.lit(1.0)))

    def off(x: Column) -> Column:
        r = x / F.col("_step")
        return F.abs(r - F.round(r))

    checked = d.join(grid, by).groupBy(*by, "n", "low", "_step").agg(F.max(F.when(F.col("_d") > SAME, off(F.col("_d")))).alias("_a"), F.max(off(F.col("_v") - F.col("low"))).alias("_b"))
    fits = (F.col("n") >= 3) & (F.coalesce("_a", F.lit(0.0)) < SPAN) & (F.col("_b") < SPAN)
    return checked.select(*by, "n", "low", F.when(fits, F.col("_step")).alias("step"))


def patterns(rows: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """(by..., n, kinds, repetition, mean_step, most_step, pattern) of each series.

    In this order: Quantized; HighRepetition (over half the values are repeats, of fewer than 256);
    ContinuousDrift (steps below 1 on average and below 10); HighEntropy.
    """
    w = Window.partitionBy(*by).orderBy(seq)
    d = rows.where(rows[value].isNotNull()).select(*by, seq, F.col(value).alias("_v"))
    d = d.withColumn("_d", F.abs(F.col("_v") - F.lag("_v").over(w)))
    facts = d.groupBy(*by).agg(F.countDistinct("_v").alias("kinds"), F.avg("_d").alias("mean_step"), F.max("_d").alias("most_step"))
    met = quantization(rows, by, value, seq).join(facts, by)
    repetition = 1 - F.col("kinds") / F.col("n")
    pattern = (
        F.when(F.col("step").isNotNull(), "Quantized")
        .when((repetition > REPEATED) & (F.col("kinds") < FEW), "HighRepetition")
        .when((F.col("n") > 1) & (F.col("mean_step") < DRIFT_MEAN) & (F.col("most_step") < DRIFT_MOST), "ContinuousDrift")
        .otherwise("HighEntropy")
    )
    return met.select(*by, "n", "low", "step", "kinds", repetition.alias("repetition"), "mean_step", "most_step", pattern.alias("pattern"))


def encoding_for(pattern: Column) -> Column:
    return F.when(pattern == "Quantized", Encoding.QUANTIZED.name).when(pattern == "HighRepetition", Encoding.DICTIONARY_RLE.name).otherwise(Encoding.CHIMP128.name)


def compression_for(encoding: Column) -> Column:
    """By the encoding's name; an unknown one gets the general choice."""
    pairs = [x for e in Encoding for x in (F.lit(e.name), F.lit(e.compression.name))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), encoding), F.lit("ZSTD"))


def recommend(rows: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """``patterns`` with the encoding and the compression for each series."""
    found = patterns(rows, by, value, seq).withColumn("encoding", encoding_for(F.col("pattern")))
    return found.withColumn("compression", compression_for(F.col("encoding")))
