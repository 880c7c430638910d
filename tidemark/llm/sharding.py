"""Balanced contiguous shards from global prefix sums of byte sizes.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut

#: Bytes that a row counts beside its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", row_bytes: int = ROW_BYTES, partitions: int | None = None) -> DataFrame:
    """Assign each row to one of ``shards`` contiguous shards of nearly equal bytes.

    Rows are put in the order of (key, text checksum, size), nulls first; rows that are equal in all
    three are interchangeable, so any order among them gives the same result.  Each range partition
    is summed once, the few totals (one row per partition) are summed up over all partitions, and a
    row's place on the global line of bytes is its partition's offset plus its prefix sum inside the
    partition.  Shard s holds the rows whose middle lies in [s, s + 1) / shards of all bytes, so a
    shard is off its target by less than one row at either end.  A key that is repeated any number
    of times only makes its rows neighbours: the range partitions are cut by checksum as well and,
    for rows alike in both, by a number that deals them out.

    Only (key, size, checksum) are shuffled, never texts.  Null or empty text: size ``row_bytes``,
    checksum 0.  An empty table gives no rows.  Other columns of ``docs`` are ignored.

    Returns key, ``size``, ``text_crc32``, ``law`` ("bytes"), ``shard``, ``slot`` (from 0 without
    gaps in each shard, in the global order) and ``grown_shard`` (null).
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    slim = docs.select(docs[key].alias("_key"), (F.octet_length(body).cast("long") + F.lit(row_bytes)).alias("_size"), F.crc32(body.cast("binary")).alias("_crc"))
    slim = slim.withColumn("_deal", F.monotonically_increasing_id())
    ranged = slim.repartitionByRange(n, "_key", "_crc", "_size", "_deal").withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)  # the partition numbers are facts from here on

    order = [F.col(c) for c in ("_key", "_crc", "_size", "_deal")]
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.select("*", F.sum("_size").over(inside).alias("_upto"), F.count(F.lit(1)).over(inside).alias("_rank"))

    # one row per partition: as few as there are partitions, whatever the input
    totals = ranged.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_bytes_ahead"),
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows_ahead"),
        F.sum("_bytes").over(Window.partitionBy(F.lit(1))).alias("_all"),
    )
    offsets = cut(offsets)
    on_line = placed.join(F.broadcast(offsets), "_part")
    # whole numbers throughout: exact up to some 10^17 bytes for 40 shards
    shard = F.least(F.lit(shards - 1), F.expr(f"(((_bytes_ahead + _upto) * 2 - _size) * {shards}) div (_all * 2)")).cast("int")
    dealt = on_line.select("_key", "_size", "_crc", shard.alias("shard"), (F.col("_rows_ahead") + F.col("_rank") - 1).alias("_row"))
    dealt = cut(dealt)
    starts = dealt.groupBy("shard").agg(F.min("_row").alias("_start"))  # at most ``shards`` rows
    return dealt.join(F.broadcast(starts), "shard").select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("_row") - F.col("_start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
