"""Order-dependent columns of series of any length, without a task that holds a whole series.

A series is cut into chunks by ``seq``, the whole number that rows are in order by: rows of one chunk
have the same ``seq`` divided by SPAN, so a chunk has at most SPAN rows where ``seq`` is unique in
its series.  Windows run within chunks.  What a chunk carries on to the next ones is one row for each
chunk, which is summed or shifted over the chunks of a series and put before the chunk's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Bits of a ``seq`` that count places within a chunk.
SPAN_BITS = 20
#: Bytes of files for each partition of rows made from them, and from where a size means that it isn't known
PART_BYTES, UNKNOWN_BYTES = 1 << 23, 1 << 60


def chunked(rows: DataFrame, seq: str) -> DataFrame:
    return rows.withColumn("_chunk", F.shiftright(F.col(seq).cast("long"), SPAN_BITS))


def within(by: list[str], *seq: str) -> WindowSpec:
    """Rows of a chunk, in order."""
    return Window.partitionBy(*by, "_chunk").orderBy(*seq)


def after(by: list[str], *seq: str) -> WindowSpec:
    """Rows of a chunk, in order, once they are ``carried``: no further sort."""
    return within(by, "_row", *seq)


def parts(rows: DataFrame) -> int | None:
    """How many partitions of PART_BYTES the files take that ``rows`` are made from; None if that's few."""
    plan = rows._jdf.queryExecution().analyzed().collectLeaves()
    leaves = [plan.apply(i) for i in range(plan.size())]
    sizes = {leaf.semanticHash(): int(str(leaf.stats().sizeInBytes())) for leaf in leaves}
    n = -(-sum(v for v in sizes.values() if v < UNKNOWN_BYTES) // PART_BYTES)
    return n if n > rows.sparkSession.sparkContext.defaultParallelism else None


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` by ``keys``, in more partitions the more there is to read: a task's share doesn't grow."""
    n = parts(rows)
    return rows.repartition(n, *keys) if n else rows


def carried(rows: DataFrame, by: list[str], seq: list[str], own: dict[str, Column], steps: list, names: list[str], marked: DataFrame | None = None) -> DataFrame:
    """Chunked rows with what their chunk gets from the earlier ones.

    ``own`` are aggregates of a chunk (of ``marked`` if given, else ``rows``), by name.  Each of ``steps``
    is a function of the window over a series' chunks that gives (name, column) of what is carried; later
    steps may use earlier ones'.  Only ``names`` come to the rows.

    What is carried stands as a row before its chunk's rows and is handed on from there, so rows are
    sorted once, and windows of ``after`` take them as they are.
    """
    each = (rows if marked is None else marked).groupBy(*by, "_chunk").agg(*[c.alias(f"_own_{n}") for n, c in own.items()])
    w = Window.partitionBy(*by).orderBy("_chunk")
    for step in steps:
        name, col = step(w)
        each = each.withColumn(name, col)
    each = each.select(*by, "_chunk", F.lit(False).alias("_row"), F.struct(*names).alias("_told"))
    met = dealt(rows.withColumn("_row", F.lit(True)).unionByName(each, allowMissingColumns=True), [*by, "_chunk"])
    told = F.first("_told").over(after(by, *seq).rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("_told", told).where("_row")
    return met.withColumns({n: F.col("_told")[n] for n in names}).drop("_told")


def earlier(w: WindowSpec, col: str | Column) -> Column:
    """The sum over the earlier chunks."""
    return F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed(rows: DataFrame, by: list[str], seq: str, out: str, ties: list[str] = []) -> DataFrame:
    """``rows`` with ``out``: their place in their series, from 0; rows of one ``seq`` are in order of ``ties``."""
    order = [seq, *ties]
    met = carried(chunked(rows, seq), by, order, {"n": F.count(F.lit(1))}, [lambda w: ("_before", earlier(w, "_own_n"))], ["_before"])
    return met.withColumn(out, F.col("_before") + F.row_number().over(after(by, *order)) - 1).drop("_chunk", "_row", "_before")


def lagged(rows: DataFrame, by: list[str], seq: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the value of the row before in the series, null for the first one."""
    met = carried(chunked(rows, seq), by, [seq], {"last": F.max_by(F.struct(F.col(value).alias("v")), F.col(seq))}, [lambda w: ("_before", F.lag("_own_last").over(w))], ["_before"])
    w = after(by, seq)
    return met.withColumn(out, F.when(F.row_number().over(w) == 1, F.col("_before.v")).otherwise(F.lag(value).over(w))).drop("_chunk", "_row", "_before")


def running(rows: DataFrame, by: list[str], seq: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of the values up to and with the row; nulls count as none."""
    met = carried(chunked(rows, seq), by, [seq], {"sum": F.coalesce(F.sum(value), F.lit(0))}, [lambda w: ("_before", earlier(w, "_own_sum"))], ["_before"])
    w = after(by, seq).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_chunk", "_row", "_before")
