"""Connected components of an edge table by hooking and contraction, with DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut


def _further(hook: DataFrame) -> DataFrame:
    """(``u``, ``p``, and ``pp``, where p points to)."""
    return cut(hook.join(hook.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", "p", "pp"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``root``): of each node of an edge, the smallest node that can be reached.

    Each round hooks every node onto its smallest neighbour, doubles the pointers and contracts the
    edges to the pointers' ends, until no edge is left.  All sums are partial minima before any
    shuffle, and the tables are written to the shared folder after each round.  Loops and repeated
    edges do no harm; an edge with a null end is left out; without edges the result is empty.
    """
    left = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    ends = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        hook = cut(hook)
        far = _further(hook)
        while not far.where("p <> pp").isEmpty():  # each turn halves the longest way
            far = _further(far.select("u", F.col("pp").alias("p")))
        hook = far.select("u", "p")
        ends = hook.select(F.col("u").alias("node"), F.col("p").alias("root")) if ends is None else ends.join(hook.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        ends = cut(ends)
        to = hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left = left.join(hook.withColumnRenamed("p", "pu"), "u").join(to, "v").where("pu <> pv")
        left = cut(left.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct())
    if ends is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends
