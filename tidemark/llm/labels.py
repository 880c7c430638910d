"""Labelled training rows: a split by checksum, and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def learnable(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """(``_k``, ``y``): the keys of ``docs`` that have a label, and the label.

    ``docs`` are the rows that may be learned from: no label of any other key is looked at further.
    Rows with a null key or label are left out; a key that has several labels has the least.  Keys are
    made distinct before they are joined, so a key that many rows share weighs no more than any other.
    """
    marked = labels.select(labels[key].alias("_k"), labels[label].cast("int").alias("y")).where("_k is not null and y is not null").groupBy("_k").agg(F.min("y").alias("y"))
    return cut(marked.join(docs.select(docs[key].alias("_k")).where("_k is not null").distinct(), "_k", "left_semi"))


def shares(keys: DataFrame) -> dict[int, int]:
    """How many of the ``learnable`` keys have each label."""
    return {r[0]: r[1] for r in keys.groupBy("y").count().collect()}  # a row for each class


def labelled(docs: DataFrame, keys: DataFrame, each: tuple[int, int], key: str = "doc_id", text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """At most ``each`` rows of class 0 and of class 1: (``text``, ``y``, extra columns).

    ``keys`` are the ``learnable`` keys of ``docs``.  The bounds are a parameter of the classifier.
    Which rows stay is decided by a hash of the key, so it's the same on every run; a key that has
    several documents gives one row (the least text).
    """
    extra = extra or []
    picked = None
    for y in (0, 1):  # a top-k of slim rows for each class
        one = keys.where(F.col("y") == y).select("_k", "y", F.xxhash64("_k").alias("_o")).orderBy("_o", "_k").limit(each[y])
        picked = one if picked is None else picked.unionByName(one)
    # at most sum(each) slim rows
    joined = docs.select(docs[key].alias("_k"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), *[docs[c] for c in extra]).join(F.broadcast(picked.select("_k", "y")), "_k")
    return joined.groupBy("_k", "y").agg(F.min(F.struct("text", *extra)).alias("_v")).select("_v.*", "y")
