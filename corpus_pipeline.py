"""A corpus from raw documents: five stages over the operators of ``tidemark.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and
reads again as the next one's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, nbest, quality, simhash, toxicity
from tidemark.llm.labels import remainder
from tidemark.llm.queries import table, vocabulary
from tidemark.llm.shared import cut, shared_dir

#: Keys of rejected rows that are broadcast at most (16 bytes each, about 100 in a hash table).
BROADCAST_KEYS = 500_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity network rejects (score of a half or more)."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, net, keep=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality machine rejects (score below a half)."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return quality.score(docs, machine, keep=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def _row_key():
    """16 bytes for a row's id and text: rows with the same key are judged alike, whatever else shares their id."""
    told = F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return F.unhex(F.md5(told.cast("binary")))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows that have one of the different keys ``keys`` (column ``_row``).

    Up to BROADCAST_KEYS keys are broadcast, so the texts stay where they are; more are joined by a
    shuffle.  The result is the same.
    """
    keys = cut(keys)
    few = keys.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys, "_row", "left_anti")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the one with the smallest id, null ids last.

    Of different texts with the smallest id one stays, and of rows alike in id and text the least.
    """
    docs = docs.select(*COLUMNS, _row_key().alias("_row"))
    ranked = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row")).alias("_rank"), "text")
    found = simhash.near_duplicates(ranked, key="_rank")
    # equal keys are equal texts: one fingerprint, one component
    by_row = cut(found.groupBy(F.col("_rank.row").alias("_row")).agg(F.max(F.col("_rank.row") == F.col("component_id.row")).alias("_keep"), F.count(F.lit(1)).alias("_n")))
    out = _without(docs, by_row.where("not _keep").select("_row"))
    many = by_row.where("_keep and _n > 1").select("_row")
    if many.isEmpty():
        return out.select(*COLUMNS)
    one = _without(out, many).select(*COLUMNS)
    rest = out.join(many, "_row", "left_semi")
    return one.unionByName(rest.groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("_r")).select("_r.*"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text holds a window of a benchmark item."""
    docs = docs.select(*COLUMNS, _row_key().alias("_row"))
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), key="_row")
    return _without(docs, found.where("n_hit > 0").select("_row").distinct()).select(*COLUMNS)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The four best segmentations of what is left, with digests of their ids and a round-trip check."""
    found = nbest.encode(docs, vocabulary(), n=4, ids=False)
    return found.select("doc_id", F.get("lengths", F.lit(0)).cast("long").alias("n_tokens"), F.get("scores", F.lit(0)).alias("score"), F.size("scores").alias("n_found"), "scores", "lengths", "digests", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("segmentation", segmented),
]

#: Trained classifiers, SimHash components and lattices are beyond SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs, home = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        path = f"{home}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
