"""The ``opN_<name>`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, decontaminate, kneser_ney, nbest, quality, sharding, simhash, token_count, toxicity, url_filter
from tidemark.llm.labels import remainder

#: The vocabulary that operators 1 and 5 use.
VOCABULARY = "piece_bpe_32k.model"

RULES = [
    url_filter.Rule("allow", "com"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every text, with digests of their ids and a round-trip check."""
    found = nbest.encode(table(spark, sf_dir, "documents"), vocabulary(), n=4, ids=False)
    return found.select("doc_id", F.coalesce(F.get("lengths", F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"), F.get("scores", F.lit(0)).alias("score"), F.size("scores").alias("n_found"), "scores", "lengths", "digests", "round_trip")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 7) == 2)
    model = kneser_ney.train(docs, ~F.col("held_out"))
    return kneser_ney.score(docs, model, keep=["held_out"])


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary(), limit=4096)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    machine = quality.train(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"))
    return quality.score(docs, machine, keep=["held_out"])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.col("n_near").cast("long").alias("n_near"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"))
    return toxicity.score(docs, net, keep=["held_out"])


def queries() -> dict:
    return {f.__name__: f for f in (op1_nbest, op2_kneser_ney, op3_neighbours, op4_shards, op5_token_counts, op6_simhash, op7_quality, op8_decontaminate, op9_url_filter, op10_toxicity)}


#: crc32 of a text in SQL, bit by bit over the bytes that hex() gives.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen(t), 1), lambda i: ('0x' || substr(hex(t), 2 * i + 1, 2))::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)), 4294967295::UBIGINT)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op9_url_filter": r"""
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(verdict, rh, rp) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), hits AS (
  SELECT page_id, r.rh || r.rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS n
  FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM q LEFT JOIN hits ON hits.page_id = q.page_id AND n = 1
""",
        "op4_shards": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 16 AS size FROM documents
), c AS (
  SELECT doc_id, size, {_CRC}::BIGINT AS crc FROM d
), s AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, crc, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total,
    row_number() OVER (ORDER BY doc_id, crc, size) AS n FROM c
), p AS (
  SELECT *, least(39, ((2 * upto - size) * 40) // (2 * total))::INTEGER AS shard FROM s
)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard, (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
""",
    }
