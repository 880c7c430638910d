"""Queries over tables whose keys and groups grow: whole results, with no task that takes most of the rows."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.functions import codecs
from tidemark.operators import split
from tidemark.plans import queries as core
from tidemark.sources import series as io


def same_as_sql(spark, name, home):
    """The query's rows over ``home``'s tables, found equal to its SQL's."""
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in home.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = core.queries()[name](spark, str(home))
    out = db.execute(core.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == sorted(out.fetchall(), key=repr)
    return got


def test_promoted_ids_beyond_the_narrow_type(spark, tmp_path):
    """Ids of a larger table don't fit 16 bits; the promoted column has 32."""
    duckdb.execute(f"COPY (SELECT * REPLACE (user_id + CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 40000 ELSE 2147480000 END AS user_id) FROM '{DATA}/events.parquet') TO '{tmp_path}/events.parquet'")
    rows = same_as_sql(spark, "ingest_promote_types", tmp_path)
    assert max(r[1] for r in rows) > 2147480000


def test_a_long_device_is_written_as_several_files(spark, tmp_path, monkeypatch):
    """One device with nearly all rows: no file, and so no task, holds them all, and none is lost."""
    monkeypatch.setattr(io, "FILE_BYTES", 1000 * io.ROW_BYTES)
    long = spark.range(8000).selectExpr("if(id % 100 = 0, concat('d', id % 7), 'hot') as device_id", "if(id % 2 = 0, 'a', 'b') as measurement", "(id * 7919) % 8000 as ts", "cast(id as double) as value", "id as seq")
    for name, config, most in (("bytes", io.Config(), 2000), ("files", io.Config(files=4), 4000)):
        io.append(long, str(tmp_path / name), config)
        back = spark.read.parquet(str(tmp_path / name))
        assert sorted(back.select(long.columns).collect()) == sorted(long.collect())
        key = F.struct("device_id", "measurement", "ts")
        files = sorted(back.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect(), key=lambda r: r.low)
        assert len(files) >= 4 and max(r.n for r in files) < most
        assert all(a.high < b.low for a, b in zip(files, files[1:]))
    texts = long.withColumn("value", F.repeat(F.lit("x"), 9 * io.ROW_BYTES))
    assert (io._files(long), io._files(texts), io._files(long.limit(0))) == (8, 80, 1)


@pytest.fixture
def hot_lines(spark, tmp_path, monkeypatch):
    """Lines of which nearly all are of one supplier, some of none, in short chunks."""
    monkeypatch.setattr(split, "SPAN_BITS", 6)
    supplier = "CASE WHEN l_orderkey = 3 THEN NULL WHEN l_orderkey % 50 = 0 THEN l_suppkey ELSE 1 END"
    flag = "CASE WHEN l_orderkey BETWEEN 100 AND 700 THEN 'A' ELSE l_returnflag END"
    duckdb.execute(f"COPY (SELECT * REPLACE ({supplier} AS l_suppkey, {flag} AS l_returnflag) FROM '{DATA}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield tmp_path
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def shares(df):
    return list(Counter(r[-1] for r in df.select("*", F.spark_partition_id()).collect()).values())


@pytest.mark.parametrize("name", ["enc_rle", "dec_rle"])
def test_runs_of_a_hot_supplier(spark, hot_lines, name):
    """A run over many chunks is one run, and no task has most of the lines, neither numbered nor coded."""
    rows = same_as_sql(spark, name, hot_lines)
    assert name == "dec_rle" or max(r[3] for r in rows) > 20 << split.SPAN_BITS
    for df in (core._lines(spark, str(hot_lines)), core.queries()[name](spark, str(hot_lines))):
        each = shares(df)
        assert max(each) < 0.6 * sum(each)


def test_partitions_grow_with_the_files(spark, monkeypatch):
    """More to read is more partitions, so that a task's share stays; little is left to Spark."""
    lines = core.table(spark, DATA, "lineitem")
    assert split.parts(lines) is None
    made = spark.createDataFrame([("a", 1, 1)], "s string, k long, v long")
    assert split.parts(made.join(spark.createDataFrame(made.rdd, made.schema), "s")) is None
    size = int(str(lines._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    monkeypatch.setattr(split, "PART_BYTES", size // 11)
    assert split.parts(lines) in (11, 12) and split.parts(lines.union(lines)) == split.parts(lines)
    n = split.parts(lines)
    assert core.queries()["enc_rle"](spark, DATA).rdd.getNumPartitions() == n
    assert split.running(lines, ["l_suppkey"], "l_orderkey", "l_quantity", "t").rdd.getNumPartitions() == n
    assert codecs.rle_decode(core.queries()["enc_rle"](spark, DATA), ["l_suppkey"], "l_returnflag").rdd.getNumPartitions() == n
