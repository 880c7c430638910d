"""Scans, statistics and the writer over small series."""

import itertools
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.errors import CodecError, InvalidState, NotFound, SchemaError, TypeMismatch
from tidemark.functions import bitcodecs, codecs
from tidemark.model import MeasurementSchema, Record, TableSchema, Tablet
from tidemark.operators import predicates as P
from tidemark.operators import indexes, split, stats
from tidemark.operators.scan import Series
from tidemark.sources import series as io
from tidemark.types import Category, Compression, DataType, Encoding, Lit

LONG = "device_id string, measurement string, ts long, value {}, seq long"


def made(spark, n, ts, v, kind="double", device="device1", measurement="temperature"):
    cast = float if kind in ("float", "double") else int
    return Series(spark.createDataFrame([(device, measurement, ts(i), cast(v(i)), i) for i in range(n)], LONG.format(kind)))


def test_basic_reads(spark):
    s = made(spark, 10, lambda i: 1000 + 100 * i, lambda i: 25 + i, "float")
    assert [r[0] for r in s.devices().collect()] == ["device1"]
    assert [r[0] for r in s.measurements("device1").collect()] == ["temperature"]
    assert s.measurements("none").count() == 0
    assert s.count("device1", "temperature").first()[0] == 10
    row = s.get("device1", "temperature", 5).first()
    assert (row.ts, row.value) == (1500, 30.0)
    assert s.get("device1", "temperature", 10).count() == 0
    assert next(s.iterate("device1", "temperature")) == (1000, 25.0)
    assert s.info().first().points == 10


@pytest.mark.parametrize(
    ("n", "ts", "v", "kind", "low", "high", "value", "expected"),
    [
        (20, lambda i: 100 * i, lambda i: 5 * i, "int", 500, 1500, None, 11),
        (100, lambda i: 100 * i, lambda i: 20 + i, "float", 1000, 2000, None, 11),
        (50, lambda i: 100 * i, lambda i: i, "int", 10001, 99999, None, 0),
        (30, lambda i: 100 * i, lambda i: 2 * i, "double", None, None, ("gt", Lit.float64(40.0)), 9),
        (50, lambda i: 50 * i, lambda i: 10 + 2 * i, "float", 500, 1500, ("lt", Lit.float32(60.0)), 15),
        (30, lambda i: 100 * i, lambda i: i, "int", None, None, ("gt", Lit.int32(20)), 9),
        (50, lambda i: 10 * i, lambda i: 2 * i, "double", 100, 300, ("lt", Lit.float64(50.0)), 15),
        (20, lambda i: 100 * i, lambda i: i, "int", 1500, 500, None, 0),
    ],
)
def test_scans(spark, n, ts, v, kind, low, high, value, expected):
    scan = made(spark, n, ts, v, kind).scan().device("device1").measurement("temperature")
    if low is not None:
        scan = scan.time_range(low, high)
    if value:
        scan = scan.where_value(*value)
    assert scan.execute().count() == expected


def test_not_found(spark):
    s = made(spark, 3, lambda i: i, lambda i: i)
    with pytest.raises(NotFound):
        s.read("x", "temperature", check=True)
    with pytest.raises(NotFound):
        s.read("device1", "x", check=True)
    assert s.read("x", "temperature").count() == 0


def test_wide_by_time(spark):
    rows = [("d", "a", 1, 1.0, 0), ("d", "b", 2, 5.0, 1), ("d", "a", 2, 2.0, 2), ("d", "a", 2, 3.0, 3), ("d", "b", 3, None, 4)]
    s = Series(spark.createDataFrame(rows, LONG.format("double")))
    got = {r.ts: (r.a, r.b) for r in s.wide(["a", "b"]).collect()}
    assert got == {1: (1.0, None), 2: (3.0, 5.0)}
    assert s.align(["a", "b"], "inner").count() == 1


def test_statistics(spark):
    rows = spark.createDataFrame([("d", "m", 1000, 10, 0), ("d", "m", 2000, 20, 1), ("d", "m", 3000, 5, 2)], LONG.format("int"))
    r = stats.statistics(rows, ["device_id"], DataType.INT32).first()
    assert (r.n, r.start, r.end, r.low, r.high, r.total, r.first, r.last) == (3, 1000, 3000, 5, 20, 35, 10, 5)
    empty = stats.statistics(rows.where("false"), [], DataType.INT32).first()
    assert empty.n == 0 and empty.start is None and empty.total is None


def test_nan_stays_out_of_bounds(spark):
    rows = spark.createDataFrame([("d", "m", i, v, i) for i, v in enumerate([1.5, float("nan"), 0.5])], LONG.format("double"))
    r = stats.statistics(rows, [], DataType.DOUBLE).first()
    assert (r.n, r.low, r.high) == (3, 0.5, 1.5)


@pytest.mark.parametrize(("n", "blocks"), [(1, 1), (249, 1), (250, 1), (499, 1), (500, 2), (1999, 7), (2000, 8), (5003, 8)])
def test_mini_blocks(spark, n, blocks):
    rows = spark.range(n).selectExpr("'s' as s", "id as seq")
    got = [r[1] for r in sorted(stats.mini_blocks(rows, ["s"]).groupBy("mini_block").count().collect())]
    assert len(got) == blocks and sum(got) == n and max(got) - min(got) <= 1 and got == sorted(got, reverse=True)


def test_tablet_rules():
    schemas = [MeasurementSchema("t", DataType.FLOAT), MeasurementSchema("n", DataType.INT32)]
    t = Tablet("d", schemas, 2, aligned=True)
    t.add_row(1, [1.0, None])
    with pytest.raises(InvalidState):
        t.add_row(1, [1.0, 1])
    with pytest.raises(TypeMismatch):
        t.add_row(2, [1.0, "x"])
    with pytest.raises(InvalidState):
        t.add_row(2, [1.0])
    assert len(t) == 1
    t.add_row(2, [2.0, 3])
    assert t.full
    with pytest.raises(InvalidState):
        t.add_row(3, [2.0, 3])
    t.clear()
    assert len(t) == 0


def test_table_schema():
    s = TableSchema("x", [MeasurementSchema("tag", DataType.TEXT, category=Category.TAG), MeasurementSchema("ts", DataType.TIMESTAMP, category=Category.TIME)])
    with pytest.raises(SchemaError):
        s.validate()
    assert s.index("ts") == 1 and s.names(Category.TAG) == ["tag"]
    with pytest.raises(NotFound):
        s.index("no")
    back = TableSchema.of("x", s.struct())
    assert [c.category for c in back.columns] == [Category.TAG, Category.TIME]


def test_writer(spark, tmp_path):
    w = io.SeriesWriter(spark, str(tmp_path / "w"))
    w.register_timeseries("d", MeasurementSchema("t", DataType.DOUBLE))
    with pytest.raises(SchemaError):
        w.write_record(Record(1, "other", {"t": 1.0}))
    with pytest.raises(SchemaError):
        w.write_record(Record(1, "d", {"x": 1.0}))
    w.write_record(Record(1, "d", {"t": 1.0}))
    w.write_record(Record(2, "d").add("t", None))
    w.flush()
    tab = Tablet("e", [MeasurementSchema("t", DataType.DOUBLE), MeasurementSchema("s", DataType.TEXT)])
    tab.add_rows([1, 2], [[5.0, "x"], [None, "y"]])
    w.write_tablet(tab)
    w.write_record(Record(3, "d", {"t": 3.0}))
    w.close()
    with pytest.raises(InvalidState):
        w.write_record(Record(4, "d", {"t": 1.0}))
    home = str(tmp_path / "w")
    s = replace(Series.open(spark, home), df=io.open_kind(spark, home, DataType.DOUBLE))
    assert list(s.iterate("d", "t")) == [(1, 1.0), (3, 3.0)]
    assert list(s.iterate("e", "t")) == [(1, 5.0)]
    both = Series.open(spark, home)  # of two types: as text
    assert list(both.iterate("e", "s")) == [(1, "x"), (2, "y")] and list(both.iterate("d", "t")) == [(1, "1.0"), (3, "3.0")]
    told = {(r.device_id, r.measurement): (r.kind, r.encoding, r.compression, r.points, r.start, r.end) for r in io.catalog(spark, home).collect()}
    assert told[("d", "t")][0] == "DOUBLE" and told[("d", "t")][3:] == (2, 1, 3) and told[("e", "s")][::3] == ("TEXT", 2)
    again = io.SeriesWriter(spark, home)  # a later writer's rows come later
    again.register_device("d", [MeasurementSchema("t", DataType.DOUBLE, Encoding.DICTIONARY), MeasurementSchema("idle", DataType.INT32)])
    again.write_record(Record(0, "d", {"t": 0.5}))
    again.close()
    s, both = replace(s, df=io.open_kind(spark, home, DataType.DOUBLE)), Series.open(spark, home)
    assert list(s.iterate("d", "t")) == [(1, 1.0), (3, 3.0), (0, 0.5)]
    assert s.get("d", "t", 2).first()["value"] == 0.5 and s.get("d", "t", 3).count() == 0
    assert both.df.groupBy("seq").count().where("count > 1").count() == 0
    told = {(r.device_id, r.measurement): (r.encoding, r.points) for r in io.catalog(spark, home).collect()}
    assert told[("d", "t")] == ("DICTIONARY", 3) and told[("d", "idle")][1] == 0
    files = list((tmp_path / "w").rglob("*.parquet"))
    assert Series.file_size(spark, str(tmp_path / "w")) == sum(f.stat().st_size for f in files)
    kept = s.cached()
    assert kept.count("d", "t").first()[0] == 3
    kept.clear_cache()


def test_types():
    assert Encoding.parse("dod") is Encoding.DELTA_OF_DELTA and Encoding.parse("Chimp") is Encoding.CHIMP128 and Encoding.parse("what") is None
    assert Encoding.for_type(DataType.INT64) is Encoding.SIMPLE8B and Encoding.for_import(DataType.INT64) is Encoding.DELTA_OF_DELTA
    assert Encoding.QUANTIZED.compression is Compression.ZSTD and Encoding.GORILLA.compression is Compression.LZ4
    assert Compression.parse("lz4").parquet == "lz4_raw"


def test_write_options():
    with pytest.raises(InvalidState):
        io.WriteOptions().build("m")
    m = io.WriteOptions().data_type(DataType.DOUBLE).analyze_and_recommend("Quantized").build("m")
    assert (m.encoding, m.compression) == (Encoding.QUANTIZED, Compression.ZSTD)


def test_arrow(spark):
    import pyarrow as pa

    t = pa.table({"timestamp": pa.array([1000, 2000, None], pa.timestamp("us")), "device_id": ["a", None, "b"], "x": pa.array([1, 2, 3], pa.uint16()), "f": pa.array([1.5, None, 2.5], pa.float32())})
    rows = {r.device_id: (r.ts, r.x, r.f) for r in io.from_arrow_table(spark, t).collect()}
    assert rows == {"a": (1, 1, 1.5), "b": (0, 3, 2.5)}
    hinted = pa.schema([pa.field("timestamp", pa.int64()), pa.field("device_id", pa.string()), pa.field("t", pa.float32(), metadata={"encoding": "chimp128"}), pa.field("h", pa.float32())])
    assert [m.encoding for m in io.schemas_of(hinted)] == [Encoding.CHIMP128, Encoding.GORILLA]
    with pytest.raises(SchemaError):
        io.from_arrow_table(spark, t.drop_columns(["device_id"]))
    wide = io.from_arrow_table(spark, t)
    out = io.to_arrow_table(wide, io.schemas_of(t.schema))
    assert out.column_names == ["timestamp", "device_id", "x", "f"] and out.num_rows == 2
    with pytest.raises(NotFound):
        io.to_arrow_table(wide, [MeasurementSchema("no", DataType.FLOAT)])


def test_streaming(spark, tmp_path):
    from tidemark.streaming import live

    src = str(tmp_path / "src")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)) as ts, 'd' as device_id, 'm' as measurement, cast(id as double) as value from range(300)").write.parquet(src)
    s = live.read(spark, src, spark.read.parquet(src).schema)
    live.sink(live.scan(s, P.measurement("m") > Lit.float64(250.0), "m"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 49
    w = live.running_statistics(s, ["device_id"], "1 hour", "10 minutes")
    q = w.writeStream.format("memory").queryName("live_stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("live_stats").collect()) == [60, 60, 60, 60, 60]


def test_ship(spark):
    import zipfile

    from tidemark.deploy import ship

    names = zipfile.ZipFile(ship(spark)).namelist()
    assert "tidemark/types.py" in names and "tidemark/operators/scan.py" in names


@pytest.mark.parametrize("bits", [0, 1, 2, 20])
def test_series_of_any_length_are_worked_on_in_chunks(spark, monkeypatch, bits):
    """One hot series, a null one, and gaps in the order: chunks of 1, 2, 4 and all rows give the same."""
    monkeypatch.setattr(split, "SPAN_BITS", bits)
    rnd = random.Random(2)
    rows = [("hot" if k % 3 else None if k % 2 else "cold", 5 * k + k % 2, rnd.choice([1, 1, 2, None, 7])) for k in range(80)]
    df = spark.createDataFrame(rows, "s string, seq long, v long").repartition(3)
    by = {}
    for s, q, v in sorted(rows, key=lambda r: r[1]):
        by.setdefault(s, []).append((q, v))
    take = lambda d, *c: sorted((tuple(r[x] for x in c) for r in d.collect()), key=repr)
    flat = lambda f: sorted(((s, *x) for s, own in by.items() for x in f(own)), key=repr)
    assert take(split.placed(df, ["s"], "seq", "n"), "s", "seq", "n") == flat(lambda own: [(q, n) for n, (q, _) in enumerate(own)])
    assert take(split.lagged(df, ["s"], "seq", "v", "b"), "s", "seq", "b") == flat(lambda own: [(q, own[n - 1][1] if n else None) for n, (q, _) in enumerate(own)])
    assert take(split.running(df, ["s"], "seq", "v", "t"), "s", "seq", "t") == flat(lambda own: [(q, sum(v or 0 for _, v in own[: n + 1])) for n, (q, _) in enumerate(own)])
    runs = codecs.rle_encode(df, ["s"], "v", "seq")
    want = flat(lambda own: [(n, v, len(list(g))) for n, (v, g) in enumerate(itertools.groupby(v for _, v in own))])
    assert take(runs, "s", "run", "v", "length") == want
    assert take(codecs.rle_decode(runs.where("s = 'hot'"), ["s"], "v"), "place", "v") == sorted(((n, v) for n, (_, v) in enumerate(by["hot"])), key=repr)
    whole = df.where("v is not null")
    back = codecs.delta_of_delta_decode(codecs.delta_of_delta(whole, ["s"], "v", "seq").drop("v"), ["s"], "code", "seq", "v")
    assert take(back, "s", "seq", "v") == take(whole, "s", "seq", "v")
    ids = codecs.dictionary_ids(df, ["s"], "v", "seq")
    assert take(ids, "s", "seq", "id") == flat(lambda own: [(q, list(dict.fromkeys(v for _, v in own)).index(v)) for q, v in own])
    monkeypatch.setattr(indexes, "SPAN_BITS", bits)
    names = df.withColumn("t", F.concat(F.lit("x"), F.col("v").cast("string")))
    order = list(dict.fromkeys(f"x{v}" for _, _, v in sorted(rows, key=lambda r: r[1]) if v is not None))
    assert take(indexes.dictionary(names, "t", "seq"), "t", "id") == sorted((t, n) for n, t in enumerate(order))


def test_a_dictionary_that_is_too_small_raises(spark):
    df = spark.createDataFrame([("a", k, k % 3) for k in range(20)] + [("b", k, k) for k in range(20)], "s string, seq long, v long")
    assert sorted(tuple(r) for r in codecs.fits_dictionary(df, ["s"], "v", 5).collect()) == [("a", 3, True), ("b", 20, False)]
    with pytest.raises(Exception, match="a dictionary holds 5 values, and there are more in b"):
        codecs.dictionary_rle(df, ["s"], "v", "seq", 5).collect()
    assert codecs.dictionary_rle(df.where("s = 'a'"), ["s"], "v", "seq", 5).count() == 20


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_block_codecs_without_floats(n):
    rnd = np.random.default_rng(n)
    flags = rnd.random(n) > 0.3
    assert (bitcodecs.gorilla_bool_decode(bitcodecs.gorilla_bool_encode(flags)) == flags).all()
    assert len(bitcodecs.gorilla_bool_encode(flags)) == 4 + -(-n // 8)
    for values in (np.round(rnd.random(n) * 100, 2), rnd.integers(-50, 50, n) * 0.25, np.full(n, 3.7)):
        code = bitcodecs.quantized_encode(values)
        assert (bitcodecs.quantized_decode(code) == values).all() and len(code) < 24 + 8 + 4 * n
    small = np.round(rnd.random(n) * 10, 1).astype("f4")
    assert (bitcodecs.quantized_decode(bitcodecs.quantized_encode(small, "f4"), "f4") == small).all()
    if n > 1:
        with pytest.raises(CodecError):
            bitcodecs.quantized_encode(rnd.random(n))
    for numbers in (rnd.integers(-9, 9, n), rnd.integers(-(2**58), 2**58, n), np.zeros(n, np.int64)):
        code = bitcodecs.simple8b_encode(numbers)
        assert (bitcodecs.simple8b_decode(code) == numbers).all()
        words, at, u = [], 0, [int(x) for x in (numbers.astype(np.int64) << 1) ^ (numbers.astype(np.int64) >> 63)]
        while at < n:  # greedy: the first selector that fits
            s = next(s for s, (m, w) in enumerate(bitcodecs._WORDS) if at + m <= n and all((x & 2**64 - 1).bit_length() <= w for x in u[at : at + m]))
            words.append(s)
            at += bitcodecs._WORDS[s][0]
        assert (np.frombuffer(code[4:], "<u8") >> np.uint64(60)).tolist() == words
