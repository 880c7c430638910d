"""Indexes, codecs and the analyzer."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.errors import CodecError
from tidemark.functions import analyzer, bitcodecs
from tidemark.operators import indexes

SERIES = "s string, seq long, v double"


def series(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], SERIES)


def test_tags(spark, tmp_path):
    rows = [("s1", "location", "datacenter1"), ("s1", "type", "temperature"), ("s2", "location", "datacenter2"), ("s2", "type", "temperature"), ("s3", "location", "datacenter1"), ("s3", "type", "humidity"), ("s4", "location", "datacenter1"), ("s4", "type", "temperature")]
    t = indexes.TagIndex(spark.createDataFrame(rows, "device string, key string, value string"))
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(t.query("location", "datacenter1")) == ["s1", "s3", "s4"]
    assert names(t.query_and([("location", "datacenter1"), ("type", "temperature")])) == ["s1", "s4"]
    assert names(t.query_or([("type", "temperature"), ("type", "humidity")])) == ["s1", "s2", "s3", "s4"]
    assert names(t.query_and([])) == names(t.query_or([])) == []
    assert tuple(t.counts().first()) == (4, 4)
    t.write(str(tmp_path / "tags"))
    assert names(indexes.TagIndex.read(spark, str(tmp_path / "tags")).query("type", "humidity")) == ["s3"]


def test_bloom():
    shape = indexes.BloomShape.sized(1000, 0.01)
    b = indexes.Bloom(shape)
    for i in range(1000):
        b.insert(f"item{i}")
    assert all(b.might_contain(f"item{i}") for i in range(1000))
    assert sum(b.might_contain(f"item{i}") for i in range(1000, 2000)) < 30
    back = indexes.Bloom.from_bytes(b.to_bytes())
    assert back.items == 1000 and back.might_contain("item7") and abs(b.false_positives - 0.01) < 0.005
    b.clear()
    assert b.false_positives == 0 and not b.might_contain("item7")
    assert indexes.BloomShape.sized(0, 0.01) == indexes.BloomShape(1024, 1)
    with pytest.raises(CodecError):
        indexes.Bloom.from_bytes(b"x")


def test_bloom_in_spark_has_the_same_bits(spark):
    shape = indexes.BloomShape.sized(50, 0.01)
    got = spark.createDataFrame([("a",), ("ü1",), ("",)], "x string").select("x", shape.positions(__import__("pyspark").sql.functions.col("x")).alias("p")).collect()
    for r in got:
        assert list(r.p) == shape.positions_of(r.x)


def test_levelled_bloom():
    m = indexes.LevelledBloom(indexes.BloomShape.sized(10, 0.01))
    m.add(0, "x")
    m.finalize(0, 7)
    m.add(1, "y")
    m.finalize(1, 8)
    for f in (m, indexes.LevelledBloom.from_bytes(m.to_bytes())):
        assert f.file_might_contain("x") and f.chunk_might_contain(7, "x") and not f.chunk_might_contain(8, "x")
        assert not f.page_might_contain(9, "x") and not f.chunk_might_contain(9, "x")


CASES = [("gorilla", "f8"), ("gorilla", "f4"), ("gorilla", "i8"), ("chimp", "f8"), ("chimp", "f4"), ("sprintz", "i4"), ("sprintz", "i8"), ("sprintz", "f8"), ("sprintz", "f4"), ("sprintz_fire", "i8"), ("sprintz_fire", "i4"), ("simple8b", "i4"), ("simple8b", "i8")]


@pytest.mark.parametrize(("codec", "kind"), CASES)
@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_round_trips(codec, kind, data):
    if kind[0] == "f":
        numbers = st.floats(width=int(kind[1]) * 8)
    else:
        top = (1 << 58) if codec == "simple8b" and kind == "i8" else (1 << 8 * int(kind[1]) - 1) - 1
        numbers = st.one_of(st.integers(-top - (codec != "simple8b" or kind == "i4"), top), st.integers(-3, 3))
    values = data.draw(st.one_of(st.lists(numbers, max_size=60), st.builds(lambda v, n: [v] * n, numbers, st.integers(0, 300))))
    own = np.array(values, kind)
    encode, decode = bitcodecs.CODECS[codec]
    back = decode(encode(own, kind), kind)
    assert back.dtype == own.dtype and back.tobytes() == own.tobytes()


def test_simple8b_refuses_wide_numbers():
    with pytest.raises(CodecError):
        bitcodecs.simple8b_encode(np.array([1 << 60]))
    with pytest.raises(CodecError):
        bitcodecs.gorilla_decode(b"\x05\0\0\0\0")


@pytest.mark.parametrize(
    ("values", "pattern", "encoding", "compression"),
    [
        ([20.0, 20.1, 20.2, 20.1, 20.0], "Quantized", "QUANTIZED", "ZSTD"),
        ([20.0] * 100, "Quantized", "QUANTIZED", "ZSTD"),
        ([20.0] * 17 + [20.3, 20.7001, 21.2345], "HighRepetition", "DICTIONARY_RLE", "ZSTD"),
        ([20.012345, 20.098765, 20.145632, 20.9], "ContinuousDrift", "CHIMP128", "LZ4"),
        ([math.exp(i * 0.731) for i in range(20)], "HighEntropy", "CHIMP128", "LZ4"),
    ],
)
def test_patterns(spark, values, pattern, encoding, compression):
    r = analyzer.recommend(series(spark, values), ["s"], "v", "seq").first()
    assert (r.pattern, r.encoding, r.compression) == (pattern, encoding, compression)


def test_quantization_grid(spark):
    r = analyzer.quantization(series(spark, [20.0, 20.1, 20.2, 20.1, 20.0]), ["s"], "v", "seq").first()
    assert r.low == 20.0 and abs(r.step - 0.1) < 1e-9
    assert analyzer.quantization(series(spark, [20.012345, 20.098765, 20.145632]), ["s"], "v", "seq").first().step is None
    assert analyzer.quantization(series(spark, [1.0, 2.0]), ["s"], "v", "seq").first().step is None
