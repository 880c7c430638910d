"""Truth tables of predicates in Python, as Spark filters, and for pruning."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import InvalidState, TypeMismatch
from tidemark.operators import predicates as P
from tidemark.operators.scan import Series
from tidemark.types import DataType, Lit

D, I, T, B = DataType.DOUBLE, DataType.INT32, DataType.TEXT, DataType.BOOLEAN


def test_time_between():
    p = P.time_range(1000, 2000)
    assert [p.matches(t) for t in (500, 1000, 1500, 2000, 2500)] == [False, True, True, True, False]
    assert p.may_match(1500, 1800) and not p.may_match(100, 500) and not p.may_match(3000, 4000)
    assert p.negate() is p


def test_value_greater_with_null():
    p = P.measurement("t") > Lit.float64(25.0)
    assert [P.evaluate(p, 0, {"t": (v, D)}) for v in (30.0, 20.0, None)] == [True, False, False]
    assert p.may_match(20.0, 30.0, D) and not p.may_match(10.0, 20.0, D)


def test_and_or_nested():
    p = P.Time("gt", 1000) & (P.measurement("t") > Lit.float64(25.0))
    assert [P.evaluate(p, t, {"t": (v, D)}) for t, v in ((1500, 30.0), (500, 30.0), (1500, 20.0), (500, 20.0))] == [True, False, False, False]
    q = ((P.measurement("t") > Lit.float64(25.0)) & (P.measurement("h") > Lit.float64(50.0))) | (P.Time("lt", 1000) & (P.measurement("p") > Lit.float64(1000.0)))
    rows = [(1500, 30.0, 60.0, 900.0), (500, 20.0, 40.0, 1100.0), (500, 20.0, 60.0, 900.0)]
    assert [P.evaluate(q, t, {"t": (a, D), "h": (b, D), "p": (c, D)}) for t, a, b, c in rows] == [True, True, False]


def test_chunk_skip():
    p = P.Time("gt", 5000)
    assert [P.may_match(p, a, b, {}) for a, b in ((1000, 2000), (4000, 6000), (6000, 7000))] == [False, True, True]
    low, high = P.Time("gt", 5000), P.Time("lt", 2000)
    assert not P.may_match(P.And([P.Time("gte", 3000), P.Time("lte", 4000)]), 5000, 6000, {})
    assert P.may_match(low | high, 1000, 1500, {}) and not P.may_match(low | high, 2500, 4500, {})
    assert P.may_match(~low, 6000, 7000, {})


def test_equality_by_type():
    for kind, lit, yes, no in ((I, Lit.int32(42), 42, 43), (T, Lit.text("device001"), "device001", "device002"), (B, Lit.boolean(True), True, False)):
        p = P.Value("m", "eq", lit)
        assert P.evaluate(p, 0, {"m": (yes, kind)}) and not P.evaluate(p, 0, {"m": (no, kind)})
    assert not P.evaluate(P.Value("m", "eq", Lit.int64(42)), 0, {"m": (42, I)})
    assert P.evaluate(P.Value("m", "ne", Lit.int64(42)), 0, {"m": (42, I)})


def test_in_and_null_leaves():
    p = P.Value("m", "in", tuple(map(Lit.int32, (10, 20, 30))))
    assert [P.evaluate(p, 0, {"m": (v, I)}) for v in (10, 20, 30, 15, 40)] == [True, True, True, False, False]
    assert P.evaluate(P.measurement("m").is_null(), 0, {"m": (None, I)}) and not P.evaluate(P.measurement("m").is_null(), 0, {"m": (42, I)})
    assert P.evaluate(P.measurement("other").is_null(), 0, {"m": (42, I)})


def test_simplify():
    x, y, z = (P.Time("gt", k) for k in (1, 2, 3))
    assert P.And([x]).simplify() == x
    assert (~~x).simplify() == x
    assert P.And([P.And([x, y]), z]).simplify() == P.And([x, y, z])
    assert P.Or([P.Or([x]), P.And([y])]).simplify() == P.Or([x, y])


def test_negate_pairs():
    for op in ("gt", "gte", "lt", "lte", "eq", "ne"):
        assert P.Time(op, 5).negate().negate() == P.Time(op, 5)
    assert P.Value("m", "is_null").negate().op == "is_not_null"


def test_literals_are_checked():
    with pytest.raises(TypeMismatch):
        Lit.int32(1 << 31)


VALUES = [None, float("nan"), -1.0, 0.0, 1.5, 2.0, 7.0]


def leaves():
    numbers = st.sampled_from([0.0, 1.5, 2.0, 3.0, float("nan")])
    one = st.builds(lambda op, v: P.Value("v", op, Lit.float64(v)), st.sampled_from(["gt", "gte", "lt", "lte", "eq", "ne"]), numbers)
    many = st.builds(lambda op, v: P.Value("v", op, tuple(map(Lit.float64, v))), st.sampled_from(["in", "not_in"]), st.lists(numbers, max_size=3))
    odd = st.builds(lambda op: P.Value("v", op, Lit.int32(2)), st.sampled_from(["gt", "eq", "ne"]))
    null = st.sampled_from([P.measurement("v").is_null(), P.measurement("v").is_not_null(), P.measurement("w").is_null()])
    time = st.builds(lambda op, t: P.Time(op, t), st.sampled_from(["gt", "lte", "eq", "ne"]), st.integers(0, 6))
    return st.one_of(one, many, odd, null, time, st.just(P.time_range(2, 4)), st.just(P.Time("in", (1, 5))))


TREES = st.recursive(leaves(), lambda x: st.one_of(st.builds(P.And, st.lists(x, max_size=3)), st.builds(P.Or, st.lists(x, max_size=3)), st.builds(P.Not, x)), max_leaves=6)


@settings(max_examples=40, deadline=None)
@given(st.lists(TREES, min_size=8, max_size=8))
def test_spark_agrees_with_python(spark, trees):
    rows = [(i, v) for i, v in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "t long, v double")
    cols = {"v": (F.col("v"), D)}
    got = df.select("t", *[P.truth(p, F.col("t"), cols).alias(f"p{k}") for k, p in enumerate(trees)]).collect()
    for r in got:
        for k, p in enumerate(trees):
            assert r[f"p{k}"] == P.evaluate(p, r.t, {"v": (VALUES[r.t], D)}), (p, VALUES[r.t])


@settings(max_examples=200, deadline=None)
@given(TREES, st.lists(st.sampled_from(VALUES[2:]), min_size=1, max_size=4))
def test_pruning_never_loses(p, values):
    stats = {"v": (min(values), max(values), D)}
    if not P.may_match(p, 0, len(values) - 1, stats):
        assert not any(P.evaluate(p, t, {"v": (v, D)}) for t, v in enumerate(values))


def test_simplify_keeps_meaning():
    p = P.And([P.Or([P.Time("gt", 1)]), P.Not(P.Not(P.And([P.Time("lt", 5), P.Time("ne", 3)])))])
    assert [P.evaluate(p, t, {}) for t in range(7)] == [P.evaluate(p.simplify(), t, {}) for t in range(7)]


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id as ts", "cast(id as int) as value", "'d' as device_id", "'m' as measurement", "id as seq").write.parquet(str(tmp_path / "s"))
    s = Series.open(spark, str(tmp_path / "s"))
    plan = s.scan().device("d").measurement("m").time_range(5, 9).where_value("gt", Lit.int32(6)).execute()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,5)" in plan and "GreaterThan(value,6)" in plan
    negated = s.scan().device("d").measurement("m").where_predicate(~(P.measurement("m") > Lit.int32(6))).execute()._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(value),LessThanOrEqual(value,6))" in negated or "LessThanOrEqual(value,6)" in negated


def test_nan_is_in_no_order():
    assert not P.evaluate(P.measurement("v") > Lit.float64(0.0), 0, {"v": (math.nan, D)})
    assert P.evaluate(P.measurement("v") != Lit.float64(0.0), 0, {"v": (math.nan, D)})


def test_scan_builder_order(spark):
    df = spark.createDataFrame([("d", "m", 1, 2.0, 0)], "device_id string, measurement string, ts long, value double, seq long")
    s = Series(df)
    with pytest.raises(InvalidState):
        s.scan().device("d").where_value("gt", Lit.float64(1.0))
    with pytest.raises(InvalidState):
        s.scan().measurement("m").execute()
    with pytest.raises(InvalidState):
        s.scan().device("d").execute()
