"""The engine's queries over the driver's tables, and the SQL that gives the same rows.

``events`` is the long table: device ``user_id``, measurement ``event_type``, order ``event_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import analyzer, bitcodecs, codecs
from tidemark.model import MeasurementSchema, TableSchema
from tidemark.operators import indexes, split, stats
from tidemark.operators import predicates as P
from tidemark.operators.scan import Series
from tidemark.sources import series as io
from tidemark.streaming import live
from tidemark.types import Category, Compression, DataType, Encoding, Lit

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- tables

POINT = ["event_id", "ts", "user_id", "event_type", "value"]
COLS = "event_id, ts, user_id, event_type, value"
LOW, HIGH = "2024-01-05 00:00:00", "2024-01-20 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> Series:
    return Series(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "value", "event_id")


def at(text: str):
    """A time in the column's own type, so that comparisons reach Parquet."""
    return F.lit(text).cast("timestamp_ntz")


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a nullable value (every third is missing) and a whole number."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("gap", F.when(F.col("event_id") % 3 != 0, F.col("value"))).withColumn("whole", F.when(F.col("event_id") % 4 != 0, F.floor("value").cast("int")))


GAPS = "(SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS gap, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value) AS INTEGER) END AS whole FROM events)"


# ---- scans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series, a range of time and a value: all three reach the Parquet scan."""
    scan = events(spark, sf_dir).scan().device(8).measurement("click").time_range(at(LOW), at(HIGH)).where_value("gt", Lit.float64(10.0))
    return scan.execute().select(*POINT)


query(f"SELECT {COLS} FROM events WHERE user_id = 8 AND event_type = 'click' AND ts BETWEEN TIMESTAMP '{LOW}' AND TIMESTAMP '{HIGH}' AND value > 10.0", "fluent_scan")(flagship)


@query(f"SELECT {COLS} FROM events WHERE user_id = 17 AND event_type = 'click'")
def scan_series(spark, d):
    return events(spark, d).read(17, "click").select(*POINT)


@query(f"SELECT {COLS} FROM events WHERE user_id = 17 AND event_type = 'click' AND ts BETWEEN TIMESTAMP '{LOW}' AND TIMESTAMP '{HIGH}'")
def scan_time_range(spark, d):
    return events(spark, d).read_time_range(17, "click", at(LOW), at(HIGH)).select(*POINT)


@query(f"SELECT {COLS} FROM events WHERE false")
def scan_inverted_range(spark, d):
    return events(spark, d).read_time_range(17, "click", at(HIGH), at(LOW)).select(*POINT)


@query("SELECT DISTINCT user_id FROM events")
def devices(spark, d):
    return events(spark, d).devices()


@query("SELECT DISTINCT event_type FROM events WHERE user_id = 8")
def measurements(spark, d):
    return events(spark, d).measurements(8)


@query("SELECT count(DISTINCT user_id) AS devices, count(DISTINCT (user_id, event_type)) AS series, count(value) AS points, min(ts) AS start, max(ts) AS \"end\" FROM events")
def file_info(spark, d):
    return events(spark, d).info()


@query("SELECT user_id, event_type, count(*) AS points, min(ts) AS start, max(ts) AS \"end\" FROM events WHERE value IS NOT NULL GROUP BY ALL")
def series_catalog(spark, d):
    return events(spark, d).catalog()


@query("SELECT count(*) AS points FROM events WHERE user_id = 17 AND event_type = 'click'")
def count_points(spark, d):
    return events(spark, d).count(17, "click")


@query(f"SELECT {COLS} FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE user_id = 17 AND event_type = 'click') WHERE n = 6")
def get_by_index(spark, d):
    return events(spark, d).get(17, "click", 5).select(*POINT)


@query(f"SELECT {COLS} FROM events WHERE false")
def get_beyond_end(spark, d):
    return events(spark, d).get(17, "click", 10**6).select(*POINT)


@query(f"SELECT {COLS} FROM events WHERE user_id = 8")
def read_device(spark, d):
    return events(spark, d).read_device(8).select(*POINT)


KINDS = ["click", "view", "purchase", "signup", "error"]
WIDE = "SELECT user_id, ts, " + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events {where} GROUP BY user_id, ts"


@query(WIDE.format(where="WHERE user_id = 8"))
def device_wide(spark, d):
    return events(spark, d).query().device(8).execute_batch(KINDS)


@query(WIDE.format(where=""))
def all_wide(spark, d):
    return events(spark, d).wide(KINDS)


@query("SELECT ts, value FROM events WHERE user_id = 17 AND event_type = 'view'")
def typed_query(spark, d):
    return events(spark, d).query().device(17).measurement("view").execute()


_DAILY = "SELECT user_id, date_trunc('day', ts) AS ts, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL"


@query(f"SELECT * FROM ({_DAILY}) WHERE click IS NOT NULL AND view IS NOT NULL")
def align_inner(spark, d):
    e = events(spark, d)
    days = Series(e.df.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")), "user_id", "event_type", "ts", "value", "event_id")
    return days.align(["click", "view"], "inner")


@query(_DAILY)
def align_outer(spark, d):
    e = events(spark, d)
    days = Series(e.df.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")), "user_id", "event_type", "ts", "value", "event_id")
    return days.align(["click", "view"])


# ---- predicates


def _filtered(p, extra=()):
    def run(spark, d):
        g = gaps(spark, d)
        values = {"gap": (F.col("gap"), DataType.DOUBLE), "whole": (F.col("whole"), DataType.INT32), "kind": (F.col("event_type"), DataType.TEXT)}
        return g.where(P.condition(p() if callable(p) else p, F.col("ts"), values)).select("event_id", "gap", "whole")

    return run


def _pred(name: str, p, where: str) -> None:
    query(f"SELECT event_id, gap, whole FROM {GAPS} WHERE {where}", name)(_filtered(p))


_T = "2024-01-11 08:56:20.125"
_TIMES = "(SELECT ts FROM events WHERE event_id IN (3, 77, 150))"
for _op, _sql in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="), ("eq", "="), ("ne", "<>")):
    _pred(f"time_filter_{_op}", lambda _op=_op: P.Time(_op, at("2024-01-01 00:00:07.179575")), f"ts {_sql} TIMESTAMP '2024-01-01 00:00:07.179575'")
    _pred(f"value_filter_{_op}", P.Value("gap", _op, Lit.float64(6.55)), f"coalesce(gap {_sql} 6.55, false)")
    _pred(f"value_filter_int_{_op}", P.Value("whole", _op, Lit.int32(7)), f"coalesce(whole {_sql} 7, false)")
    _pred(f"value_filter_text_{_op}", P.Value("kind", _op, Lit.text("error")), f"event_type {_sql} 'error'")
    _pred(f"pred_not_{_op}", ~P.Value("gap", _op, Lit.float64(6.55)), f"NOT coalesce(gap {_sql} 6.55, false)")
_pred("time_filter_between", lambda: P.time_range(at(LOW), at(HIGH)), f"ts BETWEEN TIMESTAMP '{LOW}' AND TIMESTAMP '{HIGH}'")
_pred("time_filter_in", lambda: P.Time("in", (at("2024-01-01 00:00:07.179575"), at("2024-01-01 00:03:52.824425"))), "ts IN (TIMESTAMP '2024-01-01 00:00:07.179575', TIMESTAMP '2024-01-01 00:03:52.824425')")
_pred("time_filter_not_in", lambda: P.Time("not_in", (at("2024-01-01 00:00:07.179575"), at("2024-01-01 00:03:52.824425"))), "ts NOT IN (TIMESTAMP '2024-01-01 00:00:07.179575', TIMESTAMP '2024-01-01 00:03:52.824425')")
_pred("time_in_empty", P.Time("in", ()), "false")
_pred("time_not_in_empty", P.Time("not_in", ()), "true")
_pred("time_negate", lambda: P.Time("gt", at(LOW)).negate(), f"ts <= TIMESTAMP '{LOW}'")
_pred("pred_not_between", lambda: ~P.time_range(at(LOW), at(HIGH)), f"NOT (ts BETWEEN TIMESTAMP '{LOW}' AND TIMESTAMP '{HIGH}')")
_pred("value_filter_in", P.Value("whole", "in", (Lit.int32(3), Lit.int32(9), Lit.int32(11))), "coalesce(whole IN (3, 9, 11), false)")
_pred("value_filter_not_in", P.Value("whole", "not_in", (Lit.int32(3), Lit.int32(9), Lit.int32(11))), "coalesce(whole NOT IN (3, 9, 11), false)")
_pred("value_in_empty", P.Value("whole", "in", ()), "false")
_pred("value_not_in_empty", P.Value("whole", "not_in", ()), "whole IS NOT NULL")
_pred("value_is_null", P.Value("gap", "is_null"), "gap IS NULL")
_pred("value_is_not_null", P.Value("gap", "is_not_null"), "gap IS NOT NULL")
_pred("value_negate_is_null", P.Value("gap", "is_null").negate(), "gap IS NOT NULL")
_pred("pred_and", P.measurement("gap") > Lit.float64(5.0), "coalesce(gap > 5.0, false)")
_pred("pred_and_two", (P.measurement("gap") > Lit.float64(5.0)) & (P.measurement("whole") < Lit.int32(20)), "coalesce(gap > 5.0, false) AND coalesce(whole < 20, false)")
_pred("pred_or", (P.measurement("gap") > Lit.float64(100.0)) | P.measurement("whole").is_null(), "coalesce(gap > 100.0, false) OR whole IS NULL")
_pred("pred_nested", lambda: ~(P.And([P.measurement("gap") > Lit.float64(3.0), P.measurement("whole") < Lit.int32(40)]) | P.Time("lt", at(LOW))), f"NOT ((coalesce(gap > 3.0, false) AND coalesce(whole < 40, false)) OR ts < TIMESTAMP '{LOW}')")
_pred("pred_not_in_inside_not", ~P.Value("whole", "not_in", (Lit.int32(1), Lit.int32(2))), "NOT coalesce(whole NOT IN (1, 2), false)")
_pred("pred_empty_and", P.And([]), "true")
_pred("pred_empty_or", P.Or([]), "false")
_pred("pred_not_empty_and", ~P.And([]), "false")
_pred("pred_type_mismatch_eq", P.Value("whole", "eq", Lit.int64(7)), "false")
_pred("pred_type_mismatch_ne", P.Value("whole", "ne", Lit.int64(7)), "whole IS NOT NULL")
_pred("pred_type_mismatch_not_gt", ~P.Value("whole", "gt", Lit.float64(7.0)), "true")
_pred("pred_absent_measurement", P.measurement("humidity") > Lit.float64(1.0), "false")
_pred("pred_absent_is_null", P.measurement("humidity").is_null(), "true")


def _nan(spark, d):
    return gaps(spark, d).select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("gap")).alias("v"))


_NAN = f"(SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'nan'::DOUBLE ELSE gap END AS v FROM {GAPS})"
for _name, _p, _where in (
    ("gt", P.Value("v", "gt", Lit.float64(5.0)), "coalesce(v > 5 AND NOT isnan(v), false)"),
    ("not_gt", ~P.Value("v", "gt", Lit.float64(5.0)), "NOT coalesce(v > 5 AND NOT isnan(v), false)"),
    ("ne", P.Value("v", "ne", Lit.float64(6.55)), "v IS NOT NULL AND (isnan(v) OR v <> 6.55)"),
    ("not_ne", ~P.Value("v", "ne", Lit.float64(6.55)), "NOT (v IS NOT NULL AND (isnan(v) OR v <> 6.55))"),
    ("literal_eq", P.Value("v", "eq", Lit.float64(float("nan"))), "false"),
    ("literal_ne", P.Value("v", "ne", Lit.float64(float("nan"))), "v IS NOT NULL"),
):
    query(f"SELECT event_id FROM {_NAN} WHERE {_where}", f"pred_nan_{_name}")(lambda spark, d, _p=_p: _nan(spark, d).where(P.condition(_p, F.lit(0), {"v": (F.col("v"), DataType.DOUBLE)})).select("event_id"))


@query(f"SELECT event_id, NOT coalesce(gap > 5.0, false) AS holds FROM {GAPS}")
def pred_truth_column(spark, d):
    return gaps(spark, d).select("event_id", P.truth(~P.Value("gap", "gt", Lit.float64(5.0)), F.col("ts"), {"gap": (F.col("gap"), DataType.DOUBLE)}).alias("holds"))


@query(f"SELECT * FROM ({_DAILY}) WHERE coalesce(click > 20.0, false) AND view IS NULL")
def pred_cross_measurement(spark, d):
    p = (P.measurement("click") > Lit.float64(20.0)) & P.measurement("view").is_null()
    return align_outer(spark, d).where(P.condition(p, F.col("ts"), {m: (F.col(m), DataType.DOUBLE) for m in ("click", "view")}))


@query("SELECT 0::BIGINT AS differing")
def pred_simplify(spark, d):
    raw = P.And([P.And([P.measurement("gap") > Lit.float64(3.0)]), ~~P.Or([P.Or([P.measurement("whole") < Lit.int32(40), P.measurement("gap").is_null()])])])
    a, b = (_filtered(p)(spark, d).select("event_id") for p in (raw, raw.simplify()))
    return a.exceptAll(b).union(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("differing"))


# ---- statistics


def _stats(kind: DataType, value) -> Callable:
    def run(spark, d):
        rows = gaps(spark, d).withColumn("v", value())
        return stats.statistics(rows, ["user_id"], kind, "v", "ts", "event_id").drop("first_seq", "last_seq")

    return run


def _stats_sql(v: str, total: str | None, bounds: bool) -> str:
    extra = (f", {total} AS total" if total else "") + (", min(v) AS low, max(v) AS high" if bounds else "")
    return f"SELECT user_id, count(v) AS n, min(ts) FILTER (v IS NOT NULL) AS start, max(ts) FILTER (v IS NOT NULL) AS \"end\", arg_min(v, event_id) FILTER (v IS NOT NULL) AS first, arg_max(v, event_id) FILTER (v IS NOT NULL) AS last{extra} FROM (SELECT *, {v} AS v FROM {GAPS}) GROUP BY user_id"


for _name, _kind, _col, _sql in (
    ("int", DataType.INT32, lambda: F.col("whole"), _stats_sql("whole", "sum(v)::BIGINT", True)),
    ("long", DataType.INT64, lambda: F.col("event_id") * 1000, _stats_sql("event_id * 1000", "sum(v::DOUBLE)", True)),
    ("bool", DataType.BOOLEAN, lambda: F.col("gap") > 10, _stats_sql("gap > 10", "sum(v::INTEGER)::BIGINT", False)),
    ("text", DataType.TEXT, lambda: F.col("event_type"), _stats_sql("event_type", None, False)),
):
    query(_sql, f"stats_{_name}")(_stats(_kind, _col))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.round("total", 4))


@query(_stats_sql("gap", "round(sum(v), 4)", True))
def stats_double(spark, d):
    return _rounded(_stats(DataType.DOUBLE, lambda: F.col("gap"))(spark, d))


@query(f"SELECT user_id, count(v) AS n, bool_or(isnan(v)) AS nan_total, CASE WHEN NOT bool_or(isnan(v)) THEN round(sum(v), 4) END AS total, min(v) FILTER (NOT isnan(v)) AS low, max(v) FILTER (NOT isnan(v)) AS high FROM (SELECT e.user_id, n.v FROM {_NAN} n JOIN events e USING (event_id)) GROUP BY user_id")
def stats_nan_bounds(spark, d):
    """NaN is in a total, which it makes NaN, and in no bound."""
    rows = _nan(spark, d).join(table(spark, d, "events").select("event_id", "user_id", "ts"), "event_id")
    full = stats.statistics(rows, ["user_id"], DataType.DOUBLE, "v", "ts", "event_id")
    return full.select("user_id", "n", F.isnan("total").alias("nan_total"), F.when(~F.isnan("total"), F.round("total", 4)).alias("total"), "low", "high")


@query(_stats_sql("value", "round(sum(v), 4)", True))
def stats_merge(spark, d):
    """Blocks of 16 points, then series, then devices: the same as over the points."""
    blocks = stats.manifest(table(spark, d, "events"), ["user_id", "event_type"], DataType.DOUBLE, 16, "value", "ts", "event_id")
    by_series = stats.merge(blocks.drop("block"), ["user_id", "event_type"])
    return _rounded(stats.merge(by_series.drop("event_type"), ["user_id"]).drop("first_seq", "last_seq"))


@query("SELECT count(value) AS n, min(ts) AS start, max(ts) AS \"end\" FROM events")
def stats_file(spark, d):
    return stats.statistics(table(spark, d, "events"), [], DataType.DOUBLE, "value", "ts", "event_id").select("n", "start", "end")


_BLOCKS = "(SELECT *, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS INTEGER) AS block FROM events)"


@query(f"SELECT user_id, block, count(*) AS points, min(ts) AS start, max(ts) AS \"end\" FROM {_BLOCKS} GROUP BY ALL")
def page_blocks(spark, d):
    b = stats.blocks_of(table(spark, d, "events"), ["user_id"], 16, "event_id")
    return b.groupBy("user_id", "block").agg(F.count(F.lit(1)).alias("points"), F.min("ts").alias("start"), F.max("ts").alias("end"))


@query("""SELECT event_type, mini_block, count(*) AS points, min(event_id) AS first_id, max(event_id) AS last_id FROM (
  SELECT event_type, event_id, CAST(CASE WHEN t < 250 THEN 0 WHEN t // 8 >= 250 THEN ntile(8) OVER w - 1 ELSE CASE t // 250
    WHEN 1 THEN 0 WHEN 2 THEN ntile(2) OVER w - 1 WHEN 3 THEN ntile(3) OVER w - 1 WHEN 4 THEN ntile(4) OVER w - 1 WHEN 5 THEN ntile(5) OVER w - 1 WHEN 6 THEN ntile(6) OVER w - 1
    WHEN 7 THEN ntile(7) OVER w - 1 ELSE ntile(8) OVER w - 1 END END AS INTEGER) AS mini_block
  FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS t FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY event_id)
) GROUP BY ALL""")
def miniblock_split(spark, d):
    m = stats.mini_blocks(table(spark, d, "events"), ["event_type"], "event_id")
    return m.groupBy("event_type", "mini_block").agg(F.count(F.lit(1)).alias("points"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


_MANIFEST = f"(SELECT user_id, block, count(*) AS n, min(ts) AS start, max(ts) AS \"end\", min(value) AS low, max(value) AS high FROM {_BLOCKS} GROUP BY ALL)"


def _manifest(spark, d):
    return stats.manifest(table(spark, d, "events"), ["user_id"], DataType.DOUBLE, 16, "value", "ts", "event_id")


@query(f"SELECT user_id, block, n FROM {_MANIFEST} WHERE start <= TIMESTAMP '{HIGH}' AND \"end\" >= TIMESTAMP '{LOW}'")
def prune_blocks_time(spark, d):
    return stats.prune(_manifest(spark, d), P.time_range(at(LOW), at(HIGH)), "value", DataType.DOUBLE).select("user_id", "block", "n")


@query(f"SELECT user_id, block, n FROM {_MANIFEST} WHERE high > 120.0 OR (low <= 0.5 AND high >= 0.5)")
def prune_blocks_value(spark, d):
    p = (P.measurement("value") > Lit.float64(120.0)) | (P.measurement("value") == Lit.float64(0.5))
    return stats.prune(_manifest(spark, d), p, "value", DataType.DOUBLE).select("user_id", "block", "n")


@query(f"SELECT user_id, block, n FROM {_MANIFEST}")
def prune_blocks_not(spark, d):
    return stats.prune(_manifest(spark, d), ~(P.measurement("value") > Lit.float64(0.0)), "value", DataType.DOUBLE).select("user_id", "block", "n")


@query("SELECT 0::BIGINT AS lost")
def prune_is_sound(spark, d):
    """Matches in blocks that pruning would drop."""
    p = (P.measurement("value") > Lit.float64(120.0)) & P.Time("gte", at(LOW))
    kept = stats.prune(_manifest(spark, d), p, "value", DataType.DOUBLE).select("user_id", "block")
    rows = stats.blocks_of(table(spark, d, "events"), ["user_id"], 16, "event_id").where(P.condition(p, F.col("ts"), {"value": (F.col("value"), DataType.DOUBLE)}))
    return rows.join(kept, ["user_id", "block"], "left_anti").agg(F.count(F.lit(1)).alias("lost"))


@query("SELECT o_custkey, o_orderkey, o_orderdate, previous FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE o_orderdate <= previous")
def aligned_violations(spark, d):
    return stats.violations(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate", "previous")


# ---- indexes

_TAGS = "(SELECT p_partkey AS device, key, value FROM (SELECT p_partkey, p_brand, p_type, p_size::VARCHAR AS p_size FROM part) UNPIVOT (value FOR key IN (p_brand, p_type, p_size)))"


def tags(spark, d) -> indexes.TagIndex:
    return indexes.TagIndex.of(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])


@query("SELECT p_partkey AS device FROM part WHERE p_brand = 'Brand#2'")
def tag_query(spark, d):
    return tags(spark, d).query("p_brand", "Brand#2")


@query("SELECT p_partkey AS device FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'")
def tag_and(spark, d):
    return tags(spark, d).query_and([("p_brand", "Brand#2"), ("p_type", "ECONOMY")])


@query("SELECT p_partkey AS device FROM part WHERE p_brand = 'Brand#2' OR p_size = 11")
def tag_or(spark, d):
    return tags(spark, d).query_or([("p_brand", "Brand#2"), ("p_size", "11")])


@query("SELECT p_partkey AS device FROM part WHERE false")
def tag_and_empty(spark, d):
    return tags(spark, d).query_and([])


@query("SELECT p_partkey AS device FROM part WHERE false")
def tag_or_empty(spark, d):
    return tags(spark, d).query_or([])


@query(f"SELECT count(DISTINCT device) AS devices, count(DISTINCT (key, value)) AS tags FROM {_TAGS}")
def tag_counts(spark, d):
    return tags(spark, d).counts()


@query(f"SELECT key, value, count(DISTINCT device) AS devices FROM {_TAGS} GROUP BY ALL")
def tag_bitmap_count(spark, d):
    return tags(spark, d).bitmaps("device").groupBy("key", "value").agg(F.sum("devices").alias("devices"))


@query("SELECT s_suppkey, s_name, s_acctbal AS value FROM supplier")
def key_lookup(spark, d):
    s = table(spark, d, "supplier")
    index = indexes.key_index(s, "s_name", "s_acctbal", "s_suppkey")
    return indexes.lookup(index, s.select("s_suppkey", "s_name"), "s_name")


@query("SELECT event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def key_last_write_wins(spark, d):
    return indexes.key_index(table(spark, d, "events"), "event_type", "value", "event_id")


@query("SELECT k AS key, c_custkey AS value FROM (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN repeat(c_name, 20) ELSE c_name END AS k FROM customer) WHERE strlen(k) <= 256")
def key_too_long(spark, d):
    c = table(spark, d, "customer").withColumn("k", F.when(F.col("c_custkey") % 10 == 0, F.repeat("c_name", 20)).otherwise(F.col("c_name")))
    return indexes.key_index(c, "k", "c_custkey", "c_custkey")


@query("""SELECT n, p, CAST(greatest(1, ceil(-n * ln(p) / (ln(2) * ln(2)))) AS BIGINT) AS bits,
  CAST(least(10, greatest(1, ceil(greatest(1, ceil(-n * ln(p) / (ln(2) * ln(2)))) / n * ln(2)))) AS INTEGER) AS hashes
FROM (VALUES (1000::BIGINT, 0.01::DOUBLE), (10, 0.001), (100000, 0.05), (1, 0.5)) t(n, p)""")
def bloom_sizing(spark, d):
    rows = [(n, p, (s := indexes.BloomShape.sized(n, p)).bits, s.hashes) for n, p in ((1000, 0.01), (10, 0.001), (100000, 0.05), (1, 0.5))]
    return spark.createDataFrame(rows, "n long, p double, bits long, hashes int")


@query("SELECT event_type, count(DISTINCT user_id) AS found FROM events GROUP BY event_type")
def bloom_no_false_negatives(spark, d):
    """Devices of each measurement that its own filter contains: all of them."""
    e = table(spark, d, "events")
    shape = indexes.BloomShape.sized(1000, 0.01)
    hits = indexes.bloom_probe(indexes.bloom_bits(e, "user_id", shape, ["event_type"]), e, "user_id", shape, ["event_type"])
    own = e.select("event_type", "user_id").distinct()
    return hits.join(own, ["event_type", "user_id"], "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("found"))


@query(f"""SELECT b.user_id, b.block, b.value, TRUE AS few FROM (SELECT DISTINCT user_id, block, value FROM {_BLOCKS}) b
  JOIN (SELECT DISTINCT value FROM (SELECT min(value) AS value FROM events GROUP BY event_type)) w ON b.value = w.value""")
def bloom_prune_blocks(spark, d):
    """Blocks that hold the least value of some measurement, looked for in the filters of devices, then of blocks.

    Every block that holds one is found; ``few`` says whether at most 3 % of all other pairs are.
    """
    shape = indexes.BloomShape.sized(64, 0.01)
    e = table(spark, d, "events")
    rows = stats.blocks_of(e, ["user_id"], 16, "event_id").select("user_id", "block", "value")
    bits = indexes.bloom_bits(rows, "value", shape, ["user_id", "block"])
    wanted = e.groupBy("event_type").agg(F.min("value").alias("value")).select("value").distinct()
    chunks = indexes.bloom_probe(indexes.bloom_union(bits, ["user_id"]), wanted, "value", shape, ["user_id"]).select("user_id").distinct()
    found = indexes.bloom_probe(bits.join(chunks, "user_id", "left_semi"), wanted, "value", shape, ["user_id", "block"])
    true = rows.distinct().withColumn("_true", F.lit(True))
    marked = found.join(true, ["user_id", "block", "value"], "left")
    share = bits.select("user_id", "block").distinct().agg(F.count(F.lit(1)).alias("_filters")).join(wanted.agg(F.count(F.lit(1)).alias("_asked")), how="cross").join(marked.where("_true is null").agg(F.count(F.lit(1)).alias("_wrong")), how="cross")  # one row each
    few = share.select((F.col("_wrong") <= 0.03 * F.col("_filters") * F.col("_asked")).alias("few"))
    return marked.where("_true").drop("_true").join(F.broadcast(few), how="cross")


@query("SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS id FROM (SELECT o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY 1)")
def global_dictionary(spark, d):
    return indexes.dictionary(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


# ---- encodings

_RUNS = """(SELECT l_suppkey, run, any_value(l_returnflag) AS l_returnflag, count(*) AS length FROM (
  SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY k) AS run FROM (
    SELECT *, CASE WHEN l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS new
    FROM (SELECT *, l_orderkey * 10 + l_linenumber AS o, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k FROM lineitem)
    WINDOW w AS (PARTITION BY l_suppkey ORDER BY k))) GROUP BY l_suppkey, run)"""


def _lines(spark, d):
    ties = ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    return split.placed(table(spark, d, "lineitem"), ["l_suppkey"], "l_orderkey", "k", ties).withColumn("k", F.col("k") + 1)


@query(f"SELECT l_suppkey, CAST(run AS BIGINT) AS run, l_returnflag, length FROM {_RUNS}")
def enc_rle(spark, d):
    return codecs.rle_encode(_lines(spark, d), ["l_suppkey"], "l_returnflag", "k")


@query("SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS place, l_returnflag FROM lineitem")
def dec_rle(spark, d):
    return codecs.rle_decode(enc_rle(spark, d), ["l_suppkey"], "l_returnflag")


_IDS = "(SELECT o_custkey, o_orderkey, o_orderpriority, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY f) - 1 AS INTEGER) AS id FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS f FROM orders))"


@query(f"SELECT o_custkey, o_orderkey, id FROM {_IDS}")
def enc_dictionary(spark, d):
    return codecs.dictionary_ids(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey").select("o_custkey", "o_orderkey", "id")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders")
def dec_dictionary(spark, d):
    coded = codecs.dictionary_ids(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")
    entries = codecs.dictionary_of(coded, ["o_custkey"], "o_orderpriority")
    return codecs.dictionary_decode(coded.select("o_custkey", "o_orderkey", "id"), entries, ["o_custkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events")
def enc_delta(spark, d):
    return codecs.delta(table(spark, d, "events"), ["user_id"], "event_id", "event_id").select("user_id", "event_id", "delta")


_DOD = "(SELECT user_id, event_id, m, coalesce(dl - lag(dl) OVER w, dl, m) AS code FROM (SELECT *, m - lag(m) OVER (PARTITION BY user_id ORDER BY event_id) AS dl FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS m FROM events)) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


def _millis(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", live.epoch_millis(F.col("ts")).alias("m"))


@query(f"SELECT user_id, event_id, code FROM {_DOD}")
def enc_delta_of_delta(spark, d):
    return codecs.delta_of_delta(_millis(spark, d), ["user_id"], "m", "event_id").select("user_id", "event_id", "code")


@query("SELECT user_id, event_id, epoch_us(ts) // 1000 AS m FROM events")
def dec_delta_of_delta(spark, d):
    return codecs.delta_of_delta_decode(enc_delta_of_delta(spark, d), ["user_id"], "code", "event_id", "m").select("user_id", "event_id", "m")


@query(f"SELECT user_id, event_id, xor(code << 1, code >> 63) AS z FROM (SELECT user_id, event_id, CAST(code AS BIGINT) AS code FROM {_DOD}) WHERE code >= 0 UNION ALL SELECT user_id, event_id, -2 * code - 1 FROM {_DOD} WHERE code < 0")
def enc_zigzag(spark, d):
    return enc_delta_of_delta(spark, d).select("user_id", "event_id", codecs.zigzag(F.col("code")).alias("z"))


@query(f"SELECT user_id, event_id, code FROM {_DOD}")
def dec_zigzag(spark, d):
    return enc_zigzag(spark, d).select("user_id", "event_id", codecs.unzigzag(F.col("z")).alias("code"))


@query(f"SELECT user_id, event_id, CAST(ceil(length(bin(CASE WHEN code >= 0 THEN 2 * code ELSE -2 * code - 1 END)) / 7.0) AS INTEGER) AS bytes FROM {_DOD}")
def varint_size(spark, d):
    return enc_zigzag(spark, d).select("user_id", "event_id", codecs.varint_bytes(F.col("z")).alias("bytes"))


def _quantized(spark, d):
    e = table(spark, d, "events")
    grid = e.groupBy("user_id").agg(F.min("value").alias("low")).withColumn("step", F.lit(0.01))
    return codecs.quantized(e, grid, ["user_id"], "value")


_QUANT = "(SELECT user_id, event_id, value, low, CAST(round((value - low) / 0.01) AS BIGINT) AS index FROM events JOIN (SELECT user_id, min(value) AS low FROM events GROUP BY 1) USING (user_id))"


@query(f"SELECT user_id, event_id, index FROM {_QUANT}")
def enc_quantized(spark, d):
    return _quantized(spark, d).select("user_id", "event_id", "index")


@query(f"SELECT user_id, event_id, round(low + index * 0.01, 6) AS restored FROM {_QUANT}")
def dec_quantized(spark, d):
    return _quantized(spark, d).select("user_id", "event_id", F.round("restored", 6).alias("restored"))


@query(f"SELECT user_id, max(abs(low + index * 0.01 - value)) < 1e-6 AS exact FROM {_QUANT} GROUP BY user_id")
def quant_error(spark, d):
    return _quantized(spark, d).groupBy("user_id").agg((F.max("error") < 1e-6).alias("exact"))


_DRLE = """(WITH c AS (SELECT l_suppkey, k, l_tax, CAST(dense_rank() OVER (PARTITION BY l_suppkey ORDER BY f) - 1 AS INTEGER) AS id FROM (
  SELECT *, min(k) OVER (PARTITION BY l_suppkey, l_tax) AS f FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k FROM lineitem)))
SELECT l_suppkey, run, any_value(id) AS id, any_value(l_tax) AS l_tax, count(*) AS length FROM (
  SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY k) AS run FROM (SELECT *, CASE WHEN id <> lag(id) OVER (PARTITION BY l_suppkey ORDER BY k) THEN 1 ELSE 0 END AS new FROM c)) GROUP BY l_suppkey, run)"""


@query(f"SELECT l_suppkey, CAST(run AS BIGINT) AS run, id, l_tax, length FROM {_DRLE}")
def enc_dictionary_rle(spark, d):
    return codecs.dictionary_rle(_lines(spark, d), ["l_suppkey"], "l_tax", "k")


def _blocks(spark, d):
    return stats.blocks_of(table(spark, d, "events"), ["event_type"], 512, "event_id").select("event_type", "block", "event_id", "value", (F.col("value") * 100).cast("long").alias("cents"), F.col("user_id").cast("int").alias("user"), F.col("value").cast("float").alias("small"), (F.floor(F.col("value") * 10) / 10).alias("grid"), (F.col("value") > 50).alias("high"))


_PLACES = "SELECT event_type, block, row_number() OVER (PARTITION BY event_type, block ORDER BY event_id) - 1 AS place, {col} FROM (SELECT *, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 512 AS INTEGER) AS block FROM events)"
for _codec, _col, _type, _sql in (
    ("gorilla", "value", "double", "value"), ("gorilla", "small", "float", "CAST(value AS FLOAT) AS small"), ("chimp", "value", "double", "value"), ("chimp", "small", "float", "CAST(value AS FLOAT) AS small"),
    ("simple8b", "user", "int", 'CAST(user_id AS INTEGER) AS "user"'), ("sprintz", "user", "int", 'CAST(user_id AS INTEGER) AS "user"'), ("sprintz", "value", "double", "value"), ("sprintz_fire", "user", "int", 'CAST(user_id AS INTEGER) AS "user"'),
    ("quantized", "grid", "double", "floor(value * 10) / 10 AS grid"), ("gorilla_bool", "high", "boolean", "value > 50 AS high"),
):

    def _round_trip(spark, d, _codec=_codec, _col=_col, _type=_type):
        coded = bitcodecs.encode_blocks(_blocks(spark, d), ["event_type", "block"], _col, "event_id", _codec)
        return bitcodecs.decode_blocks(coded, ["event_type", "block"], _col, _type, _codec)

    query(_PLACES.format(col=_sql), f"roundtrip_{_codec}_{_col}")(_round_trip)


_XORS = """(SELECT event_type, xor(cents, lag(cents) OVER (PARTITION BY event_type, block ORDER BY event_id)) AS x FROM (
  SELECT event_type, event_id, CAST(trunc(value * 100) AS BIGINT) AS cents, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 512 AS INTEGER) AS block FROM events))"""


@query(f"""SELECT event_type, count(*) AS n, count(*) FILTER (x = 0) AS same, sum(CASE WHEN x = 0 THEN 64 WHEN x < 0 THEN 0 ELSE 64 - length(bin(x)) END)::BIGINT AS lead,
  sum(CASE WHEN x = 0 THEN 64 ELSE length(bin(x & -x)) - 1 END)::BIGINT AS trail FROM {_XORS} WHERE x IS NOT NULL GROUP BY event_type""")
def xor_residual_stats(spark, d):
    """How many whole numbers repeat, and the zeros around XORs, by measurement."""
    p = bitcodecs.xor_profile(_blocks(spark, d), ["event_type", "block"], "cents", "event_id")
    return p.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("same").cast("long")).alias("same"), F.sum(F.col("lead").cast("long")).alias("lead"), F.sum(F.col("trail").cast("long")).alias("trail"))


_RESIDUAL = "(SELECT event_type, event_id, d, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z FROM (SELECT event_type, event_id, user_id - coalesce(lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id), 0) AS d FROM events))"


def _residuals(spark, d):
    e = codecs.delta(table(spark, d, "events"), ["event_type"], "user_id", "event_id").select("event_type", "event_id", F.coalesce("delta", "user_id").alias("d"))
    return e.withColumn("z", codecs.zigzag(F.col("d")))


@query(f"SELECT event_type, event_id, z FROM {_RESIDUAL}")
def sprintz_delta_residuals(spark, d):
    return _residuals(spark, d).select("event_type", "event_id", "z")


@query(f"SELECT event_type, CAST(CASE WHEN z = 0 THEN 0 ELSE length(bin(z)) END AS INTEGER) AS bits, count(*) AS n FROM {_RESIDUAL} GROUP BY ALL")
def bit_width_histogram(spark, d):
    """How many residuals need how many bits: what a word-packing codec's size follows from."""
    bits = F.when(F.col("z") == 0, 0).otherwise(F.length(F.bin("z"))).alias("bits")
    return _residuals(spark, d).groupBy("event_type", bits).agg(F.count(F.lit(1)).alias("n"))


@query()
def simple8b_words(spark, d):
    """Words and points of each block of whole numbers."""
    coded = bitcodecs.encode_blocks(_blocks(spark, d), ["event_type", "block"], "cents", "event_id", "simple8b")
    return coded.select("event_type", "block", "points", ((F.octet_length("code") - 4) / 8).cast("long").alias("words"))


@query()
def encoded_sizes(spark, d):
    """Bytes of each measurement's values under each codec."""
    rows, out = _blocks(spark, d), None
    for codec, col in (("gorilla", "value"), ("chimp", "value"), ("simple8b", "cents"), ("sprintz", "cents"), ("sprintz_fire", "cents")):
        one = bitcodecs.encode_blocks(rows, ["event_type", "block"], col, "event_id", codec).groupBy("event_type").agg(F.sum("points").alias("points"), F.sum(F.octet_length("code")).alias("bytes")).withColumn("codec", F.lit(codec))
        out = one if out is None else out.unionByName(one)
    return out


# ---- analysis

_GRID = """d AS (SELECT user_id, event_id, value AS v, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS dv FROM events WHERE value IS NOT NULL),
g AS (SELECT user_id, count(*) AS n, min(v) AS low, coalesce(min(dv) FILTER (dv > 1e-10), 1.0) AS s FROM d GROUP BY 1),
q AS (SELECT d.user_id, n, low, CASE WHEN n >= 3 AND coalesce(max(abs(dv / s - round(dv / s))) FILTER (dv > 1e-10), 0) < 0.05 AND max(abs((v - low) / s - round((v - low) / s))) < 0.05 THEN any_value(s) END AS step FROM d JOIN g USING (user_id) GROUP BY d.user_id, n, low),
f AS (SELECT user_id, count(DISTINCT v) AS kinds, avg(dv) AS mean_step, max(dv) AS most_step FROM d GROUP BY 1),
p AS (SELECT q.*, kinds, 1 - kinds / n AS repetition, mean_step, most_step, CASE WHEN step IS NOT NULL THEN 'Quantized' WHEN 1 - kinds / n > 0.5 AND kinds < 256 THEN 'HighRepetition' WHEN n > 1 AND mean_step < 1.0 AND most_step < 10.0 THEN 'ContinuousDrift' ELSE 'HighEntropy' END AS pattern FROM q JOIN f USING (user_id))"""


@query(f"WITH {_GRID} SELECT user_id, n, low, step IS NOT NULL AS quantized FROM q")
def detect_quantization(spark, d):
    return analyzer.quantization(table(spark, d, "events"), ["user_id"], "value", "event_id").select("user_id", "n", "low", F.col("step").isNotNull().alias("quantized"))


@query(f"WITH {_GRID} SELECT user_id, n, kinds, round(repetition, 9) AS repetition, round(mean_step, 10) AS mean_step, round(most_step, 6) AS most_step, pattern FROM p")
def analyze_pattern(spark, d):
    p = analyzer.patterns(table(spark, d, "events"), ["user_id"], "value", "event_id")
    return p.select("user_id", "n", "kinds", F.round("repetition", 9).alias("repetition"), F.round("mean_step", 10).alias("mean_step"), F.round("most_step", 6).alias("most_step"), "pattern")


_CHOICE = "CASE pattern WHEN 'Quantized' THEN 'QUANTIZED' WHEN 'HighRepetition' THEN 'DICTIONARY_RLE' ELSE 'CHIMP128' END"


@query(f"WITH {_GRID} SELECT user_id, pattern, {_CHOICE} AS encoding, CASE WHEN {_CHOICE} = 'CHIMP128' THEN 'LZ4' ELSE 'ZSTD' END AS compression FROM p")
def recommend_encoding(spark, d):
    return analyzer.recommend(table(spark, d, "events"), ["user_id"], "value", "event_id").select("user_id", "pattern", "encoding", "compression")


_LINE_GRID = _GRID.replace("FROM events", "FROM (SELECT l_suppkey AS user_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS event_id, l_quantity AS value FROM lineitem)")


@query(f"WITH {_LINE_GRID} SELECT user_id AS l_suppkey, pattern FROM p")
def analyze_quantized(spark, d):
    return analyzer.patterns(_lines(spark, d), ["l_suppkey"], "l_quantity", "k").select("l_suppkey", "pattern")


@query("SELECT * FROM (VALUES ('QUANTIZED', 'ZSTD'), ('SIMPLE8B', 'ZSTD'), ('DICTIONARY_RLE', 'ZSTD'), ('CHIMP128', 'LZ4'), ('GORILLA', 'LZ4'), ('PLAIN', 'ZSTD'), ('OTHER', 'ZSTD')) t(encoding, compression)")
def recommend_compression(spark, d):
    rows = spark.createDataFrame([(e,) for e in ("QUANTIZED", "SIMPLE8B", "DICTIONARY_RLE", "CHIMP128", "GORILLA", "PLAIN", "OTHER")], "encoding string")
    return rows.withColumn("compression", analyzer.compression_for(F.col("encoding")))


# ---- taking in and writing

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT l_orderkey, l_shipdate, measurement, value FROM (SELECT l_orderkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR measurement IN (l_quantity, l_extendedprice, l_discount, l_tax))")
def ingest_long(spark, d):
    return io.to_long(table(spark, d, "lineitem"), _LINE, "l_orderkey", "l_shipdate")


@query(f"SELECT event_id, user_id, ts, 'gap' AS measurement, gap AS value FROM {GAPS} WHERE gap IS NOT NULL UNION ALL SELECT event_id, user_id, ts, 'whole', whole::DOUBLE FROM {GAPS} WHERE whole IS NOT NULL")
def ingest_drop_nulls(spark, d):
    return io.to_long(gaps(spark, d), ["gap", "whole"], "user_id", "ts", "event_id")


@query("SELECT event_id, CAST(user_id AS INTEGER) AS device_small, CAST(value AS FLOAT) AS small, CAST(value AS DOUBLE) AS wide FROM events")
def ingest_promote_types(spark, d):
    """Numbers of the type that a narrower one is promoted to: what the narrower one can't hold is no error."""
    e = table(spark, d, "events")
    return e.select("event_id", F.col("user_id").cast(DataType.of(T.ShortType()).spark).alias("device_small"), F.col("value").cast("float").alias("small"), F.col("value").alias("wide"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS from_us, epoch_us(ts) // 1000000 * 1000 AS from_s, epoch_us(ts) // 1000 AS from_ns FROM events")
def ingest_ts_units(spark, d):
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", io.millis("us", "us").alias("from_us"), io.millis(F.floor(F.col("us") / F.lit(1000000).cast("decimal(10,0)")), "s").alias("from_s"), io.millis(F.col("us") * 1000, "ns").alias("from_ns"))


@query("SELECT user_id AS device_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE epoch_us(ts) // 1000 END AS ts, value FROM events WHERE event_id % 7 <> 0")
def ingest_null_device(spark, d):
    """Rows without a device go; a null time is 0."""
    e = table(spark, d, "events")
    rows = e.select(F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("device_id"), F.when(F.col("event_id") % 11 != 0, F.unix_micros(F.col("ts").cast("timestamp"))).alias("timestamp"), "value")
    return io.normalized(rows, [MeasurementSchema("value", DataType.DOUBLE)], "us")


def line_schema(spark, d) -> TableSchema:
    struct = table(spark, d, "lineitem").schema
    role = {"l_returnflag": Category.TAG, "l_linestatus": Category.TAG, "l_shipdate": Category.TIME}
    return TableSchema("lineitem", [MeasurementSchema(f.name, DataType.of(f.dataType), category=role.get(f.name, Category.FIELD)) for f in struct])


@query("SELECT l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def tag_field_time_projection(spark, d):
    return line_schema(spark, d).project(table(spark, d, "lineitem"), Category.TAG, Category.TIME)


@query("SELECT * FROM (VALUES ('l_discount', 6), ('l_extendedprice', 5), ('l_linenumber', 3), ('l_orderkey', 0), ('l_partkey', 1), ('l_quantity', 4), ('l_suppkey', 2), ('l_tax', 7)) t(name, place)")
def schema_lookup(spark, d):
    s = line_schema(spark, d)
    s.validate()
    return spark.createDataFrame([(n, s.index(n)) for n in s.sorted_names(Category.FIELD)], "name string, place int")


def _scratch(spark) -> str:
    """A folder for files that a query writes: shared by all executors where the cluster names one."""
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


for _c in Compression:

    def _written(spark, d, _c=_c):
        path = _scratch(spark)
        long = table(spark, d, "events").select(F.col("user_id").alias("device_id"), F.col("event_type").alias("measurement"), "ts", "value", F.col("event_id").alias("seq"))
        io.append(long, path, io.Config.default().with_(compression=_c))
        return Series.open(spark, path).df

    query("SELECT user_id AS device_id, event_type AS measurement, ts, value, event_id AS seq FROM events", f"parquet_roundtrip_{_c.parquet}")(_written)


@query("""SELECT device_id, measurement, kind, encoding, compression, points, "start", "end" FROM (
  SELECT l_returnflag AS device_id, 'price' AS measurement, 'DOUBLE' AS kind, 'GORILLA' AS encoding, 'LZ4' AS compression, count(*) AS points, min(l_orderkey) AS "start", max(l_orderkey) AS "end" FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT l_returnflag, 'status', 'TEXT', 'DICTIONARY', 'ZSTD', count(*), min(l_orderkey), max(l_orderkey) FROM lineitem GROUP BY l_returnflag)""")
def writer_catalog(spark, d):
    """Two types of every device in one dataset: appended in turn, listed with their encodings, and read again."""
    path, lines = _scratch(spark), table(spark, d, "lineitem")
    price, status = MeasurementSchema("price", DataType.DOUBLE, Encoding.GORILLA, Compression.LZ4), MeasurementSchema("status", DataType.TEXT, Encoding.DICTIONARY, Compression.ZSTD)
    w = io.SeriesWriter(spark, path)
    for r in lines.select("l_returnflag").distinct().collect():  # a row for each device
        w.register_device(r[0], [price, status])
    w.close()
    for m, col in ((price, "l_extendedprice"), (status, "l_linestatus")):
        rows = lines.select(F.col("l_returnflag").alias("device_id"), F.lit(m.name).alias("measurement"), F.col("l_orderkey").cast("long").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"), *[(F.col(col) if k is m.kind else F.lit(None)).cast(k.spark).alias(c) for k, c in io.COLUMN.items()])
        io.append(rows, f"{path}/points", schemas=[price, status], follow=True)
    return io.catalog(spark, path)


@query("""SELECT user_id AS device_id, arg_min(value, o) AS first, arg_max(value, o) AS last, count(*) AS n FROM (
  SELECT user_id, value, event_id AS o FROM events UNION ALL SELECT user_id, value + 1000, event_id + 1 + (SELECT max(event_id) FROM events) FROM events) GROUP BY user_id""")
def append_order(spark, d):
    """What is appended later is later in the order of writing, though it counts from 0 again."""
    path = _scratch(spark)
    rows = table(spark, d, "events").select(F.col("user_id").alias("device_id"), F.col("event_type").alias("measurement"), "ts", "value", F.col("event_id").cast("long").alias("seq"))
    for more in (0, 1000):
        io.append(rows.withColumn("value", F.col("value") + more), path, follow=more > 0)
    return stats.statistics(Series.open(spark, path).df, ["device_id"], DataType.DOUBLE).select("device_id", "first", "last", "n")


@query("SELECT user_id, event_type AS value, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY f) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT user_id, event_type, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events)")
def dictionary_by_series(spark, d):
    """Each device's dictionary of measurements, by first appearance."""
    e = table(spark, d, "events").withColumn("value", F.col("event_type"))
    return codecs.dictionary_of(codecs.dictionary_ids(e.select("user_id", "value", "event_id"), ["user_id"], "value", "event_id"), ["user_id"], "value")


@query("SELECT user_id, event_type AS name, count(DISTINCT value) AS kinds, count(DISTINCT value) <= 8 AS fits FROM events GROUP BY user_id, event_type")
def dictionary_fits(spark, d):
    """Which series a dictionary of 8 entries holds: others want another encoding."""
    e = table(spark, d, "events").where("value is not null")
    return codecs.fits_dictionary(e.withColumn("name", F.col("event_type")), ["user_id", "name"], "value", 8)


@query("SELECT user_id, event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def daily_statistics(spark, d):
    """The statistics that the streaming adaptor keeps, over what is there now."""
    e = table(spark, d, "events")
    w = live.running_statistics(e, ["user_id", "event_type"], "1 day", "1 hour")
    return w.select("user_id", "event_type", F.col("window.start").alias("day"), "n", F.round("total", 4).alias("total"), "low", "high")


@query(f"SELECT {COLS} FROM events WHERE event_type = 'click' AND value > 50.0")
def stream_scan(spark, d):
    return live.scan(table(spark, d, "events").withColumnRenamed("event_type", "measurement"), P.measurement("click") > Lit.float64(50.0), "click").withColumnRenamed("measurement", "event_type").select(*POINT)
