"""Encodings that relational operators express: runs, dictionaries, deltas, zigzag, quantisation.

Each encoder works on series: rows of the same ``by``, in order of the whole number ``seq``.  Each
decoder gives the encoder's input back.  Long series are worked on in chunks (``operators.split``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import CodecError
from tidemark.operators import split


# ---- runs


def rle_encode(rows: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """(by..., run, value, length): runs of equal values, numbered from 0; nulls make runs of their own."""
    slim = split.chunked(rows.select(*by, seq, value), seq)

    def steps_of(met: DataFrame, w) -> DataFrame:
        new = F.when(F.row_number().over(w) > 1, (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")).otherwise(0)
        return met.withColumn("_new", new).withColumn("_nth", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    marked = steps_of(split.dealt(slim, [*by, "_chunk"]), split.within(by, seq))
    ends = F.struct(F.col(value).alias("v"))
    own = {"first": F.min_by(ends, F.col(seq)), "last": F.max_by(ends, F.col(seq)), "new": F.sum("_new"), "n": F.count(F.lit(1)), "head": F.count_if(F.col("_nth") == 0)}
    goes_on = F.lag("_own_last").over
    met = split.carried(slim, by, [seq], own, [
        # a chunk begins with a new run unless its first value is the last one of the chunk before
        lambda w: ("_starts", goes_on(w).isNull() | ~F.col("_own_first.v").eqNullSafe(goes_on(w)["v"])),
        lambda w: ("_begins", (F.col("_starts") & goes_on(w).isNotNull()).cast("int")),
        lambda w: ("_ahead", split.earlier(w, F.col("_own_new") + F.col("_begins")) + F.col("_begins")),
        # and the run that a chunk ends with has the heads of the chunks that go on with it as well
        lambda w: ("_heads", F.sum(F.when(F.col("_starts"), 0).otherwise(F.col("_own_head"))).over(Window.partitionBy(*by, "_ahead"))),
        lambda w: ("_more", F.when(~F.lead("_starts").over(w), F.lead("_heads").over(w)).otherwise(0)),
        lambda w: ("_n", F.col("_own_n")),
    ], ["_starts", "_ahead", "_more", "_n"], marked)
    w = split.after(by, seq)
    met = steps_of(met, w).withColumn("_at", F.row_number().over(w))
    heads = met.where("_at = 1 or _new = 1").withColumn("_next", F.lead("_at").over(w))
    length = F.coalesce(F.col("_next"), F.col("_n") + 1) - F.col("_at") + F.when(F.col("_next").isNull(), F.col("_more")).otherwise(0)
    return heads.where("_starts or _at > 1").select(*by, (F.col("_ahead") + F.col("_nth")).alias("run"), value, length.alias("length"))


def rle_decode(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., place, value): places from 0 in the order of the runs."""
    ahead = split.running(runs, by, "run", "length", "_upto").withColumn("_ahead", F.col("_upto") - F.col("length"))
    spread = ahead.select(*by, value, "_ahead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("_i"))
    return spread.select(*by, (F.col("_ahead") + F.col("_i")).alias("place"), value)


# ---- dictionaries


def _numbered(rows: DataFrame, by: list[str], value: str, seq: str, out: str) -> DataFrame:
    """(_of_<by>..., _of_value, out): each series' different values, numbered by first appearance."""
    first = rows.groupBy(*by, value).agg(F.min(seq).alias("_first"))
    return split.placed(first, by, "_first", "_id").select(*[F.col(b).alias(f"_of_{b}") for b in by], F.col(value).alias("_of_value"), F.col("_id").cast("int").alias(out))


def _with_ids(rows: DataFrame, numbered: DataFrame, by: list[str], value: str) -> DataFrame:
    same = [rows[b].eqNullSafe(numbered[f"_of_{b}"]) for b in by] + [rows[value].eqNullSafe(numbered["_of_value"])]
    return rows.join(numbered, same).drop(*[f"_of_{b}" for b in by], "_of_value")


def dictionary_ids(rows: DataFrame, by: list[str], value: str, seq: str, out: str = "id") -> DataFrame:
    """Rows with the id of their value in its series: from 0, by first appearance.

    Values are numbered where there's one row for each; a value of many rows is one row there.  Null is
    a value like any other.
    """
    return _with_ids(rows, _numbered(rows, by, value, seq, out), by, value)


def dictionary_of(rows: DataFrame, by: list[str], value: str, id_: str = "id") -> DataFrame:
    return rows.select(*by, id_, value).distinct()


def dictionary_decode(rows: DataFrame, entries: DataFrame, by: list[str], id_: str = "id") -> DataFrame:
    return rows.join(entries, [*by, id_])


def dictionary_rle(rows: DataFrame, by: list[str], value: str, seq: str, most: int = 256) -> DataFrame:
    """(by..., run, id, value, length): runs of dictionary ids, for series with up to ``most`` different values.

    A series with more raises ``CodecError`` when it's encoded; ``fits_dictionary`` tells such series
    apart first, for another encoding.
    """
    told = F.raise_error(F.concat(F.lit(f"CodecError: a dictionary holds {most} values, and there are more in "), F.concat_ws(", ", *[F.col(b).cast("string") for b in by])))
    runs = _with_ids(rle_encode(rows, by, value, seq), _numbered(rows, by, value, seq, "id"), by, value)
    return runs.select(*by, "run", F.when(F.col("id") < most, F.col("id")).otherwise(told.cast("int")).alias("id"), value, "length")


def fits_dictionary(rows: DataFrame, by: list[str], value: str, most: int = 256) -> DataFrame:
    """(by..., kinds, fits): how many different values a series has, and whether a dictionary holds them."""
    kinds = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.count(F.lit(1)).alias("kinds"))
    return kinds.withColumn("fits", F.col("kinds") <= most)


# ---- deltas


def delta(rows: DataFrame, by: list[str], value: str, seq: str, out: str = "delta") -> DataFrame:
    """The difference to the value before; null for a series' first."""
    return split.lagged(rows, by, seq, value, "_last").withColumn(out, F.col(value) - F.col("_last")).drop("_last")


def delta_of_delta(rows: DataFrame, by: list[str], value: str, seq: str, out: str = "code") -> DataFrame:
    """Of each series: the first value, the first difference, then differences of differences."""
    w = split.within(by, seq)
    staged = split.dealt(split.chunked(rows, seq), [*by, "_chunk"]).withColumn("_one", F.lag(value).over(w)).withColumn("_at", F.row_number().over(w))
    # a chunk's last value, and the one before that if it has two rows
    tail = F.array_compact(F.array(F.when(F.col("_at") > 1, F.struct(F.col("_one").alias("v"))), F.struct(F.col(value).alias("v"))))
    empty = F.array().cast(staged.select(tail.alias("t")).schema["t"].dataType)
    before = lambda w, n: F.coalesce(F.lag("_own_tail", n).over(w), empty)
    met = split.carried(staged, by, [seq], {"tail": F.max_by(tail, F.col(seq))}, [lambda w: ("_tail", F.concat(before(w, 2), before(w, 1)))], ["_tail"])
    w = split.after(by, seq)
    earlier = lambda k: F.try_element_at("_tail", F.lit(-k))["v"]
    one = F.when(F.col("_at") > 1, F.col("_one")).otherwise(earlier(1))
    two = F.when(F.col("_at") > 2, F.lag(value, 2).over(w)).when(F.col("_at") == 2, earlier(1)).otherwise(earlier(2))
    d, e = F.col(value) - one, one - two
    return met.withColumn(out, F.coalesce(d - e, d, F.col(value))).drop("_chunk", "_row", "_one", "_at", "_tail")


def delta_of_delta_decode(rows: DataFrame, by: list[str], code: str, seq: str, out: str = "value") -> DataFrame:
    """Two running sums over each series: of differences of differences, and of the differences they give."""
    first = rows.groupBy(*by).agg(F.min(seq).alias("_first")).select(*[F.col(b).alias(f"_of_{b}") for b in by], "_first")
    met = split.chunked(rows.join(first, [rows[b].eqNullSafe(first[f"_of_{b}"]) for b in by]).drop(*[f"_of_{b}" for b in by]), seq)
    met = split.dealt(met, [*by, "_chunk"])
    head, w = F.col(seq) == F.col("_first"), split.within(by, seq)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_d", F.sum(F.when(head, 0).otherwise(F.col(code))).over(upto))
    met = met.withColumn("_s", F.sum(F.when(head, F.col(code)).otherwise(F.col("_d"))).over(upto)).withColumn("_n", F.row_number().over(w) - F.when(F.shiftright(F.col("_first").cast("long"), split.SPAN_BITS) == F.col("_chunk"), 1).otherwise(0))
    met = split.carried(met, by, [seq], {"d": F.max_by("_d", seq), "s": F.max_by("_s", seq), "n": F.max_by("_n", seq)}, [
        lambda w: ("_before_d", split.earlier(w, "_own_d")),
        # a chunk's differences are all larger by what the chunks before it have summed up
        lambda w: ("_before_s", split.earlier(w, F.col("_own_s") + F.col("_own_n") * F.col("_before_d"))),
    ], ["_before_d", "_before_s"])
    return met.withColumn(out, F.col("_before_s") + F.col("_s") + F.col("_n") * F.col("_before_d")).drop("_chunk", "_row", "_first", "_d", "_s", "_n", "_before_d", "_before_s")


# ---- zigzag and variable-length integers


def zigzag(v: Column) -> Column:
    """Signed to unsigned, small magnitudes to small numbers; for 64-bit integers."""
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1)))


def varint_bytes(u: Column) -> Column:
    """Bytes of a number in groups of seven bits; the sign bit counts as a number's highest."""
    bits = F.when(u == 0, F.lit(1)).otherwise(F.length(F.bin(u)))
    return F.ceil(bits / 7).cast("int")


# ---- quantisation


def quantize(v: Column, low: Column, step: Column) -> Column:
    """The number of steps above the least value, halves away from zero."""
    return F.round((v - low) / step).cast("long")


def dequantize(index: Column, low: Column, step: Column) -> Column:
    return low + index * step


def quantized(rows: DataFrame, grid: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows of series that have a (low, step) in ``grid``, with ``index``, ``restored`` and ``error``."""
    met = rows.join(grid, by)
    met = met.withColumn("index", quantize(F.col(value), F.col("low"), F.col("step")))
    met = met.withColumn("restored", dequantize(F.col("index"), F.col("low"), F.col("step")))
    return met.withColumn("error", F.abs(F.col("restored") - F.col(value)))


def require_lossless(rows: DataFrame, value: str, most: float = 0.0) -> DataFrame:
    """Raise CodecError if a quantised row is off by more than ``most``."""
    worst = rows.agg(F.max("error")).first()[0]
    if worst is not None and worst > most:
        raise CodecError(f"quantising {value} is off by up to {worst}")
    return rows
