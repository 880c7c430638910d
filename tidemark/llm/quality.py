"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

y = w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], in time linear in the
number of features that a text has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textscan
from tidemark.llm.labels import labelled, learnable
from tidemark.llm.shared import claim, text_column

BUCKETS = 1 << 15
RANK = 8
#: Labelled rows of either class that the machine is fitted on, at most.
EACH = 4_000
STATS = ("log words", "log bytes", "mean word bytes", "upper", "lower", "digit", "blank", "dot and comma", "other mark", "beyond ASCII", "different words", "top word", "word again at once", "lines again", "words a line", "log n_chars", "n_chars against text")
_KIND = np.full(256, 5, np.uint8)  # other mark
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 6
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[44, 46]] = 4
_LINES = np.zeros(256, bool)
_LINES[[10, 13]] = True


def features(texts, n_chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows of an Arrow column: (row starts, word buckets, word values, statistics)."""
    off, raw = textscan.buffers(texts)
    for lo, hi in textscan.groups(off):
        own = off[lo : hi + 1] - off[lo]
        data = raw[off[lo] : off[hi]]
        w = textscan.words(data, own, textscan.MARKS)
        n_docs, words, size = hi - lo, np.diff(w.first), np.diff(own)
        doc = np.repeat(np.arange(n_docs), words)
        bucket = (w.hash >> np.uint64(64 - 15)).astype(np.int64)
        key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
        begin = np.searchsorted(key, np.arange(n_docs + 1) * BUCKETS)
        kinds = np.bincount(np.repeat(np.arange(n_docs), size) * 8 + _KIND[data], minlength=8 * n_docs).reshape(n_docs, 8)[:, :7]
        lines = textscan.words(data, own, _LINES)
        line_doc, line_n = np.repeat(np.arange(n_docs), np.diff(lines.first)), np.diff(lines.first)
        other = np.bincount(np.unique(np.stack([line_doc.astype(np.uint64), lines.hash], 1), axis=0)[:, 0].astype(np.int64), minlength=n_docs) if len(line_doc) else np.zeros(n_docs)
        again = np.bincount(doc[1:][(w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])], minlength=n_docs)
        top = np.zeros(n_docs)
        np.maximum.at(top, key // BUCKETS, count)
        one, bytes_ = np.maximum(words, 1), np.maximum(size, 1)
        chars = np.asarray(n_chars[lo:hi], float)
        stats = np.column_stack([
            np.log1p(words), np.log1p(size), np.minimum(size / one, 100), kinds / bytes_[:, None], np.diff(begin) / one, top / one, again / one,
            1 - other / np.maximum(line_n, 1), np.log1p(words / np.maximum(line_n, 1)), np.log1p(np.maximum(chars, 0)), np.clip(chars / bytes_, 0, 4),
        ])
        yield begin, key % BUCKETS, np.sqrt(count / one[key // BUCKETS]), stats


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the runs between begins; a run may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0)])
    return total[begin[1:]] - total[begin[:-1]]


@dataclass
class Machine:
    w0: float
    w: np.ndarray  # of the word buckets, then of the statistics
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, begin, bucket, value, stats) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        ws, vs = self.w[BUCKETS:], self.v[BUCKETS:]
        own = self.v[bucket] * value[:, None]
        first = sums(own, begin) + x @ vs
        square = sums((own * own).sum(1), begin) + (x * x) @ (vs * vs).sum(1)
        return self.w0 + sums(self.w[bucket] * value, begin) + x @ ws + 0.5 * ((first**2).sum(1) - square)


def fit(begin, bucket, value, stats, y, rank: int = RANK, passes: int = 12, rate: float = 0.08, decay: float = 2e-4, seed: int = 5) -> Machine:
    """AdaGrad on the logistic loss, over shuffled small batches."""
    rng = np.random.default_rng(seed)
    n = len(y)
    mean, scale = (stats.mean(0), stats.std(0) + 1e-6) if n else (np.zeros(len(STATS)), np.ones(len(STATS)))
    m = Machine(0.0, np.zeros(BUCKETS + len(STATS)), rng.normal(0, 0.02, (BUCKETS + len(STATS), rank)), mean, scale)
    if not n:
        m.v[:] = 0  # chance starts nothing that wasn't learnt: every logit is 0
        return m
    m.w0 = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    x_all = np.clip((stats - mean) / scale, -5, 5)
    gw, gv, g0 = np.full(len(m.w), 1e-2), np.full(m.v.shape, 1e-2), 1e-2
    tail = np.arange(BUCKETS, BUCKETS + len(STATS))
    for _ in range(passes):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            rows = order[lo : lo + 64]
            size = begin[rows + 1] - begin[rows]
            at = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            b, x = bucket[at], value[at]
            cuts = np.concatenate([[0], np.cumsum(size)])
            stat = x_all[rows]
            own = m.v[b] * x[:, None]
            first = sums(own, cuts) + stat @ m.v[tail]
            square = sums((own * own).sum(1), cuts) + (stat * stat) @ (m.v[tail] ** 2).sum(1)
            z = m.w0 + sums(m.w[b] * x, cuts) + stat @ m.w[tail] + 0.5 * ((first**2).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            u, inv = np.unique(b, return_inverse=True)
            each = np.repeat(g, size)
            dw = np.bincount(inv, each * x, len(u)) + decay * m.w[u]
            part = (each * x)[:, None] * (np.repeat(first, size, 0) - own)
            dv = np.stack([np.bincount(inv, part[:, f], len(u)) for f in range(rank)], 1) + decay * m.v[u]
            dws = stat.T @ g + decay * m.w[tail]
            dvs = (stat * g[:, None]).T @ first - ((stat**2).T @ g)[:, None] * m.v[tail] + decay * m.v[tail]
            for i, d_w, d_v in ((u, dw, dv), (tail, dws, dvs)):
                gw[i] += d_w**2
                gv[i] += d_v**2
                m.w[i] -= rate * d_w / np.sqrt(gw[i])
                m.v[i] -= rate * d_v / np.sqrt(gv[i])
            g0 += g.sum() ** 2
            m.w0 -= rate * g.sum() / np.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, learn, each: int = EACH, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> Machine:
    """Fit on the labelled rows of ``docs`` with ``learn``: at most ``each`` of either class.

    Labels of other rows are never looked at.  Features are made by the executors; the driver gets
    slim numbers, at most 6 bytes for each of ``BUCKETS`` from a row.  Rows with a null key or label
    teach nothing, and repeated rows count once.  Without labelled rows the machine scores every text
    a half.
    """
    import pyarrow as pa

    chosen = docs.where(learn)
    n_chars = F.coalesce(chosen[chars].cast("long"), F.lit(0)) if chars else F.lit(0).cast("long")
    rows = labelled(chosen.withColumn("_chars", n_chars), learnable(chosen, labels, "quality", key), (each, each), key, text, ["_chars"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, y = 0, b.column(2).to_pylist()
            for begin, bucket, value, stats in features(b.column(0), b.column(1).to_numpy()):
                n = len(begin) - 1
                cols = [pa.array([bucket[i:j].astype(np.int32).tobytes() for i, j in zip(begin, begin[1:])], pa.binary()), pa.array([value[i:j].astype(np.float32).tobytes() for i, j in zip(begin, begin[1:])], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary()), pa.array(y[at : at + n], pa.int32())]
                at += n
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "value", "stats", "y"])

    got = rows.select("text", "_chars", "y").mapInArrow(make, "bucket binary, value binary, stats binary, y int").collect()  # at most 2 x each rows
    got.sort(key=lambda r: (bytes(r.bucket), bytes(r.stats), r.y))  # the same order on every run
    buckets = [np.frombuffer(r.bucket, np.int32) for r in got]
    begin = np.concatenate([[0], np.cumsum([len(b) for b in buckets])]).astype(np.int64)
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    stats = np.array([np.frombuffer(r.stats, np.float64) for r in got]).reshape(-1, len(STATS))
    return fit(begin, cat(buckets, np.int32).astype(np.int64), cat([np.frombuffer(r.value, np.float32) for r in got], np.float32).astype(np.float64), stats, np.array([r.y for r in got], float))


def score(docs: DataFrame, machine: Machine, keep: list[str] | None = None, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """key, ``keep``, ``score`` (0 to 1, higher: better) and ``predicted`` (1 from a half) of every row.

    Null text is empty and is scored by its statistics alone; a null n_chars counts as 0; rows may
    repeat; an empty table gives no rows; other columns are passed on only if ``keep`` names them.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(machine)
    names = [key, *(keep or [])]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for b in batches:
            z = [shared.value.logits(*f) for f in features(b.column(0), b.column(1).to_numpy())]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z) if z else np.zeros(0), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    n_chars = F.coalesce(docs[chars].cast("long"), F.lit(0)) if chars else F.lit(0).cast("long")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double, predicted int"
    return docs.select(text_column(docs, text).alias("_text"), n_chars.alias("_chars"), *[docs[c] for c in names]).mapInArrow(run, schema)
