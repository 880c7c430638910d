"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is then dropped down every tree, and the
index is the table of (leaf, vector).  A query walks all trees through one priority queue, ordered by
how little it would have to move to be on a subtree's side, and takes leaves until they hold enough
vectors: as many as it took some of the queries, whose true neighbours are found by looking at all
vectors once, to find the wished share of those.  Where a leaf's vectors and the queries that want it meet, exact distances give the best of
that leaf, and the best of all leaves are the answer.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut

#: Vectors that the trees are fitted on: one in FIT_PART, at least and at most so many.  Leaves grow in number with them.
FIT_PART, FIT_LEAST, FIT_MOST = 16, 16_384, 131_072
TREES, LEAF = 8, 32
#: The share of true neighbours that is to be found, and the queries that it's measured with.
RECALL, MEASURED = 0.96, 128
#: A query's leaves hold, for each tree, at least so many vectors.
LEAST = 1_000
#: Vectors of a leaf that meet its queries in one group; a larger leaf is several groups.
GROUP = 2_048


@dataclass
class Tree:
    """Inner nodes as arrays: a side's child is a node if >= 0, else leaf -1 - child."""

    normal: np.ndarray  # [nodes, dim]
    offset: np.ndarray
    child: np.ndarray  # [nodes, 2]
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.normal) else np.full(len(x), -1, np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            side = (np.einsum("ij,ij->i", x[inner], self.normal[n]) > self.offset[n]).astype(np.int64)
            at[inner] = self.child[n, side]
        return -1 - at


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Split by the plane between two random points' cells, down to ``leaf`` points."""
    normal, offset, child, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        cutat = _plane(x[own], rng) if len(own) > leaf else None
        if cutat is None:
            if parent >= 0:
                child[parent][side] = -1 - leaves
            leaves += 1
            continue
        n, o, right = cutat
        me = len(normal)
        normal.append(n)
        offset.append(o)
        child.append([0, 0])
        if parent >= 0:
            child[parent][side] = me
        todo += [(own[~right], me, 0), (own[right], me, 1)]
    d = x.shape[1] if x.ndim == 2 else 0
    return Tree(np.array(normal).reshape(-1, d), np.array(offset), np.array(child, np.int64).reshape(-1, 2), leaves)


def _plane(x: np.ndarray, rng: np.random.Generator):
    for attempt in range(4):
        if attempt < 3:
            a, b = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(2):  # towards two means
                near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = x[near].mean(0), x[~near].mean(0)
            n = b - a
            o = n @ (a + b) / 2
        else:
            n = rng.standard_normal(x.shape[1])
            o = np.median(x @ n)
        size = np.linalg.norm(n)
        if size < 1e-12:
            continue
        n, o = n / size, o / size
        right = x @ n > o
        if min(right.sum(), (~right).sum()) >= 0.05 * len(x):
            return n, o, right
    return (n, o, right) if size >= 1e-12 and right.any() and not right.all() else None


def walk(forest: list[Tree], q: np.ndarray, sizes: list[np.ndarray], want: float) -> list[tuple[int, int]]:
    """(tree, leaf)s through one queue over all trees, until they hold ``want`` vectors per tree."""
    heap = [(0.0, t, 0 if len(tree.normal) else -1) for t, tree in enumerate(forest)]
    dots = [tree.normal @ q - tree.offset for tree in forest]
    heapq.heapify(heap)
    out, held = [], 0
    while heap and held < want * len(forest):
        far, t, n = heapq.heappop(heap)
        if n < 0:
            out.append((t, -1 - n))
            held += int(sizes[t][-1 - n])
            continue
        d = float(dots[t][n])
        side = int(d > 0)
        heapq.heappush(heap, (far, t, int(forest[t].child[n, side])))
        heapq.heappush(heap, (max(far, abs(d)), t, int(forest[t].child[n, 1 - side])))
    return out


def needed(forest: list[Tree], sizes: list[np.ndarray], q: np.ndarray, leaves: np.ndarray) -> list[float]:
    """For each neighbour, given by its leaf in each tree: the vectors per tree of a query's walk that just finds it."""
    first = {}
    held = 0
    for t, l in walk(forest, q, sizes, float("inf")):
        held += int(sizes[t][l])
        first[t, l] = held / len(forest)
    return [min(first[t, int(l)] for t, l in enumerate(row)) for row in leaves]


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(``id``, ``vec``) of the rows that take part: alike rows once.

    Null, empty and zero vectors, those with null or non-finite components and rows with a null key
    take no part; nor do those of another length than most have.
    """
    v = rows[vector]
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = rows.where(v.isNotNull() & rows[key].isNotNull() & (F.size(v) > 0) & F.forall(v, number) & F.exists(v, lambda x: x != 0)).select(rows[key].cast("long").alias("id"), v.alias("vec"))
    most = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("vec") == (most[0] if most else 0))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest(rows: DataFrame, asked, k: int = 10, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, least: int = LEAST) -> DataFrame:
    """The ``k`` nearest other rows of each row for which the column ``asked`` is true.

    Returns ``query_id``, ``rank`` (from 1), the found key and ``score``, the Euclidean distance in
    double precision on the original vectors; ties go to the smaller key.  Rows alike in key and
    vector count once; a row is never its own answer.

    Equal vectors are one vector with its k + 1 smallest keys, which is all that an answer can hold
    of them, so a vector that a third of all rows share weighs no more than any other.  Queries with
    equal vectors are searched once.  A leaf with more than ``GROUP`` vectors is dealt over several
    groups, each of which all its queries visit.  The forest (of at most FIT_MOST vectors) and the
    leaves' sizes are broadcast.  How many vectors a query looks at is measured: for up to MEASURED
    queries the true neighbours are found among all vectors, and every query takes as many leaves as
    let those find ``recall`` of theirs.  On clustered vectors that is a small part of the table; on
    vectors without any structure a large one, as no tree can tell them apart.

    Vectors that are null, empty, zero, have null or non-finite components or another length than most
    take no part, nor do rows with a null key; an empty table gives no rows; other columns are ignored.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    good = usable(rows, key, vector).distinct()
    first = Window.partitionBy("vec").orderBy("id")
    kept = good.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    kinds = kept.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("kind", F.monotonically_increasing_id())
    kinds = cut(kinds)
    total = kinds.count()
    as_query = rows.where(asked)
    asking = cut(usable_like(as_query, key, vector, kinds).distinct())
    questions = cut(asking.select("vec").distinct().withColumn("kind", F.monotonically_increasing_id()))

    fit_rows = min(FIT_MOST, max(FIT_LEAST, total // FIT_PART))
    picked = kinds.select("vec", F.xxhash64(F.col("ids")[0]).alias("_o")).orderBy("_o").limit(fit_rows).select("vec").toArrow().column(0)  # at most fit_rows rows
    x = _matrix(picked.combine_chunks()).astype(np.float64) if len(picked) else np.zeros((0, 1))
    given = spark.sparkContext.broadcast(x)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                tree = grow(given.value, leaf, np.random.default_rng((7, t)))
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([pickle.dumps(tree)], pa.binary())], names=["id", "tree"])

    forest = [pickle.loads(r.tree) for r in sorted(spark.range(0, trees, 1, trees).mapInArrow(grown, "id long, tree binary").collect())]
    shared = spark.sparkContext.broadcast(forest)

    def sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(t.leaves, np.int64) for t in shared.value]
        for b in batches:
            v = _matrix(b.column(0)).astype(np.float64)
            for h, t in zip(held, shared.value):
                h += np.bincount(t.leaf_of(v), minlength=t.leaves)
        got = [(i, l, c) for i, h in enumerate(held) for l, c in enumerate(h.tolist()) if c]
        yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["tree", "leaf", "n"])

    sizes = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in kinds.select("vec").mapInArrow(sizes_of, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():  # a row per leaf
        sizes[r.tree][r.leaf] = r.n
    sizes_shared = spark.sparkContext.broadcast(sizes)
    tried = questions.select("vec", F.xxhash64("vec").alias("_o")).orderBy("_o").limit(MEASURED).select("vec").toArrow().column(0)  # at most MEASURED rows
    asks_ = _matrix(tried.combine_chunks()).astype(np.float64) if len(tried) else np.zeros((0, 1))
    told = spark.sparkContext.broadcast(asks_)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, list[int]]]] = [[] for _ in told.value]
        for b in batches:
            v = _matrix(b.column(0)).astype(np.float64)
            for lo in range(0, len(v), 4096):
                own = v[lo : lo + 4096]
                dist = np.stack([((own - q) ** 2).sum(1) for q in told.value])
                near = np.argpartition(dist, min(k, len(own) - 1), 1)[:, : k + 1]
                used, place = np.unique(near, return_inverse=True)
                leaves = np.stack([t.leaf_of(own[used]) for t in shared.value], 1)[place.reshape(near.shape)]
                for i, held in enumerate(best):
                    held += zip(dist[i, near[i]].tolist(), leaves[i].tolist())
                    if len(held) > 1000:
                        best[i] = sorted(held)[: k + 1]
        rows_ = [(i, d, l) for i, held in enumerate(best) for d, l in sorted(held)[: k + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows_], t) for c, t in enumerate((pa.int32(), pa.float64(), pa.list_(pa.int32())))], names=["q", "d", "leaves"])

    want = least
    if len(asks_) and total > least:
        near = kinds.select("vec").mapInArrow(look, "q int, d double, leaves array<int>")
        near = near.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy("d", "leaves"))).where(F.col("_n") <= k + 1)
        by: dict[int, list] = {}
        for r in near.orderBy("q", "d", "leaves").collect():  # at most MEASURED * (k + 1) rows
            by.setdefault(r.q, []).append(r.leaves)
        # the nearest is the query's own vector
        found = sorted(w for q, rows_ in by.items() for w in needed(forest, sizes, asks_[q], np.array(rows_[1:]).reshape(-1, trees)))
        if found:
            want = max(least, int(np.ceil(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)])))

    def bucket(tree, leaf_, part):
        return (np.int64(tree) << np.int64(52)) | (np.int64(leaf_) << np.int64(28)) | np.int64(part)

    names = ["bucket", "asks", "kind", "vec", "ids"]
    schema = f"bucket long, asks byte, kind long, vec {kinds.schema['vec'].dataType.simpleString()}, ids array<long>"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, kind = _matrix(b.column(0)).astype(np.float64), b.column(1).to_numpy()
            for t, tree in enumerate(shared.value):
                l = tree.leaf_of(v)
                ways = -(-sizes_shared.value[t][l] // GROUP)
                key_ = bucket(t, l.astype(np.int64), (kind % np.maximum(ways, 1)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key_, pa.int64()), pa.array(np.zeros(len(l), np.int8)), b.column(1), b.column(0), b.column(2)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(0)).astype(np.float64)
            for lo in range(0, len(v), 256):
                keys, whose = [], []
                for i in range(lo, min(lo + 256, len(v))):
                    for t, l in walk(shared.value, v[i], sizes_shared.value, want):
                        for part in range(int(-(-sizes_shared.value[t][l] // GROUP))):
                            keys.append(int(bucket(t, l, part)))
                            whose.append(i)
                at = pa.array(whose, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.ones(len(keys), np.int8)), b.column(1).take(at), b.column(0).take(at), pa.nulls(len(keys), pa.list_(pa.int64()))], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, float]] = {}
        limit: dict[int, float] = {}
        stored: list[tuple] = []
        now = None

        def out():
            q, i, d = [], [], []
            for kind, found in best.items():
                for id_, dist in sorted(found.items(), key=lambda z: (z[1], z[0]))[: k + 1]:
                    q.append(kind)
                    i.append(id_)
                    d.append(dist)
            best.clear()
            limit.clear()
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["kind", "id", "score"])

        for b in batches:
            keys, asks, kind, vec = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3)).astype(np.float64)
            cuts = np.flatnonzero(np.diff(keys)) + 1 if len(keys) else []
            for i, j in zip([0, *cuts], [*cuts, len(keys)]):
                if i == j:
                    continue
                if keys[i] != now:
                    now, stored = keys[i], []
                m = i + int(np.searchsorted(asks[i:j], 1, "left"))
                if m > i:
                    stored.append((vec[i:m], b.column(4).slice(i, m - i).to_pylist()))
                if m < j and len(stored) > 1:
                    stored = [(np.concatenate([s[0] for s in stored]), [y for s in stored for y in s[1]])]
                if not stored:
                    continue
                for q in range(m, j):
                    diff = stored[0][0] - vec[q]
                    dist = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                    kq = int(kind[q])
                    near = np.flatnonzero(dist <= limit.get(kq, np.inf))
                    if len(near) > k + 1:
                        near = near[dist[near] <= np.partition(dist[near], k)[k]]
                    if not len(near):
                        continue
                    found = best.setdefault(kq, {})
                    for e in near.tolist():
                        for id_ in stored[0][1][e]:
                            found[id_] = float(dist[e])
                    if len(found) > k + 1:
                        top = sorted(found.items(), key=lambda z: (z[1], z[0]))[: k + 1]
                        best[kq] = dict(top)
                        limit[kq] = top[-1][1]
                if len(best) > 20_000:
                    yield out()
        yield out()

    index = kinds.select("vec", "kind", "ids").mapInArrow(store, schema)
    probes = questions.select("vec", "kind").mapInArrow(ask, schema)
    met = index.unionByName(probes).repartition(n, "bucket").sortWithinPartitions("bucket", "asks").mapInArrow(meet, "kind long, id long, score double")
    found = met.groupBy("kind", "id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("score", "id"))).where(F.col("_n") <= k + 1)
    lists = ranked.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("found"))  # k + 1 at most
    answered = asking.join(questions, "vec").join(lists, "kind")
    own = F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k)
    return answered.select(F.col("id").alias("query_id"), F.posexplode(own).alias("_p", "_f")).select("query_id", (F.col("_p") + 1).alias("rank"), F.col("_f.id").alias(key), F.col("_f.score").alias("score"))


def usable_like(rows: DataFrame, key: str, vector: str, kinds: DataFrame) -> DataFrame:
    """Rows of ``rows`` whose vector is one of ``kinds``: usable, and of the common length."""
    good = rows.where(rows[vector].isNotNull() & rows[key].isNotNull()).select(rows[key].cast("long").alias("id"), rows[vector].alias("vec"))
    return good.join(kinds.select("vec"), "vec", "left_semi").select("id", "vec")
