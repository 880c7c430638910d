"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into parts; part i gets a threshold t_i >= -1 with sum(t_i) = T - m + 1.  If
two fingerprints differed in more than t_i bits in every part, they would differ in at least
sum(t_i + 1) = T + 1 bits; so any two within T bits agree within t_i in some part, and probing each
part within its threshold finds every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import claim, cut, text_column
from tidemark.llm.textscan import mix

WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints that the plan is estimated on; the plan changes costs, never results.
SAMPLE = 2048
#: Costs of a probe that is shuffled and of a candidate that is verified.
PROBE_COST, CANDIDATE_COST = 1.0, 0.03
#: Parts that the fingerprints of a component are dealt into when they get its smallest key.
SALTS = 16
#: A fingerprint with more than one in HOT times shuffle partitions of all rows is joined by a broadcast.
HOT = 4
#: Members of a bucket that are verified in one task; a larger bucket's members are dealt by further bits.
CROWD = 20_000
#: Turns of dealing by further bits; what is a crowd even then is verified as it is.
TURNS = 4
#: Buckets up to this size are verified by shifted comparisons of a whole batch at once.
SMALL = 12


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles; 0 without words."""
    import xxhash

    parts = text.lower().split()
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, parts), np.int64, n) + 1
    stop = np.cumsum(size) - 1
    begin = stop - size + 1
    ones, total, digest = np.zeros(64, np.int64), n - words + 1, xxhash.xxh64_intdigest
    for lo in range(0, total, 65_536):
        hi = min(total, lo + 65_536)
        h = np.array([digest(joined[i:j], seed) for i, j in zip(begin[lo:hi].tolist(), stop[lo + words - 1 : hi + words - 1].tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``fp`` (the 64 bits as a signed long) of every row; null text is empty."""
    import pyarrow as pa

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key], text_column(docs, text).cast("binary").alias("text")).mapInArrow(of, f"`{key}` {kind}, fp long")


# ---- the plan


def ball(bits: int, radius: int) -> int:
    return sum(comb(bits, k) for k in range(radius + 1))


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in ``m`` parts of nearly equal size, correlated bits together.

    A part grows from the bit that is most correlated with others, by the free bit with the largest
    mean correlation to what the part holds.
    """
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    x = bits - bits.mean(0)
    s = np.sqrt((x**2).sum(0)) + 1e-12
    c = np.abs((x.T @ x) / s[:, None] / s[None])
    np.fill_diagonal(c, 0)
    free, parts = set(range(64)), []
    for size in (64 // m + (i < 64 % m) for i in range(m)):
        own = [max(sorted(free), key=lambda b: c[b, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < size:
            nxt = max(sorted(free), key=lambda b: c[b, own].sum())
            own.append(nxt)
            free.discard(nxt)
        parts.append(sorted(own))
    return parts


def near_share(sample: np.ndarray, part: list[int], most: int) -> list[float]:
    """For each radius up to ``most``: the share of pairs that agree within it in a part.

    The larger of what is seen in the sample's pairs and of what independent bits would give.
    """
    mask = np.uint64(sum(1 << b for b in part))
    x = sample & mask
    seen = np.zeros(most + 1)
    for shift in range(1, min(len(x), 200)):
        d = np.bitwise_count(x ^ np.roll(x, shift))
        seen += [(d <= t).sum() for t in range(most + 1)]
    seen /= max(1, len(x) * max(1, min(len(x), 200) - 1))
    p = np.array([((sample >> np.uint64(b)) & np.uint64(1)).mean() for b in part])
    differ = 2 * p * (1 - p)
    dist = np.zeros(most + 2)
    dist[0] = 1
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.maximum(seen, np.cumsum(dist)[: most + 1]).tolist()


def plan(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The parts and thresholds with the least estimated cost over ``n`` fingerprints.

    For each number of parts, dynamic programming over parts and used-up threshold finds the best
    allocation of sum(t_i) = radius - m + 1, t_i >= -1 (-1: the part isn't probed).
    """
    best = None
    for m in range(2, radius + 2):
        parts = group_bits(sample, m)
        total = radius - m + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for i, part in enumerate(parts):
            top = min(len(part), total + m)  # others may go to -1
            share = near_share(sample, part, max(0, min(top, 3)))
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, ts) in table.items():
                for t in range(-1, min(top, 3) + 1):
                    own = 0.0 if t < 0 else PROBE_COST * n * (ball(len(part), t) + (t > 0)) + CANDIDATE_COST * n * n * share[t]
                    if used + t not in nxt or cost + own < nxt[used + t][0]:
                        nxt[used + t] = (cost + own, [*ts, t])
            table = nxt
        if total in table and (best is None or table[total][0] < best[0]):
            best = (table[total][0], list(zip(parts, table[total][1])))
    return best[1]


# ---- probing and verifying


def part_values(fp: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(part):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def flips(bits: int, radius: int) -> np.ndarray:
    """All masks of 1 to ``radius`` bits."""
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for k in range(1, radius + 1) for c in combinations(range(bits), k)], np.uint64)


def probes(fp: np.ndarray, parts: list[tuple[list[int], int]]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, fingerprints, 0 for what is stored or 1 for what asks)."""
    for i, (part, t) in enumerate(parts):
        if t < 0:
            continue
        own, top = part_values(fp, part), np.uint64(i << 58)
        yield own | top, fp, 0
        for mask in flips(len(part), t) if t else ():
            yield (own ^ mask) | top, fp, 1


def forest(fp: np.ndarray, asks: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of a bucket's links: never more pairs than members.

    Members that are linked leave the list of those still to be reached, so a dense group costs few
    comparisons; a link needs one of its two ends to be stored in the bucket.
    """
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = np.bitwise_count(fp[left] ^ fp[x]) <= radius
            if asks[x]:
                hit &= ~asks[left]
            if hit.any():
                got = left[hit].tolist()
                left = left[~hit]
                todo += got
                out += [(x, y) for y in got]
    return out


def bucket_links(bucket: np.ndarray, fp: np.ndarray, asks: np.ndarray, radius: int = RADIUS) -> tuple[list, list]:
    """Links of whole buckets that stand one after another, as two lists of fingerprints."""
    cutat = np.flatnonzero(np.diff(bucket)) + 1
    begin = np.concatenate([[0], cutat])
    size = np.diff(np.concatenate([begin, [len(bucket)]]))
    wanted = np.zeros(len(begin), bool)
    number = np.repeat(np.arange(len(begin)), size)
    inner = size[number] <= SMALL
    for s in range(1, SMALL):
        same = inner[:-s] & (bucket[:-s] == bucket[s:]) & ~(asks[:-s] & asks[s:]) if s < len(bucket) else np.zeros(0, bool)
        if not same.any():
            break
        at = np.flatnonzero(same)
        wanted[number[at[np.bitwise_count(fp[at] ^ fp[at + s]) <= radius]]] = True
    wanted |= size > SMALL
    a, b = [], []
    for g in np.flatnonzero(wanted):
        lo, hi = begin[g], begin[g] + size[g]
        own = fp[lo:hi]
        for x, y in forest(own, asks[lo:hi], radius):
            a.append(own[x])
            b.append(own[y])
    return a, b


def further_bits(bucket: np.ndarray, fp: np.ndarray, asks: np.ndarray, radius: int, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Members of crowded buckets in smaller ones: each once for each of radius + 1 groups of bits.

    Two members within the radius agree in all bits of some group, so every link is found again.  The
    groups are other ones in each turn.
    """
    order = np.random.default_rng((radius, turn)).permutation(64)
    for k, part in enumerate(np.array_split(order, radius + 1)):
        own = part_values(fp, part.tolist()) + np.uint64(k << 32)
        yield mix(bucket.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(own + np.uint64(turn << 40))).view(np.int64), fp, asks


def links(distinct: DataFrame, parts: list[tuple[list[int], int]], radius: int = RADIUS) -> DataFrame:
    """(``a``, ``b``): for each bucket, a spanning forest of the links of different fingerprints ``fp``.

    A bucket of more than ``CROWD`` members isn't verified where it is: its members go on to smaller
    buckets by further bits, so no task holds more than a crowd, and no link is lost.
    """
    import pyarrow as pa

    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["bucket", "fp", "asks"]

    def rows(bucket, fp, asks):
        return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(asks.astype(np.int8))], names=columns)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(all_fp), 8192):
                for bucket, fp, asks in probes(all_fp[lo : lo + 8192], parts):
                    yield rows(bucket, fp, np.full(len(fp), asks))

    def verify(last: bool):
        """Links (``a``, ``b``), and as rows with a ``bucket`` the members of crowds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = []
            size, crowd = 0, None

            def found(cols):
                a, b = bucket_links(*cols, radius)
                ends = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b))
                return pa.RecordBatch.from_arrays([*ends, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int8())], names=["a", "b", "bucket", "asks"])

            def passed_on(cols):
                return pa.RecordBatch.from_arrays([pa.array(cols[1].view(np.int64)), pa.nulls(len(cols[0]), pa.int64()), pa.array(cols[0]), pa.array(cols[2].astype(np.int8))], names=["a", "b", "bucket", "asks"])

            def done():
                return found([np.concatenate(x) for x in zip(*held)])

            for b in batches:
                cols = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), b.column(2).to_numpy(zero_copy_only=False) == 1]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(cols[0])) + 1, [len(cols[0])]]) if len(cols[0]) else [0]
                spans = list(zip(cuts[:2], cuts[1:2])) + list(zip(cuts[1:-1], cuts[2:]))
                if len(cuts) > 3 and np.diff(cuts[1:-1]).max() <= CROWD:  # the buckets in the middle, all at once
                    spans = [(cuts[0], cuts[1]), (cuts[1], cuts[-2]), (cuts[-2], cuts[-1])]
                whole = []  # members of buckets that end within this batch
                for i, j in spans:
                    own = [c[i:j] for c in cols]
                    if held and own[0][0] != held[0][0][0]:
                        yield done()
                        held, size = [], 0
                    if crowd is not None and own[0][0] != crowd:
                        crowd = None
                    if crowd is None and not last and own[0][0] == own[0][-1] and size + j - i > CROWD:
                        crowd = own[0][0]
                        for x in held:
                            yield passed_on(x)
                        held, size = [], 0
                    if crowd is not None:
                        yield passed_on(own)
                    elif j < len(cols[0]) and not held:
                        whole.append(own)
                    else:  # the last bucket of a batch may go on
                        held.append(own)
                        size += j - i
                if whole:
                    yield found([np.concatenate(x) for x in zip(*whole)])
            if held:
                yield done()

        return run

    def deal(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for cols in further_bits(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), b.column(2).to_numpy(zero_copy_only=False) == 1, radius, turn):
                    yield rows(*cols)

        return run

    dealt, out, schema = distinct.select("fp").mapInArrow(probe, "bucket long, fp long, asks byte"), None, "a long, b long, bucket long, asks byte"
    for turn in range(TURNS + 1):
        met = cut(dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "asks").mapInArrow(verify(turn == TURNS), schema))
        own = met.where("bucket is null").select("a", "b")
        out = own if out is None else out.unionByName(own)
        crowds = met.where("bucket is not null").selectExpr("bucket", "a AS fp", "asks")
        if crowds.isEmpty():
            break
        dealt = crowds.mapInArrow(deal(turn), "bucket long, fp long, asks byte")
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest key reachable) of every row.

    Fingerprints are grouped first, so any number of equal texts is one fingerprint with one smallest
    key; only different fingerprints are probed, each bucket gives a spanning forest, and the
    components are found by contraction.  Null or empty text has fingerprint zero and is linked like
    any other; rows with a null key get their group's component; an empty table gives no rows.
    """
    marked = cut(fingerprints(docs, key, text))
    spark = docs.sparkSession
    distinct = cut(marked.groupBy("fp").agg(F.min(key).alias("_least"), F.count(F.lit(1)).alias("_rows")))
    n, total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    if n > 1:
        picked = distinct.select("fp", F.xxhash64("fp").alias("_o")).orderBy("_o").limit(SAMPLE).collect()  # at most SAMPLE rows
        sample = np.array([r[0] for r in picked], np.int64).view(np.uint64)
        ends = components(links(distinct, plan(sample, n, radius), radius))
        joined = distinct.join(ends.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_least", "_rows", F.coalesce("root", "fp").alias("_root"))
        least = joined.groupBy("_root").agg(F.min("_least").alias("component_id"))
        # a component may hold any number of fingerprints: its one row goes to each of SALTS parts of them
        salted = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = cut(joined.withColumn("_salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted, ["_root", "_salt"]).select("fp", "component_id", "_rows"))
    else:
        named = distinct.select("fp", F.col("_least").alias("component_id"), "_rows")
    # a fingerprint of many rows, as that of all empty texts, is broadcast; the others are joined by a shuffle
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = F.col("_rows") > total // (HOT * parts) + 1
    hot = named.where(many).select("fp", "component_id")  # fewer than HOT * parts rows, 16 bytes each
    name = [key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"]
    some = marked.join(F.broadcast(hot), "fp").select(*name)
    rest = marked.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(named.where(~many).select("fp", "component_id"), "fp")
    return some.unionByName(rest.select(*name))
