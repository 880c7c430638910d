"""An interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Counting: each task counts the word pairs of its texts and sends them, by first word, to shards; a
shard sums them, writes one sorted hash array to the shared folder, and sends on what it knows of
single words (counts, continuation counts); these are summed and written likewise.  What travels is
blobs of distinct pairs, never tokens.  First words that are so frequent that they would fill a
shard are split by their second word.

Tokens are words between ASCII white space with A-Z in lower case, then one end per text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textscan
from tidemark.llm.shared import mapped, packed, publish, shared_dir, text_column, unpacked

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Bytes of text whose pairs are one shard, about; there are at least as many shards as shuffle partitions.
SHARD_BYTES = 64 << 20
#: Shards of pairs for each shard of words, which are far fewer than pairs.
WORDS_PER = 8
#: Tokens that a task counts together before it sends its pairs on.
TOGETHER = 2_000_000
#: One in so many texts is looked at to find first words to split; it only decides on what shard a pair is.
LOOK = 16
_U = np.uint64


def pairs(w: textscan.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, text's first place) of all pairs of the texts: start and words, words and end."""
    n = len(w.first) - 1
    d = np.arange(n)
    second = np.empty(len(w.hash) + n, np.uint64)
    second[np.arange(len(w.hash)) + np.repeat(d, np.diff(w.first))] = w.hash
    second[w.first[1:] + d] = END
    first = np.empty_like(second)
    first[1:] = second[:-1]
    begin = w.first[:-1] + d
    first[begin] = START
    return first, second, begin


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """Numbers below n that rise with x."""
    return ((x >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


@dataclass
class Layout:
    """Where pairs and words are: the number of shards, and first words that are split."""

    shards: int
    word_shards: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    ways: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def of_pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = first
        if len(self.hot):
            i = np.searchsorted(self.hot, first)
            i[i == len(self.hot)] = 0
            split = self.hot[i] == first
            if split.any():
                at = first.copy()
                at[split] = textscan.mix(first[split] + (textscan.mix(second[split]) % self.ways[i[split]]) * _U(0x9E3779B97F4A7C15))
        return _spread(textscan.mix(at), self.shards)

    def of_words(self, word: np.ndarray) -> np.ndarray:
        return _spread(word, self.word_shards)


def find_hot(rows: DataFrame, shards: int, word_shards: int) -> Layout:
    """Words with more than a quarter of a shard's share of the tokens, from one in LOOK texts."""
    import pyarrow as pa

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {int(START): 0}
        n = 0
        for b in batches:
            for w in textscan.scan(b.column(0)):
                u, c = np.unique(w.hash, return_counts=True)
                n += len(w.hash)
                total[int(START)] += w.hi - w.lo
                big = c >= max(2, len(w.hash) // (16 * shards))
                for x, k in zip(u[big].tolist(), c[big].tolist()):
                    total[x] = total.get(x, 0) + k
                if len(total) > 64 * shards:
                    total = dict(sorted(total.items(), key=lambda z: -z[1])[: 32 * shards])
        top = sorted(total.items(), key=lambda z: -z[1])[: 8 * shards]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.uint64()).cast(pa.string()), pa.array([k for _, k in top], pa.int64()), pa.array([n] + [0] * (len(top) - 1), pa.int64())], names=["word", "n", "tokens"])

    found = rows.mapInArrow(heavy, "word string, n long, tokens long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    all_ = found.agg(F.sum("tokens")).first()[0] or 0
    if not all_:
        return Layout(shards, word_shards)
    share = all_ / (4 * shards)
    hot = sorted((int(r.word), -int(-r.n // share)) for r in found.where(F.col("n") > share).collect())  # fewer than 4 for each shard
    return Layout(shards, word_shards, np.array([h for h, _ in hot], np.uint64), np.array([max(1, k) for _, k in hot], np.uint64))


# ---- blobs


def _narrow(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and places and values of what doesn't fit one."""
    big = np.flatnonzero(x >= 255)
    out = np.minimum(x, 255).astype(np.uint8)
    return out, big.astype(np.uint64), x[big].astype(np.uint64)


def _wide(small: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[at.astype(np.int64)] = value.astype(np.int64)
    return out


def _pack_pairs(first: np.ndarray, second: np.ndarray, count: np.ndarray) -> bytes:
    """Pairs that stand by first word: each first word once, with how many second words it has."""
    at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    runs = _narrow(np.diff(np.append(at, len(first))))
    return packed(first[at], *(x for r in (runs, _narrow(count)) for x in (r[1], r[2])), second, runs[0], _narrow(count)[0])


def _unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = unpacked(np.frombuffer(blob, np.uint8))
    u = [x.view(np.uint64) for x in p[:6]]
    return np.repeat(u[0], _wide(p[6], u[1], u[2])), u[5], _wide(p[7], u[3], u[4])


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each value."""
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], *((np.add.reduceat(v[order], at) if len(at) else v[:0]) for v in values), order[at]


# ---- counting


def train(docs: DataFrame, learn, text: str = "text", shards: int | None = None) -> Model:
    """Count the model on the rows of ``docs`` for which the column ``learn`` is true.

    ``shards`` is the number of hash arrays of pairs: by default one for each SHARD_BYTES of text or
    for each shuffle partition, whichever are more.  So what one worker sums is bounded however large
    the corpus is; first words that would fill a shard are split.  Null texts count as empty, which is
    one end; repeated rows count each time; other columns don't matter; of an empty table the model
    gives every token probability 1.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rows = docs.where(learn).select(text_column(docs, text).alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if shards is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(least, int(-(-size // SHARD_BYTES)))
    n, m = shards, max(min(shards, least), -(-shards // WORDS_PER))
    layout = find_hot(rows.where(F.pmod(F.xxhash64("text"), F.lit(LOOK)) == 0), n, m)
    home = shared_dir(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for w in textscan.scan(b.column(0)):
                first, second, _ = pairs(w)
                held.append((first, second))
                size += len(first)
                if size >= TOGETHER:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def send(held) -> pa.RecordBatch:
        first, second = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        held.clear()
        _, c, pick = _summed(textscan.pair_key(first, second), np.ones(len(first), np.int32))
        first, second = first[pick], second[pick]
        shard = layout.of_pairs(first, second)
        order = np.argsort(shard.astype(np.uint64) << _U(44) | first >> _U(20))
        first, second, c, shard = first[order], second[order], c[order], shard[order]
        cutat = np.searchsorted(shard, np.arange(n + 1))
        got = [(s, _pack_pairs(first[i:j], second[i:j], c[i:j])) for s, (i, j) in enumerate(zip(cutat, cutat[1:])) if j > i]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["shard", "blob"])

    def by_shard(batches):
        """(shard, its blobs): rows come in the order of shards."""
        now, blobs = None, []
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1)):
                if s != now and blobs:
                    yield now, blobs
                    blobs = []
                now = s
                blobs.append(x.as_py())
        if blobs:
            yield now, blobs

    def sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, blobs in by_shard(batches):
            first, second, c = (np.concatenate(x) for x in zip(*map(_unpack_pairs, blobs)))
            key, c, pick = _summed(textscan.pair_key(first, second), c)
            first, second = first[pick], second[pick]
            small, at, big = _narrow(c)
            publish(f"{home}/pairs/{s:06d}", packed(key, at, big, small))
            words, times, one, two, more, _ = _summed(first, c, *((c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)))
            after, kinds, _ = _summed(second, np.ones(len(second), np.int64))
            ends = int(c[second == END].sum())
            stats = np.array([len(key), *((c == k).sum() for k in (1, 2, 3, 4))], np.int64)
            out = []
            # both stand in the order of words' shards; only shards that get something are sent a blob
            to_words, to_after = layout.of_words(words), layout.of_words(after)
            end_at, home_at = int(layout.of_words(np.array([END]))[0]), s % m
            for t in np.unique(np.concatenate([to_words, to_after, [end_at, home_at]])).tolist():
                i, j = np.searchsorted(to_words, [t, t + 1])
                k, l = np.searchsorted(to_after, [t, t + 1])
                own_end = np.array([ends if t == end_at else 0], np.int64)
                cols = [words[i:j], after[k:l], own_end, np.append(stats, s) if t == home_at else stats[:0]]
                narrow = [x.astype(np.uint32) if not len(x) or x.max() < 2**32 else x.astype(np.int64) for x in (times[i:j], one[i:j], two[i:j], more[i:j], kinds[k:l])]
                out.append((t, packed(*cols, *narrow)))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["shard", "blob"])

    def sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, blobs in by_shard(batches):
            words, sums, stats, counted = [], [], np.zeros(5, np.int64), []
            for x in blobs:
                p = unpacked(np.frombuffer(x, np.uint8))
                w, a, end, own = p[0].view(np.uint64), p[1].view(np.uint64), p[2].view(np.int64), p[3].view(np.int64)
                by = [v.view(np.uint32 if len(v) == 4 * len(k) else np.int64).astype(np.int64) for v, k in zip(p[4:], (w, w, w, w, a))]
                words += [w, a, np.array([END])]
                zero = np.zeros(len(w), np.int64)
                sums += [np.stack([*by[:4], zero], 1), np.stack([*[np.zeros(len(a), np.int64)] * 4, by[4]], 1), np.array([[end[0], 0, 0, 0, 0]], np.int64)]
                if len(own):
                    stats += own[:5]
                    counted.append(int(own[5]))
            words, sums = np.concatenate(words), np.concatenate(sums)
            known = sums.any(1)
            key, *cols, _ = _summed(words[known], *sums[known].T)
            publish(f"{home}/words/{s:06d}", packed(key, *cols))
            real = key != START
            kinds = cols[4][real]
            told = {"shards": counted, "pairs": stats.tolist(), "tokens": int(cols[0][real].sum()), "words": int(real.sum()), "kinds": [int(kinds.sum()), *(int((kinds == k).sum()) for k in (1, 2, 3, 4)), int((kinds > 2).sum())]}
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([json.dumps(told)])], names=["shard", "told"])

    def gathered(rows, parts):
        return rows.repartition(parts, "shard").sortWithinPartitions("shard")

    sums = gathered(gathered(rows.mapInArrow(count, "shard int, blob binary"), n).mapInArrow(sum_pairs, "shard int, blob binary"), m)
    told = {r.shard: json.loads(r.told) for r in sums.mapInArrow(sum_words, "shard int, told string").collect()}  # one row of totals per shard
    total = lambda k: np.sum([t[k] for t in told.values()], axis=0).tolist() if told else None
    return Model(home, layout, sorted(s for t in told.values() for s in t["shards"]), sorted(told), total("pairs") or [0] * 5, total("tokens") or 0, total("words") or 0, total("kinds") or [0] * 6)


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2, D3+ from how many have the counts 1 to 4.

    Where the estimate isn't between 0 and the count, as on very little text, half the count: every
    discount is positive, so every word keeps some probability.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    rule = [1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return [d if n1 and n2 and 0 < d < k else 0.5 * k for k, d in enumerate(rule, 1)]


@dataclass
class Model:
    """A counted model: where its arrays are, and its totals.  It's small; the arrays stay in their files."""

    home: str
    layout: Layout
    pair_files: list[int]  # shards that were counted and published
    word_files: list[int]
    pairs: list[int]  # kinds, and how many have the counts 1 to 4
    tokens: int
    words: int
    kinds: list[int]  # the sum of continuation counts; how many are 1 to 4; how many are over 2

    def __post_init__(self):
        self.d = discounts(*self.pairs[1:5])
        self.d_kinds = discounts(*self.kinds[1:5])
        b = self.kinds[0]
        spare = self.d_kinds[0] * self.kinds[1] + self.d_kinds[1] * self.kinds[2] + self.d_kinds[2] * self.kinds[5]
        #: what every word, an unknown one too, gets of the discounted part
        self.floor = (spare / b if b else 1.0) / (self.words + 1)

    def reader(self) -> Reader:
        if self.home not in _readers:
            _readers.clear()
            _readers[self.home] = Reader(self)
        return _readers[self.home]


_readers: dict[str, Reader] = {}


class Reader:
    """A process's memory-mapped view of a model."""

    def __init__(self, model: Model):
        self.m = model
        self._maps: dict[tuple[str, int], list[np.ndarray]] = {}
        self._files = {"pairs": set(model.pair_files), "words": set(model.word_files)}

    def _at(self, what: str, shard: int) -> list[np.ndarray] | None:
        """A shard's arrays; None where nothing was counted.  A file that was published and isn't there raises."""
        if shard not in self._files[what]:
            return None
        if (what, shard) not in self._maps:
            uri = f"{self.m.home}/{what}/{shard:06d}"
            try:
                self._maps[what, shard] = unpacked(mapped(uri))
            except FileNotFoundError as e:
                raise FileNotFoundError(f"{uri} of the model is missing: spark.checkpoint.dir must name a folder that all executors share") from e
        return self._maps[what, shard]

    def word_stats(self, words: np.ndarray) -> np.ndarray:
        """[5, n]: count, followers seen once, twice, more often, and continuation count of sorted words."""
        out = np.zeros((5, len(words)), np.int64)
        shard = self.m.layout.of_words(words)
        for s in np.unique(shard).tolist():
            i, j = np.searchsorted(shard, [s, s + 1])
            if (p := self._at("words", s)) is None or not len(p[0]):
                continue
            key = p[0].view(np.uint64)
            spot = np.searchsorted(key, words[i:j])
            spot[spot == len(key)] = 0
            hit = np.flatnonzero(key[spot] == words[i:j])
            for c in range(5):
                out[c, i + hit] = p[1 + c].view(np.int64)[spot[hit]]
        return out

    def pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), np.int64)
        key, shard = textscan.pair_key(first, second), self.m.layout.of_pairs(first, second)
        order = np.lexsort((key, shard))
        cutat = np.searchsorted(shard[order], np.arange(self.m.layout.shards + 1))
        for s, (i, j) in enumerate(zip(cutat, cutat[1:])):
            if j == i or (p := self._at("pairs", s)) is None or not len(p[0]):
                continue
            keys, want = p[0].view(np.uint64), key[order[i:j]]
            spot = np.searchsorted(keys, want)
            spot[spot == len(keys)] = 0
            got = p[3][spot].astype(np.int64)
            big = np.flatnonzero(got == 255)
            if len(big):
                at = np.searchsorted(p[1].view(np.uint64), spot[big].astype(np.uint64))
                got[big] = p[2].view(np.uint64)[np.minimum(at, len(p[2]) // 8 - 1)].astype(np.int64)
            got[keys[spot] != want] = 0
            out[order[i:j]] = got
        return out

    def logs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, count of the second word, log10 of the add-one base) of each pair."""
        m = self.m
        both, place = np.unique(np.concatenate([first, second]), return_inverse=True)
        c, one, two, more, kinds = self.word_stats(both)
        v, w = place[: len(first)], place[len(first) :]
        d_kind = np.array([0.0, *m.d_kinds])[np.minimum(kinds, 3)]
        single = (kinds - d_kind) / (m.kinds[0] or 1) + m.floor
        d_pair = np.array([0.0, *m.d])
        n = self.pair_counts(first, second)
        left = (m.d[0] * one + m.d[1] * two + m.d[2] * more) / np.maximum(c, 1)
        left[c == 0] = 1.0
        p = (n - d_pair[np.minimum(n, 3)]) / np.maximum(c, 1)[v] + left[v] * single[w]
        seen = np.where(both == START, 0, c)[w]
        return np.log10(p), seen, np.log10((seen + 1) / (m.tokens + m.words + 1))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Log10 probabilities of whole texts under a model; ``keep`` names more columns to pass on.

    Returns key, ``n_tokens`` (words and the end), ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (add-one unigrams), ``score`` and ``perplexity``.  Null text is
    empty and is the end alone.  A model of no text gives every token probability 1.  Rows may repeat
    and keys may be null; an empty table gives no rows; other columns are passed on only if ``keep``
    names them.  A file of the model that is gone raises ``FileNotFoundError``.
    """
    import pyarrow as pa

    keep = keep or []
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for b in batches:
            out = []
            for w in textscan.scan(b.column(0), most=2 << 20):
                first, second, begin = pairs(w)
                log, seen, base = reader.logs(first, second)
                n = np.diff(np.append(begin, len(first)))
                out.append((n, np.add.reduceat((seen > 0).astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(log, begin)))
            if not out:
                continue
            n, known, base, log = (np.concatenate(x) for x in zip(*out))
            cols = [pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(log), pa.array(10.0 ** np.minimum(-log / n, 300))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*b.schema.names[1:], "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    names = [key, *keep]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select(text_column(docs, text).alias("_text"), *[docs[c] for c in names]).mapInArrow(run, schema)
