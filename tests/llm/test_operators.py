"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats and empty tables."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.llm import ann, decontaminate, kneser_ney, labels, nbest, quality, queries, sharding, simhash, textscan, token_count, toxicity, url_filter

#: Extra columns whose names the operators use themselves
CLASHES = {"score": 1.5, "fp": 7, "shard": "s", "kind": 3, "bucket": 4, "_k": 5, "_n": 6, "y": 7, "size": 8, "held": 9, "n_tokens": 10, "word": "w", "id": 11}


def documents(spark, rows):
    """Rows of (doc_id, text), with clashing columns beside."""
    df = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


def sample(n=60, seed=1):
    rnd = random.Random(seed)
    vocab = ["the", "of", "And", "ére", "zeta", "日本", "alpha,", "b.", "x1"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 40)))) for i in range(n)]
    long = " ".join(rnd.choice(vocab) for _ in range(30_000))
    odd = [None, "", "   ", "\n\n", "word", rows[0][1], rows[0][1].upper(), rows[1][1] + " tail", "a\tb\nc\x0bd", "x" * 70_000, long, long + " end", "\u00a0nbsp\u2003wide"]
    rows += list(enumerate(odd, n))
    return rows + [rows[3], rows[3]]  # repeated rows


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [(0, "x")]).where("false")


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- words


@pytest.mark.parametrize(("separators", "pattern"), [(textscan.BLANKS, rb"[^\x20\x09-\x0D]+"), (textscan.MARKS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_words(rows, separators, pattern, most):
    texts = [t for _, t in rows]
    seen = {}
    for w in textscan.scan(pa.array(texts, pa.string()), separators, most):
        for d in range(w.hi - w.lo):
            own = slice(w.first[d], w.first[d + 1])
            words = [w.data[a:b].tobytes() for a, b in zip(w.start[own], w.end[own])]
            assert words == re.findall(pattern, (texts[w.lo + d] or "").encode().lower())
            for x, h in zip(words, w.hash[own].tolist()):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    assert textscan.hash_words(list(seen)).tolist() == list(seen.values())


def test_words_longer_than_a_chunk(monkeypatch):
    text = b"ab " + b"x" * 5_000 + b" cd " + b"yz" * 700
    want = textscan.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), textscan.BLANKS).hash.tolist()
    for chunk in (1, 7, 512, 1_400, 5_000):
        monkeypatch.setattr(textscan, "CHUNK", chunk)
        assert textscan.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), textscan.BLANKS).hash.tolist() == want


def test_one_long_text_takes_bounded_memory():
    """50 MB in one text: some bytes a byte, not dozens."""
    import tracemalloc

    raw = np.frombuffer(b"some words of a very long text " * (50_000_000 // 31), np.uint8)
    tracemalloc.start()
    w = textscan.words(raw, np.array([0, len(raw)]), textscan.BLANKS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w.hash) == 7 * (50_000_000 // 31) and peak < 16 * len(raw)


# ---- 1: segmentation


@pytest.fixture(scope="module")
def lattice():
    return nbest.segmenter(queries.vocabulary(), 4).lattice


def all_paths(lattice, part):
    edges, out = lattice.edges(part), []

    def go(at, value, lens):
        if not at:
            out.append((-value, tuple(lens), value))
        for i, v, _ in edges[at] if at else ():
            go(i, value + v, [*lens, i - at])

    go(len(part), 0, [])
    return sorted(out)


@pytest.mark.parametrize("word", ["the", "tion", "erreth", "日本a", "aaaaaaa", "\nOre", "  x", "<s>", "🎉", "▁"])
def test_n_best_is_brute_force(lattice, word):
    part = nbest.part_form(word)
    want = all_paths(lattice, part)
    found = lattice.n_best(part, 6)
    assert [v for v, _ in found] == [w[2] for w in want[:6]]
    assert [i for _, i in found] == [lattice._ids_of(part, w[1]) for w in want[:6]]
    ids, value, gap = lattice.best_of([part, word * 3])
    assert ids[0] == found[0][1] and value[0] == found[0][0]
    assert gap[0] == (want[0][2] - want[1][2] if len(want) > 1 else -1)


def test_one_order_for_parts_of_any_length(lattice):
    """The search of long parts gives what the other gives, ties and all."""
    rnd = random.Random(3)
    for _ in range(600):
        letters = rnd.choice(["ab", "the ion", "  x", "éa日", "0123", "aaaaaaab", " \n="])
        part = nbest.part_form("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))))
        for n in (1, 4, 9):
            assert lattice._n_best_long(part, n) == lattice.n_best(part, n)


def test_a_million_blanks_and_many_runs_of_them(lattice):
    s = nbest.Segmenter(queries.vocabulary(), 4)
    blank = min(v for p, i in lattice.ids.items() if not p.strip(" ") for v in [int(lattice.value[i])])
    for text in (" " * 1_000_000, "a  b " * 9_000):
        (found,) = s.segment([text])
        assert len(found) == 4 and all(lattice.decode(i) == text for _, i in found)
        assert all(sum(int(lattice.value[k]) for k in np.frombuffer(i, "<u2").tolist()) == v for v, i in found) and blank < 0
    assert found[0][0] < -8_000 * 10**9 * nbest.STEP


def test_a_small_cache_changes_nothing(monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join("".join(rnd.choice("theino") for _ in range(rnd.randint(1, 6))) for _ in range(40)) for _ in range(300)] + ["y" * 3_000, "é" * 500]
    want = nbest.Segmenter(queries.vocabulary(), 4).segment(texts)
    monkeypatch.setattr(nbest, "CACHE", 60)
    monkeypatch.setattr(nbest, "CACHE_BYTES", 2_000)
    s = nbest.Segmenter(queries.vocabulary(), 4)
    assert [x for t in texts for x in s.segment([t])] == want
    assert len(s.at) <= 60 and s.held <= 2_000
    assert [(0, 2), (2, 3), (3, 4)] == list(token_count.blocks([1, 1, 5 << 20, 2])) and list(token_count.blocks([])) == []


def test_whole_texts_are_brute_force(lattice):
    s = nbest.Segmenter(queries.vocabulary(), 4)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(" \nabcé▁ht") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    for t, found in zip(texts, s.segment(texts)):
        want = all_paths(lattice, " " + t)
        assert [v for v, _ in found] == [w[2] for w in want[:4]], t
        ids = {lattice._ids_of(" " + t, w[1]): w[2] for w in want}
        assert len({i for _, i in found}) == len(found) and all(ids[i] == v for v, i in found)


def test_different_parts_are_looked_up_once_for_many_texts():
    rnd = random.Random(8)
    texts = ["", " ", "\n", "a", " a", "a ", "a\n", "\na", "a  b", "a \nb", *("".join(rnd.choice(" \n\tabé▁日🎉") for _ in range(rnd.randint(0, 30))) for _ in range(2000))]
    for some in (texts, texts[::-1], ["a b a", "b a\nb"], [""], []):
        names, which, first = nbest.Segmenter.split(some)
        assert len(set(names)) == len(names) and len(first) == len(some) + 1
        for t, i, j in zip(some, first[:-1], first[1:]):
            parts = token_count.pre_tokens(t)
            assert [names[k] for k in which[i:j]] == ([""] if parts and parts[0][:1] == "\n" else []) + parts
    asked = []
    s = nbest.Segmenter(queries.vocabulary(), 4)

    class Cache(dict):
        def __getitem__(self, p):
            asked.append(p)
            return dict.__getitem__(self, p)

    s.at = Cache()
    s.segment(["one two one two " * 50 + "three"] * 20)
    assert sorted(asked) == ["", "one", "three", "two"][1:]


def test_the_bytes_of_many_ids(spark):
    texts = ["a b", "zebra", "", "c é\nd", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.round_trip for r in nbest.encode(df, queries.vocabulary()).collect())
    lat = nbest.segmenter(queries.vocabulary(), 4).lattice
    ids = np.frombuffer(nbest.Segmenter(queries.vocabulary(), 1).segment(["c é\nd 日🎉"] * 3)[1][0][1], "<u2")
    many = np.tile(ids, 20_000)  # more than are looked up at once
    assert lat.raw_of(many) == lat.text_of(ids.tobytes()).encode() * 20_000 and lat.raw_of(ids[:0]) == b""


def test_values_beyond_64_bits(spark):
    """10,000 indented lines, double blanks, and one run of 200,000 blanks."""
    texts = ["\n".join(["    x"] * 10_000), "a  b" * 10_000, "a" + " " * 200_000 + "b"]
    lat = nbest.segmenter(queries.vocabulary(), 4).lattice
    plain = {i: round(v / nbest.STEP) for i, v in enumerate(lat.value.tolist())}  # whole scores
    plain[lat.bytes_at[10]] = lat.unknown  # the one byte piece here: a line's end
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in nbest.encode(df, queries.vocabulary()).collect():
        assert r.round_trip and len(r.scores) == 4 and len(set(r.digests)) == 4
        assert r.scores == [sum(plain[i] for i in s) * lat.unit for s in r.segmentations] == sorted(r.scores, reverse=True)
        assert r.lengths == [len(s) for s in r.segmentations] and r.scores[0] < -(10**9) * 8_797


def test_more_than_255_segmentations_of_a_long_part(lattice):
    part = " " + "a" * 60
    many = lattice._n_best_long(part, 600)
    lists = [[0]] + [[] for _ in part]  # the plain way: each place's 600 best values
    for j, row in enumerate(lattice.edges(part)[1:], 1):
        lists[j] = sorted((x + v for i, v, _ in row for x in lists[i]), reverse=True)[:600]
    assert [v for v, _ in many] == lists[-1] and len({i for _, i in many}) == 600


def test_encode(spark, docs, rows, empty):
    path = queries.vocabulary()
    out = nbest.encode(docs, path).collect()
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    for r in out:
        assert r.scores == sorted(r.scores, reverse=True) and len(set(r.digests)) == len(r.digests)
        assert r.lengths == [len(s) for s in r.segmentations]
    back = nbest.decode(spark.createDataFrame([(r.doc_id, r.segmentations[-1]) for r in out], "doc_id long, ids array<int>"), path)
    assert all(b.text in texts[b.doc_id] for b in back.collect())
    assert nbest.encode(empty, path).count() == 0
    nothing = next(r for r in out if texts[r.doc_id] == {""})
    assert nothing.scores == [0.0] and nothing.segmentations == [[]]


# ---- 2: language model


def plain_model(texts):
    seqs = [["<s>", *re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), "</s>"] for t in texts]
    pairs = Counter(p for s in seqs for p in itertools.pairwise(s))
    words = Counter(w for s in seqs for w in s[1:])
    kinds = Counter(w for _, w in pairs)
    how = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    d, dk = kneser_ney.discounts(*how(pairs)), kneser_ney.discounts(*how(kinds))
    floor = sum(dk[min(v, 3) - 1] for v in kinds.values()) / len(pairs) / (len(words) + 1)
    after = defaultdict(list)
    for (v, _), n in pairs.items():
        after[v].append(n)

    def p(v, w):
        single = (kinds[w] - [0, *dk][min(kinds[w], 3)]) / len(pairs) + floor
        if v not in after:
            return single
        total = sum(after[v])
        return (pairs[v, w] - [0, *d][min(pairs[v, w], 3)]) / total + sum(d[min(n, 3) - 1] for n in after[v]) / total * single

    return p, words


def test_language_model(docs, rows, empty):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    p, words = plain_model([t or "" for i, t in rows if not held(i)])
    marked = docs.withColumn("held_out", labels.remainder(F.col("doc_id"), 7) == 2)
    model = kneser_ney.train(marked, ~F.col("held_out"), shards=5)
    assert (model.tokens, model.words) == (sum(words.values()), len(words))
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in kneser_ney.score(marked, model, keep=["held_out"]).collect():
        s = ["<s>", *re.findall(rb"[^\x20\x09-\x0D]+", texts[r.doc_id][0].encode().lower()), "</s>"]
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(s) - 1
        assert r.n_known == sum(words[w] > 0 for w in s[1:])
        assert r.score == pytest.approx(sum(math.log10(p(*x)) for x in itertools.pairwise(s)), rel=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (model.tokens + model.words + 1)) for w in s[1:]), rel=1e-9)
    assert abs(sum(p(b"the", w) for w in words) + p(b"the", "never") - 1) < 1e-9
    nothing = kneser_ney.train(empty, F.lit(True), shards=2)
    assert {r.score for r in kneser_ney.score(docs, nothing).collect()} == {0.0}
    assert kneser_ney.score(empty, model).count() == 0


def test_hot_first_words_are_split_and_found_again(spark):
    docs = documents(spark, [(i, " ".join(f"the w{(i * 7 + k) % 97}" for k in range(30))) for i in range(200)])
    model = kneser_ney.train(docs, F.lit(True), shards=8)
    layout = kneser_ney.find_hot(docs.select("text"), 8, 2)
    assert len(layout.hot) and layout.ways.max() > 1
    model2 = kneser_ney.train(docs, F.lit(True), shards=1)
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in kneser_ney.score(docs, m).collect()) for m in (model, model2))
    assert a == b


@pytest.mark.parametrize("what", ["pairs", "words"])
def test_a_missing_file_of_a_model_raises(spark, what):
    docs = documents(spark, [(i, f"the w{i % 9} of a w{i % 5}") for i in range(60)])
    model = kneser_ney.train(docs, F.lit(True), shards=3)
    files = model.pair_files if what == "pairs" else model.word_files
    assert files
    for f in files:
        os.unlink(f"{model.home.removeprefix('file://')}/{what}/{f:06d}")
    with pytest.raises(Exception, match="of the model is missing"):
        kneser_ney.score(docs, model).collect()


def test_shards_grow_with_the_corpus(spark, docs, rows, monkeypatch):
    """A shard's text is bounded, and the number of shards changes no score."""
    key = lambda m: got(kneser_ney.score(docs.where("doc_id < 40"), m).selectExpr("doc_id", "round(score, 8) AS score"), "doc_id", "score")
    few = kneser_ney.train(docs, F.lit(True))
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 20_000)
    many = kneser_ney.train(docs, F.lit(True))
    size = sum(len((t or "").encode()) for _, t in rows)
    assert few.layout.shards == 4 and many.layout.shards == -(-size // 20_000) > 8 and many.layout.word_shards < many.layout.shards
    assert key(few) == key(many) and len(many.pair_files) > 4


# ---- 3: neighbours


def test_neighbours_exact_when_small(spark):
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((300, 8)).astype(np.float32)
    x[100:250] = x[100]  # half of all rows are one vector
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors += [(900, None), (901, []), (902, [0.0] * 8), (903, [None] + [1.0] * 7), (904, [float("nan")] * 8), (905, [float("inf")] + [0.0] * 7), (906, [1.0, 2.0]), (None, [1.0] * 8), vectors[5]]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "vec": F.lit("x"), "kind": F.lit(2), "score": F.lit(0.5)})
    out = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=10).collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(out) == list(range(0, 300, 50))
    for q, found in out.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(300) if i != q)[:10]
        assert [(a, b) for a, b, _ in sorted(found)] == [(n + 1, i) for n, (_, i) in enumerate(want)]
        assert [s for *_, s in sorted(found)] == pytest.approx([s for s, _ in want], abs=1e-12)
    assert ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0)
    assert few.count() == 2


def recall_of(out, ids, x, asked):
    found = defaultdict(set)
    for r in out:
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in asked:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found[ids[q]] & {ids[i] for i in np.argsort(d, kind="stable")[:10]})
    return hits / (10 * len(asked))


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_recall(spark, monkeypatch, spread):
    """Clustered and shapeless vectors; of clustered ones a query meets a small part."""
    rnd = np.random.default_rng(1)
    centres = rnd.standard_normal((60, 32))
    x = (centres[rnd.integers(0, 60, 6000)] * 0.5 + spread * rnd.standard_normal((6000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    wants = []
    old = ann.needed
    monkeypatch.setattr(ann, "needed", lambda *a: wants.append(old(*a)) or wants[-1])
    out = ann.nearest(df, F.col("vec_id") % 50 == 0, least=100).collect()
    assert recall_of(out, list(range(6000)), x.astype(float), range(0, 6000, 50)) >= 0.9
    if spread < 1:
        assert np.quantile(np.concatenate(wants), 0.96) < 0.05 * 6000


def test_recall_of_the_registered_query(spark):
    data = DATA.replace("0.001", "0.01")
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, data, "embeddings").collect() if r.embedding is not None]
    x = np.array([v for _, v in rows], float)
    ids = [i for i, _ in rows]
    assert recall_of(queries.op3_neighbours(spark, data).collect(), ids, x, [k for k, i in enumerate(ids) if i % 100 == 0]) >= 0.9


# ---- 4: shards


def test_shards(docs, rows, empty):
    out = sharding.shard_by_bytes(docs, 7).collect()
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: zlib.crc32((t or "").encode())
    line = sorted((i, crc(t), size(t)) for i, t in rows)
    total, upto, want, slots = sum(s for *_, s in line), 0, [], Counter()
    for i, c, s in line:
        upto += s
        shard = min(6, (2 * upto - s) * 7 // (2 * total))
        want.append((i, s, c, shard, slots[shard]))
        slots[shard] += 1
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out) == sorted(want)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    assert sharding.shard_by_bytes(empty, 7).count() == 0


def test_shards_with_one_key(spark):
    same = documents(spark, [(5, "abc")] * 90 + [(None, "x")] * 10)
    out = sharding.shard_by_bytes(same, 10).collect()
    assert len(out) == 100 and max(Counter(r.shard for r in out).values()) <= 12
    for s in range(10):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))


# ---- 5: token counts


def test_pre_tokens_add_up():
    tok = token_count.tokenizer(queries.vocabulary())
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(" \n\tabcé▁<s>日🎉") for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    assert tok.parts
    assert [sum(tok.of_parts(tok.split(t))) if t else 0 for t in texts] == tok.whole(texts)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(docs, rows, empty, name):
    path = queries.vocabulary(name)
    want = token_count.tokenizer(path).whole([t or "" for _, t in rows])
    out = got(token_count.count_tokens(docs, path, limit=500, most=20), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert out == sorted(((i, len((t or "").encode()), n, n > 500) for (i, t), n in zip(rows, want)), key=repr)
    assert token_count.count_tokens(empty, path).count() == 0


def test_token_counts_of_long_unspaced_lines(spark, monkeypatch):
    """Pre-tokens of a megabyte go through caches that are bounded in characters."""
    monkeypatch.setattr(token_count, "CACHE_CHARS", 1_000)
    path = queries.vocabulary()
    texts = ["x" * 1_000_000, ("ab" * 50_000 + "\n") * 3, "日本" * 100_000, "a b c"] * 2
    want = token_count.tokenizer(path).whole(texts)
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert sorted(r.n_tokens for r in token_count.count_tokens(df, path).collect()) == sorted(want)
    held = token_count.Cache()
    held.add(["x" * 2_000], [3])
    held.trim()
    assert not held and held.chars == 0
    assert all(len(w) <= token_count.ENTRY for w in token_count.frequent_pre_tokens(df, path))


# ---- 6: near-duplicates


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, radius=4):
    fps = sorted({f for _, f in pairs})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            up[root(a)] = root(b)
    least = {}
    for i, f in pairs:
        least[root(f)] = min(i, least.get(root(f), i))
    return {f: least[root(f)] for f in fps}


def test_near_duplicates(docs, rows, empty):
    pairs = [(i, plain_fingerprint(t)) for i, t in rows]
    of = plain_components(pairs)
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(((i, f"{f:016x}", of[f]) for i, f in pairs), key=repr)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_every_plan_finds_every_link(seed):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(12)} | {0}
    fps = np.array(sorted(fps), np.uint64)
    plans = [simhash.plan(fps, n) for n in (10, 10**5, 10**8, 10**11)]
    for m in (2, 3, 4, 5):
        parts = simhash.group_bits(fps, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        for extra in range(m):
            t = [0] * m
            t[extra] = 4 - m + 1
            plans.append(list(zip(parts, t)))
    want = {(int(a), int(b)) for a, b in itertools.combinations(fps.tolist(), 2) if (a ^ b).bit_count() <= 4}
    for p in plans:
        assert sum(t for _, t in p) == 4 - len(p) + 1
        if sum(simhash.ball(len(x), t) for x, t in p if t >= 0) > 3000:
            continue
        rows = [(k, f, a) for ks, fs, a in simhash.probes(fps, p) for k, f in zip(ks.tolist(), fs.tolist())]
        rows.sort(key=lambda r: (r[0], r[2]))
        a, b = simhash.bucket_links(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows]) == 1)
        links = {(min(int(x), int(y)), max(int(x), int(y))) for x, y in zip(a, b)}
        assert links <= want
        assert plain_components([(0, f) for f in fps.tolist()]).keys() == set(fps.tolist())
        assert closure(links, fps) == closure(want, fps)


def closure(links, fps):
    up = {int(f): int(f) for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {f: root(f) for f in up}


def test_crowded_buckets_are_dealt_by_further_bits(spark, monkeypatch):
    """A bucket of very many fingerprints, and members of other buckets beside: no link is lost in any turn."""
    rnd = random.Random(12)
    low = [rnd.getrandbits(48) for _ in range(500)]
    fps = {(0xABCD << 48) | b for b in low} | {(0xABCD << 48) | (b ^ sum(1 << k for k in rnd.sample(range(48), rnd.randint(1, 4)))) for b in low[:200]} | {rnd.getrandbits(64) for _ in range(50)}
    fps |= {f ^ 5 for f in list(fps)[:40]}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in sorted(fps)], "fp long").repartition(3)
    parts = [(list(range(48, 64)), 0)] + [(list(range(12 * k, 12 * k + 12)), 0) for k in range(4)]
    want = plain_components(list(enumerate(sorted(fps))))
    for crowd, turns in ((20_000, 4), (100, 4), (3, 2), (1, 1)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "TURNS", turns)
        up = {f: f for f in fps}

        def root(f, up=up):
            while up[f] != f:
                f = up[f]
            return f

        for r in simhash.links(df, parts).collect():
            a, b = (int(np.int64(x).view(np.uint64)) for x in (r.a, r.b))
            assert (a ^ b).bit_count() <= 4
            up[root(a)] = root(b)
        groups = defaultdict(set)
        for f in fps:
            groups[root(f)].add(want[f])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_one_fingerprint_with_a_third_of_all_rows(spark):
    rows = [(i, None if i % 3 else f"one two three four five s{i}") for i in range(900)] + [(None, ""), (None, "one two three four five s3")]
    pairs = [(i, plain_fingerprint(t)) for i, t in rows]
    of = plain_components([(10**9 if i is None else i, f) for i, f in pairs])
    out = got(simhash.near_duplicates(documents(spark, rows)), "doc_id", "fingerprint", "component_id")
    assert out == sorted(((i, f"{f:016x}", of[f]) for i, f in pairs), key=repr)


def test_components(spark):
    from tidemark.llm.components import components

    rnd = random.Random(3)
    edges = [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    out = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert out == closure(real, {x for e in real for x in e})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 7 and 10: classifiers


def judged(n, seed, bad, odd):
    """(id, text, quality, toxic) of synthetic documents."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(["an", "the", "re", "ti", "on", "ed", "ly"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    out = []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(20, 120))]
        toxic, good = rnd.random() < 0.3, rnd.random() < 0.7
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(bad)
        if not good:
            words = [w.upper() + rnd.choice(odd) for w in words]
        out.append((i, " ".join(words), int(good), int(toxic)))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = judged(900, 4, ["scoundrel", "rascal", "knave"], ["%%", "##"])
    docs = documents(spark, [(i, t) for i, t, *_ in rows])
    marks = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    return docs, marks, {i: (q, t) for i, _, q, t in rows}


def accuracy(out, truth, place):
    held = [r for r in out if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    return sum(r.predicted == truth[r.doc_id][place] for r in held) / len(held)


def test_quality(labelled, docs, empty):
    own, marks, truth = labelled
    own = own.withColumn("held_out", labels.remainder(F.col("doc_id"), 3) == 1)
    machine = quality.train(own, marks, ~F.col("held_out"))
    assert accuracy(quality.score(own, machine, keep=["held_out"]).collect(), truth, 0) > 0.95
    assert quality.score(docs, machine).where("score is null").count() == 0
    assert quality.score(empty, machine).count() == 0
    none = quality.train(empty, marks, F.lit(True))
    assert {round(r.score, 6) for r in quality.score(docs, none).collect() if r.score is not None} <= {round(x / 1e6, 6) for x in range(10**6 + 1)}


def test_machine_is_the_pairwise_sum(rows):
    rnd = np.random.default_rng(2)
    m = quality.Machine(0.3, rnd.normal(size=quality.BUCKETS + len(quality.STATS)), rnd.normal(size=(quality.BUCKETS + len(quality.STATS), 4)), np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    texts = [t for _, t in rows[:6]]
    begin, bucket, value, stats = next(quality.features(pa.array(texts, pa.string()), np.zeros(6)))
    z = m.logits(begin, bucket, value, stats)
    for d in range(6):
        i = np.concatenate([bucket[begin[d] : begin[d + 1]], np.arange(quality.BUCKETS, quality.BUCKETS + len(quality.STATS))])
        x = np.concatenate([value[begin[d] : begin[d + 1]], np.clip(stats[d], -5, 5)])
        want = 0.3 + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert z[d] == pytest.approx(want, rel=1e-9)


def test_toxicity(labelled, docs, rows, empty):
    own, marks, truth = labelled
    own = own.withColumn("held_out", labels.remainder(F.col("doc_id"), 5) == 0)
    net = toxicity.train(own, marks, ~F.col("held_out"), each=(400, 400))
    assert accuracy(toxicity.score(own, net, keep=["held_out"]).collect(), truth, 1) > 0.95
    out = toxicity.score(docs, net).collect()
    assert len(out) == len(rows) and all(r.score is not None for r in out)
    assert max(r.windows for r in out) > 1000
    assert toxicity.score(empty, net).count() == 0
    one = toxicity.train(empty, marks, F.lit(True))
    only = toxicity.train(own, marks.where("toxic = 0"), F.lit(True))
    assert all(r.score < 0.1 for r in toxicity.score(docs, only).collect())
    assert len({round(r.score, 9) for r in toxicity.score(docs, one).collect()}) == 1


@pytest.mark.parametrize(("name", "n", "out"), [("quality", 3, 1), ("toxic", 5, 0)])
def test_held_out_labels_teach_nothing(labelled, name, n, out):
    """Whatever the held-out labels say, every score stays equal to the bit; with a bound that bites, too."""
    own, marks, _ = labelled
    own = own.withColumn("held_out", labels.remainder(F.col("doc_id"), n) == out)
    held = labels.remainder(F.col("doc_id"), n) == out
    runs = []
    for flip in (F.col(name), F.when(held, 1).otherwise(F.col(name)), F.when(held, 0).otherwise(F.col(name)), F.when(held, F.lit(None)).otherwise(F.col(name))):
        told = marks.withColumn(name, flip.cast("int"))
        if name == "quality":
            runs.append(got(quality.score(own, quality.train(own, told, ~F.col("held_out"), each=100)), "doc_id", "score"))
        else:
            runs.append(got(toxicity.score(own, toxicity.train(own, told, ~F.col("held_out"), each=(60, 100))), "doc_id", "score"))
    assert runs[1] == runs[0] and runs[2] == runs[0] and runs[3] == runs[0]


def test_the_bound_is_filled_from_rows_to_learn_from(labelled):
    """Held-out and absent documents take no place from those that teach."""
    own, marks, truth = labelled
    learn = own.where("doc_id >= 600")
    keys = labels.learnable(learn, marks, "toxic")
    assert {r._k: r.y for r in keys.collect()} == {i: t for i, (_, t) in truth.items() if i >= 600}
    rows = labels.labelled(learn, keys, (50, 40))
    assert {r[0]: r[1] for r in rows.groupBy("y").count().collect()} == {0: 50, 1: 40}
    assert labels.shares(keys) == {k: sum(t == k for i, (_, t) in truth.items() if i >= 600) for k in (0, 1)}


def plain_worst_window(net, text):
    """The worst window's logit and its first word, one word and one step at a time."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda z: 1 / (1 + np.exp(-z))

    def inputs(w):
        h = int(textscan.hash_words([w])[0])
        b, _ = toxicity.grams_of(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
        return np.concatenate([p["word"][h >> (64 - toxicity.WORD_BITS)], p["gram"][b].mean(0) if len(b) else np.zeros(toxicity.DIM)])

    def side(xs, d):
        h, out = np.zeros(toxicity.HIDDEN), []
        for x in xs:
            gi, gh = x @ p["x" + d] + p["b" + d], h @ p["h" + d]
            n = toxicity.HIDDEN
            z, r = sig(gi[:n] + gh[:n]), sig(gi[n : 2 * n] + gh[n : 2 * n])
            new = np.tanh(gi[2 * n :] + r * gh[2 * n :])
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    best = []
    for lo in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        xs = [inputs(w) for w in words[lo : lo + toxicity.WINDOW]]
        states = [np.concatenate(s) for s in zip(side(xs, "f"), side(xs[::-1], "b")[::-1])]
        weight = np.exp([np.tanh(s @ p["att"]) @ p["att_v"] for s in states])
        pooled = sum(w * s for w, s in zip(weight / weight.sum(), states)) if states else np.zeros(2 * toxicity.HIDDEN)
        best.append((-(pooled @ p["out"] + p["bias"][0]), lo))
    return -min(best)[0], min(best)[1], len(best)


def test_toxicity_is_the_plain_network(spark, labelled, rows):
    own, marks, _ = labelled
    net = toxicity.train(own, marks, F.lit(True), each=(100, 200))
    texts = [t for _, t in rows if len(t or "") < 5_000][:40] + [None, "", "%%", "a", " ".join(f"word{k}" for k in range(49))]
    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, t in enumerate(texts):
        logit, at, many = plain_worst_window(net, t)
        assert out[i].windows == many and out[i].score == pytest.approx(float(net.probability(np.array([logit]))[0]), abs=2e-5)
        assert out[i].predicted == int(out[i].score >= 0.5)


@pytest.mark.parametrize("bound", [1 << 18, 40, 3])
def test_words_met_before_are_not_made_again(rows, monkeypatch, bound):
    monkeypatch.setattr(toxicity, "KNOWN", bound)
    made, own = [], toxicity.grams_of
    monkeypatch.setattr(toxicity, "grams_of", lambda data, start, end: (made.append(len(start)), own(data, start, end))[1])
    net = toxicity.Network.fresh(np.random.default_rng(2))
    known = toxicity.Known(net)
    texts = [t or "" for _, t in rows]
    for lo in (0, 20, 40, 0, 20, 40):
        for w in textscan.scan(pa.array(texts[lo : lo + 20]), textscan.MARKS):
            found, want = toxicity.worst_windows(net, *known.prepare(w)), toxicity.worst_windows(net, toxicity.prepare(w))
            made.pop()  # prepare's own
            assert found[0] == pytest.approx(want[0], abs=1e-5) and (found[2] == want[2]).all()
            assert len(known.hash) == len(known.x) <= bound and (np.diff(known.hash.astype(float)) >= 0).all()
    if bound > 100:
        assert sum(made) == len(known.hash)  # each word once


def test_full_windows_in_place_are_the_network(rows):
    net = toxicity.Network.fresh(np.random.default_rng(7))
    for p in net.p.values():
        p *= 3
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 2 * toxicity.DIM)).astype(np.float32)
    for n in (1, 2, 700):
        at = rng.integers(0, 50, (n, toxicity.WINDOW))
        assert net.run_full(net.gates(x), at) == pytest.approx(net.run(x, at, None), abs=1e-4)


def test_toxicity_learns_from_long_texts(spark):
    """Only very long texts, each with one bad word deep inside."""
    rnd = random.Random(9)
    vocab = [f"plain{k}" for k in range(300)]
    made = []
    for i in range(400):
        words = [rnd.choice(vocab) for _ in range(1_000)]
        if i % 2:
            words[rnd.randrange(1_000)] = "scoundrel"
        made.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    net = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in made], "doc_id long, toxic int"), F.col("doc_id") < 300)
    out = toxicity.score(docs.where("doc_id >= 300"), net).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in out) >= 0.95 * len(out)


def test_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "_F", np.float64)
    rnd = np.random.default_rng(0)
    texts = [b"foo bar baz qux", b"a b c"]
    t = toxicity.prepare(textscan.words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), textscan.MARKS))
    net = toxicity.Network.fresh(rnd)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = net.inputs(t.word, t.grams, t.begin)
    at, mask, dz = np.array([t.at[:4], [*t.at[4:7], 0]]), np.array([[1, 1, 1, 1], [1, 1, 1, 0]], bool), np.array([0.3, -0.7])
    _, held = net.run(x, at, mask, hold=True)
    g, dx = net.gradient(x, at, mask, held, dz)
    for array, own in [(net.p[k], g[k]) for k in g] + [(x, dx)]:
        i = tuple(rnd.integers(0, s) for s in array.shape)
        was, ends = array[i], []
        for e in (1e-5, -1e-5):
            array[i] = was + e
            ends.append((net.run(x, at, mask) * dz).sum())
        array[i] = was
        assert own[i] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-9)


def test_windows_cover_all_words():
    n = np.array([0, 1, 31, 32, 33, 48, 49, 1000])
    doc, first, size = toxicity.windows_of(n)
    for d, words in enumerate(n.tolist()):
        own = [(a, a + s) for x, a, s in zip(doc, first.tolist(), size.tolist()) if x == d]
        assert set().union(*(range(a, b) for a, b in own)) == set(range(words))
        assert all(b <= words for _, b in own)


# ---- 8: decontamination


def plain_hits(text, items, width=10):
    word = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = re.findall(word, (text or "").encode().lower())
    hit, found = set(), set()
    for i, t in items:
        w = re.findall(word, (t or "").encode().lower())
        for k in range(max(1, len(w) - width + 1)) if w else ():
            own = w[k : k + width]
            for p in range(len(words) - len(own) + 1):
                if words[p : p + len(own)] == own:
                    hit.update(range(p, p + len(own)))
                    found.add(str(i))
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, rows, docs, empty, monkeypatch):
    items = [(1, "short one"), (2, rows[2][1] + " extra words that occur nowhere else at all here"), (3, None), (4, ""), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (6, rows[0][1]), (6, rows[0][1]), (7, "x1"), (8, rows[7][1]), (10, "Bench: the quick-brown fox; jumps over one lazy dog and more")]
    more = [(100, "a w1 w2, W3 w4 w5 w6 w7 w8 w9 w10 w11 and w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (101, "the QUICK brown fox jumps over one lazy dog and so on"), (102, "short\none short one"), (103, "one short one")]
    more += [(104, " ".join(f"w{k}" for k in range(1, 6))), (105, " ".join(f"w{k}" for k in range(6, 13)))]  # a passage cut in two
    own = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    want = sorted(((i, *plain_hits(t, items)) for i, t in rows + more), key=repr)
    out = decontaminate.decontaminate(own, benchmark)
    assert got(out, "doc_id", "n_words", "n_hit", "items") == want
    assert all(r.n_near >= len(r["items"]) for r in out.collect())
    near = {r.doc_id: r.n_near for r in decontaminate.decontaminate(spark.createDataFrame([(1, "w12 w11 w10 w9 w8 w7 w6 w5 w4 w3 w2 w1"), (2, "w1 w2 w3")], "doc_id long, text string"), benchmark.where("item_id = 5")).collect()}
    assert near == {1: 1, 2: 0}
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    assert got(decontaminate.decontaminate(own, benchmark.where("false")), "doc_id", "n_hit", "items") == sorted(((i, 0, []) for i, _ in rows + more), key=repr)
    spans = next(r for r in out.collect() if r.doc_id == 100)
    assert sorted((s.first, s.size) for s in spans.spans)[0] == (1, 10)
    monkeypatch.setattr(decontaminate, "FILE_WORDS", 150)  # several files of phrases
    assert got(decontaminate.decontaminate(own, benchmark), "doc_id", "n_words", "n_hit", "items", "n_near", "spans") == got(out, "doc_id", "n_words", "n_hit", "items", "n_near", "spans")


def test_one_index_serves_any_benchmark_and_segments_change_nothing(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{rnd.randrange(25)}" for _ in range(rnd.randint(0, 200)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first = spark.createDataFrame([(k, " ".join(f"w{rnd.randrange(25)}" for _ in range(4))) for k in range(30)] + [(None, "w1"), (9, None)], "item_id long, text string")
    second = spark.createDataFrame([(k, " ".join(rows[k][1].split()[5:20])) for k in range(40)], "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "items", "n_near", "spans")
    segments = decontaminate.build_index(docs).cache()
    found = [got(decontaminate.search(segments, decontaminate.store_phrases(b)), *columns) for b in (first, second)]
    for b, f in zip((first, second), found):
        items = [("" if r.item_id is None else r.item_id, r.text) for r in b.collect()]
        assert [x[:4] for x in f] == sorted(((i, *plain_hits(t, items)) for i, t in rows), key=repr)
        for i, _, _, _, near, _ in f:
            words = dict(rows)[i].split()
            held = [set(words[k : k + decontaminate.NEAR]) for k in range(len(words))]
            windows = [(n, set(w[k : k + 10])) for n, t in items for w in [(t or "").split()] for k in range(max(1, len(w) - 9)) if w]
            assert near == len({n for n, w in windows if any(w <= h for h in held)})
    monkeypatch.setattr(decontaminate, "SEGMENT_ROWS", 3)
    assert got(decontaminate.decontaminate(docs, first), *columns) == found[0]


def test_passes_return_every_row(spark, monkeypatch):
    """Repeated and null ids, with equal and with different texts, in one pass and in several."""
    items = [(k, " ".join(f"q{k}x{j}" for j in range(12))) for k in range(40)]
    texts = ["clean words", items[0][1], "a " + items[1][1] + " b " + items[2][1], items[2][1], None]
    rows = [(i, t) for i in (1, None, 2) for t in texts] + [(1, texts[1]), (None, texts[1]), (3, texts[0])]
    want = sorted(((i, *plain_hits(t, items)) for i, t in rows), key=repr)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (decontaminate.FILE_WORDS, 150):
        monkeypatch.setattr(decontaminate, "FILE_WORDS", most)
        out = decontaminate.decontaminate(docs, benchmark)
        assert out.schema["doc_id"].dataType.simpleString() == "bigint"
        assert got(out, "doc_id", "n_words", "n_hit", "items") == want


# ---- 9: URLs


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com/", "http://example.com/en/x", "http://www.example.com/en/x", "https://WWW.Example.Com/en", "http://m.www.example.com/en/1?q#f",
        "http://b.net/es/1", "http://b.net/ess/1", "http://net/fr/", "http://notnet/fr/", "http://xcom/a", "http://a.com:80/x", "http://a.com?x=/en/", "http://example.com#/en/", "x://y://z.com/en/", "http://example.com//en/", "http://.com/a",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("h"), "rule": F.lit(1), "_key": F.lit(2)})
    rules = [(r.verdict, r.host, r.path) for r in queries.RULES]

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(h.count("."), len(h), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    assert got(url_filter.judge_urls(pages, queries.RULES), "page_id", "host", "path", "rule", "verdict") == sorted(((i, *plain(u)) for i, u in enumerate(urls)), key=repr)
    assert url_filter.judge_urls(pages.where("false"), queries.RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, [], default="block").collect()} == {"block"}


def test_long_and_repeated_urls(spark):
    """Each row gets its verdict, whatever the length of its URL, its id or the rows like it."""
    long = ["http://" + "a." * 20_000 + "com/" + "x/" * 200_000, "http://example.com/en/" + "y" * 1_000_000, "http://" + "net/" * 100_000, "s" * 500_000]
    rows = [(1, u) for u in long] + [(1, long[1])] * 3 + [(None, "http://net/es/")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    out = [(r.page_id, r.n, r.rule, r.verdict) for r in url_filter.judge_urls(pages, queries.RULES).withColumn("n", F.length("path")).collect()]
    want = [(1, 400_001, "com/", "allow"), (1, 99_999 * 4 + 1, None, "allow"), (1, 0, None, "allow"), *[(1, 1_000_004, "example.com/en/", "block")] * 4, *[(None, 4, "net/es/", "block")] * 2]
    assert sorted(out, key=repr) == sorted(want, key=repr)


def test_trie_paths():
    trie = url_filter.Trie([url_filter.Rule("block", "a.b", "/x/y"), url_filter.Rule("allow", "a.b", "/x/"), url_filter.Rule("block", "b", ""), url_filter.Rule("allow", "a.b", "/x/y"), url_filter.Rule("block", "", "/zz")])
    find = lambda h, p: (r := trie.find(h, p)) and str(r)
    assert find("a.b", "/x/yes") == "a.b/x/y" and trie.find("a.b", "/x/yes").verdict == "block"
    assert find("c.a.b", "/x/n") == "a.b/x/" and find("a.b", "/x") == "b" and find("q.b", "") == "b"
    assert find("other", "/zzz") == "/zz" and find("other", "/") is None


# ---- on the given tables


def test_queries_have_oracles_or_tests(spark):
    for name, f in queries.queries().items():
        out = f(spark, DATA)
        assert out.count() > 0, name
