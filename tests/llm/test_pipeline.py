"""Each stage of the pipeline against a plain version on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.conftest import DATA
from tests.llm.test_operators import plain_components, plain_fingerprint, plain_hits
from tidemark.llm import queries


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = queries.table(spark, DATA, "documents"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DATA).write.parquet(path)
        nxt = spark.read.parquet(path)
        out.append((docs, nxt))
        docs = nxt
    return out


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == pipeline.COLUMNS and after.count() <= before.count()


@pytest.mark.parametrize(("place", "query", "good"), [(0, "op10_toxicity", 0), (1, "op7_quality", 1)])
def test_filters(spark, stages, place, query, good):
    """The stage keeps what the operator's own query accepts."""
    before, after = stages[place]
    kept = {r.doc_id for r in queries.queries()[query](spark, DATA).where(F.col("predicted") == good).collect()} if place == 0 else None
    if kept is not None:
        assert pairs(after) == [p for p in pairs(before) if p[0] in kept]
    else:
        assert set(pairs(after)) <= set(pairs(before)) and len(pairs(after)) > 0.7 * len(pairs(before))


def test_near_duplicates(stages):
    before, after = stages[2]
    rows = [(i, plain_fingerprint(t)) for i, t in pairs(before)]
    of = plain_components(rows)
    assert [i for i, _ in pairs(after)] == sorted({of[f] for _, f in rows})


def test_decontamination(spark, stages):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in queries.table(spark, DATA, "benchmark").collect()]
    assert pairs(after) == [(i, t) for i, t in pairs(before) if not plain_hits(t, items)[1]]


def test_segmentation(stages):
    before, after = stages[4]
    assert sorted(r.doc_id for r in after.collect()) == [i for i, _ in pairs(before)]
    assert after.where("not round_trip").count() == 0


def test_repeated_ids_and_nulls(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "x y z q"), (3, None), (4, ""), (5, "p q r s t u")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_n", F.lit(1)).withColumn("component_id", F.lit(2))
    out = pipeline.one_of_near_duplicates(spark, docs, DATA)
    assert sorted((r.doc_id, r.text) for r in out.where("doc_id is not null").collect()) == [(1, "a b c d e"), (3, None), (5, "p q r s t u")]




def crowded(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.mark.parametrize("few", [pipeline.BROADCAST_KEYS, 0])
def test_one_id_on_different_texts(spark, monkeypatch, few):
    """Rows with one id, or none, go or stay by their own texts."""
    monkeypatch.setattr(pipeline, "BROADCAST_KEYS", few)
    texts = [" ".join(f"v{k}x{j}" for j in range(30)) for k in range(12)]
    rows = [(7, t) for t in texts[:5]] + [(None, t) for t in texts[4:9]] + [(8, texts[9]), (8, texts[0]), (6, texts[1])]
    rows += [(7, texts[2]), (None, texts[5]), (None, None), (9, "")]
    out = pipeline.one_of_near_duplicates(spark, crowded(spark, rows), DATA)
    least = {}
    for i, t in rows:
        least[t or ""] = min((i is None, i or 0), least.get(t or "", (True, 0)))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in out.collect()) == sorted((i, t) for t, i in least.items())
    assert out.columns == pipeline.COLUMNS


@pytest.mark.parametrize("few", [pipeline.BROADCAST_KEYS, 0])
def test_benchmark_takes_only_rows_that_are_hit(spark, monkeypatch, few):
    monkeypatch.setattr(pipeline, "BROADCAST_KEYS", few)
    leak = next(r.text for r in queries.table(spark, DATA, "benchmark").collect() if len((r.text or "").split()) >= 12)
    rows = [(i, t) for i in (1, None) for t in ("clean words", leak, "more clean words", None, "clean words")] + [(2, "clean words")]
    out = pipeline.without_benchmark(spark, crowded(spark, rows), DATA)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(((i, t) for i, t in rows if t != leak), key=repr)
    assert out.columns == pipeline.COLUMNS


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES])
def test_a_table_without_rows(spark, stage):
    out = stage(spark, crowded(spark, []), DATA)
    assert out.count() == 0


def test_documents_without_labels_stay(spark):
    """Where no row has a label, neither classifier rejects any; rows with one id, or none, stay too."""
    rows = [(i, f"some words of text {i} " * 9) for i in range(10**9, 10**9 + 8)] + [(None, "words of no id"), (None, None), (10**9, ""), (10**9, "x")]
    docs = crowded(spark, rows)
    for stage in (pipeline.drop_toxic, pipeline.keep_quality):
        out = stage(spark, docs.withColumns({"score": F.lit("s"), "predicted": F.lit(2), "y": F.lit(3)}), DATA)
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(rows, key=repr)
        assert out.columns == pipeline.COLUMNS
