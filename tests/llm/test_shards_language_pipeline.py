"""Sharding, language ID, the SQL of the corpus queries and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import frame  # noqa: F401
import corpus_pipeline
from check_queries import compare, duck
from tabforge.llm import langid
from tabforge.llm.common import stored
from tabforge.llm.langid import LanguageModel, calibrate, predict_language, softmax, train_language_model
from tabforge.llm.queries import QUERIES, SQL
from tabforge.llm.sharding import permuted, shard_rows, side_of
from test_duplicates import brute_near
from test_lines_packing_chat import brute_lines


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 1023])
def test_permutation(spark, n):
    rows = spark.range(n).withColumn("n", F.lit(n).cast("long"))
    places = [r[0] for r in rows.select(permuted(F.col("id"), F.col("n"), side_of(F.col("n")), 7)).collect()]
    assert sorted(places) == list(range(n))
    assert n < 17 or places != sorted(places)


def test_shards(spark, frame):
    docs = [(i, f"text {i % 7} é" * (i % 5)) for i in range(101)] + [(None, None), (None, "x"), (3, "again"), (3, "again")]
    df = frame(docs).withColumn("shard", F.lit("clash"))
    rows = shard_rows(df, 10, seed=1).collect()
    assert rows == shard_rows(df, 10, seed=1).collect() or sorted(map(repr, rows)) == sorted(map(repr, shard_rows(df.repartition(5), 10, seed=1).collect()))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == len(docs) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert shard_rows(df.limit(0), 10).count() == 0


def test_language_accuracy(spark, sf_dir):
    got = QUERIES["op7_language_id"](spark, sf_dir).collect()
    true = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(true)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and true[r.doc_id].lang]
    assert np.mean([r.lang_pred == true[r.doc_id].lang for r in held]) >= 0.98


def test_language_edges(spark, frame):
    docs = [(i, "the cat and the dog") for i in range(30)] + [(i, "der hund und die katze") for i in range(30, 60)]
    labelled = frame(docs).withColumn("lang", F.when(F.col("doc_id") < 30, "en").otherwise("de"))
    labelled = labelled.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string")))
    model = train_language_model(labelled)
    odd = frame([(1, None), (2, ""), (3, "123 !? ²"), (4, "THE DOG"), (5, "die katze"), (5, "die katze"), (6, "ñ" * 100_000), (None, "the")])
    got = [(r.doc_id, r.lang_pred, r.score) for r in predict_language(odd, model).collect()]
    by = {i: (p, s) for i, p, s in got}
    assert len(got) == 8 and by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] == "en" and by[5][0] == "de" and 0 < by[6][1] <= 1
    assert set(map(repr, got)) == set(map(repr, ((r.doc_id, r.lang_pred, r.score) for r in predict_language(odd.repartition(3), model).collect())))
    again = train_language_model(labelled.repartition(5))
    assert np.array_equal(model.weights, again.weights) and model.temperature == again.temperature
    none = train_language_model(labelled.limit(0))
    assert {r.lang_pred for r in predict_language(odd, none).collect()} == {"und"}
    assert (model.weights == 0).mean() > 0.9  # the penalties leave it sparse


def test_temperature():
    r = np.random.default_rng(0)
    logits = r.standard_normal((4000, 3)) * 2
    labels = np.array([r.choice(3, p=p) for p in softmax(logits)])
    assert abs(calibrate(logits * 5, labels) - 5) < 0.5 and calibrate(np.empty((0, 3)), np.empty(0, int)) == 1.0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), SQL[name], duck(sf_dir)) is None


def test_all_operators_are_registered():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language ID"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    assert len(left) >= 0.97 * docs.count() and all(any(map(str.isalpha, t)) for t in left.values())
    short = stages["line dedup"](spark, kept, sf_dir)
    assert short.columns == docs.columns
    want = {i: t for i, t in brute_lines(list(left.items()), 50).items() if t.strip()}
    assert {r.doc_id: r.text for r in short.collect()} == want
    single = stages["MinHash near-dedup"](spark, short, sf_dir)
    assert single.columns == docs.columns
    near = {i for i, (_, _, stays) in brute_near(list(want.items()), 5, 80).items() if stays}
    assert {r.doc_id for r in single.collect()} == near
    packed = stages["best-fit packing"](spark, single, sf_dir).collect()
    size = Counter()
    for r in packed:
        size[r.doc_id] += r["size"]
    assert size == {i: len(want[i].encode()) + 1 for i in near}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, packed))
    assert [corpus_pipeline.STAGES[i][1](spark, docs.limit(0), sf_dir).count() for i in range(4)] == [0] * 4


def test_pipeline_stages_with_odd_rows(spark, frame):
    passage = "\n".join(f"line {k} of a passage that several of these documents share" for k in range(12))
    rows = [(1, passage), (2, "own words first\n" + passage), (None, passage), (3, None), (4, ""), (5, "one two three four five six seven"),
            (5, "one two three four five six seven"), (6, "one two three four five six seven"), (None, "one two three four five six seven")]
    docs = frame(rows).withColumn("n_chars", F.length("text").cast("long"))
    stages = dict(corpus_pipeline.STAGES)
    short = stages["line dedup"](spark, docs, None)
    assert short.columns == docs.columns
    same = "one two three four five six seven"
    assert Counter((r.doc_id, r.text) for r in short.collect()) == Counter(
        {(1, passage): 1, (2, "own words first"): 1, (5, same): 2, (6, same): 1, (None, same): 1})
    single = stages["MinHash near-dedup"](spark, short, None)
    assert single.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in single.collect()) == Counter(
        {(1, passage): 1, (2, "own words first"): 1, (5, same): 2, (None, same): 1})


def test_repeated_texts_are_drawn_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(langid, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    words = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "drei", "vier"]
    texts = [(" ".join(words[i >> k & 7] for k in (0, 3, 6)), "x") for i in range(300)]
    hot = [(f"copy {words[k]} {k}", "x") for k in range(8)]  # some of them are drawn
    table = spark.createDataFrame(texts + hot * 100, "text string, lang string")
    langid.train_language_model(table, per_language=150)
    sample = kept[0].groupBy("label", "order").count().collect()
    assert {r["count"] for r in sample} == {1}
    assert 90 < len(sample) < 210
    parts = [r["count"] for r in kept[0].where("part >= 0").groupBy("part").count().collect()]
    assert len(parts) == langid.PARTS and max(parts) < 0.5 * sum(parts)
    langid.train_language_model(spark.createDataFrame(texts[:1] * 500 + [(texts[0][0], "y")], "text string, lang string"))
    assert kept[1].count() == 2
