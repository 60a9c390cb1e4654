"""Stored feature models against Spark ML's vectors; the classifier's folds and threshold."""

import pytest
from pyspark.sql import functions as F

from brieflane.operators import classify, features
from brieflane.operators import text as tx
from brieflane.sources import fixtures as fx
from brieflane.streaming.posts_stream import shared_folder
from conftest import SF_MID, SF_SMALL


@pytest.fixture(scope="module")
def titles(spark):
    return fx.posts(spark, SF_MID).select("id", F.coalesce("title", F.lit("")).alias("title"))


def test_vectors_equal_spark_ml(spark, titles):
    """Same terms and weights; the place of a term differs only among terms of one count, whose
    order Spark ML leaves open."""
    model = features.fit(titles, "id", "title", shared_folder(spark, "t-model"))
    ml = tx.ml_pipeline("title").fit(titles)
    vocabulary = ml.stages[2].vocabulary
    ours = {r["index"]: r.term for r in model.terms().collect()}
    assert model.n_terms == len(vocabulary) == len(ours) and model.n_docs == titles.count()
    counts = {r.term: r.total_count for r in tx.vocabulary(titles, "id", "title").collect()}
    assert [counts[ours[i]] for i in range(len(ours))] == [counts[t] for t in vocabulary]
    mine = {r.id: (r.indices, r["values"]) for r in model.vectors(titles, "id", "title").collect()}
    seen = 0
    for r in ml.transform(titles).select("id", "features").collect():
        indices, values = mine[r.id]
        assert indices == sorted(indices)
        want = {vocabulary[i]: w for i, w in zip(r.features.indices.tolist(), r.features.values.tolist())}
        got = {ours[i]: w for i, w in zip(indices, values)}
        assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
        seen += 1
    assert seen == len(mine)


def test_ml_vectors_feed_an_estimator(spark):
    docs = fx.posts(spark, SF_SMALL).select("id", F.coalesce("title", F.lit("")).alias("title"))
    model = features.fit(docs, "id", "title", shared_folder(spark, "t-model"))
    vectors = model.ml_vectors(docs, "id", "title")
    plain = {r.id: (r.indices, r["values"]) for r in model.vectors(docs, "id", "title").collect()}
    for r in vectors.collect():
        assert r.features.size == model.n_terms
        assert (r.features.indices.tolist(), r.features.values.tolist()) == plain[r.id]
    from pyspark.ml.clustering import KMeans
    assert KMeans(k=2, maxIter=1, seed=1).fit(vectors).summary.k == 2


def test_unseen_terms_empty_texts_and_reloading(spark):
    known = spark.createDataFrame([(1, "oil oil price"), (2, "oil up"), (3, None), (4, "")], "id int, t string")
    folder = shared_folder(spark, "t-model")
    features.fit(known, "id", "t", folder)
    model = features.FeatureModel(spark, folder)
    assert (model.n_docs, model.n_terms) == (4, 3)  # 'up' is a stop word; the empty token counts
    new = spark.createDataFrame([(7, "price new new oil"), (8, "never seen"), (9, None), (10, " ")], "id int, t string")
    got = {r.id: (r.indices, [round(v, 6) for v in r["values"]]) for r in model.vectors(new, "id", "t").collect()}
    terms = {r.term: (r["index"], r.idf) for r in model.terms().collect()}
    assert got[7] == (sorted([terms["price"][0], terms["oil"][0]]), [round(w, 6) for _, w in sorted([terms["price"], terms["oil"]])])
    assert got[8] == ([], []) and got[9][0] == [terms[""][0]] and got[10] == ([], [])
    assert model.vectors(new.limit(0), "id", "t").collect() == []
    with pytest.raises(ValueError):
        features.FeatureModel(spark, shared_folder(spark, "none"))


def test_folds_do_not_overlap_and_cover(spark):
    d = spark.range(5000).withColumn("fold", classify.fold_digit("id")).withColumn("out", classify.held_out("id"))
    share = {r["fold"]: r["count"] / 5000 for r in d.groupBy("fold").count().collect()}
    assert len(share) == 16 and max(share.values()) < 0.08
    assert not set(classify.HELD_OUT) & set(classify.VALIDATION)
    assert 0.17 < d.where("out").count() / 5000 < 0.21


def test_threshold_separates_the_validation_fold(spark):
    rows = [(1, 0.9), (1, 0.62), (1, 0.61), (0, 0.6), (0, 0.3), (0, 0.1), (0, 0.05)]
    p = spark.createDataFrame(rows, "y int, p double")
    t = classify.best_threshold(p, "y", "p")
    assert 0.6 < t <= 0.61
    assert classify.best_threshold(p.where("y = 1"), "y", "p") == 0.5
    w = {r.y: r.w for r in p.withColumn("w", classify.class_weights(p, "y")).collect()}
    assert abs(w[1] - 7 / 6) < 1e-9 and abs(w[0] - 7 / 8) < 1e-9


def test_rare_words_are_learned_without_a_vocabulary(spark):
    """Words whose frequency lies far down a vocabulary decide the class."""
    rows = [(i, f"common filler{i % 7} " + ("good" if i % 4 else "bad") + f"{i % 5} x{i}", 1 if i % 4 else 0) for i in range(600)]
    d = spark.createDataFrame([*rows, (1000, None, 1), (1001, "x", None)], "doc_id int, text string, quality int")
    _, threshold, held = classify.quality_model(d)
    out = held.collect()
    assert 0 <= threshold <= 1 and {r.doc_id for r in out} == {r.doc_id for r in d.where(classify.held_out("doc_id") & F.col("quality").isNotNull()).collect()}
    assert sum(r.prediction == r.quality for r in out) / len(out) > 0.95
