"""Steps that move few bytes: texts before their words, landed rows once, deliveries computed once."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from brieflane.operators import features
from brieflane.operators import text as tx
from brieflane.session import names_in
from brieflane.sources import fixtures as fx
from brieflane.sources import reconcile as rc
from brieflane.streaming import posts_stream as ps

TEXTS = [("1", "a cat and a dog"), ("2", "cat  cat zebra"), ("3", None), ("4", ""), ("5", "  "), (None, "cat dog lion"), ("6", "dog tiger cat")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "id string, t string")


def test_counts_move_texts_not_words(spark, texts):
    own = tx.counts_by_doc(texts.unionByName(texts), "id", "t")
    assert plan_of(own).count("Exchange") == 1 and "hashpartitioning(doc_id" in plan_of(own)
    assert "hashpartitioning(doc_id#" in plan_of(own) and ", term#" not in plan_of(own).split("hashpartitioning(")[1].split(")")[0]
    want = tx.term_counts(texts.unionByName(texts), "id", "t").collect()
    assert sorted(map(str, own.collect())) == sorted(map(str, want))


@pytest.mark.parametrize("head", [1, 2, 1 << 17])
def test_vectors_and_sums_by_any_head(spark, texts, monkeypatch, head):
    monkeypatch.setattr(tx, "HEAD_TERMS", head)
    model = features.fit(texts, "id", "t", ps.shared_folder(spark, "m"))
    index = {r.term: (r["index"], r.idf) for r in model.terms().collect()}
    counts = {}
    for r in tx.term_counts(texts, "id", "t").collect():
        counts.setdefault(r.doc_id, {})[r.term] = r.tf
    counts.pop(None)  # a text without an id meets no row
    got = {r.id: (r.indices, r["values"]) for r in model.vectors(texts, "id", "t").collect()}
    assert set(got) == {i for i, _ in TEXTS}
    for i, (indices, values) in got.items():
        want = sorted((index[t][0], n * index[t][1]) for t, n in counts.get(i, {}).items())
        assert indices == [a for a, _ in want] and values == pytest.approx([b for _, b in want])
    sums = {r.id: r.total for r in tx.feature_sums(texts, "id", "t").collect()}
    assert sums == pytest.approx({i: sum(v) for i, (_, v) in got.items()})


def test_deliveries_are_copies_and_packed(spark):
    one = spark.range(3).select(F.col("id").cast("string").alias("response_id"), F.lit("s").alias("subreddit"), F.lit("en").alias("search_term"),
                                F.lit(0).cast("bigint").alias("page"), F.lit(200).alias("status"), F.expr("uuid()").alias("body"))
    landing = ps.shared_folder(spark, "t-deliveries")
    ps.land_responses(one, landing, fx.EPOCH_2024, 2, F.lit(7))
    first, second = (spark.read.schema(ps.RESPONSE_SCHEMA).json(f"{landing}/delivery={i}").orderBy("response_id").collect() for i in (0, 1))
    assert [r.body for r in first] == [r.body for r in second] and len(first) == 3
    assert {(b.fetched_at - a.fetched_at).total_seconds() for a, b in zip(first, second)} == {3600.0}
    assert all(n.endswith(".json.gz") for n in names_in(spark, f"{landing}/delivery=1") if n.startswith("part-"))


def test_landed_rows_do_not_move_again_for_the_day(spark):
    schema = "id string, v bigint, at date"
    a, b = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    path = ps.shared_folder(spark, "t-days")
    rc.reconcile(path, spark.createDataFrame([("1", 1, a), ("2", 2, a), ("3", 3, b)], schema), F.col("at"))
    # 1 has moved to the second day, 2 is as it was, 4 is new; the first day is touched by 2
    landed = spark.createDataFrame([("1", 1, b), ("2", 2, a), ("2", 2, a), ("4", 4, b)], schema)
    one = rc.newest(landed.withColumn("day", F.col("at")), "id", None)
    stored = rc.stored_table(spark, path, landed.schema)
    rows = rc.compare(stored, one, "id")
    assert "hashpartitioning(_nd#" not in plan_of(rows) and "hashpartitioning(day#" not in plan_of(rows).split("LeftSemi")[0]
    assert sorted((r.id, r.day, r.kind) for r in rows.collect()) == [
        ("1", a, "kept"), ("1", b, "inserted"), ("2", a, "unchanged"), ("3", b, "kept"), ("4", b, "inserted")]
