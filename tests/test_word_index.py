"""The stored word index against the search that splits every text."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brieflane.operators import config as cfgops
from brieflane.operators import filters, word_index
from brieflane.operators.word_index import WordIndex
from brieflane.plans import api, indexes
from brieflane.session import discard
from brieflane.sources import fixtures as fx
from brieflane.streaming.posts_stream import shared_folder
from conftest import SF_SMALL

DAY = dt.date(2024, 1, 1)


def texts(n, seed=0):
    rng = random.Random(seed)
    letters = ["a", "b", "ab", "é", "日本", " ", "  ", "x", "\t", "\n", "oil", "-"]
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 12))), DAY + dt.timedelta(days=rng.randint(0, 3))) for i in range(n)]
    return rows + [(n, None, DAY), (n + 1, "", DAY), (n + 2, "   ", None), (n + 3, "oil price up", None), (n + 4, "b" * 5000 + " a", DAY)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, t string, day date")


TERMS = ["a", "ab", "abx", "oil", "il p", "oil price", "é", "日本 ", " x", "b  b", "", " ", "   ", "\t", "-a", None, "b" * 40, "zz"]


def hits(df):
    return sorted((r.id, r.term, r.k) for r in df.collect())


@pytest.fixture
def terms(spark):
    return spark.createDataFrame([(t, i % 2) for i, t in enumerate(TERMS)] + [("oil", 7)], "term string, k int")


def indexed(spark, rows, **options):
    index = WordIndex(spark, shared_folder(spark, "t-index"), "int", buckets=3, **options)
    df = frame(spark, rows)
    index.add(df, "id", F.col("t"), F.col("day"))
    return index, df


def test_index_finds_what_a_scan_finds(spark, terms):
    index, df = indexed(spark, texts(400))
    want = hits(filters.substring_matches(df, F.col("t"), terms, "term", "id"))
    assert hits(index.matches(df, F.col("t"), terms, "term", "id")) == want
    assert want == sorted((i, t, k) for i, text, _ in texts(400) for t, k in [(t, i % 2) for i, t in enumerate(TERMS)] + [("oil", 7)]
                          if text is not None and t is not None and t in text)
    few = df.where(F.col("id") % 2 == 0)  # only rows of the given table
    assert hits(index.matches(few, F.col("t"), terms, "term", "id")) == [h for h in want if h[0] % 2 == 0]
    none = terms.where(F.lit(False))
    assert index.matches(df, F.col("t"), none, "term", "id").collect() == []


def test_only_new_days_are_indexed(spark, terms):
    rows = texts(200, 1)
    first = [r for r in rows if r[2] is None or r[2] < DAY + dt.timedelta(days=2)]
    index, _ = indexed(spark, first)
    df = frame(spark, rows)
    assert index.add(df, "id", F.col("t"), F.col("day")) == {DAY + dt.timedelta(days=2), DAY + dt.timedelta(days=3)}
    assert index.add(df, "id", F.col("t"), F.col("day")) == set()
    assert hits(index.matches(df, F.col("t"), terms, "term", "id")) == hits(filters.substring_matches(df, F.col("t"), terms, "term", "id"))
    assert index.vocabulary().count() == index.vocabulary().distinct().count()
    assert index.postings().groupBy("_rid", "_word").count().where("count > 1").collect() == []


def test_changed_days_and_days_that_broke_off(spark, terms):
    rows = texts(200, 2)
    index, df = indexed(spark, rows)
    changed = [(i, "oil " + (t or "") if d == DAY and i % 3 == 0 else t, d) for i, t, d in rows if not (d == DAY and i % 3 == 1)]
    new = frame(spark, changed)
    assert index.add(new, "id", F.col("t"), F.col("day"), again={DAY}) == {DAY}
    want = hits(filters.substring_matches(new, F.col("t"), terms, "term", "id"))
    assert hits(index.matches(new, F.col("t"), terms, "term", "id")) == want
    discard(spark, f"{index.folder}/days")  # as if the list of days had not been written
    assert len(index.add(new, "id", F.col("t"), F.col("day"))) == 5
    assert hits(index.matches(new, F.col("t"), terms, "term", "id")) == want


def test_empty_table(spark, terms):
    index, df = indexed(spark, [])
    assert index.days() == set() and index.matches(df, F.col("t"), terms, "term", "id").collect() == []


def test_discovery_and_news_read_no_text(spark):
    cfg = cfgops.config_lookup(fx.analyzed_entities(spark), fx.config_table(spark))
    p = fx.posts(spark, SF_SMALL)
    found = api.discover_subreddits(p, cfg, index=indexes.of_posts(spark, SF_SMALL))
    plain = api.discover_subreddits(p, cfg)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_entities_without_spaces_need_only_postings(spark):
    """The plan of a search whose terms have no space does not hold the text column."""
    index = indexes.of_posts(spark, SF_SMALL)
    p = fx.posts(spark, SF_SMALL).select("id", "subreddit", F.lower("title").alias("lt"))
    terms = spark.createDataFrame([("tion",), ("ung",)], "term string")
    out = index.matches(p, F.col("lt"), terms, "term", "id").select("id", "subreddit", "term")
    plan = out._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "documents.parquet" in line]
    assert scans and all("text" not in line.split("ReadSchema")[-1] for line in scans)
    assert hits(out.withColumn("k", F.lit(0)).withColumn("id", F.col("id").cast("int"))) == hits(
        filters.substring_matches(p, F.col("lt"), terms, "term", "id").withColumn("k", F.lit(0)).withColumn("id", F.col("id").cast("int")))


def test_texts_are_stored_not_a_row_for_each_word(spark):
    """A text is one row in each bucket; postings are made of it when they are read."""
    rows = texts(300, 3)
    index, df = indexed(spark, rows)
    stored = spark.read.parquet(f"{index.folder}/postings")
    assert stored.groupBy("_rid", "day", "bucket").count().where("count > 1").collect() == []
    assert stored.count() < index.postings().count()
    got = sorted((r["_rid"], r["_word"]) for r in index.postings().collect())
    assert got == sorted((i, w) for i, t, _ in rows if t is not None for w in set(t.split(" ")) - {""})
    assert index.postings().where(F.col("bucket") != index._bucket("_word")).collect() == []
    assert sorted(r["_word"] for r in index.vocabulary().collect()) == sorted({w for _, w in got})


@pytest.mark.parametrize("many,few,short", [(0, 64, 64), (0, 3, 64), (10 ** 6, 3, 2), (0, 64, 0)])
def test_any_size_of_a_search_finds_the_same(spark, terms, monkeypatch, many, few, short):
    monkeypatch.setattr(word_index, "MANY_WORDS", many)
    monkeypatch.setattr(word_index, "FEW_PIECES", few)
    monkeypatch.setattr(word_index, "SHORT_WORD", short)
    rows = texts(200, 4) + [(9000 + i, w, DAY) for i, w in enumerate(["日本語oil", "e\u0301x", "😀ab😀", "oil" * 40, "x" * 70 + "日本"])]
    index, df = indexed(spark, rows)
    assert hits(index.matches(df, F.col("t"), terms, "term", "id")) == hits(filters.substring_matches(df, F.col("t"), terms, "term", "id"))
    grams = {(r["_gram"], r["_word"]) for r in index.grams().collect()}
    assert grams == {(w[i:i + filters.GRAM], w) for r in index.vocabulary().collect() for w in [r["_word"]] for i in range(len(w))}


def test_a_repeated_or_null_id_keeps_its_words(spark):
    index, df = indexed(spark, [(1, "oil gas", DAY), (1, "gas tin", DAY), (None, "oil", DAY)])
    got = sorted(((r["_rid"], r["_word"]) for r in index.postings().collect()), key=str)
    assert got == [(1, "gas"), (1, "gas"), (1, "oil"), (1, "tin"), (None, "oil")]
