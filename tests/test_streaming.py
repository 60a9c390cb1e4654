"""Stateful streams: windowed counts, late rows, restarts, dead letters."""

import json

import pytest
from pyspark.sql import functions as F

from brieflane.sources import fixtures as fx
from brieflane.streaming import posts_stream as ps

START = fx.EPOCH_2024 + 40 * 86400
RESPONSE = "response_id string, subreddit string, search_term string, page bigint, status int, body string"


def land(spark, landing, name, hours, posts, extra=()):
    """One response of posts (id, created day, score), fetched ``hours`` after the start."""
    kids = [{"data": {"id": i, "title": f"t{i}", "score": score, "num_comments": 1, "created_utc": fx.EPOCH_2024 + day * 86400}}
            for i, day, score in posts]
    rows = [(name, "s", "en", 0, 200, json.dumps({"data": {"children": kids}}))] + list(extra)
    ps.land_responses(spark.createDataFrame(rows, RESPONSE).coalesce(1), f"{landing}/{name}", START + 3600 * hours, 1)


class Counts:
    """A stream of windowed counts over a landing, run as often as wanted."""

    def __init__(self, spark):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ps.ROCKSDB)
        self.spark = spark
        self.landing, self.out, self.ckpt = (ps.shared_folder(spark, n) for n in ("w-landing", "w-out", "w-ckpt"))

    def run(self, files=1):
        posts = ps.unique_posts(ps.read_landing(self.spark, self.landing, files), "6 hours")
        ps.run_available_now(ps.windowed_counts(posts, "4 hours"), self.out, self.ckpt)

    def rows(self):
        counts = self.spark.read.parquet(self.out)
        hours = ((F.unix_seconds("window_start") - START) / 3600).cast("int")
        return sorted(tuple(r) for r in counts.select(hours, F.datediff("created_day", F.lit("2024-01-01")), "n_posts", "engagement").collect())


def test_counts_close_once_and_survive_restarts(spark):
    c = Counts(spark)
    land(spark, c.landing, "a", 0, [("1", 0, 5), ("2", 0, 7), ("3", 9, 1)])
    c.run()
    assert c.rows() == []  # no window is closed yet
    land(spark, c.landing, "b", 5, [("2", 0, 7), ("4", 0, 2)])  # 2 was counted in the first window
    c.run()
    c.run()  # a restart without new files
    land(spark, c.landing, "c", 11, [])  # finds nothing, but moves the watermark to hour 5
    c.run()
    assert c.rows() == [(0, 0, 2, 14), (0, 9, 1, 2)]
    land(spark, c.landing, "d", 30, [("5", 1, 1)])
    c.run()
    assert c.rows() == [(0, 0, 2, 14), (0, 9, 1, 2), (4, 0, 1, 3)]
    totals = {(r.created_day.day, r.n_posts, r.engagement) for r in ps.daily_totals(spark.read.parquet(c.out)).collect()}
    assert totals == {(1, 3, 17), (10, 1, 2)}


def test_many_micro_batches_equal_one(spark):
    found = []
    for files in (1, 100):
        c = Counts(spark)
        for i in range(6):
            land(spark, c.landing, f"r{i}", 2 * i, [(str(j), j % 5, j) for j in range(3 * i, 3 * i + 6)])
        land(spark, c.landing, "close", 60, [])
        c.run(files)
        found.append(c.rows())
    assert sum(r[2] for r in found[0]) == 21
    assert {r[1:] for r in found[0]} and sum(r[3] for r in found[0]) == sum(r[3] for r in found[1])


def test_late_rows_are_not_counted_and_can_be_found(spark):
    c = Counts(spark)
    unique = ps.shared_folder(spark, "w-unique")
    land(spark, c.landing, "a", 0, [("1", 0, 5)])
    land(spark, c.landing, "b", 30, [("2", 0, 1)])
    c.run()
    land(spark, c.landing, "late", 1, [("9", 0, 50), ("1", 0, 5)])  # the watermark is at hour 24
    land(spark, c.landing, "z", 60, [])
    c.run()
    assert c.rows() == [(0, 0, 1, 6), (28, 0, 1, 2)]
    posts = ps.unique_posts(ps.read_landing(spark, c.landing), "6 hours").drop("fetched_at")
    # a table of unique posts that was written while the late file had not landed yet
    spark.createDataFrame([("1",), ("2",)], "id string").write.parquet(unique)
    assert posts.isStreaming
    landed = spark.read.schema(ps.RESPONSE_SCHEMA).option("recursiveFileLookup", "true").json(c.landing)
    late = ps.late_posts(landed, spark.read.parquet(unique)).collect()
    assert [(r.id, r.score) for r in late] == [("9", 50)]


BAD = [("x1", "s", "en", 0, 503, "down"), ("x2", "s", "en", 0, 200, "{"), ("x3", "s", "en", 0, None, "{}"), ("x4", "s", "en", 0, 200, None),
       ("x5", "s", "en", 0, 200, json.dumps({"data": {"children": [{"data": {"title": "no id"}}, {"data": {"id": "b", "score": "x"}}, None]}}))]


def test_dead_letters_after_a_failed_batch(spark, monkeypatch):
    landing, folder, ckpt = (ps.shared_folder(spark, n) for n in ("l-landing", "l-out", "l-ckpt"))
    land(spark, landing, "a", 0, [("1", 0, 5), ("2", 0, 7)], BAD)
    land(spark, landing, "b", 1, [("3", 0, 5)])
    write, calls = ps.write_part, []

    def fail_once(part, path):
        calls.append(path)
        if len(calls) == 2:  # between the two tables of the first batch
            raise RuntimeError("lost")
        write(part, path)

    monkeypatch.setattr(ps, "write_part", fail_once)
    with pytest.raises(Exception, match="lost"):
        ps.split_sinks(ps.read_landing(spark, landing, 1), folder, ckpt)
    land(spark, landing, "c", 2, [("4", 0, 5)], BAD[:1])  # lands before the restart
    ps.split_sinks(ps.read_landing(spark, landing, 1), folder, ckpt)
    good = [r.id for r in spark.read.parquet(f"{folder}/good").collect()]
    bad = [(r.kind, r.record_id, r.reason) for r in spark.read.parquet(f"{folder}/bad").collect()]
    assert sorted(good) == ["1", "2", "3", "4"]
    assert sorted(bad) == sorted([
        ("post_response", "x1", "HTTP 503"), ("post_response", "x1", "HTTP 503"), ("post_response", "x2", "malformed JSON"),
        ("post_response", "x3", "HTTP without status"), ("post_response", "x4", "empty body"),
        ("post", "x5#0", "no id"), ("post", "x5#1", "bad score"), ("post", "x5#2", "no data")])


def test_top_posts_after_a_restart_without_new_files(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ps.ROCKSDB)
    landing, folder, ckpt = (ps.shared_folder(spark, n) for n in ("t-landing", "t-out", "t-ckpt"))

    def run():
        top = ps.keep_top_posts(ps.stream_posts(spark, landing, max_files_per_trigger=1), folder, ckpt, k=2)
        return [(r["rank"], r.id) for r in top.orderBy("rank").collect()]

    for i in range(4):
        land(spark, landing, f"r{i}", i, [(str(10 * i + j), 0, 100 * j + i) for j in range(3)])
    first = run()
    assert first == [(1, "32"), (2, "22")]
    assert run() == first
    assert len(ps._numbered(spark, folder, "top")) == 2
    land(spark, landing, "r9", 5, [("99", 0, 999)])
    assert run() == [(1, "99"), (2, "32")]


def test_top_posts_of_an_empty_landing(spark):
    landing, folder, ckpt = (ps.shared_folder(spark, n) for n in ("e-landing", "e-out", "e-ckpt"))
    ps.land_responses(spark.createDataFrame([], RESPONSE), landing, START, 1)
    assert ps.keep_top_posts(ps.stream_posts(spark, landing), folder, ckpt).collect() == []
