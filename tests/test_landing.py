"""Reconciliation, bucketed posts, interval joins, distinct counts."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from brieflane import sinks
from brieflane.operators import config as cfgops
from brieflane.operators import distinct, intervals
from brieflane.plans import api
from brieflane.sources import fixtures as fx
from brieflane.sources import reconcile
from brieflane.streaming.posts_stream import shared_folder
from conftest import SF_SMALL

T0 = dt.datetime(2024, 5, 1)
POST = "id string, score int, at timestamp_ntz"


def rows(spark, data):
    return spark.createDataFrame([(i, s, None if d is None else T0 + dt.timedelta(days=d)) for i, s, d in data], POST)


def run(spark, path, data):
    out = reconcile.reconcile(path, rows(spark, data), F.to_date("at")).collect()
    return {((r.day - T0.date()).days if r.day.year > 1970 else None, r.kind): r.n for r in out}


def stored(spark, path):
    return sorted(((r.id, r.score) for r in spark.read.parquet(path).collect()), key=repr)


def files(spark, path):
    return {r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect()}


def test_reconcile_writes_only_what_is_different(spark):
    path = shared_folder(spark, "rec")
    first = [("a", 1, 0), ("b", 2, 0), ("c", 3, 1), ("d", None, 2), ("e", 5, None), (None, 9, 0)]
    assert run(spark, path, first) == {(0, "inserted"): 2, (1, "inserted"): 1, (2, "inserted"): 1, (None, "inserted"): 1}
    before = files(spark, path)
    assert run(spark, path, first) == {(0, "unchanged"): 2, (1, "unchanged"): 1, (2, "unchanged"): 1, (None, "unchanged"): 1}
    assert files(spark, path) == before  # a second run writes nothing
    second = [("a", 10, 0), ("c", 3, 1), ("c", 3, 1), ("f", 6, 2), ("d", 0, 2)]
    assert run(spark, path, second) == {(0, "changed"): 1, (0, "kept"): 1, (1, "unchanged"): 1, (2, "inserted"): 1, (2, "changed"): 1}
    assert stored(spark, path) == sorted([("a", 10), ("b", 2), ("c", 3), ("d", 0), ("e", 5), ("f", 6)], key=repr)
    day1 = {f for f in before if "day=2024-05-02" in f}
    assert day1 and day1 <= files(spark, path)  # the day without a difference was not written
    assert run(spark, path, []) == {}


def test_reconcile_after_a_run_that_broke_off(spark, monkeypatch):
    path = shared_folder(spark, "rec")
    run(spark, path, [("a", 1, 0)])
    monkeypatch.setattr(reconcile, "discard", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run(spark, path, [("a", 2, 0), ("b", 1, 0)])
    monkeypatch.undo()
    assert run(spark, path, [("a", 2, 0), ("b", 1, 0)]) == {(0, "unchanged"): 2}
    assert stored(spark, path) == [("a", 2), ("b", 1)]


def test_the_last_fetch_of_an_id_counts(spark):
    path = shared_folder(spark, "rec")
    data = rows(spark, [("a", 1, 0), ("a", 2, 0), ("b", 7, 0)]).withColumn("fetched", F.when(F.col("score") == 1, 5).otherwise(3))
    reconcile.reconcile(path, data, F.to_date("at"), fetched="fetched")
    assert stored(spark, path) == [("a", 1), ("b", 7)]


def test_bucketed_posts_are_not_shuffled(spark):
    p = fx.posts(spark, SF_SMALL).select("id", "subreddit", "search_term", "created_utc")
    posts = sinks.land_posts_bucketed(p, f"t_{uuid.uuid4().hex}", shared_folder(spark, "bucketed"), buckets=8)
    cfg = cfgops.config_lookup(fx.analyzed_entities(spark), fx.config_table(spark))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a plan too large to broadcast
    try:
        found = api.fetch_posts(posts, cfg).select("entity_pos", "id")
        got = sorted(map(tuple, found.collect()))
        final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        scan = next(i for i, line in enumerate(final.splitlines()) if "FileScan" in line and "subreddit" in line)
        above = final.splitlines()[:scan]
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        chain, at = [], depth(final.splitlines()[scan])
        for line in reversed(above):
            if depth(line) < at:
                chain.append(line)
                at = depth(line)
        join = next(i for i, line in enumerate(chain) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in chain[:join]), "\n".join(chain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    whole = fx.posts(spark, SF_SMALL)
    want = api.fetch_posts(whole, cfg).select("entity_pos", "id")
    assert got == sorted(map(tuple, want.collect())) and got


@pytest.mark.parametrize("unit", ["hour", "day", "month"])
def test_interval_join_equals_python(spark, unit):
    rng = random.Random(5)
    points = [(i, rng.choice("aab"), T0 + dt.timedelta(hours=rng.randint(0, 600))) for i in range(300)] + [(900, "a", None), (901, None, T0)]
    spans = []
    for i in range(60):
        start = T0 + dt.timedelta(hours=rng.randint(-50, 600))
        spans.append((i, rng.choice("abc"), start, start + dt.timedelta(hours=rng.choice([0, 1, 24, 200, -3]))))
    spans += [(100, "a", None, T0), (101, "a", T0, None), (102, None, T0, T0)]
    p = spark.createDataFrame(points, "i int, k string, t timestamp_ntz")
    s = spark.createDataFrame(spans, "j int, k string, a timestamp_ntz, b timestamp_ntz")
    got = intervals.interval_join(p, s, ["k"], "t", "a", "b", unit, "merge").select("i", "j").collect()
    want = [(i, j) for i, k, t in points for j, kk, a, b in spans if None not in (k, t, kk, a, b) and k == kk and a <= t <= b]
    assert sorted(map(tuple, got)) == sorted(want) and want
    counts = intervals.counts_by_interval(p, s, ["k"], "t", "a", "b", ["j"], {"n": F.count("*")}, unit)
    assert {r.j: r.n for r in counts.collect()} == {j: sum(1 for _, x in want if x == j) or None for j, *_ in spans}


def test_a_thousand_spans_are_not_broadcast(spark):
    p = fx.posts(spark, SF_SMALL)
    s = spark.range(1000).select(F.col("id").alias("j"), F.concat(F.lit("src"), F.col("id") % 10).alias("subreddit"),
                                 F.lit(T0).cast("timestamp_ntz").alias("a"), F.lit(T0).cast("timestamp_ntz").alias("b"))
    out = intervals.interval_join(p, s, ["subreddit"], "created_utc", "a", "b", strategy="merge")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_levels_equal_python_and_sketches_stay_within_their_error(spark):
    rng = random.Random(6)
    data = [(rng.choice("eef"), rng.randint(0, 3), str(rng.randint(0, 4000)), rng.choice(["x", "y", None])) for _ in range(9000)]
    df = spark.createDataFrame(data, "e string, d int, r string, o string")
    sets = [["e", "d"], ["e"], ["d"], []]
    got = {(x.level, x.e, x.d): (x.n_rows, x.n_r, x.n_o) for x in distinct.distinct_levels(df, sets, ["r", "o"]).collect()}
    want = {}
    for s in sets:
        for e, d, r, o in data:
            key = (",".join(s), e if "e" in s else None, d if "d" in s else None)
            want.setdefault(key, []).append((r, o))
    assert got == {k: (len(v), len({r for r, _ in v}), len({o for _, o in v} - {None})) for k, v in want.items()}
    path = shared_folder(spark, "t-sketch")
    distinct.daily_sketches(df, ["e", "d"], ["r"]).write.parquet(path)
    for keys in (["e"], ["d"], []):
        for x in distinct.merged(spark.read.parquet(path), keys, ["r"]).collect():
            n, exact, _ = got[(",".join(keys), x.asDict().get("e"), x.asDict().get("d"))]
            assert x.n_rows == n and abs(x.about_r - exact) <= 4 * distinct.standard_error() * exact + 1


def test_intermediate_tables_are_swept(spark):
    from brieflane import session
    kept = list(session._intermediate)
    session._intermediate.clear()
    try:
        df = session.written(spark.range(3), "sweep")
        assert df.count() == 3
        path = session._intermediate[0]
        assert session.names_in(spark, path) and session.sweep(spark) == 1
        assert session.names_in(spark, path) == [] and session.sweep(spark) == 0
    finally:
        session._intermediate.extend(kept)
