"""As-of joins and calendar trends against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brieflane.operators import asof, market, trend

T0 = dt.datetime(2024, 3, 1)


def ticks(n, seed):
    rng = random.Random(seed)
    # one symbol holds most of the rows; times repeat
    return [(rng.choice(["hot"] * 8 + ["a", "b"]), T0 + dt.timedelta(hours=rng.randint(0, 300)), float(rng.randint(1, 99))) for _ in range(n)]


def asks(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 5 + ["a", "b", "none"]), T0 + dt.timedelta(hours=rng.randint(-20, 400))) for i in range(n)]


def last(rows, symbol, at, strict=False, within=None):
    found = [(t, p) for s, t, p in rows if s == symbol and (t < at or (t == at and not strict)) and (within is None or t >= at - within)]
    return max(found, default=(None, None))


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_python(spark, unit, strict):
    right, left = ticks(600, 1), asks(200, 2)
    r = spark.createDataFrame(right + [(None, T0, 1.0), ("a", None, 2.0)], "s string, t timestamp_ntz, p double").repartition(5)
    l = spark.createDataFrame(left, "i int, s string, at timestamp_ntz").repartition(3)
    out = asof.asof_join(l, r, ["s"], "at", "t", {"t": "when", "p": "price"}, unit, strict)
    assert sorted(tuple(x) for x in out.collect()) == sorted((i, s, at, *last(right, s, at, strict)) for i, s, at in left)


def test_asof_within_an_interval(spark):
    right, left = ticks(60, 3), asks(100, 4)
    r = spark.createDataFrame(right, "s string, t timestamp_ntz, p double")
    l = spark.createDataFrame(left, "i int, s string, at timestamp_ntz")
    out = asof.asof_join(l, r, ["s"], "at", "t", {"p": "price"}, within=F.expr("INTERVAL 5 HOURS"))
    assert sorted((x.i, x.price) for x in out.collect()) == sorted((i, last(right, s, at, within=dt.timedelta(hours=5))[1]) for i, s, at in left)


def test_asof_of_null_keys_and_empty_sides(spark):
    l = spark.createDataFrame([(1, None, T0), (2, "a", None), (2, "a", None), (3, "a", T0), (3, "a", T0)], "i int, s string, at timestamp_ntz")
    r = spark.createDataFrame([("a", T0, None), ("a", T0 - dt.timedelta(days=400), 7.0)], "s string, t timestamp_ntz, p double")
    out = asof.asof_join(l, r, ["s"], "at", "t", {"p": "price", "t": "since"})
    assert sorted(((x.i, x.price, x.since) for x in out.collect()), key=repr) == sorted(
        [(1, None, None), (2, None, None), (2, None, None), (3, None, T0), (3, None, T0)], key=repr)
    assert asof.asof_join(l, r.limit(0), ["s"], "at", "t", {"p": "price"}).count() == 5
    assert asof.asof_join(l.limit(0), r, ["s"], "at", "t", {"p": "price"}).collect() == []


def test_quotes_at_midnight_and_without_prices(spark):
    t = spark.createDataFrame([("a", T0, 4.0), ("a", T0 + dt.timedelta(days=3), 5.0), ("b", T0, 0.0)], "symbol string, ts timestamp_ntz, price double")
    a = spark.createDataFrame([(1, "a", T0 + dt.timedelta(days=3)), (2, "a", T0), (3, "b", T0 + dt.timedelta(days=1)), (4, "z", T0)],
                              "i int, symbol string, at timestamp_ntz")
    got = {r.i: (r.current_price, r.previous_close, r.change_pct) for r in market.quotes_at(a, t).collect()}
    assert got == {1: (5.0, 4.0, 25.0), 2: (4.0, None, None), 3: (0.0, 0.0, None), 4: (None, None, None)}


POSTS = [("e", 0, "1mo", d, n) for d, n in [(0, 5), (0, 7), (1, 2), (4, 10), (5, 1), (11, 3)]] + [("f", 1, "1w", 3, 9)]


@pytest.fixture
def relevant(spark):
    return spark.createDataFrame([(e, p, tf, T0 + dt.timedelta(days=d, hours=5), n) for e, p, tf, d, n in POSTS],
                                 "entity string, entity_pos int, timeframe string, created_utc timestamp_ntz, engagement bigint")


def by_day(entity, until):
    days = [d for e, _, _, d, _ in POSTS if e == entity]
    return [sum(n for e, _, _, d, n in POSTS if e == entity and d == day) for day in range(min(days), max(max(days), until) + 1)]


def test_the_day_before_counts_zero_where_it_had_no_posts(spark, relevant):
    rows = trend.engagement_trend(relevant).where("entity = 'e'").orderBy("day_start").collect()
    want = by_day("e", 0)
    assert [r.engagement for r in rows] == want == [12, 2, 0, 0, 10, 1, 0, 0, 0, 0, 0, 3]
    assert [r.prev_engagement for r in rows] == [None] + want[:-1]
    assert [r.change for r in rows][1:] == [b - a for a, b in zip(want, want[1:])]


@pytest.mark.parametrize(("days", "step", "baseline"), [(1, 1, 1), (3, 1, 2), (3, 2, 3), (7, 7, 2)])
def test_sliding_windows_equal_python(spark, relevant, days, step, baseline):
    until = F.lit(T0 + dt.timedelta(days=20)).cast("timestamp_ntz")
    rows = trend.window_trend(relevant, days, step, baseline, until).collect()
    want = []
    for e, first in (("e", 0), ("f", 3)):
        d = by_day(e, 20)
        for i in range(len(d) - 1, days - 2, -step):
            total = lambda k: sum(d[k - days + 1:k + 1]) if k - days + 1 >= 0 else None
            before = [total(i - days * k) for k in range(1, baseline + 1)]
            known = [b for b in before if b is not None]
            mean = sum(known) / len(known) if known else None
            now = total(i)
            want.append((e, T0.date() + dt.timedelta(days=first + i), now, before[0], None if before[0] is None else now - before[0],
                         None if mean is None else round(mean, 6), round(now / mean, 6) if mean else None))
    got = [(r.entity, r.last_day, r.engagement, r.prev_engagement, r.change, r.baseline, r.ratio) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all((r.last_day - r.first_day).days == days - 1 for r in rows)
