import numpy as np
import pytest
from pyspark.sql import functions as F

from brieflane.llm import ann_crosspolytope, queries, topk_pivot
from brieflane.llm.vectors import usable

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, label int"
EDGE = [(0, [1.0, 0.0], 1), (100, [0.5, 0.5], None), (100, [0.5, 0.5], 2), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1),
        (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [float("inf"), 0.0], 1),
        (None, [1.0, 1.0], 1), (9, [-1.0, 3.0], 1), (20, [2.0, 2.0], 1), (10, [1.0, 2.0, 3.0], 1)]


def test_pivot_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk_pivot, "BLOCK_ROWS", 120)
    monkeypatch.setattr(topk_pivot, "QUERY_ROWS", 3)
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: np.floor(1024 * np.array(r.embedding, np.float64)).astype(int) for r in v.collect()}
    want = []
    for q in rows:
        if q % 100 == 0:
            best = sorted((-int(rows[q] @ x), i) for i, x in rows.items() if i != q)[:10]
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    got = [tuple(r) for r in queries.op6_exact_topk(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_bound_order_stops_early():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(20, 8)) * 3000
    x = np.floor(centers[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 30)
    pivots = x[:40]
    seen = []
    d = topk_pivot.distances(x, pivots)
    ids = np.arange(4000)
    found = topk_pivot.search_cell((ids[:5], x[:5], d[:5]), (ids, x, d), 10, seen)
    for i, (_, near, score) in enumerate(found):
        want = sorted((-int(x[i] @ y), j) for j, y in enumerate(x) if j != i)[:10]
        assert [(-s, j) for s, j in zip(score, near)] == want
    assert sum(seen) < 4000  # of 5 * 4000


def test_exact_search_of_edge_rows(spark):
    v = spark.createDataFrame(EDGE, SCHEMA).withColumn("score", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_pivot.top_k(v, F.col("id") % 100 == 0).collect()}
    assert got[0, 1] == (20, 1024 * 2048) and got[0, 2] == (1, 1 << 20) and got[0, 3] == (2, 1 << 20)
    assert len([k for k in got if k[0] == 0]) == 6  # 1, 2, 7, 9, 20, 100
    assert topk_pivot.top_k(v.limit(0), F.col("id") % 100 == 0).collect() == []


def test_sums_beyond_doubles_are_exact(spark):
    big = [(0, [2.0 ** 31, 1.0]), (1, [2.0 ** 31, 1.0]), (2, [2.0 ** 31, 0.0]), (3, [-1e200, 0.0])]
    v = spark.createDataFrame(big, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk_pivot.top_k(v, F.col("id") == 0, scale=1).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2 ** 62 + 1), (0, 2, 2, 2 ** 62), (0, 3, 3, -2 ** 63 + 1)]


def recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = queries.op10_ann(spark, sf).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hits = n = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        true = ids[np.lexsort((ids, -s))[:20]]
        own = sorted(by[ids[q]], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(abs(r.score - float(x[q] @ x[ids == r.vec_id][0])) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len(set(true) & {r.vec_id for r in own})
        n += 20
    return hits / n


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    assert recall(spark, sf) >= 0.9


def recall_of(spark, x, **kw):
    """Mean recall of the 20 nearest of every 20th row, by brute force; and the fewest rows found."""
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    by = {}
    for r in ann_crosspolytope.neighbours(v, F.col("id") % 20 == 0, **kw).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(by.get(q, set()) & set(np.lexsort((np.arange(len(x)), -s))[:20].tolist())) / 20)
    return np.mean(hits), min(len(by.get(q, ())) for q in range(0, len(x), 20))


def given(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.embedding for r in rows], np.float64)


def test_recall_with_two_hashes(spark):
    mean, fewest = recall_of(spark, given(spark), hashes=2)
    assert mean >= 0.9 and fewest == 20


@pytest.mark.parametrize("whole", [ann_crosspolytope.BUCKET_ROWS, 100])
@pytest.mark.parametrize("lengths", ["outlier", "lognormal", "huge"])
def test_recall_with_unequal_lengths(spark, lengths, whole):
    x = given(spark)
    if lengths == "lognormal":
        x = x * np.exp(np.random.default_rng(1).normal(0, 0.7, len(x)))[:, None]
    x[7] *= 100
    x = x * (1e100 if lengths == "huge" else 1)
    mean, fewest = recall_of(spark, x, whole=whole)
    assert mean >= 0.9 and fewest == 20


def test_copies_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(ann_crosspolytope, "BUCKET_ROWS", 50)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[100:400] = x[100]
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann_crosspolytope.neighbours(v, F.col("id") == 200, k=20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(100, 120))
    two = ann_crosspolytope.neighbours(v, F.col("id") == 200, k=20, hashes=2).orderBy("rank").collect()
    assert [r.vec_id for r in two] == list(range(100, 120))


def test_many_equal_queries_are_dealt_into_lots(spark, monkeypatch):
    monkeypatch.setattr(ann_crosspolytope, "QUERY_ROWS", 50)
    seen = spark.sparkContext.accumulator(0)
    best_of = ann_crosspolytope.best_of

    def counted(q, *rest):
        seen.add(len(q) > 100)
        return best_of(q, *rest)

    monkeypatch.setattr(ann_crosspolytope, "best_of", counted)
    x = np.random.default_rng(2).normal(size=(900, 16))
    x[:300] = x[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann_crosspolytope.neighbours(v, F.col("id") < 300, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 300 and all(own == [i for i in range(21 if q < 20 else 20) if i != q][:20] for q, own in got.items())
    assert seen.value == 0


def test_neighbours_of_edge_rows(spark):
    v = spark.createDataFrame(EDGE, SCHEMA).withColumn("codes", F.lit("clash"))
    got = ann_crosspolytope.neighbours(v, F.col("id") % 20 == 0).collect()
    assert {r.vec_id for r in got} <= {0, 1, 2, 9, 20, 100}
    zero = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 0)
    assert zero[0] == (1, 20, 2.0) and zero[1:3] == [(2, 1, 1.0), (3, 2, 1.0)]
    assert ann_crosspolytope.neighbours(v.limit(0), F.col("id") % 20 == 0).collect() == []


def test_usable(spark):
    rows = usable(spark.createDataFrame(EDGE, SCHEMA), "vec_id", "embedding", zero=True).collect()
    assert sorted(r.id for r in rows) == [0, 1, 2, 7, 9, 10, 20, 100]


def test_hashes_follow_rows_and_components():
    rule = ann_crosspolytope.hashes_for
    assert [rule(n, 64) for n in (0, 1, 2000, 500_000, 60_000_000, 10 ** 10)] == [1, 1, 1, 1, 2, 3]
    assert [rule(n, 64) for n in range(1, 10 ** 7, 99_991)] == sorted(rule(n, 64) for n in range(1, 10 ** 7, 99_991))
    assert rule(10 ** 9, 1) == 1 and rule(10 ** 9, 1024) <= rule(10 ** 9, 64) <= rule(10 ** 9, 8)
