import random

import pytest

from brieflane.llm import components, jaccard_join
from tests.llm.helpers import EDGE_ROWS, SF, brute_components, edge_docs, empty_docs


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(jaccard_join.components_of(docs, words, percent)) == brute_components(rows, words, percent)


def families(seed, n=160):
    """Near copies at many distances, passages that many texts share, short texts, copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, bases = [word() for _ in range(30)], [[word() for _ in range(rng.choice([3, 6, 40, 120]))] for _ in range(8)]
    rows = []
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.3:
            t = t[:len(t) // 2] + passage + t[len(t) // 2:]
        rows.append((i * 3, " ".join(t)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_families(spark, monkeypatch, small):
    if small:  # every path: blocks, frequent tokens, tokens of many groups
        for name, value in (("LIGHT", 2), ("BLOCK", 8), ("FREQUENT_FROM", 3), ("FREQUENT", 200), ("COUNTED_TOKENS", 2000)):
            monkeypatch.setattr(jaccard_join, name, value)
    rows = families(5 + small)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(jaccard_join.components_of(docs, 4, 85)) == brute_components(rows, 4, 85)


def test_matrix_alone_loses_no_link(spark, monkeypatch):
    """Without the groups of step 1 the token-group matrix must find every link."""
    no_edges = lambda cells, percent: cells.select(cells["label"].alias("a"), cells["label"].alias("b")).where("false")
    real, calls = jaccard_join.compare, []

    def compare(cells, percent):
        calls.append(1)
        return no_edges(cells, percent) if len(calls) == 1 else real(cells, percent)

    monkeypatch.setattr(jaccard_join, "compare", compare)
    monkeypatch.setattr(jaccard_join, "LIGHT", 3)
    rows = families(9)
    assert result(jaccard_join.components_of(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85)) \
        == brute_components(rows, 4, 85)


@pytest.mark.parametrize("bound", [1, 3])
def test_bounds_of_large_groups_lose_no_link(spark, monkeypatch, bound):
    """Large groups of near copies that foreign texts share passages with, in many bounds."""
    for name, value in (("BOUND", bound), ("BITS", 256), ("LIGHT", 6)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(bound)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else word() for w in base)) for i in range(80)]
    rows += [(100 + i, " ".join(base[:rng.randint(5, 58)] + [word() for _ in range(rng.randint(0, 12))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(jaccard_join.components_of(docs, 4, 85)) == brute_components(rows, 4, 85)


def test_edge_rows(spark):
    rows = [(d, t) for d, t, *_ in EDGE_ROWS]
    assert result(jaccard_join.components_of(edge_docs(spark), 4, 85)) == brute_components(rows, 4, 85)
    assert jaccard_join.components_of(empty_docs(spark), 4, 85).collect() == []
    kept = jaccard_join.one_of_each(edge_docs(spark)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12]
    assert {r.score for r in kept} == {"clash"}


def test_connected(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 7)]
    got = components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in got} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 0}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
