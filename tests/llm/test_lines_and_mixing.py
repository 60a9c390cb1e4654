import duckdb
import pytest
from pyspark.sql import functions as F

from brieflane.llm import line_dedup, mixing, queries
from tests.llm.helpers import DOCS, SF, brute_line_dedup, edge_docs, empty_docs
from oracle_check import rows_of


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(cols, want.fetchall())


def test_line_dedup_on_a_small_table(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\n\n c \ny", "a\nb", "q\nq\nq\nq\nq", "b\nc\nd", "\n\n", "a\nb\nc\nd\ne\n"]
    rows = list(enumerate(texts))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.text, r.line_dedup.n_lines, r.line_dedup.n_removed) for r in got} == brute_line_dedup(rows)


def test_line_dedup_of_edge_rows(spark):
    got = line_dedup.dedup_lines(edge_docs(spark)).collect()
    assert len(got) == 14 and {c for r in got for c in [r.score, r.row, r.later]} == {"clash"}
    assert {r.doc_id: r.text for r in got}[9] == "x\ny"
    assert {r.doc_id: r.text for r in got}[8] == "A\nB\nC\nD\nE"
    assert sum(r.text is None for r in got) == 1
    assert line_dedup.dedup_lines(empty_docs(spark)).collect() == []


def test_repeated_rows_and_null_ids_keep_their_lines(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]


def deviation(slots, units, period):
    """Largest distance from the fluid schedule over all prefixes of a source's slots."""
    most = 0.0
    for j, t in enumerate(sorted(slots)):
        most = max(most, abs(j - units / period * t), abs(j + 1 - units / period * (t + 1)))
    return most


@pytest.mark.parametrize("sizes", [[500, 20, 20, 1], [1], [900] + [3] * 40, [7, 7, 7]])
def test_schedule_stays_within_one_block(spark, sizes):
    t = spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "src string, n bigint")
    units = mixing.shares(t, None)
    u = {r.src: r.units for r in units.collect()}
    rows = mixing.schedule(units).collect()
    assert sorted(r.slot for r in rows) == list(range(1000)) and sum(u.values()) == 1000
    for src in u:
        own = sorted(r.slot for r in rows if r.src == src)
        assert len(own) == u[src] and deviation(own, u[src], 1000) < 1
        assert all(j * 1000 // u[src] <= s < -(-(j + 1) * 1000 // u[src]) for j, s in enumerate(own))


def test_given_weights_and_edge_rows(spark):
    out = mixing.mix(edge_docs(spark), {"a": 0.75, "b": 0.25}, block_docs=2)
    rows = out.select("row.*", "block", out["slot"].alias("at"), "place").collect()
    assert len(rows) == 14 and len({(r["at"], r.place) for r in rows}) == 14
    assert all((r.place in (0, 1)) for r in rows)
    assert mixing.mix(empty_docs(spark)).collect() == []


def test_mix_order_keeps_rows(spark):
    docs = spark.createDataFrame([(i, "t", "en", f"s{i % 3}", 1) for i in range(300)], DOCS)
    got = mixing.in_mix_order(docs)
    assert got.columns == docs.columns
    rows = [(r.doc_id, r.source) for r in got.collect()]
    assert sorted(d for d, _ in rows) == list(range(300))
    # blocks of 16 of three equal sources alternate
    blocks = [{s for _, s in rows[i:i + 16]} for i in range(0, 288, 16)]
    assert all(len(b) == 1 for b in blocks) and all(len(set.union(*blocks[i:i + 3])) == 3 for i in range(0, 18, 3))


def test_ranks_are_dense_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 10)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    got = mixing.mix(docs, block_docs=8).select((F.col("block") * 8 + F.col("place")).alias("r")).collect()
    assert sorted(r.r for r in got) == list(range(1000))
