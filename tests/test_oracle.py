"""Every registered query against its DuckDB oracle (sf0.001; the driver checks sf0.01)."""

import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path[:0] = [ROOT, os.path.join(ROOT, "scripts")]

import __spark_entry__ as se  # noqa: E402
from brieflane.plans import registry  # noqa: E402
from oracle_check import TABLES, rows_of, type_mismatches  # noqa: E402

SQLS = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con():
    import duckdb
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(SQLS)
    assert rows_only == {"quality_classifier"}
    assert set(SQLS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = con.execute(SQLS[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert type_mismatches(stypes, {d[0]: str(d[1]) for d in rel.description}) == []
    assert rows_of(df.columns, srows) == rows_of(dcols, drows)


def test_entry_smoke(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["entity", "rank", "id", "subreddit", "title", "score", "num_comments",
                          "engagement", "search_term", "created_utc"]
