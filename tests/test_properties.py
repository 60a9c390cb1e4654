"""Property tests (hypothesis): tokenizer parity and segment-level counting."""

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brieflane.operators import text as tx
from brieflane.plans.q_text import sql_tokens

ALPHABET = [" ", "\t", "\n", "\x0b", "\f", "\r", "a", "B", "é", "the", "Price,", "ß"]
piece_text = st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join)
texts = st.lists(piece_text, min_size=1, max_size=40)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(texts)
def test_tokenize_matches_ml_tokenizer_and_duckdb(spark, values):
    from pyspark.ml.feature import Tokenizer
    df = spark.createDataFrame([(i, t) for i, t in enumerate(values)], "id int, t string")
    ours = {r.id: list(r.toks) for r in df.select("id", tx.tokenize(F.col("t")).alias("toks")).collect()}
    ml = {r.id: list(r.w) for r in Tokenizer(inputCol="t", outputCol="w").transform(df).collect()}
    assert ours == ml
    con = duckdb.connect()
    con.execute("CREATE TABLE d (id INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", list(enumerate(values)))
    duck = {i: list(toks) for i, toks in con.execute(f"SELECT id, {sql_tokens('t')} FROM d").fetchall()}
    assert duck == ours


segments = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.lists(st.sampled_from(ALPHABET), max_size=8).map("".join)),
                    min_size=0, max_size=25)


@SETTINGS
@given(segments)
def test_segment_counts_equal_assembled(spark, segs):
    rows = [(d, i, t) for i, (d, t) in enumerate(segs)]
    seg = spark.createDataFrame(rows, "doc_id string, position int, text string")
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string")
    got = sorted(tuple(r) for r in tx.segment_term_counts(seg, docs, salts=3).collect())
    joined = {d: " ".join(t for dd, _, t in sorted(rows, key=lambda r: r[1]) if dd == d) for d in "abcd"}
    full = spark.createDataFrame(list(joined.items()), "doc_id string, t string")
    want = sorted(tuple(r) for r in tx.term_counts(full, "doc_id", "t").collect())
    assert got == want
