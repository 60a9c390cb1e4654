import collections
import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from brieflane.llm import bpe_fst, langid  # noqa: E402
from tests.llm.helpers import SF, brute_components, brute_line_dedup, edge_docs, empty_docs  # noqa: E402


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, rows = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    one = corpus_pipeline.language_id(spark, docs, SF)
    assert one.columns == cols and sorted(r.doc_id for r in one.collect()) == sorted(d for d, _ in rows)

    two = corpus_pipeline.remove_repeated_lines(spark, docs, SF)
    want = {d: t for d, (t, n, gone) in brute_line_dedup(rows).items() if not n or gone < n}
    got = two.collect()
    assert two.columns == cols and {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)

    three = corpus_pipeline.near_duplicates(spark, docs, SF)
    keep = sorted(d for d, n, c in brute_components(rows, 5, 80) if c == d)
    assert three.columns == cols and sorted(r.doc_id for r in three.collect()) == keep

    four = corpus_pipeline.mix_sources(spark, docs, SF)
    assert four.columns == cols and sorted(r.doc_id for r in four.collect()) == sorted(d for d, _ in rows)


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = [(d, t) for d, (t, n, gone) in brute_line_dedup(rows).items() if not n or gone < n]
    keep = {d for d, n, c in brute_components(left, 5, 80) if c == d}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_fst.load_ranks(P.path("byte_bpe_50k.tiktoken")),
                            special_tokens={})
    want = {d: np.array(enc.encode_ordinary(t), "<u4").tobytes() for d, t in left if d in keep}
    assert {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, SF).collect()} == want


def brute_mix(rows, block_docs=16):
    """rows: (id, source) with distinct ids -> {id: (slot, place)}."""
    n = collections.Counter(s for _, s in rows)
    names = sorted(n)
    raw = [math.floor(math.sqrt(n[s]) * 1000) for s in names]
    period = max(1000, 10 * len(names))
    free = period - len(names)
    rest = sorted(range(len(names)), key=lambda i: (-(free * raw[i] % sum(raw)), names[i]))
    units = [1 + free * r // sum(raw) for r in raw]
    for i in rest[:period - sum(units)]:
        units[i] += 1
    slots = [[] for _ in names]
    for slot in range(period):
        ready = [(-(-(len(had) + 1) * period // u), -u, i) for i, (had, u) in enumerate(zip(slots, units))
                 if len(had) * period // u <= slot]
        slots[min(ready)[2]].append(slot)
    out = {}
    for i, s in enumerate(names):
        own = sorted((d for d, x in rows if x == s), key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d))
        for rank, d in enumerate(own):
            block = rank // block_docs
            out[d] = (block // units[i] * period + slots[i][block % units[i]], rank % block_docs)
    return out


def test_run_returns_the_mix(spark):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.slot, r.place) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == brute_mix([(d, source[d]) for d in got]) and len(set(got.values())) == len(got)


def test_last_stage_knows_the_order_of_the_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.mix_sources(spark, docs, SF).write.parquet(str(tmp_path / "mix"))
    files = sorted(str(p) for p in (tmp_path / "mix").glob("part-*"))
    order = [r.doc_id for f in files for r in spark.read.parquet(f).coalesce(1).collect()]
    got = corpus_pipeline.encode(spark, spark.read.parquet(str(tmp_path / "mix")), SF).orderBy("slot", "place").collect()
    assert [r.doc_id for r in got] == order


def test_language_fit_does_not_follow_the_length(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    learn = [(i, "the house is on the hill and animal taxi hotel", "en", "a", 0) for i in range(20)]
    learn += [(100 + i, "das haus ist auf dem berg und animal taxi hotel", "de", "a", 0) for i in range(20)]
    model = langid.fit(spark.createDataFrame(learn, schema), F.lit(True))
    own = [(1, "taxi hotel", None, "a", 0), (2, "дом на горе " * 100, None, "a", 0), (3, "дом", None, "a", 0),
           (4, "animal taxi hotel " * 100, None, "a", 0), (5, "123", None, "a", 0)]
    docs = spark.createDataFrame(own, schema)
    assert sorted(r.doc_id for r in langid.keep_identified(docs, model).collect()) == [1, 4]
    # nothing to learn from: every text with a letter stays
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == [1, 2, 3, 4]


def test_stages_on_edge_rows(spark, tmp_path):
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, start in (("edge", edge_docs(spark, extra=False)), ("extra", edge_docs(spark)), ("empty", empty_docs(spark))):
        docs = start
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, SF)
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if k < 4:
                assert docs.columns == start.columns and docs.columns[:5] == own
        ids = sorted(r.doc_id or 0 for r in docs.collect())
        # 1, 2, 3, 7 have no letter; the copies 5, 5 and the one without an id go with 4
        assert ids == ([] if name == "empty" else [4, 6, 8, 9, 10, 11, 12])


def test_spark_entry_registers_it(spark):
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_input_from_a_table_with_null_columns(spark):
    docs = spark.createDataFrame([(1, "the same words again and again", None, None, None)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.mix_sources(spark, docs, SF).count() == 1
    assert corpus_pipeline.near_duplicates(spark, docs.union(docs), SF).count() == 1
    assert corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit("en")), SF).count() == 1


def test_last_stage_follows_the_files_it_reads(spark, tmp_path):
    # files in an order of their own, not that of the mix: the last stage has nothing else to go by
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, f"text {i}", "en", "a" if i % 3 else None, 6) for i in range(100)]
    docs = spark.createDataFrame(rows, schema).repartitionByRange(3, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"))
    docs.write.parquet(str(tmp_path / "mix"))
    got = corpus_pipeline.encode(spark, spark.read.parquet(str(tmp_path / "mix")), SF).orderBy("slot", "place").collect()
    for own in ([i for i in range(99, -1, -1) if i % 3], [i for i in range(99, -1, -1) if i % 3 == 0]):
        assert [r.doc_id for r in got if r.doc_id in set(own)] == own
    assert len({(r.slot, r.place) for r in got}) == 100


def test_slices_of_any_size_encode_alike(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    path = P.path("byte_bpe_50k.tiktoken")
    want = sorted(map(tuple, bpe_fst.encode_documents(docs, path, P.PATTERN).collect()))
    monkeypatch.setattr(bpe_fst, "SLICE_BYTES", 1)
    assert sorted(map(tuple, bpe_fst.encode_documents(docs, path, P.PATTERN).collect())) == want
    tokens = bpe_fst.TokenBytes({0: b"a", 2: b"bc"})
    assert tokens.join(np.array([2, 0, 2])) == b"bcabc" and tokens.join(np.array([], np.int64)) == b""
    with pytest.raises(ValueError):
        tokens.join(np.array([1]))
