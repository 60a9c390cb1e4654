import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from brieflane.llm import piece_bpe, queries
from helpers import SF, edge_docs, empty_docs

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "the", " ", "  ", "▁", "é", "日本", "\n", "\t", "👩‍👩‍👧", "ing", "İ", "́", "x", " th", "\0", "�", "<s>", "<0x0A>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def expected(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())


def mixed(n, seed, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, most))) for _ in range(n)]


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_sentencepiece(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, docs[r.doc_id])


def test_ids_spans_and_decoding_of_mixed_texts(library):
    model = piece_bpe.piece_model(MODEL)
    for text in ["", " ", "▁a ▁", " " * 100 + "x" + " " * 17, "日本" * 3000, "a" * 20_000, *mixed(3000, 1)]:
        ids, starts, ends = model.encode(text)
        proto = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in proto]
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in proto]
        assert model.decode(ids.tolist()) == library.decode(ids.tolist())


def test_spans_cover_the_text():
    model = piece_bpe.piece_model(MODEL)
    for text in mixed(500, 2):
        _, starts, ends = model.encode_whole(text)
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(starts, ends)) == data


def test_decoding_of_any_ids(library):
    model, rng = piece_bpe.piece_model(MODEL), random.Random(3)
    some = [0, 1, 2, 264, 259, 28705, *(3 + b for b in (32, 0xe2, 0x91, 0xa0, 0xf0, 0xff))]
    for ids in ([rng.choices(some, k=6) for _ in range(4000)] + [rng.choices(range(32_000), k=8) for _ in range(1000)]):
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("options", [{}, {"remove_extra_whitespaces": False}, {"escape_whitespaces": False}, {"add_dummy_prefix": False}])
def test_normalisation_by_a_compiled_map(rule, options):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **options)
    spec = dict(piece_bpe.fields(library.serialized_normalizer_spec()))
    model = object.__new__(piece_bpe.PieceModel)
    model.prefix, model.squeeze, model.space = spec.get(3, 1), spec.get(4, 1), "▁" if spec.get(5, 1) else " "
    model.map = piece_bpe.CharacterMap(spec[2])
    rng = random.Random(4)
    letters = [*ALPHABET, "ﬁ", "①", "ｱﾞ", "　", "​", "각", "ý", "Å", "㌀", "﻿", "ß", "K"]
    for _ in range(1500):
        text = "".join(rng.choices(letters, k=rng.randint(0, 20)))
        got, origin = model.normalize(text)
        want, offsets = library.normalize(text, with_offsets=True)
        assert got == want
        at = np.cumsum([0, *(len(c.encode()) for c in got)])
        chars = [len(text.encode()[:int(origin[k])].decode()) for k in at]
        assert not got or chars == list(offsets)


def test_edge_rows_and_the_way_back(spark, library):
    docs = edge_docs(spark)
    rows = piece_bpe.encode_documents(docs, MODEL, keep=True)
    want = sorted((repr(r.doc_id), *expected(library, r.text)) for r in docs.collect())
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows.collect()) == want
    back = piece_bpe.decode_documents(rows, MODEL)
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == texts
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, -1, 99_999_999, 264])], "doc_id int, ids array<bigint>")
    assert {r.doc_id: r.text for r in piece_bpe.decode_documents(odd, MODEL).collect()} == {1: None, 2: "", 3: "a"}


def test_empty_table(spark):
    out = piece_bpe.encode_documents(empty_docs(spark).withColumn("ids", F.lit("clash")), MODEL)
    assert out.collect() == []


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_bpe.PieceModel(b"")
