import hashlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402
import tiktoken  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from brieflane.llm import bpe_fst, queries, token_counts  # noqa: E402
from tests.llm.helpers import EDGE_ROWS, SF, edge_docs, empty_docs  # noqa: E402

WORD_FILE, BYTE_FILE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
EXTRA = ["İstanbul I'm we'LL don't", "a<|endoftext|>b <|startoftext|><|endoftext|>", "\x85x y\x0b\x1c z", "''s 's'S",
         "zażółć gęślą jaźń", "!!!???---===>>>" * 20, " \t\n  \r\n" * 5, "0123456789" * 30, "हिन्दी العربية русский"]


def library_counts(texts):
    return [len(e.ids) for e in Tokenizer.from_file(WORD_FILE).encode_batch(texts, add_special_tokens=False)]


def library_ids():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_fst.load_ranks(BYTE_FILE), special_tokens={})


def test_token_counts_match_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(rows, library_counts(list(rows.values()))))
    got = queries.op1_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len(rows[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048) for r in got)


def test_token_counts_of_edge_rows(spark):
    got = token_counts.token_counts(edge_docs(spark), WORD_FILE).collect()
    want = library_counts([t or "" for _, t, *_ in EDGE_ROWS])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(
        ((d, n) for (d, *_), n in zip(EDGE_ROWS, want)), key=key)
    assert token_counts.token_counts(empty_docs(spark), WORD_FILE).collect() == []


def test_token_counts_of_odd_texts():
    assert token_counts.PieceCounter(WORD_FILE).counts(EXTRA).tolist() == library_counts(EXTRA)


def test_encoding_matches_the_library_and_decodes(spark):
    enc = library_ids()
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_bpe(spark, SF).collect():
        ids = np.array(enc.encode_ordinary(rows[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_encoding_of_edge_rows(spark):
    enc = library_ids()
    got = bpe_fst.encode_documents(edge_docs(spark), BYTE_FILE, P.PATTERN, keep_ids=True).collect()
    want = sorted(np.array(enc.encode_ordinary(t or ""), "<u4").tobytes() for _, t, *_ in EDGE_ROWS)
    assert sorted(bytes(r.ids) for r in got) == want
    assert bpe_fst.encode_documents(empty_docs(spark), BYTE_FILE, P.PATTERN).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60) | st.sampled_from(EXTRA) | st.text(alphabet="abcdeinrst the", max_size=60))
def test_transducer_equals_the_library(text):
    codec = bpe_fst.codec(BYTE_FILE, P.PATTERN)
    ids = codec.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library_ids_once().encode_ordinary(text)
    assert codec.decode(ids, step=1) == text.encode()


def library_ids_once(kept=[]):
    if not kept:
        kept.append(library_ids())
    return kept[0]


def test_stream_encoder_emits_after_bounded_lookahead():
    machine = bpe_fst.codec(BYTE_FILE, P.PATTERN).machine
    for piece in (b"antidisestablishmentarianism", b" internationalization", b"aaaaaaaaaaaaaaaaaaaa", b"=" * 40):
        stream, out, most = bpe_fst.StreamEncoder(machine), [], 0
        for b in piece:
            out += stream.feed(b)
            most = max(most, stream.at - sum(int(machine.size_of[t]) for t in out))
        out += stream.end()
        assert [machine.bytes_of[t] for t in out] == machine.merged(piece)
        assert most <= max(map(len, machine.ranks))


def test_stream_decoder_holds_unfinished_characters():
    table = {i: bytes([i]) for i in range(256)}
    text = "aé日👩b"
    stream = bpe_fst.StreamDecoder(table)
    parts = [stream.feed([b]) for b in text.encode()]
    assert "".join(parts) + stream.end() == text and "�" not in "".join(parts)


def test_tables_start_anew_when_full(monkeypatch):
    monkeypatch.setattr(bpe_fst, "REMEMBERED_STATES", 50)
    monkeypatch.setattr(bpe_fst, "REMEMBERED_WORDS", 5)
    codec = bpe_fst.Codec(BYTE_FILE, P.PATTERN)
    for text in EXTRA * 2:
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == library_ids_once().encode_ordinary(text)


def test_utf8_machine_equals_the_library_decoder():
    """Byte by byte and in runs, also of bytes that are no UTF-8."""
    import codecs
    import random
    rng = random.Random(2)
    alphabet = [b"a", "é".encode(), "日".encode(), "👩".encode(), b"\x80", b"\xe2\x82", b"\xf0\x9f", b"\xc0", b"\xff", b"\xe0\x80"]
    for _ in range(3000):
        runs = [b"".join(rng.choices(alphabet, k=rng.randint(0, 4))) for _ in range(4)]
        machine, held = bpe_fst.Utf8Machine(), codecs.getincrementaldecoder("utf-8")("replace")
        for run in runs:
            k = machine.follow(run)
            held.decode(run)
            assert k == len(held.getstate()[0]), runs


def test_every_token_of_the_vocabulary_alone():
    """Tokens that merging makes come out of the transducer, the few others are looked up."""
    machine = bpe_fst.codec(BYTE_FILE, P.PATTERN).machine
    pieces = list(machine.ranks)
    got = machine.encode_all(pieces)
    assert [int.from_bytes(g, "little") for g in got] == [machine.ranks[p] for p in pieces]
    assert len(machine.unmade) < 0.05 * len(machine.ranks)
