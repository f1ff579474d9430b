"""Token counts and byte-level BPE against the public libraries."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from landwatch.llm import bpe, queries, transducer

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, " ", "a", "x" * 3000, "ab" * 400, " " * 700 + "abc", "a\nb\r\n  c", "日本語のテキスト 😀😀", "<s> </s> <unk> <0x0A>", "▁ ▁▁x", "don't stop 12345 3.14 αβγ Привет",
         "the the the", "the the the", "\x00\x07 odd"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, n_tokens int")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_and_decodes(spark, table, plain):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.decode(bpe.encode(table, path, P.PATTERN), path).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.ids == plain.encode_ordinary(TEXTS[r.doc_id] or "")
        assert bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode()


def test_bpe_of_empty_table(spark, table):
    assert bpe.encode(table.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect() == []


def test_matrix_equals_heap():
    ranks = bpe.Ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    pieces = [b"abababababab", b" thehehehe", "ñandúñandú".encode(), b"0000000", b"zzzzqqqqzzzz"]
    ids, counts = ranks.encode_pieces(pieces)
    at = 0
    for p, n in zip(pieces, counts):
        assert ids[at:at + n].tolist() == ranks.encode_long(p).tolist()
        at += n


def test_bpe_query(spark, plain):
    want = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    for r in queries.op10_byte_bpe(spark, SF).collect():
        ids = plain.encode_ordinary(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_counts_equal_library(spark, table):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = transducer.count(table, P.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in enumerate(TEXTS)}
    assert transducer.count(table.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_count_query_and_small_state_table(spark, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in queries.op3_token_counts(spark, SF).collect()}
    assert got == {i: (n := len(sp.encode(t)), n > 4096) for i, t in texts.items()}
    monkeypatch.setattr(transducer, "TABLE", 10)
    run = transducer.Transducer(P.path("piece_bpe_32k.model"))
    some = list(texts.values())[:20]
    assert [int(run([t])[0]) for t in some] == [len(sp.encode(t)) for t in some]
