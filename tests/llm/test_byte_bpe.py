"""Rank-queue encoding against the public library that reads the same rank files."""

import base64
import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def library(name):
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


LIBRARY = {n: library(n) for n in NAMES}


def test_pattern_is_the_public_one():
    from lexmill.llm.byte_bpe import PATTERN

    assert PATTERN == public_tokenizers.PATTERN


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcth eéßΣİ1289\n\t\r ,.!'s　\x85 ́<|end日本😀", max_size=80), max_size=4))
@pytest.mark.parametrize("name", NAMES)
def test_ids_are_the_librarys(name, texts):
    from lexmill.llm.byte_bpe import rank_encoder

    got, sizes = rank_encoder(name).batch(pa.array(["x", None, *texts], pa.string()).slice(1))
    want = [LIBRARY[name](t) for t in ["", *texts]]
    assert sizes.tolist() == [len(w) for w in want] and got.tolist() == [i for w in want for i in w]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 300_000), max_size=40))
def test_rank_set(ranks):
    from lexmill.llm.byte_bpe import RankSet

    own = RankSet(300_001)
    for r in ranks:
        own.add(r)
        own.add(r)
    for r in sorted(ranks):
        assert own.least() == r
        own.remove(r)
    assert own.least() == -1


def test_long_pretokens():
    from lexmill.llm.byte_bpe import rank_encoder

    merged, want = rank_encoder(NAMES[0]).ranks.merged, LIBRARY[NAMES[0]]
    for piece in ("ab" * 20_000, "a" * 30_001, " " * 10_000 + "x", "the" * 5_000 + "é" * 999):
        assert rank_encoder(NAMES[0]).ids_of(piece) == want(piece)
    assert len(merged(b"xyz" * 200_000)) > 100_000  # far past what merging by a scan of the whole piece could do


def test_digests(spark, docs, corpus, none, odd):
    from lexmill.llm.byte_bpe import decoded_bytes, encoded_ids, round_trip_digests

    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for d, text, *_ in corpus:
        ids = LIBRARY[NAMES[0]](text or "")
        want[d] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))
    got = round_trip_digests(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want
    assert round_trip_digests(none).count() == 0
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in round_trip_digests(odd).collect()) == sorted((d is not None, d or 0, len(LIBRARY[NAMES[0]](t or ""))) for d, t in [(None, "a b c d e f"), (None, ""), (5, "a b c d e f"), (5, "a b c d e f"), (5, "other text"), (6, "")])
    back = {r["doc_id"]: bytes(r["bytes"]) for r in decoded_bytes(encoded_ids(docs)).collect()}
    assert back == {d: (t or "").encode() for d, t, *_ in corpus}
    assert [r["bytes"] for r in decoded_bytes(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [None]


def test_digests_of_long_texts_are_taken_in_stretches(monkeypatch):
    from lexmill.llm import byte_bpe

    enc = byte_bpe.rank_encoder(NAMES[0])
    ids, _ = enc.batch(pa.array(["some words, and 12 more of them " * 40]))
    whole = byte_bpe._sha256(enc.digits, ids, 1), byte_bpe._sha256(enc.tokens, ids)
    monkeypatch.setattr(byte_bpe, "STRETCH", 7)
    assert (byte_bpe._sha256(enc.digits, ids, 1), byte_bpe._sha256(enc.tokens, ids)) == whole
    assert whole[0] == hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest()
