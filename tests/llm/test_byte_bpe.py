"""Byte-level BPE against tiktoken and the plain definition."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from corpusmill.llm import op12_byte_bpe as op
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, ids string, bytes int, n_tokens int"


@pytest.fixture(scope="module")
def oracle():
    ranks = op.parsed(op.default_ranks()[0])
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return op.Codec(*op.default_ranks())


def same(codec, oracle, texts):
    for text, packed in zip(texts, codec.encode(texts)):
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == oracle.encode_ordinary(text), text[:200]
        assert codec.decode(ids.astype(np.int64)) == text.encode()


def by_definition(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in ranks:
        return [ranks[piece]]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_runs_and_overlapping_merges(codec, oracle):
    runs = [c * n for c in "-=0._* \n\t#aAé…　" for n in [*range(1, 140), 300, 1000]]
    unsure = sorted(op.shared_middles(codec.ranks))
    assert unsure
    odd = [s.decode("utf-8", "ignore") for s in unsure]
    rng = random.Random(3)
    odd += [rng.choice("ax ") + "".join(rng.choice(odd) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    same(codec, oracle, [*runs, *odd, *(" " + r + "x" for r in runs)])
    for s in [*unsure, *(rng.choice(unsure) + rng.choice(unsure) for _ in range(2000)), b"-" * 301, b"ab" * 99]:
        assert op.merged(s, codec.ranks) == by_definition(s, codec.ranks)


def test_any_characters(codec, oracle):
    rng = random.Random(4)
    some = [chr(c) for c in range(0x3000)] + [chr(rng.randrange(0xE000, 0x110000)) for _ in range(3000)] + list("😀👩‍👩‍👧é́​\x85 ")
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["'s 'S it's don't we'LL  x \t\n  y", "<|endoftext|>", "a" * 50_000, "word " * 50_000, "　" * 999 + "x", "1" * 9999, "\x00\x00 \r\n\r\n"]
    same(codec, oracle, texts)


def test_memory_is_bounded(codec, oracle, monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 50)
    fresh = op.Codec(*op.default_ranks())
    for k in range(30):
        same(fresh, oracle, [f"w{i * k} u{i}x again" for i in range(20)])
        assert len(fresh.young) < 200 and len(fresh.old) < 200


def test_query(spark, oracle):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op.query(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(oracle.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_awkward_rows(spark, oracle):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "naïve 😀 'tis"), (4, "naïve 😀 'tis"), (None, "no id"), (5, "x y " * 100_000), (6, "\u0000 \x7f")]
    frame = spark.createDataFrame([(k, t, "i", 1, 2) for k, t in texts], SCHEMA)
    got = sorted(((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in op.round_trip(frame).collect()))
    want = sorted((k or 0, len(oracle.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in texts)
    assert got == want
    assert op.round_trip(frame.limit(0)).count() == 0
    whole = op.encode(frame, form="arrays")
    by = {k: t or "" for k, t in texts}
    for r in whole.collect():
        text, at = by[r.doc_id], 0
        for i, s, e in zip(r.ids, r.starts, r.ends):
            token = oracle.decode_single_token_bytes(i)
            # bytes of the characters covered hold the token's
            first = len(text[:s].encode())
            assert first <= at and at + len(token) <= first + len(text[s:e].encode()) and s < e
            at += len(token)
        assert at == len(text.encode())
    back = op.decode(whole, "ids").selectExpr("doc_id", "cast(bytes as string) as text").collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((k or 0, t or "") for k, t in texts)
    with pytest.raises(Exception, match="not in the vocabulary"):
        op.decode(spark.createDataFrame([(1, [99999])], "doc_id long, ids array<int>")).collect()
