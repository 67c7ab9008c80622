"""Packing and byte-level BPE against the tokenizers' own libraries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from dupeloom.llm.bytebpe import byte_bpe, encode_documents, read_ranks
from dupeloom.llm.packing import best_fit_decreasing, lower_bound, pack_documents

from .conftest import EDGE_TEXTS

RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_bpe_equals_tiktoken(spark, sf_dir, edge_docs, oracle):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), edge_docs):
        got = sorted(map(tuple, encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()), key=str)
        wanted = []
        for r in docs.select("doc_id", "text").collect():
            ids = np.asarray(oracle.encode_ordinary(r.text or ""), "<u4")
            wanted.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert got == sorted(wanted, key=str)


def test_bpe_of_odd_white_space(oracle):
    bpe = byte_bpe(RANKS, public_tokenizers.PATTERN)
    for text in ["it's 'tis \n'sx", " a  b\n\n\nc ", "a\x1cb", "x　y z", "a\n b", "'ll'S", *[t or "" for t in EDGE_TEXTS]]:
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == oracle.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def check_packing(docs, rows, capacity):
    tokenizer = Tokenizer.from_file(JSON)
    wanted = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.asarray([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % capacity + 1
        ends = list(range(first, len(ids) + 1, capacity))
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            wanted.append((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(wanted, key=str)
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return placed


def test_packing(spark, sf_dir, edge_docs, no_docs):
    added = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b\nc d", "<|endoftext| >", " two  <|endoftext|>\n<|endoftext|>"]
    added_docs = spark.createDataFrame([*enumerate(added), *((9, t) for t in added)], "doc_id long, text string")
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), edge_docs, added_docs):
        rows = pack_documents(docs, JSON, 1024, 2).collect()
        placed = check_packing(docs, rows, 1024)
        assert len(placed) <= 1.03 * lower_bound(np.asarray([r.length for r in rows]), 1024)
    assert pack_documents(no_docs, JSON).collect() == []


def test_gaps_are_packed_again_across_buckets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    once = check_packing(docs, pack_documents(docs, JSON, 1024, 2, per_bucket=20, rounds=0).collect(), 1024)
    again = check_packing(docs, pack_documents(docs, JSON, 1024, 2, per_bucket=20, rounds=3).collect(), 1024)
    assert len(again) <= len(once)


def test_lower_bound_is_one():
    rng = np.random.default_rng(5)
    assert lower_bound(np.asarray([], np.int64), 10) == 0
    assert lower_bound(np.asarray([6, 6, 6]), 10) == 3
    for _ in range(200):
        lengths = rng.integers(1, 11, rng.integers(1, 30))
        bins, offsets, room = best_fit_decreasing(lengths, 10)
        assert np.bincount(bins, lengths).max() <= 10 and len(room) == bins.max() + 1
        assert lower_bound(lengths, 10) <= len(room)
        assert [10 - lengths[bins == b].sum() for b in range(len(room))] == room


def test_ranks_are_used_only_where_proved():
    from dupeloom.llm.packing import rank_encoder, tokenizer_of

    fast = rank_encoder(Tokenizer.from_file(JSON))
    own = Tokenizer.from_file(JSON)
    for text in ["it's aaaa'll   b\n\nc", " 1234 x12!? ", "zzzzzzzzzzzz", *[t for t in EDGE_TEXTS if t and t.isascii()]]:
        assert fast(text) == own.encode(text, add_special_tokens=False).ids
    other = public_tokenizers.path("word_bpe_49k.json")
    assert rank_encoder(Tokenizer.from_file(other)) is None
    assert rank_encoder(own) and np.frombuffer(tokenizer_of(JSON)[1]("é ½ <|endoftext|>"), "<u4").tolist() == own.encode("é ½ <|endoftext|>", add_special_tokens=False).ids
