from __future__ import annotations

import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainlens.llm.common import new_folder
from chainlens.llm.huffman import Codebook, code_lengths
from chainlens.llm.token_files import read_token_files, write_token_files
from test_packing import encoded


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=60))
def test_lengths_are_huffman_s_where_the_limit_allows(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    lengths = code_lengths(np.array(counts), 60)
    assert (lengths * counts).sum() == cost
    tight = code_lengths(np.array(counts), 6)
    assert tight.max() <= 6 and sum(2.0**-b for b in tight.tolist()) <= 1


def test_too_many_symbols():
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, np.int64), 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=700), max_size=6))
def test_round_trip(streams):
    flat = [i for s in streams for i in s]
    symbols, counts = np.unique(np.array(flat, np.int64), return_counts=True)
    book = Codebook(symbols, code_lengths(counts, 12))
    coded = [book.encode(np.array(s, np.int64)) for s in streams]
    got = book.decode([p for p, _ in coded], [c for _, c in coded], np.array([len(s) for s in streams], np.int64))
    assert got.tolist() == flat


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=700), max_size=6))
def test_streams_coded_at_once_are_those_coded_alone(streams):
    flat = np.array([i for s in streams for i in s], np.int64)
    symbols, counts = np.unique(flat, return_counts=True)
    book = Codebook(symbols, code_lengths(counts, 12))
    data, ends, marks = book.encode_all(flat, np.array([len(s) for s in streams], np.int64))
    alone = [book.encode(np.array(s, np.int64)) for s in streams]
    assert data == b"".join(p for p, _ in alone)
    assert ends.tolist() == np.cumsum([len(p) for p, _ in alone]).tolist()
    assert marks.tolist() == [m for _, c in alone for m in c.tolist()]


def in_order(rows):
    """Documents as the files hold them: by id, then by the checksum of their ids."""
    import zlib

    coded = [(i, np.array(encoded(t or "") + [2], "<u4")) for i, t, *_ in rows]
    return sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1].tobytes())))


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_files_hold_the_corpus_in_order(request, spark, rows, frame):
    path = new_folder(spark, "test-token-files")
    write_token_files(request.getfixturevalue(frame), path)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    start = 0
    for r, (doc_id, ids) in zip(got, in_order(rows), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (doc_id, start, len(ids), ids.tobytes())
        start += len(ids)
    book = {r.id: r for r in spark.read.parquet(f"{path}/codebook").collect()}
    assert sum(r.n for r in book.values()) == start
    shards = spark.read.parquet(f"{path}/manifest").orderBy("shard").collect()
    assert [r.first_token for r in shards] == [sum(s.n_tokens for s in shards[:k]) for k in range(len(shards))]


def test_empty_corpus(spark, no_docs):
    path = new_folder(spark, "test-token-files")
    write_token_files(no_docs, path)
    assert read_token_files(spark, path).count() == 0
