"""Operators 6 and 9 and what they share, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainlens.llm import windows
from chainlens.llm.bwt_dedup import ByteStrings, Shard, interleave, merge, remove_repeated_bytes
from chainlens.llm.suffix_tree_dedup import WordSequences, deep_suffixes, remove_repeated_words, word_hashes

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def kept(sequences, length):
    """For each sequence, which symbols stay."""
    counts = Counter(tuple(s[k : k + length]) for s in sequences for k in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = set()
        for k in range(len(s) - length + 1):
            if counts[tuple(s[k : k + length])] > 1:
                gone.update(range(k, k + length))
        out.append([k not in gone for k in range(len(s))])
    return out


def bytes_expected(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    out = Counter()
    for (doc_id, *_), text, stay in zip(rows, texts, kept(texts, length), strict=True):
        spans = len(re.findall("0+", "".join("01"[s] for s in stay)))
        out[doc_id, len(text), spans, bytes(b for b, s in zip(text, stay) if s)] += 1
    return out


def words_expected(rows, length):
    texts = [WORDS.findall((t or "").encode()) for _, t, *_ in rows]
    out = Counter()
    for (doc_id, *_), words, stay in zip(rows, texts, kept(texts, length), strict=True):
        out[doc_id, len(words), len(words) - sum(stay), b" ".join(w for w, s in zip(words, stay) if s).decode()] += 1
    return out


def bytes_found(df, length):
    return Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in remove_repeated_bytes(df, length).collect())


def words_found(df, length):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_words(df, length).collect())


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_bytes(request, rows, frame):
    assert bytes_found(request.getfixturevalue(frame), 50) == bytes_expected(rows, 50)


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_words(request, rows, frame):
    assert words_found(request.getfixturevalue(frame), 10) == words_expected(rows, 10)


def test_contract_lengths(docs, rows):
    assert bytes_found(docs, 200) == bytes_expected(rows, 200)
    assert words_found(docs, 35) == words_expected(rows, 35)


def test_large_groups_are_split(monkeypatch, docs, rows):
    monkeypatch.setattr(windows, "MAX_GROUP", 1)
    monkeypatch.setattr(windows, "LEVELS", 4)
    assert bytes_found(docs, 50) == bytes_expected(rows, 50)
    assert words_found(docs, 10) == words_expected(rows, 10)


def test_small_portions(docs, rows):
    symbols = ByteStrings(50, shard_bytes=64)
    texts = [(t or "").encode() for _, t, *_ in rows]
    flags = symbols.mark(texts)
    counts = Counter(t[k : k + 50] for t in texts for k in range(len(t) - 49))
    for text, own in zip(texts, flags, strict=True):
        assert own.tolist() == [k + 50 <= len(text) and counts[text[k : k + 50]] > 1 for k in range(len(text))]


def test_empty_tables(no_docs):
    assert remove_repeated_bytes(no_docs).count() == 0
    assert remove_repeated_words(no_docs).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.integers(1, 200))
def test_merged_transforms(texts, shard_bytes):
    texts = [t.encode() for t in texts]
    counts = Counter(t[k : k + 10] for t in texts for k in range(len(t) - 9))
    flags = ByteStrings(10, 3, shard_bytes).mark(texts)
    for text, own in zip(texts, flags, strict=True):
        assert own.tolist() == [k + 10 <= len(text) and counts[text[k : k + 10]] > 1 for k in range(len(text))]


def test_merging_keeps_the_order_of_blocks():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(10, 60))) for _ in range(12)]
    data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    left = np.repeat(ends, [len(t) for t in texts]) - np.arange(len(data))
    names = np.array([int.from_bytes(data[k : k + 2], "big") if left[k] >= 2 else -1 for k in range(len(data))])
    cut = int(ends[5])
    places = np.flatnonzero(names >= 0)
    a, b = (Shard.sorted(p, 2, names, left) for p in (places[places < cut], places[places >= cut]))

    def suffix(p):
        return data[p : p + 10][: left[p] // 2 * 2]

    smaller, not_larger = interleave(a, b)
    others = [suffix(p) for p in b.places]
    for p, low, high in zip(a.places, smaller, not_larger, strict=True):
        assert (low, high) == (sum(o < suffix(p) for o in others), sum(o <= suffix(p) for o in others))
    merged = merge(a, b)
    order = [suffix(p) for p in merged.places]
    assert order == sorted(order) and sorted(merged.places) == places.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120), st.integers(1, 20))
def test_deep_suffixes(words, depth):
    words = np.array(words, np.int64)
    starts = np.arange(max(0, len(words) - depth + 1))
    if not len(starts):
        return
    if depth < 8 and depth & (depth - 1):
        with pytest.raises(ValueError):
            deep_suffixes(words, starts, depth)
        return
    counts = Counter(tuple(words[s : s + depth]) for s in starts)
    assert sorted(deep_suffixes(words, starts, depth)) == [s for s in starts if counts[tuple(words[s : s + depth])] > 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=5))
def test_word_hashes(texts):
    hashes, counts = word_hashes(texts)
    words = [WORDS.findall(t) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(flat) == len(hashes) and len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=5), st.integers(3, 20), st.integers(1, 3))
def test_equal_windows_have_equal_anchors(texts, length, gram):
    symbols = np.array([s for t in texts for s in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.array([len(t) for t in texts])
    keys = {}
    seen = Counter()
    for text, start, size, key in zip(*windows.anchored_runs(symbols, counts, length, gram), strict=True):
        for s in range(start, start + size):
            seen[text, s] += 1
            assert keys.setdefault(tuple(texts[text][s : s + length]), key) == key
    assert seen == Counter((k, s) for k, t in enumerate(texts) for s in range(len(t) - length + 1))


@pytest.mark.parametrize("symbols", [ByteStrings(50), WordSequences(10)])
def test_a_passage_of_many_documents_is_in_no_large_group(monkeypatch, spark, symbols):
    monkeypatch.setattr(windows, "MAX_GROUP", 20)
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, f"{rng.random()} {rng.random()} {passage} {rng.random()} {rng.random()}") for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = windows._rows(df, "doc_id", "text")
    contents = windows.run_contents(texts, windows.repeated_runs(texts, symbols), symbols)
    routed, large = windows._routed(contents, symbols)
    assert max(r["count"] for r in routed.groupBy("route").count().collect()) <= 20
    marks = windows.counted_windows(large, symbols).collect()
    assert len({bytes(r.content) for r in marks}) > 20
    found = bytes_found(df, 50) if isinstance(symbols, ByteStrings) else words_found(df, 10)
    assert found == (bytes_expected(rows, 50) if isinstance(symbols, ByteStrings) else words_expected(rows, 10))


def test_one_entry_of_a_repeated_anchor_travels_by_key():
    rng = random.Random(1)
    entries = [(7, rng.randrange(2**64), k << 16 | 5) for k in range(1000)] + [(8, 1, 2 << 16 | 3), (9, 4, 1), (9, 4, 1)]
    rng.shuffle(entries)
    by_key, others = windows.combined(np.array(entries, np.uint64))
    assert by_key[:, 0].tolist() == [7, 8, 9] and (by_key[:, 2] >> np.uint64(63)).tolist() == [1, 0, 1]
    assert (others[:, 2] >> np.uint64(63)).all()
    back = {(k, row, place & (2**63 - 1)) for part in (by_key, others) for k, row, place in part.tolist()}
    assert back == set(entries) and len(by_key) + len(others) == 1002
    assert [len(part) for part in windows.combined(np.empty((0, 3), np.uint64))] == [0, 0]
