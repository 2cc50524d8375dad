from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlens.llm import piecewise as P

M64 = (1 << 64) - 1


def plain_fingerprint(data: bytes) -> str:
    """Byte by byte: roll, cut, hash each chunk, at two block sizes."""
    if not data:
        return "0::"
    values = [P._spread(b) for b in range(256)]
    rolled = []
    for i in range(len(data)):
        h = sum((values[data[i - k]] >> 32) * pow(0x2C1B3C6D, k, 1 << 32) for k in range(7) if i >= k) % (1 << 32)
        h ^= h >> 15
        h = h * 0x85EBCA6B % (1 << 32)
        rolled.append(h ^ h >> 13)

    def ends(level):
        mask = (1 << level) - 1
        return [i + 1 for i, h in enumerate(rolled) if level <= 32 and h & mask == mask]

    def signature(level):
        cuts = sorted({0, len(data), *ends(level)})
        out = ""
        for a, b in zip(cuts, cuts[1:]):
            h = 0
            for byte in reversed(data[a:b]):
                h = (h * P._FACTOR + values[byte]) & M64
            h = (h ^ h >> 29) * 0x9E3779B97F4A7C15 & M64
            out += "".join(chr(P._ALPHABET[x]) for x in (h >> 58, h >> 52 & 63))
        return out

    level = 0
    while len(data) > 64 << level:
        level += 1
    while len(ends(level)) > 256:
        level += 1
    return f"{level}:{signature(level)}:{signature(level + 1)}"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain_likeness(x, y):
    if x == y:
        return 1.0
    sides = [(int(f.split(":")[0]), f.split(":")[1:]) for f in (x, y)]
    cut = lambda s: [s[k : k + 2] for k in range(0, len(s), 2)]
    best = 0.0
    for i, a in enumerate(sides[0][1]):
        for j, b in enumerate(sides[1][1]):
            if sides[0][0] + i == sides[1][0] + j:
                a2, b2 = cut(a), cut(b)
                best = max(best, 1.0 - plain_distance(a2, b2) / max(1, len(a2), len(b2)))
    return best




@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 40), st.integers(0, 3))
def test_fingerprint_byte_by_byte(data, times, tail):
    text = data * times + data[:tail]
    assert P.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("stretch", [1 << 20, 64, 7])
def test_stretches_change_nothing(monkeypatch, stretch):
    rng = random.Random(4)
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in (1, 6, 7, 8, 63, 64, 65, 500, 5000)] + [b"A" * 3000, b"ab" * 900]
    want = [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(P, "STRETCH", stretch)
    assert [P.fingerprint(t) for t in texts] == want


def test_chunks_longer_than_the_power_table():
    text = b"A" * 200_000
    h = 0
    for byte in reversed(text):
        h = (h * P._FACTOR + P._spread(byte)) & M64
    assert P._chunk_hashes(np.frombuffer(text, np.uint8), np.array([0])).tolist() == [h]


def test_every_position_a_boundary(monkeypatch):
    """Beyond the top level no position closes a chunk, so the signature stays bounded."""
    monkeypatch.setattr(P, "_rolled", lambda data, a, b: np.full(b - a, 0xFFFFFFFF, np.uint32))
    level, first, second = P.fingerprint(b"x" * 10_000).split(":")
    assert int(level) == 33 and len(first) == len(second) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30)), max_size=20))
def test_distances(pairs):
    got = P.edit_distances([np.array(a, np.int32) for a, _ in pairs], [np.array(b, np.int32) for _, b in pairs], most=7)
    assert got.tolist() == [plain_distance(a, b) for a, b in pairs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=2, max_size=6))
def test_likeness_of_fingerprints(texts):
    prints = [P.fingerprint(t) for t in texts]
    got = P.likenesses(prints, prints[1:] + prints[:1]).tolist()
    assert got == [plain_likeness(a, b) for a, b in zip(prints, prints[1:] + prints[:1])]
    assert all(0 <= x <= 1 for x in got)


def test_small_edits_stay_alike():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(1500))
    other = " ".join(f"v{rng.randrange(900)}" for _ in range(1500))
    a = P.fingerprint(text.encode())
    assert P.likenesses([a], [P.fingerprint((text[:3000] + "inserted here" + text[3000:]).encode())])[0] > 0.9
    assert 0.3 < P.likenesses([a], [P.fingerprint(P.edited(text, other).encode())])[0] < 0.75
    assert P.likenesses([a], [P.fingerprint(other.encode())])[0] < 0.1


def expected(rows):
    """Result rows as a multiset; rows with one id must not hold different texts."""
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    texts = [t for _, _, t in order]
    out = Counter()
    for (known, i, text), following in zip(order, texts[1:] + texts[:1]):
        cut = len(text) // 2
        changed = text[: len(text) - cut] + following[:cut]
        own, new, after = (P.fingerprint(t.encode()) for t in (text, changed, following))
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out[i if known else None, len(text), sha, own, new, plain_likeness(own, new), plain_likeness(own, after)] += 1
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_experiment_equals_a_loop(spark, rows, parts):
    pairs = [(r[0], r[1]) for r in rows if not (r[0] is None and r[1] is None)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(parts)
    assert Counter(map(tuple, P.edit_experiment(df).collect())) == expected(pairs)


@pytest.mark.parametrize("pairs", [[], [(4, "one text")], [(None, None)], [(1, ""), (2, None)], [(7, "same text " * 9)] * 30, [(k, "x" * k) for k in range(3)]])
def test_few_and_equal_documents(spark, pairs):
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert Counter(map(tuple, P.edit_experiment(df).collect())) == expected(pairs)


def test_clashing_columns_and_documents_of_one_id(spark, clashing, rows):
    names = ("h", "tie", "part", "kind", "next_text", "next_part")
    df = clashing.select("*", *[F.lit("x").alias(n) for n in names if n not in clashing.columns])
    assert P.edit_experiment(df).count() == len(rows)
    got = sorted((r.doc_id or -1, r.n_chars, r.fingerprint) for r in P.fingerprint_documents(df).collect())
    assert got == sorted((r[0] or -1, len(r[1] or ""), P.fingerprint((r[1] or "").encode())) for r in rows)


def test_likeness_column(spark):
    texts = ["some text of a few words", "some text of a few more words", "", None]
    prints = [None if t is None else P.fingerprint(t.encode()) for t in texts]
    df = spark.createDataFrame([(a, b) for a in prints for b in prints], "a string, b string")
    for a, b, got in df.select("a", "b", P.likeness(F.col("a"), F.col("b"))).collect():
        assert got == (None if a is None or b is None else plain_likeness(a, b))


def test_registered_query(spark):
    from chainlens.llm.registry import op11_fingerprints

    sf = "/root/testdata/sf0.001"
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, op11_fingerprints(spark, sf).collect())) == expected(pairs)
