from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chainlens.llm import simhash
from chainlens.llm.components import connected_components
from chainlens.llm.simhash import leaves_of, link_leaf, linked_fingerprints, near_copy_components, one_of_each_component


def fingerprint(text, n=4):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(values, max_bits=4):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= max_bits:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def near_values(rng, n):
    """Fingerprints with dense groups, chains and strangers."""
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(n // 10):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([3, 30])):
            v = centre
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                v ^= 1 << b
            out.add(v)
        for _ in range(5):
            for b in rng.sample(range(64), 4):
                centre ^= 1 << b
            out.add(centre)
    return sorted(out)


def expected(rows):
    prints = [(r[0], fingerprint(r[1] or "")) for r in rows]
    root = classes(sorted({f for _, f in prints}))
    least = defaultdict(lambda: None)
    for i, f in prints:
        if i is not None:
            least[root[f]] = i if least[root[f]] is None else min(least[root[f]], i)
    return Counter((i, f, least[root[f]]) for i, f in prints)


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_components(request, rows, frame):
    got = near_copy_components(request.getfixturevalue(frame)).collect()
    assert Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got) == expected(rows)


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_one_row_of_each_component(request, rows, no_docs, frame):
    docs, want = request.getfixturevalue(frame), expected(rows)
    got = one_of_each_component(docs)
    assert got.columns == docs.columns
    have = got.collect()
    with_id = sorted({c for _, _, c in want if c is not None})
    assert sorted(r.doc_id for r in have if r.doc_id is not None) == with_id
    roots = classes(sorted({f for _, f, _ in want}))
    assert sum(r.doc_id is None for r in have) == len({roots[f] for _, f, c in want if c is None})
    assert one_of_each_component(no_docs).count() == near_copy_components(no_docs).count() == 0


@pytest.mark.parametrize("dense", [8, 2048])
def test_linking_a_leaf(monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    values = near_values(random.Random(dense), 300)
    got = link_leaf(np.array(values, np.uint64))
    assert [values[k] for k in got] == [classes(values)[v] for v in values]


def test_a_dense_ball_costs_no_pairs():
    centre = 0x123456789ABCDEF0
    ball = [centre] + [centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    assert set(link_leaf(np.array(ball * 1, np.uint64)).tolist()) == {0}


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4), st.integers(0, 12))
def test_near_pairs_share_a_leaf(value, flipped, depth):
    other = value
    for b in flipped:
        other ^= 1 << b
    row, leaf = leaves_of(np.array([value, other], np.uint64), depth)
    assert set(leaf[row == 0].tolist()) & set(leaf[row == 1].tolist())


def test_sharded_links_are_whole(monkeypatch, spark):
    monkeypatch.setattr(simhash, "LEAF", 16)
    values = near_values(random.Random(1), 400)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()
    have = {r.node % (1 << 64): r.component for r in got}
    root = classes(values)
    sizes = Counter(root.values())
    assert set(have) == {v for v in values if sizes[root[v]] > 1}
    names = defaultdict(set)
    for v, c in have.items():
        names[root[v]].add(c)
    assert all(len(n) == 1 for n in names.values()) and len({min(n) for n in names.values()}) == len(names)


@pytest.mark.parametrize("edges", [[], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)] + [(100, 101), (101, 100), (5, 5)]])
def test_connected_components(spark, edges):
    edges = edges + [(None, 1), (7, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    parent = {x: x for e in real for x in e}
    for _ in parent:
        for a, b in real:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
