from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from chainlens.llm.mixing import BUCKET_BITS, HASH_BITS, mix_documents, temperature


def place(doc_id, epoch, seed=0):
    key = f"{seed}:{epoch}:{'' if doc_id is None else doc_id}"
    return int(hashlib.md5(key.encode()).hexdigest()[: HASH_BITS // 4], 16)


def words(text):
    return len((text or "").encode().split())


def exponent_for(shares, limit, budget_share=None):
    """The smallest exponent at which no source has more than ``limit`` passes."""

    def most(a):
        if budget_share is None:
            return (max(shares) / min(shares)) ** (1 - a)
        return budget_share * min(shares) ** (a - 1) / sum(p**a for p in shares)

    low, high = 0.0, 1.0
    if most(0.0) <= limit:
        return 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if most(middle) <= limit else (middle, high)
    return high


def uses_expected(rows, limit, budget=None):
    """How often each row is taken, by (id, text, source)."""
    tokens = Counter()
    for i, t, _, s, _ in rows:
        tokens[s] += words(t)
    corpus = sum(tokens.values())
    shares = {s: n / corpus for s, n in tokens.items() if n}
    share = None if budget is None else min(budget, limit * corpus) / corpus
    a = exponent_for(list(shares.values()), limit, share)
    power = {s: p**a for s, p in shares.items()}
    passes = {s: (max(shares.values()) / p) ** (1 - a) for s, p in shares.items()}
    if budget is not None:
        budget = min(budget, limit * corpus)
        passes = {s: budget * power[s] / sum(power.values()) / tokens[s] for s in shares}
    passes = {s: round(p) if abs(p - round(p)) < 1e-6 else p for s, p in passes.items()}
    out = Counter()
    for s in {r[3] for r in rows}:
        whole = int(passes.get(s, 1.0))
        quota = (passes.get(s, 1.0) - whole) * tokens[s]
        own = sorted((r for r in rows if r[3] == s), key=lambda r: place(r[0], whole))
        by_place = defaultdict(list)
        for r in own:
            by_place[place(r[0], whole)].append(r)
        total, open_ = 0, quota > 0
        for p in sorted(by_place):
            total += sum(words(r[1]) for r in by_place[p])
            open_ = open_ and total <= quota
            for r in by_place[p]:
                out[r[0], r[1], s] += whole + open_
    return +out


@pytest.mark.parametrize("frame", ["docs", "clashing"])
@pytest.mark.parametrize(("limit", "budget"), [(1.5, None), (1.05, None), (4.0, 5000), (3.0, 1500)])
def test_uses(request, rows, frame, limit, budget):
    df = request.getfixturevalue(frame)
    got = mix_documents(df, max_repetition=limit, budget_tokens=budget)
    assert got.columns[-3:] == ["epoch", "mix_block", "mix_order"] and len(set(got.columns)) == len(got.columns)
    have = got.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in have) == uses_expected(rows, limit, budget)
    for r in have:
        assert r.mix_order == place(r.doc_id, r.epoch) and 0 <= r.mix_block < 64


def test_every_document_is_used_without_a_budget(docs, rows):
    have = {(r.doc_id, r.text) for r in mix_documents(docs).collect()}
    assert have == {(r[0], r[1]) for r in rows}


def test_targets(spark):
    counts = {"a": 700, "b": 200, "c": 90, "d": 10, None: 0}
    totals = spark.createDataFrame(list(counts.items()), "source string, tokens long")
    target = 1.2
    mix = temperature(totals, target_entropy=target)
    weights = {r.source: r.weight for r in mix.sources.collect()}
    assert weights[None] == 0 and abs(sum(weights.values()) - 1) < 1e-9
    entropy = -sum(w * math.log(w) for w in weights.values() if w)
    assert abs(entropy - target) < 1e-6 and abs(mix.entropy - entropy) < 1e-6
    assert temperature(totals, target_entropy=0.1).exponent == 1.0
    assert temperature(totals, target_entropy=9.0).exponent == 0.0
    limited = temperature(totals, max_repetition=2.0)
    assert max(r.passes for r in limited.sources.collect()) <= 2.0 + 1e-6 and 0 < limited.exponent < 1
    assert temperature(totals, max_repetition=1000.0).exponent == 0.0


def test_one_source_and_none(spark, no_docs):
    one = spark.createDataFrame([(k, "some words here", "en", "s", 1) for k in range(9)], no_docs.schema)
    assert mix_documents(one).count() == 9
    assert mix_documents(no_docs).count() == 0


def test_no_python_in_the_plan(docs):
    plan = mix_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and BUCKET_BITS < HASH_BITS
