from __future__ import annotations

import re
from collections import Counter

import pytest

from chainlens.llm.quality import POLICIES, RULES, ablations, apply_policy, policy_mask, rule_ledger

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    words = WORDS.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    counts, cover, seen, dup = Counter(windows), set(), set(), 0
    for k, w in enumerate(windows):
        if counts[w] > 1:
            cover.update(range(k, k + 8))
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover))


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_measurements(request, rows, frame):
    got = rule_ledger(request.getfixturevalue(frame)).collect()
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == Counter((i, *measured(t or "")) for i, t, *_ in rows)


def test_bits_policies_and_ablations(spark, docs, no_docs):
    ledger = rule_ledger(docs)
    rows = apply_policy(ledger).collect()
    for r in rows:
        assert bool(r.failures & policy_mask("base")) == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.failures == 0)
    for rule, bit in zip(RULES, (1 << k for k in range(len(RULES)))):
        got = {r.rule: r for r in ablations(ledger, "v1").collect()}[rule]
        assert got.n_failed == sum(bool(r.failures & bit) for r in rows)
        assert got.n_only == sum(r.failures == bit for r in rows)
    assert {r.rule for r in ablations(ledger, "base").collect()} == set(POLICIES["base"])
    assert rule_ledger(no_docs).count() == 0


def test_each_rule_can_fail(spark):
    cases = {
        "few_words": "a few words",
        "repeated_words": "one two three four five six seven eight nine ten " * 4,
        "short_words": " ".join("a b c d e f g h i j k l m n o p q r s t u v w x y z".split()),
        "long_words": " ".join(f"{'long' * 5}{k}" for k in range(30)),
        "symbols": " ".join(f"word{k} #" for k in range(30)),
        "duplicate_lines": "\n".join(["line of text"] * 10 + [f"other line {k}" for k in range(6)]),
        "exclamations": " ".join(f"word{k}!" for k in range(30)),
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases.values())], "doc_id long, text string")
    got = {r.doc_id: r.failures for r in rule_ledger(df).collect()}
    for k, rule in enumerate(cases):
        assert got[k] >> list(RULES).index(rule) & 1, rule
