from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainlens.llm import conversations as C

WHITE = " \t\n\x0b\x0c\r"
TYPES = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """(cost, audit, repaired lines) by searching all repairs, cheapest and then ASCII-least first; turns are (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        tail = roles[-1:] if roles else "-"
        if (i, tail) in seen:
            continue
        seen.add((i, tail))
        if i == len(turns) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, lines

        def legal(r):
            return re.fullmatch(r"s?(ua)*u?", roles + r) is not None

        for r, name in (("u", "user"), ("a", "assistant")):
            if legal(r):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + r, (*lines, f"{name}:")))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, lines))
            if fault not in ("b", "d"):
                extra = 5 * (fault == "t")
                if role and legal(role[0]):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if legal(r):
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, roles + r, (*lines, f"{name}:{text}")))


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        body = text.rstrip(WHITE)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        hit = zlib.crc32(key.encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            yield from [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)


def expected(rows):
    """The contract's row of every conversation of damaged ``rows``."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, turns in by_conv.items():
        turns.sort()
        numbers = [t for known, t, *_ in turns if known]
        plain = [t[2:] for t in turns]
        found = faults(plain)
        cost, audit, lines = cheapest([(*t, f) for t, f in zip(plain, found)])
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(found.count(f) for f in "bdt"),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


ROWS = (
    [(c, t, ("system", "user", "assistant", "tool", "user", "assistant")[(c + t) % 6], f"text {c * t % 5}{'.?! x'[(c * 7 + t) % 5]}") for c in range(60) for t in range(c % 9)]
    + [(100, t, r, x) for t, r, x in [(0, "user", "a."), (None, "system", "b."), (None, None, "c."), (7, "assistant", None), (7, "", ""), (3, "User", " \t\n")]]
    + [(None, t, "user" if t % 2 else "assistant", "same.") for t in (1, 2, 2, 9)]
    + [(200, t, ("user", "assistant")[t % 2], f"{t}{'.' if t % 3 else ''}") for t in range(300)]
    + [(300, 1, "user", "again.")] * 40
    + [(400, 1, "assistant", "é" * 3000 + "."), (400, 2, "user", "日本語!\x85")]
)


def repaired(spark, rows, columns=TYPES, extra=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, columns).repartition(3)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    conversations, turns = C.repair_conversations(df)
    digests = {r.conv_id: r.repaired_sha256 for r in C.repaired_digests(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*tuple(r)[1:], digests.get(r.conv_id, empty)) for r in conversations.collect()}


@pytest.mark.parametrize("bits", [12, 4])
def test_repairs_equal_an_exhaustive_search(spark, monkeypatch, bits):
    """Blocks of 16 rows cut conversations into many pieces."""
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ROWS]
    assert repaired(spark, ROWS) == expected(rows)


def test_registered_query(spark, tmp_path):
    """Damage, every original conversation, nulls and conversations that lose all turns."""
    from chainlens.llm.registry import op13_conversations

    rows = ROWS + [(1000 + c, 0, "user", "one turn.") for c in range(60)]
    spark.createDataFrame(rows, TYPES).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in op13_conversations(spark, str(tmp_path)).collect()}
    want = expected(damage(rows))
    gone = {r[0] for r in rows} - set(want)
    assert gone
    want |= {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone}
    assert got == want


def test_empty_table_and_clashing_columns(spark):
    assert repaired(spark, [], TYPES) == {}
    rows = ROWS[:40]
    assert repaired(spark, rows, extra=["at", "block", "sub", "audit", "cost", "after", "fault", "tie"]) == expected(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=10), st.integers(0, 10))
def test_program_is_cheapest_and_ascii_least(codes, cut):
    """One block, and two blocks joined through their costs from state to state."""
    turns = [("suax"[c % 4] if c < 8 else "x", "", "d" if c == 8 else "t" if c >= 4 else "") for c in codes]
    cost, audit, _ = cheapest(turns)
    coded = bytes(codes)
    assert C.backward(coded, C.END)[C.START] == cost
    path, state = C.walk(coded, C.END, C.START)
    assert path + C.ending(state) == audit
    head, tail = coded[:cut], coded[cut:]
    after = C.backward(tail, C.END)
    unit = [C.backward(head, tuple(0 if s == to else C.FAR for s in range(4))) for to in range(4)]
    assert min(unit[to][C.START] + after[to] for to in range(4)) == cost
    first, middle = C.walk(head, after, C.START)
    second, state = C.walk(tail, C.END, middle)
    assert first + second + C.ending(state) == audit
