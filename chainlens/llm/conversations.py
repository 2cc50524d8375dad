"""Conversation structure repair by a square-root checkpointed dynamic program (operator 13).

A conversation's turns, in order, are edited until their role initials read
``(s?(ua)+)?``.  Keep costs 0, Rerole 1, Delete 2, Insert (an empty turn) 5;
a truncated turn that stays costs 5 more; blank and repeated turns must go.
Which role a Rerole or an Insert gives follows from the turns before it, so a
string of the letters D, I, K and R is a whole repair.  Of the cheapest
repairs the ASCII-least is taken: from the front, the first letter that is
tight (its cost and the least cost of what is left add up to the optimum).

The program runs backward over vectors of four costs, one for each state (no
turn yet, after s, after u, after a).  Within a block of rows only every
square-root-th vector is stored; the walk forward computes the others again,
a stretch at a time.

A conversation may hold a third of all rows, so nothing gathers one:

* turns are range-partitioned and sorted by conversation and turn, and cut
  into blocks of at most ``BLOCK`` rows; a *piece* is what a block holds of a
  conversation;
* each piece gives the least costs from each state before it to each state
  behind it; going backward over a conversation's pieces, these give the
  cost vector behind every piece (the outer checkpoints);
* each piece is then walked forward from each of the four states; going
  forward over the pieces tells which of the four walks is the repair.

Only the two passes over pieces run along a conversation; they carry one
vector or one state from piece to piece and hold no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm.common import shuffle_partitions, staged

#: Rows of a block, as a power of two; bounds what a task holds, not the result.
BLOCK_BITS = 12
#: Larger than any cost.
FAR = 1 << 50

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind an inserted or reroled turn.
_GIVEN = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The cost vector behind a conversation's last turn: what inserts still cost.
END = (0, 10, 5, 0)

# code of a turn: 8 if it must go, else its kind (s, u, a, other) and 4 if truncated
_KINDS = "sua"


def _step(code: int, after: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """Least costs before a turn and its inserts from those behind it."""
    s0, ss, su, sa = after
    s0, ss, su, sa, to_u, to_a = s0 + 2, ss + 2, su + 2, sa + 2, su, sa
    if code < 8:
        stays, kind = (5, code - 4) if code >= 4 else (0, code)
        u = to_u + stays + (kind != 1)
        a = to_a + stays + (kind != 2)
        if kind == 0:
            s0 = min(s0, after[1] + stays)
        s0, ss, su, sa = min(s0, u), min(ss, u), min(su, a), min(sa, u)
    su, sa = min(su, sa + 5), min(sa, su + 5)
    return min(s0, su + 5), min(ss, su + 5), su, sa


def backward(codes: bytes, after: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    for code in reversed(codes):
        after = _step(code, after)
    return after


def _letters(code: int, state: int, here: tuple, after: tuple) -> Iterator[tuple[str, int]]:
    """The tight letters of one turn from ``state``: its inserts, then what becomes of it."""
    while True:
        least = here[state]
        if after[state] + 2 == least:
            yield "D", state
            return
        given = _GIVEN[state]
        if here[given] + 5 == least:
            yield "I", given
            state = given
            continue
        stays, kind = (5, code - 4) if code >= 4 else (0, code)
        if kind == 0 and state == START and after[SYSTEM] + stays == least:
            yield "K", SYSTEM
        elif kind == given - 1 and after[given] + stays == least:
            yield "K", given
        else:
            yield "R", given
        return


def walk(codes: bytes, after: tuple[int, int, int, int], state: int) -> tuple[str, int]:
    """The letters of the ASCII-least cheapest edits of ``codes``, and the state behind them."""
    n = len(codes)
    step = max(1, isqrt(n))
    checkpoints = {n: after}
    vector = after
    for k in range(n - 1, -1, -1):
        vector = _step(codes[k], vector)
        if k % step == 0:
            checkpoints[k] = vector
    out = []
    for low in range(0, n, step):
        high = min(n, low + step)
        vectors = [checkpoints[high]]
        for k in range(high - 1, low - 1, -1):
            vectors.append(_step(codes[k], vectors[-1]))
        vectors.reverse()
        for k in range(low, high):
            for letter, state in _letters(codes[k], state, vectors[k - low], vectors[k - low + 1]):
                out.append(letter)
    return "".join(out), state


def ending(state: int) -> str:
    """The inserts behind the last turn."""
    return "I" * (END[state] // 5)


# ---- streams over sorted rows ----


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """``(key, rows)`` of rows that follow each other with the same first ``keys`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _stream(df: DataFrame, run, schema: dict[str, str]) -> DataFrame:
    """``run`` over the rows of each partition; ``schema`` maps column names to Spark types."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    text = ", ".join(f"`{n}` {t}" for n, t in schema.items())
    arrow = to_arrow_schema(StructType.fromDDL(text))
    return df.mapInArrow(lambda batches: _batched(run(batches), arrow), text)


def ordered_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, turn, role, text, at, block``: all turns in order, staged.

    ``at`` ascends with (conversation, turn, role, text), nulls first, over
    the whole table; its upper bits name the block.
    """
    spark = turns.sparkSession
    named = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    # equal rows are alike, so a tie may be cut anywhere: a very common row spreads over partitions
    dealt = named.withColumn("tie", F.monotonically_increasing_id())
    placed = dealt.repartitionByRange(shuffle_partitions(spark), *order[:3], F.xxhash64("text"), "tie").drop("tie")
    # within a partition's range, rows of one (conversation, turn, role) keep the order of the ranges: by hash first
    placed = placed.sortWithinPartitions(*order[:3], F.xxhash64("text"), "text")
    at = F.monotonically_increasing_id()
    return staged(placed.withColumn("at", at).withColumn("block", F.shiftright("at", BLOCK_BITS)), "turns")


def turn_codes(ordered: DataFrame) -> DataFrame:
    """``block, at, conv_id, turn, initial, fault``: what the program needs of each turn.

    ``fault`` is the first that holds: ``b`` blank, ``d`` the role and text
    were seen before in the conversation, ``t`` truncated, else empty.
    """
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    facts = ordered.select(
        "block",
        "at",
        "conv_id",
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        (body == "").alias("blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")).alias("content"),
    )
    facts = staged(facts, "turn_facts")
    # tasks combine a text that is repeated very often before it travels; each first place is a row of its own
    firsts = facts.groupBy("conv_id", "content").agg(F.min("at").alias("first_at"))
    seen = facts.join(firsts.select("first_at"), facts["at"] == F.col("first_at"), "left")
    fault = F.when(F.col("blank"), "b").when(F.col("first_at").isNull(), "d").when(F.col("cut"), "t").otherwise("")
    return staged(seen.select("block", "at", "conv_id", "turn", "initial", fault.alias("fault")), "turn_codes")


def _codes(rows: list[tuple]) -> bytes:
    """``rows`` end with (initial, fault)."""
    return bytes(8 if f in ("b", "d") else (_KINDS.find(i) if i and i in _KINDS else 3) + 4 * (f == "t") for *_, i, f in rows)


def repair_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``(conversations, repaired)`` of all turns.

    ``conversations``: ``conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit``, a row per conversation that has turns.  ``repaired``:
    ``conv_id, at, sub, role, text``, the turns that stay or were inserted;
    a conversation's order is (``at``, ``sub``).

    Turns are ordered by turn, nulls first; turns of one number by role, then
    by a hash of the text and the text.  A null role or text is one space, so
    the former is no known role and the latter is blank; null ids form one
    conversation.  Gaps leave out null turn numbers.  An empty table gives no
    rows; other columns are not looked at.
    """
    spark = turns.sparkSession
    parts = shuffle_partitions(spark)
    ordered = ordered_turns(turns, id_col, turn_col, role_col, text_col)
    id_type, turn_type = (ordered.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    codes = turn_codes(ordered)
    by_block = codes.select("block", "conv_id", "at", "turn", "initial", "fault")

    def pieces(batches):
        for (block, conv), rows in _runs(batches, 2):
            encoded = _codes(rows)
            numbers = [r[1] for r in rows if r[1] is not None]
            pairs = zip(rows, rows[1:])
            faults = [r[3] for r in rows]
            yield (
                conv,
                block,
                [c for state in range(4) for c in backward(encoded, tuple(0 if state == s else FAR for s in range(4)))],
                [faults.count(f) for f in "bdt"],
                sum((a[2] or "") + (b[2] or "") not in ("su", "ua", "au") for a, b in pairs),
                rows[0][2],
                rows[-1][2],
                numbers[0] if numbers else None,
                numbers[-1] if numbers else None,
                sum(a != b for a, b in zip(numbers, numbers[1:])) + 1 if numbers else 0,
            )

    piece_schema = {
        "conv_id": id_type, "block": "bigint", "costs": "array<bigint>", "faults": "array<bigint>", "illegal": "bigint",
        "first_initial": "string", "last_initial": "string", "first_turn": turn_type, "last_turn": turn_type, "turns": "bigint",
    }
    found = staged(
        _stream(by_block.repartition(parts, "block").sortWithinPartitions("block", "conv_id", "at"), pieces, piece_schema), "pieces"
    )

    def checkpoints(batches):
        """Backward over each conversation's pieces: the vector behind each; the last row of a conversation is its first piece."""
        conv = state = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here, block, costs, faults, illegal, first_i, last_i, first_t, last_t, n = row
                if state is None or here != conv:
                    if state is not None:
                        yield _total(conv, state)
                    conv, state = here, (END, [0, 0, 0], 0, None, None, None, 0, True)
                after, counts, wrong, next_i, low, high, distinct, last = state
                yield (conv, block, list(after), last, None, None, None, None)
                if not last:
                    wrong += (last_i or "") + (next_i or "") not in ("su", "ua", "au")
                distinct += n - (last_t is not None and last_t == low)
                state = (
                    tuple(min(costs[4 * to + s] + after[to] for to in range(4)) for s in range(4)),
                    [a + b for a, b in zip(counts, faults, strict=True)],
                    wrong + illegal,
                    first_i,
                    first_t if first_t is not None else low,
                    high if high is not None else last_t,
                    distinct,
                    False,
                )
        if state is not None:
            yield _total(conv, state)

    def _total(conv, state):
        after, counts, wrong, _, low, high, distinct, _ = state
        return (conv, None, None, None, 0 if low is None else high - low + 1 - distinct, counts, wrong, after[START])

    check_schema = {
        "conv_id": id_type, "block": "bigint", "after": "array<bigint>", "last": "boolean",
        "gaps": "bigint", "faults": "array<bigint>", "illegal": "bigint", "cost": "bigint",
    }
    checked = staged(
        _stream(
            found.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("block").desc()), checkpoints, check_schema
        ),
        "piece_vectors",
    )
    vectors = checked.where("block IS NOT NULL")

    def walks(batches):
        for (block, conv), rows in _runs(batches, 2):
            _, _, _, _, after, last = rows[0]
            encoded = _codes([r[:4] for r in rows[1:]])
            paths = [walk(encoded, tuple(after), s) for s in range(4)]
            yield conv, block, [p + (ending(s) if last else "") for p, s in paths], [s for _, s in paths]

    headers = vectors.select(
        "block", "conv_id", F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast(turn_type).alias("turn"),
        F.lit(None).cast("string").alias("initial"), F.lit(None).cast("string").alias("fault"), "after", "last",
    )
    rows = by_block.select("*", F.lit(None).cast("array<bigint>").alias("after"), F.lit(None).cast("boolean").alias("last"))
    walked = staged(
        _stream(
            rows.unionByName(headers).repartition(parts, "block").sortWithinPartitions("block", "conv_id", "at"),
            walks,
            {"conv_id": id_type, "block": "bigint", "paths": "array<string>", "states": "array<int>"},
        ),
        "piece_walks",
    )

    def chosen(batches):
        conv, state, begun = None, START, False
        for batch in batches:
            for here, block, paths, states in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or here != conv:
                    conv, state, begun = here, START, True
                yield conv, block, state, paths[state]
                state = states[state]

    edits = staged(
        _stream(
            walked.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block"),
            chosen,
            {"conv_id": id_type, "block": "bigint", "state": "int", "edits": "string"},
        ),
        "piece_edits",
    )
    # the audit of a conversation is one string, whatever its length
    in_order = F.array_sort(F.collect_list(F.struct("block", "edits")))
    audits = edits.groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda p: p["edits"]), "").alias("audit"))
    totals = checked.where("block IS NULL")
    conversations = totals.join(audits, totals["conv_id"].eqNullSafe(audits["conv_id"])).select(
        totals["conv_id"],
        "gaps",
        F.col("faults")[0].alias("blank"),
        F.col("faults")[1].alias("duplicate"),
        F.col("faults")[2].alias("truncated"),
        "illegal",
        "cost",
        "audit",
    )
    return conversations, _repaired(ordered, edits, parts)


def _repaired(ordered: DataFrame, edits: DataFrame, parts: int) -> DataFrame:
    id_type = ordered.schema["conv_id"].dataType.simpleString()

    def apply(batches):
        path, used, body, state = "", 0, 0, START
        for batch in batches:
            for _, conv, at, role, text, begin, edits_here in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if edits_here is not None:
                    path, used, body, state = edits_here, 0, len(edits_here.rstrip("I")), begin
                    continue
                sub = 0
                while True:
                    letter = path[used]
                    used += 1
                    if letter == "D":
                        break
                    given = _GIVEN[state]
                    if letter == "I":
                        state = given
                        yield conv, at, sub, _ROLE[given], ""
                        sub += 1
                        continue
                    if letter == "R":
                        state, role = given, _ROLE[given]
                    else:
                        state = SYSTEM if role[:1] == "s" else given
                    yield conv, at, sub, role, text
                    sub += 1
                    break
                if used == body:  # the last turn: what follows are inserts
                    for used in range(body + 1, len(path) + 1):
                        state = _GIVEN[state]
                        yield conv, at, sub, _ROLE[state], ""
                        sub += 1

    header = edits.select(
        "block", "conv_id", F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), "state", F.col("edits").alias("path"),
    )
    rows = ordered.select(
        "block", "conv_id", "at", "role", "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("path")
    )
    return _stream(
        rows.unionByName(header).repartition(parts, "block").sortWithinPartitions("block", "conv_id", "at"),
        apply,
        {"conv_id": id_type, "at": "bigint", "sub": "int", "role": "string", "text": "string"},
    )


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``role:text`` lines.

    A digest is sequential: a conversation's lines pass through one task, which
    sorts them by spilling and holds the digest's state alone.
    """
    import hashlib

    parts = shuffle_partitions(repaired.sparkSession)

    def digest(batches):
        conv, sha = None, None
        for batch in batches:
            for here, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sha is None or here != conv:
                    if sha is not None:
                        yield conv, sha.hexdigest()
                    conv, sha = here, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    sha.update(f"\n{role}:{text}".encode())
        if sha is not None:
            yield conv, sha.hexdigest()

    dealt = repaired.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "at", "sub").select("conv_id", "role", "text")
    return _stream(dealt, digest, {"conv_id": repaired.schema["conv_id"].dataType.simpleString(), "repaired_sha256": "string"})


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role ``user``.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text = F.coalesce(F.col("text"), F.lit(" "))
    kept = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("hit")
    ).where("hit <> 0")
    hit = F.col("hit")
    changed = F.when(hit == 1, "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1))).alias("copy")
    return kept.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies).drop("copy")
