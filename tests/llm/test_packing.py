from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainlens.llm.packing import CapacityTree, best_fit_decreasing, pack_documents
from chainlens.llm.tokenize import PieceEncoder, default_vocabulary


def encoded(text):
    from tokenizers import Tokenizer

    if not hasattr(encoded, "tokenizer"):
        encoded.tokenizer = Tokenizer.from_file(default_vocabulary())
    return encoded.tokenizer.encode(text, add_special_tokens=False).ids


def greedy_fills(lengths, window):
    """Best-fit decreasing, piece by piece."""
    room = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in room if r >= n]
        if fitting:
            room.remove(min(fitting))
            room.append(min(fitting) - n)
        else:
            room.append(window - n)
    return Counter(room)


def check_packed(got, rows, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    want = Counter((i, tuple(encoded(t or "") + [0])) for i, t in ((r[0], r[1]) for r in rows))
    have = Counter()
    for (doc_id, n), pieces in by_doc.items():
        # documents of one id and size are told apart by taking the pieces of each start in turn
        starts = defaultdict(list)
        for r in pieces:
            starts[r.start].append(tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()))
        assert sorted(starts) == list(range(0, n, window))
        for k in range(len(starts[0])):
            have[doc_id, sum((sorted(starts[s])[k] for s in sorted(starts)), ())] += 1
    assert have == want


@pytest.mark.parametrize("window", [64, 1024])
def test_every_id_is_packed_once(docs, rows, window):
    got = pack_documents(docs, window).collect()
    check_packed(got, rows, window)
    lengths = [n for i, t, *_ in rows for full, rest in [divmod(len(encoded(t or "")) + 1, window)] for n in [window] * full + [rest] * (rest > 0)]
    fills = Counter(window - sum(r.length for r in got if r.sequence_id == s) for s in {r.sequence_id for r in got})
    assert fills == greedy_fills(lengths, window)


def test_empty_table_and_clashing_columns(no_docs, clashing, rows):
    assert pack_documents(no_docs).count() == 0
    check_packed(pack_documents(clashing).collect(), rows, 1024)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    window = 24
    plan = sorted(best_fit_decreasing(Counter(lengths), window))
    used = defaultdict(list)
    for length, n in Counter(lengths).items():
        own = [p for p in plan if p[0] == length]
        assert own[0][1] == 0
        for rank in range(n):
            _, first_rank, first_window, offset = [p for p in own if p[1] <= rank][-1]
            used[first_window + rank - first_rank].append((offset, length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    assert Counter(window - sum(n for _, n in p) for p in used.values()) == greedy_fills(lengths, window)
    assert sorted(used) == list(range(len(used)))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 40)), st.integers(0, 40))
def test_capacity_tree(held, least):
    tree = CapacityTree(40)
    for c in range(41):
        tree.set(c, True)
    for c in set(range(41)) - held:
        tree.set(c, False)
    assert tree.tightest(least) == min((c for c in held if c >= least), default=None)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t ab'.,1é日\x85", max_size=30), max_size=6))
def test_pieces_give_the_library_s_ids(texts):
    if not hasattr(test_pieces_give_the_library_s_ids, "encoder"):
        test_pieces_give_the_library_s_ids.encoder = PieceEncoder(default_vocabulary(), memory_bytes=10_000)
    ids, offsets = test_pieces_give_the_library_s_ids.encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [encoded(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.text(alphabet=" \n\r\t\x0b\x1c\x85\xa0\u2003\u200b\u2028\u3000\u180eabsS'.,;<|1é×÷ÿɏɐΩ日“”\u0301", max_size=30), max_size=6),
    st.booleans(),
)
def test_cuts_at_any_neighbours_give_the_library_s_ids(texts, large):
    if not hasattr(test_cuts_at_any_neighbours_give_the_library_s_ids, "encoder"):
        test_cuts_at_any_neighbours_give_the_library_s_ids.encoder = PieceEncoder(default_vocabulary(), memory_bytes=10_000)
    column = pa.array(["before\n", *texts, "behind"], pa.large_string() if large else pa.string()).slice(1, len(texts))
    ids, offsets = test_cuts_at_any_neighbours_give_the_library_s_ids.encoder.encode(column)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [encoded(t) for t in texts]


def test_a_word_is_learned_once_whatever_follows_it():
    encoder = PieceEncoder(default_vocabulary())
    text = "A wordly, a wordly. A wordly\na wordly; é wordly's wordly"
    ids, _ = encoder.encode([text])
    assert ids.tolist() == encoded(text)
    assert [p for p in encoder.index if "wordly" in p] == [" wordly"]


def test_special_tokens_have_the_ids_of_a_plain_encode(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_vocabulary())
    text = "before <|endoftext|> after<|endoftext|>"
    ids = plain.encode(text, add_special_tokens=False).ids
    assert ids.count(50256) == 2
    got = pack_documents(spark.createDataFrame([(1, text), (2, "no such token")], "doc_id long, text string")).collect()
    assert [np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got if r.doc_id == 1] == [[*ids, 0]]


def test_memory_of_pieces_is_bounded_in_bytes():
    """Many distinct words: the encoder keeps no more than its bytes allow, and its ids stay the library's."""
    import random

    rng = random.Random(1)
    encoder = PieceEncoder(default_vocabulary(), memory_bytes=200_000)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(7)) for _ in range(100)) for _ in range(20)]
        before = len(encoder.index)
        ids, offsets = encoder.encode(texts)
        assert before <= encoder.memory_pieces + 2 * 2000
        assert ids[offsets[3] : offsets[4]].tolist() == encoded(texts[3])
