"""Removal of repeated word sequences by prefix-partitioned suffix trees (operator 9).

:mod:`chainlens.llm.windows` splits the suffixes that may have a deep common
prefix into groups by a common part of variable length, and groups into
memory-sized portions.  A task builds its portion's suffix tree top-down and
write-only (after Giegerich, Kurtz and Stoye, 2003): a node's suffixes are told
apart by the next ``EDGE`` words, a child with a single suffix is a leaf and
left alone, and only nodes with several suffixes are opened further.  Nodes as
deep as a window that still hold two or more suffixes are the repeats.

Words are compared by dense names, exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chainlens.llm.windows import mixed, repeated_spans

LENGTH = 35
GRAM = 6
#: Words that tell a node's children apart; a power of two.
EDGE = 8

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (_BASE, inverse)]
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(white, prepend=True))
    begin, end = edge[::2], edge[1::2]
    powers, inverse = _powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])])
    hashes = mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * _BASE)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(begin, bounds), prepend=0)


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense names of pairs of names."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


def _opened(node: np.ndarray) -> np.ndarray:
    """Which suffixes are in a node with others."""
    return np.bincount(node)[node] > 1 if len(node) else np.zeros(0, bool)


def deep_suffixes(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Of suffixes that have ``depth`` words: those below a node of that depth with two or more."""
    edges, done = words, 1
    while done < min(EDGE, depth):
        edges = _named(edges[: len(edges) - done], edges[done:])
        done *= 2
    if done > depth:
        raise ValueError("a window must have at least an edge's words")
    alive, node, reached = starts, edges[starts], done
    while True:
        several = _opened(node)
        alive, node = alive[several], node[several]
        if reached >= depth or not len(alive):
            return alive
        # the last edge may overlap the one before it
        reached = min(reached + done, depth)
        node = _named(node, edges[alive + reached - done])


class WordSequences:
    """Words as symbols, repeats found by suffix trees."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes(texts)

    def cutter(self, text: bytes) -> Callable[[int, int], bytes]:
        words = text.split()
        return lambda a, b: b" ".join(words[a:b])

    def mark(self, contents: list[bytes]) -> list[np.ndarray]:
        names: dict[bytes, int] = {}
        parts = [[names.setdefault(w, len(names)) for w in content.split()] for content in contents]
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        words = np.fromiter((w for p in parts for w in p), np.int64, int(sizes.sum()))
        flags = np.zeros(len(words), bool)
        starts = np.flatnonzero(np.repeat(ends, sizes) - np.arange(len(words)) >= self.length)
        if len(starts):
            flags[deep_suffixes(words, starts, self.length)] = True
        return [flags[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def remove_repeated_words(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``n_words, n_removed, kept_text``: the kept words, joined by single spaces.

    A word goes if a window of ``length`` words that covers it also starts
    anywhere else, in the input as it was; windows stay within a document.  A
    null text has no words, and shorter texts lose nothing; rows of equal id
    and text are two places like any others; an empty table gives no rows.
    Columns of the input that have the new names are replaced.
    """
    symbols = WordSequences(length)
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    marked = repeated_spans(docs.select(*columns), symbols, id_col, text_col)
    at, spans_at = columns.index(text_col), len(columns)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for text, found in zip(batch.column(at), batch.column(spans_at).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                edges = [0, *(x for s in found or () for x in (s["start"], s["end"])), len(words)]
                n.append(len(words))
                removed.append(sum(s["end"] - s["start"] for s in found or ()))
                words = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=[*columns, "n_words", "n_removed", "kept_text"],
            )

    added = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()),
    ]
    return marked.mapInArrow(remove, T.StructType([*docs.select(*columns).schema, *added]))
