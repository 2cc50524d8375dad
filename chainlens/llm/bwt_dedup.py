"""Removal of repeated byte strings by merged Burrows-Wheeler transforms (operator 6).

:mod:`chainlens.llm.windows` brings together the contents whose 200-byte
strings may be equal.  A task cuts them into shards and sorts each shard's
suffixes once, over an alphabet of ``STEP``-byte blocks (dense names of their
hashes), to the depth of a whole string.

Two shards are merged without sorting their suffixes again (after Holt and
McMillan, 2014).  For every suffix of one shard the interleave holds how many
suffixes of the other are smaller, and how many are not larger, at first by one
block only.  A refinement puts one block in front: the bounds of ``block +
rest`` follow from the bounds of ``rest`` through the other shard's transform,
so round *h* interleaves suffixes by their first *h* blocks.  After ``DEPTH`` rounds two bounds that differ enclose an interval
of suffixes with a common prefix of a whole string: a repeat.  The final bounds
interleave the shards' orders into the merged one, which the next merge uses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chainlens.llm.windows import gram_hashes, mixed, repeated_spans

LENGTH = 200
GRAM = 32
#: Blocks of a string: their number and the bytes of a shard.
DEPTH = 5
SHARD_BYTES = 3 << 18


class Shard:
    """Suffixes (places with a whole block), sorted by their first ``DEPTH`` blocks; ``repeat`` flags whole strings met twice.

    ``names`` has the name of the block from each place on, ``left`` the bytes
    from there to the end of its content.
    """

    def __init__(self, places: np.ndarray, step: int, names: np.ndarray, left: np.ndarray, repeat: np.ndarray):
        self.places, self.step, self.names, self.left, self.repeat = places, step, names, left, repeat
        self.n = len(places)
        # rank of the suffix one block further on, or -1 where there is none
        rank = np.full(len(names) + step, -1, np.int64)
        rank[places] = np.arange(self.n)
        self.rest = np.where(left[places] >= 2 * step, rank[places + step], -1)

    @staticmethod
    def sorted(places: np.ndarray, step: int, names: np.ndarray, left: np.ndarray) -> Shard:
        held = np.zeros(len(names) + step * DEPTH, bool)
        held[places] = True
        ahead = np.append(names, np.full(step * DEPTH, -1, names.dtype))
        # a suffix ends where the next block is not held
        on, keys = np.ones(len(places), bool), []
        for k in range(DEPTH):
            on &= held[places + step * k] & (left[places] >= step * (k + 1))
            keys.append(np.where(on, ahead[places + step * k], -1) + 1)
        # two names a sort key
        pairs = [(keys[k] << 32) | keys[k + 1] if k + 1 < DEPTH else keys[k] for k in range(0, DEPTH, 2)]
        order = np.lexsort(pairs[::-1])
        places = places[order]
        whole = left[places] >= step * DEPTH
        same = whole[1:] & whole[:-1] & (keys[-1][order][1:] > 0)
        for pair in pairs:
            pair = pair[order]
            same &= pair[1:] == pair[:-1]
        repeat = np.zeros(len(places), bool)
        repeat[1:] |= same
        repeat[:-1] |= same
        return Shard(places, step, names, left, repeat)

    def whole(self) -> np.ndarray:
        """Which suffixes begin with a whole string: ``DEPTH`` blocks, each held."""
        on, at = np.ones(self.n, bool), np.arange(self.n)
        for _ in range(DEPTH - 1):
            on &= self.rest[at] >= 0
            at = np.where(on, self.rest[at], 0)
        return on

    def transform(self) -> np.ndarray:
        """First block and rank of the rest of every suffix as one ascending key: the inverse of stepping back a block."""
        return np.sort(self.names[self.places].astype(np.int64) * (self.n + 2) + self.rest + 1)


def interleave(a: Shard, b: Shard) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of ``a``: how many of ``b`` are smaller, and how many not larger, by their first ``DEPTH`` blocks."""
    keys = b.transform()
    block = a.names[a.places].astype(np.int64) * (b.n + 2)
    empty = a.rest < 0
    # by the first block alone, all that share it are equal, whatever follows
    smaller, not_larger = np.searchsorted(keys, block), np.searchsorted(keys, block + b.n + 1)
    for _ in range(DEPTH - 1):
        below = np.searchsorted(keys, block + np.where(empty, 0, smaller[a.rest] + 1))
        above = np.searchsorted(keys, block + np.where(empty, 1, not_larger[a.rest] + 1))
        if np.array_equal(below, smaller) and np.array_equal(above, not_larger):
            break
        smaller, not_larger = below, above
    return smaller, not_larger


def merge(a: Shard, b: Shard) -> Shard:
    smaller, not_larger = interleave(a, b)
    met = a.whole() & (not_larger > smaller)
    edges = np.zeros(b.n + 1, np.int64)
    np.add.at(edges, smaller[met], 1)
    np.add.at(edges, not_larger[met], -1)
    from_a = np.arange(a.n) + smaller
    places = np.empty(a.n + b.n, np.int64)
    repeat = np.empty(a.n + b.n, bool)
    slots = np.ones(a.n + b.n, bool)
    slots[from_a] = False
    places[from_a], repeat[from_a] = a.places, a.repeat | met
    places[slots], repeat[slots] = b.places, b.repeat | (np.cumsum(edges[:-1]) > 0)
    return Shard(places, a.step, a.names, a.left, repeat)


class ByteStrings:
    """Bytes as symbols, repeats found by merging shard transforms."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES):
        if length % DEPTH:
            raise ValueError(f"the length must be a multiple of {DEPTH}")
        self.length, self.gram, self.shard_bytes = length, min(gram, length), shard_bytes

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        of_byte = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return of_byte[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)

    def cutter(self, text: bytes) -> Callable[[int, int], bytes]:
        return lambda a, b: text[a:b]

    def mark(self, contents: list[bytes]) -> list[np.ndarray]:
        step = self.length // DEPTH
        symbols, sizes = self.hashes(contents)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(symbols))
        names = np.full(len(symbols), -1, np.int64)
        if len(symbols) >= step:
            blocks = np.flatnonzero(left >= step)
            _, names[blocks], times = np.unique(gram_hashes(symbols, step)[blocks], return_inverse=True, return_counts=True)
            # a string with a block that stands here once can't repeat: its suffixes are leaves, and left out
            several = np.zeros(len(symbols) + self.length, bool)
            several[blocks] = times[names[blocks]] > 1
            possible = left >= self.length
            for k in range(DEPTH):
                possible &= several[step * k : step * k + len(symbols)]
            needed = np.zeros(len(symbols) + self.length, bool)
            for k in range(DEPTH):
                needed[step * k : step * k + len(symbols)] |= possible
            needed = needed[: len(symbols)]
        else:
            needed = np.zeros(len(symbols), bool)
        shards = []
        group = (ends - 1) // self.shard_bytes
        for k in range(int(group[-1]) + 1 if len(group) else 0):
            own = np.flatnonzero(group == k)
            if len(own):
                places = np.arange(ends[own[0]] - sizes[own[0]], ends[own[-1]])
                shards.append(Shard.sorted(places[needed[places]], step, names, left))
        while len(shards) > 1:
            shards = [merge(*shards[k : k + 2]) if k + 1 < len(shards) else shards[k] for k in range(0, len(shards), 2)]
        flags = np.zeros(len(symbols), bool)
        for shard in shards:
            flags[shard.places] = shard.repeat
        return [flags[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def remove_repeated_bytes(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``n_bytes, spans, kept``: removed byte runs as ``(start, end)``, and what is left, as bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in the input as it was.  A null text is empty, and shorter
    texts lose nothing; rows of equal id and text are two places like any
    others; an empty table gives no rows.  Columns of the input that have the
    new names are replaced.
    """
    symbols = ByteStrings(length)
    columns = [c for c in docs.columns if c not in ("n_bytes", "spans", "kept")]
    marked = repeated_spans(docs.select(*columns), symbols, id_col, text_col)
    at, spans_at = columns.index(text_col), len(columns)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, found in zip(batch.column(at), batch.column(spans_at).to_pylist(), strict=True):
                body = (text.as_py() or "").encode()
                edges = [0, *(x for s in found or () for x in (s["start"], s["end"])), len(body)]
                sizes.append(len(body))
                spans.append(found or [])
                kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=[*columns, "n_bytes", "spans", "kept"],
            )

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(span)),
        T.StructField("kept", T.BinaryType()),
    ]
    return marked.mapInArrow(remove, T.StructType([*docs.select(*columns).schema, *added]))
