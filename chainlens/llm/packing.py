"""Packing documents into fixed windows by best-fit decreasing (operator 1).

Every document is encoded and closed with a separator id.  A document longer
than a window is first cut into full windows; what is left of it, and every
shorter document, is a piece of 1 to ``window`` ids.

Best-fit decreasing looks at lengths only, and there are at most ``window``
different ones.  So the plan is made from the histogram of lengths: equal
pieces are placed together into runs of equally filled windows, and a segment
tree indexed by remaining capacity finds the tightest open run.  The plan's
size depends on ``window``, not on the corpus.  Tasks then give each piece its
rank among the pieces of its length (a count by task, summed over tasks) and
look its window up in the plan.  No piece of text leaves the task that made it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.llm.common import id_text, if_small, staged
from chainlens.llm.tokenize import column_batches, default_vocabulary, encoder

PIECE_SCHEMA = "part int, slot long, doc_id {id}, start long, length int, doc_tokens long, ids binary"


class CapacityTree:
    """Segment tree over capacities 0..n: which hold open windows, and the smallest such capacity at or above one."""

    def __init__(self, n: int):
        self.base = 1 << n.bit_length()
        self.held = np.zeros(2 * self.base, bool)

    def set(self, capacity: int, held: bool) -> None:
        i = capacity + self.base
        self.held[i] = held
        while i > 1:
            i //= 2
            self.held[i] = self.held[2 * i] or self.held[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.base
        if self.held[i]:
            return least
        while i > 1:  # climb until a right sibling holds something, then descend to its left-most leaf
            if i % 2 == 0 and self.held[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.held[2 * i] else 2 * i + 1
                return i - self.base
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int]]:
    """Plan rows ``(length, first_rank, first_window, offset)``.

    Pieces of ``length`` whose rank is ``first_rank + k``, up to the next plan
    row of that length, go to window ``first_window + k`` at ``offset``.
    """
    tree, runs = CapacityTree(window), [[] for _ in range(window + 1)]
    plan, windows = [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            runs[capacity].append((first, count))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, count = window, windows, left
                opened = -(-left // (window // length))
                windows += opened
            else:
                first, count = runs[capacity].pop()
            # a window that has taken a piece is tighter than before: it takes the same length until it has no room for it
            each = capacity // length
            full, rest = min(count, left // each), 0
            if full < count:
                rest = min(left - full * each, each)
            for k in range(each if full else 0):
                plan.append((length, rank, first, window - capacity + k * length))
                rank += full
            for k in range(rest):
                plan.append((length, rank, first + full, window - capacity + k * length))
                rank += 1
            left -= full * each + rest
            used = full + (1 if rest else 0)
            if capacity < window:
                if count > used:
                    runs[capacity].append((first + used, count - used))
                tree.set(capacity, bool(runs[capacity]))
            put(capacity - each * length, first, full)
            put(capacity - rest * length, first + full, 1 if rest else 0)
    return plan


def tokenized_pieces(
    docs: DataFrame,
    window: int = 1024,
    separator: int = 0,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of every document, staged: ``part, slot, doc_id, start, length, doc_tokens, ids``.

    ``ids`` are little-endian unsigned 32-bit; ``part`` is the task that made
    the piece and ``slot`` counts the task's pieces of that length.  A null
    text is empty and gives one piece that holds the separator alone; a null
    or repeated id is a document like any other.
    """
    path = vocabulary or default_vocabulary()
    source = id_text(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(path).encode
        slots = np.zeros(window + 1, np.int64)
        for batch in batches:
            texts = batch.column(1)
            for a, b in column_batches(texts):
                ids, offsets = encode(texts.slice(a, b - a))
                sizes = np.diff(offsets) + 1
                # every text's ids with the separator behind them
                flat = np.insert(ids, offsets[1:], separator).astype("<u4")
                pieces = -(-sizes // window)
                doc = np.repeat(np.arange(b - a), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, sizes[doc] - start)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                new = np.flatnonzero(np.diff(ordered, prepend=-1))
                slot = np.empty(len(doc), np.int64)
                slot[order] = np.arange(len(doc)) - np.repeat(new, np.diff(new, append=len(doc))) + slots[ordered]
                slots += np.bincount(length, minlength=window + 1)
                # pieces follow each other in flat, so their ends are the running sum of their lengths
                ends = np.concatenate([[0], np.cumsum(length)]) * 4
                binary = pa.Array.from_buffers(
                    pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(doc), part, np.int32)),
                        pa.array(slot),
                        batch.column(0).slice(a, b - a).take(pa.array(doc)),
                        pa.array(start),
                        pa.array(length.astype(np.int32)),
                        pa.array(sizes[doc]),
                        binary.cast(pa.binary()),
                    ],
                    names=["part", "slot", "doc_id", "start", "length", "doc_tokens", "ids"],
                )

    return staged(source.mapInArrow(cut, PIECE_SCHEMA.format(id=id_type)), "pieces")


def placed(pieces: DataFrame, window: int = 1024) -> DataFrame:
    """``pieces`` (with any columns beside ``part, slot, length``) plus ``sequence_id`` and ``offset``.

    Columns are carried along, so callers drop ``ids`` first where they need
    the placement alone.
    """
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = staged(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece_ranks")
    # at most `window` rows reach the driver, whatever the corpus
    histogram = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sorted(best_fit_decreasing(histogram, window))
    length, first_rank, first_window, offset = np.array(plan or [(0, 0, 0, 0)], np.int64).T
    # one ascending key over (length, rank): lengths follow each other by their counts
    above = np.zeros(window + 2, np.int64)
    for size, n in histogram.items():
        above[size + 1] = n
    above = np.cumsum(above)
    keys = above[length] + first_rank

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rank = f.pop("base").to_numpy() + f["slot"].to_numpy()
            key = above[f["length"].to_numpy()] + rank
            row = np.searchsorted(keys, key, side="right") - 1
            f["sequence_id"] = first_window[row] + key - keys[row]
            f["offset"] = offset[row]
            yield f

    # a row per task and length; beyond a broadcast, ids stay where they are and the place alone travels
    ranks = if_small(base.select("part", "length", "base"), row_bytes=16)
    joined = pieces.join(ranks, ["part", "length"])
    schema = joined.drop("base").schema.add("sequence_id", "long").add("offset", "long")
    return joined.mapInPandas(look_up, schema)


def pack_documents(docs: DataFrame, window: int = 1024, **options) -> DataFrame:
    """Packed pieces with their ids: ``sequence_id, offset, doc_id, start, length, doc_tokens, ids``.

    The ids of a sequence are those of its pieces by ``offset``.  An empty
    table gives no rows.
    """
    pieces = tokenized_pieces(docs, window, **options)
    return placed(pieces, window).select("sequence_id", "offset", "doc_id", "start", "length", "doc_tokens", "ids")
