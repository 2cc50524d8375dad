"""Context-triggered piecewise fingerprints of documents (operator 11).

A hash rolls over the last seven bytes of a text.  A position whose hash ends
in ``L`` one bits closes a chunk at block size ``2^L``, so an edit moves the
boundaries near it and no others, and every boundary of ``2^(L+1)`` is one of
``2^L``.  A text is cut at the smallest block size that gives about 64 chunks or
less by the text's length, or at the next larger one with at most 256
boundaries where a text repeats itself; its signature has 12 bits of each
chunk's polynomial hash, at that block size and at the next one::

    level:signature:signature of the next level

Two fingerprints are alike as their signatures at a common block size are: one
less the edit distance over the longer signature's length, at the better of
two common sizes, and 0 where the sizes have none in common.  The whole text
enters both signatures; long texts are read in stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.llm.common import id_text, shuffle_partitions, staged

WINDOW = 7
USUAL_CHUNKS, MOST_BOUNDARIES = 64, 256
TOP_LEVEL = 32
#: Bytes worked on at once; bounds memory, not the result.
STRETCH = 1 << 20

_MASK64 = (1 << 64) - 1
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BASE = 0x9E3779B97F4A7C15


def _spread(k: int) -> int:
    """A fixed 64-bit number for each ``k`` (the finaliser of SplitMix64)."""
    z = (k + 1) * _BASE & _MASK64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK64
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK64
    return z ^ z >> 31


_BYTES64 = np.array([_spread(b) for b in range(256)], np.uint64)
_BYTES32 = (_BYTES64 >> np.uint64(32)).astype(np.uint32)
_ROLL = [np.uint32(pow(0x2C1B3C6D, k, 1 << 32)) for k in range(WINDOW)]
_FACTOR = _spread(1 << 20) | 1


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for k in range((n - 1).bit_length()):  # doubling: the second half is the first times factor^(2^k)
        m = 1 << k
        out[m : 2 * m] = out[: len(out[m : 2 * m])] * np.uint64(pow(factor, m, 1 << 64))
    return out


_LOW = _powers(_FACTOR, 1 << 16)
_HIGH = _powers(pow(_FACTOR, 1 << 16, 1 << 64), 1 << 15)  # texts of up to 2 GB, as Spark's are


def _power(at: np.ndarray) -> np.ndarray:
    """``_FACTOR ** at``, modulo 2^64."""
    low = _LOW[at & 0xFFFF]
    return low * _HIGH[at >> 16] if at.size and int(at.max()) >> 16 else low


def _rolled(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """The mixed rolling hash of positions ``a`` to ``b``; windows end at the text's beginning."""
    from_ = max(0, a - WINDOW + 1)
    values = _BYTES32[data[from_:b]]
    h = values * _ROLL[0]
    for k in range(1, WINDOW):
        h[k:] += values[: len(values) - k] * _ROLL[k] if k < len(values) else 0
    h = h[a - from_ :]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _triggers(data: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that close a chunk at ``level``, and their hashes."""
    mask = np.uint32((1 << level) - 1)
    at, hashes = [], []
    for a in range(0, len(data), STRETCH):
        h = _rolled(data, a, min(len(data), a + STRETCH))
        hit = np.flatnonzero((h & mask) == mask)
        at.append(hit + a)
        hashes.append(h[hit])
    return np.concatenate(at), np.concatenate(hashes)


def _boundaries(data: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The level a text is cut at, its boundaries, and which of them hold at the next level."""
    level = (max(0, len(data) - 1) // USUAL_CHUNKS).bit_length()
    at, hashes = _triggers(data, level)
    while len(at) > MOST_BOUNDARIES:
        level += 1
        keep = (hashes >> np.uint32(level - 1)) & 1 == 1 if level <= TOP_LEVEL else np.zeros(len(at), bool)
        at, hashes = at[keep], hashes[keep]
    after = (hashes >> np.uint32(level)) & 1 == 1 if level < TOP_LEVEL else np.zeros(len(at), bool)
    return level, at, after


def _sizes(starts: np.ndarray, end: int) -> np.ndarray:
    out = np.empty(len(starts), np.int64)
    out[:-1] = starts[1:] - starts[:-1]
    out[-1] = end - starts[-1]
    return out


def _chunk_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Polynomial hash of each chunk."""
    sums = np.zeros(len(starts), np.uint64)
    for a in range(0, len(data), STRETCH):
        b = min(len(data), a + STRETCH)
        first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
        local = np.maximum(starts[first:last], a) - a
        place = np.arange(a, b) - np.repeat(starts[first:last], _sizes(local, b - a))
        sums[first:last] += np.add.reduceat(_BYTES64[data[a:b]] * _power(place), local)
    return sums


def _signature(hashes: np.ndarray) -> str:
    h = hashes ^ (hashes >> np.uint64(29))
    bits = ((h * np.uint64(_BASE)) >> np.uint64(52)).astype(np.int64)
    pairs = np.empty((len(bits), 2), np.int64)
    pairs[:, 0], pairs[:, 1] = bits >> 6, bits & 63
    return _ALPHABET[pairs].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """The fingerprint of a text's UTF-8 bytes; an empty text has no chunks."""
    if not data:
        return "0::"
    text = np.frombuffer(data, np.uint8)
    level, at, after = _boundaries(text)
    ends = at + 1
    starts = np.concatenate([[0], ends])
    above = np.concatenate([[True], after])
    if starts[-1] == len(text):
        starts, above = starts[:-1], above[:-1]
    hashes = _chunk_hashes(text, starts)
    # a chunk of the next level is a run of this one's: hash(AB) = hash(A) + factor^|A| hash(B)
    groups = np.flatnonzero(above)
    base = np.repeat(starts[groups], _sizes(groups, len(starts)))
    merged = np.add.reduceat(hashes * _power(starts - base), groups)
    return f"{level}:{_signature(hashes)}:{_signature(merged)}"


# ---- likeness ----


def _tokens(signature: str) -> np.ndarray:
    return np.frombuffer(signature.encode(), "<u2").astype(np.int32)


def edit_distances(left: list[np.ndarray], right: list[np.ndarray], most: int = 1024) -> np.ndarray:
    """Levenshtein distances of pairs of signatures (of at most 257 tokens each), many pairs of like lengths at a time."""
    out = np.zeros(len(left), np.int32)
    by_length = np.argsort([max(len(a), len(b)) for a, b in zip(left, right, strict=True)], kind="stable")
    for start in range(0, len(left), most):
        taken = by_length[start : start + most]
        a, b = [left[k] for k in taken], [right[k] for k in taken]
        size_a, size_b = (np.array([len(x) for x in side]) for side in (a, b))
        wide_a, wide_b = (
            np.full((len(side), int(size.max())), pad, np.int32) for side, size, pad in ((a, size_a, -1), (b, size_b, -2))
        )
        for wide, side in ((wide_a, a), (wide_b, b)):
            for k, x in enumerate(side):
                wide[k, : len(x)] = x
        steps = np.arange(wide_b.shape[1] + 1, dtype=np.int16)
        row = np.tile(steps, (len(a), 1))
        found = np.where(size_a == 0, size_b, 0)
        for i in range(1, wide_a.shape[1] + 1):
            best = np.empty_like(row)
            best[:, 0] = i
            np.minimum(row[:, :-1] + (wide_b != wide_a[:, i - 1 : i]), row[:, 1:] + 1, out=best[:, 1:], casting="unsafe")
            # an insertion costs one a step: the running minimum of what is left after taking the steps off
            best -= steps
            np.minimum.accumulate(best, axis=1, out=best)
            best += steps
            row = best
            here = np.flatnonzero(size_a == i)
            found[here] = row[here, size_b[here]]
        out[taken] = found
    return out


def likenesses(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness, 0 to 1, of pairs of fingerprints."""
    out = np.zeros(len(left))
    pairs: list[tuple[int, str, str]] = []
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y:
            out[k] = 1.0
            continue
        (i, *p), (j, *q) = x.split(":"), y.split(":")
        at = int(j) - int(i)
        if at == 0:
            pairs += [(k, p[0], q[0]), (k, p[1], q[1])]
        elif at == 1:
            pairs.append((k, p[1], q[0]))
        elif at == -1:
            pairs.append((k, p[0], q[1]))
    if pairs:
        distances = edit_distances([_tokens(a) for _, a, _ in pairs], [_tokens(b) for _, _, b in pairs])
        for (k, a, b), d in zip(pairs, distances.tolist(), strict=True):
            out[k] = max(out[k], 1.0 - d / max(1, len(a) // 2, len(b) // 2))
    return out


def likeness(left: Column, right: Column) -> Column:
    """Likeness of two columns of fingerprints; null where one is."""

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        known = a.notna() & b.notna()
        out = pd.Series(np.nan, index=a.index, dtype="Float64")
        out[known] = likenesses(a[known].tolist(), b[known].tolist())
        return out.mask(~known)

    return compare(left, right)


# ---- documents ----


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row; a null text is empty.  No row travels."""
    source = id_text(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prints = [fingerprint(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(prints, pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    return source.mapInArrow(run, f"doc_id {id_type}, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last ``len // 2`` code points replaced by the first as many of ``following``."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


_RESULT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_RESULT_TYPES = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Finished rows that wait to be compared together.
_TOGETHER = 2048


def _finished(rows: list[tuple]) -> list[list]:
    """Columns of the result for ``(doc_id, text, fingerprint, next text, next fingerprint)``."""
    changed = [edited(text, following).encode() for _, text, _, following, _ in rows]
    prints = [fingerprint(c) for c in changed]
    own = [r[2] for r in rows]
    return [
        [r[0] for r in rows],
        [len(r[1]) for r in rows],
        [hashlib.sha256(c).hexdigest() for c in changed],
        own,
        prints,
        likenesses(own, prints).tolist(),
        likenesses(own, [r[4] for r in rows]).tolist(),
    ]


def edit_experiment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.  The next document has the next larger id; the
    last is followed by the first.  Null ids come first; documents of one id
    follow each other by a hash of the text, then the text, and equal rows are
    alike, so each repeated row has a result of its own.  A null text is
    empty.  A single document follows itself; an empty table gives no rows.

    Texts are range-partitioned once; a task holds one document beside its
    batch.  The last document of a partition meets the first of the next one
    in a join with a row for each partition.
    """
    spark = docs.sparkSession
    source = id_text(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()
    # the running number only cuts a very common row into several ranges
    keyed = source.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tie"))
    ordered = (
        keyed.repartitionByRange(shuffle_partitions(spark), "doc_id", "h", "tie")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
    )
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = _RESULT_TYPES.format(id=id_type)
    arrow = to_arrow_schema(StructType.fromDDL(types))
    edge_types = f"part int, kind int, {types}, text string"
    edge_arrow = to_arrow_schema(StructType.fromDDL(edge_types))

    def table(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting, held = None, []

        def edge(kind: int, row: tuple) -> pa.RecordBatch:
            doc_id, text, own = row
            return table([[v] for v in (part, kind, doc_id, None, None, own, None, None, None, text)], edge_arrow)

        def done() -> pa.RecordBatch:
            n = len(held)
            return table([[part] * n, [0] * n, *_finished(held), [None] * n], edge_arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                here = (doc_id, text, fingerprint(text.encode()))
                if waiting is None:
                    yield edge(1, here)
                else:
                    held.append((*waiting, text[: len(waiting[1]) // 2], here[2]))
                    if len(held) == _TOGETHER:
                        yield done()
                        held.clear()
                waiting = here
        if held:
            yield done()
        if waiting is not None:
            yield edge(2, waiting)

    rows = staged(ordered.mapInArrow(run, edge_types), "edit_experiment")
    # numbers of partitions that hold rows
    parts = rows.where("kind = 1").select("part")
    around = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(around), F.min("part").over(Window.partitionBy())).alias("next_part"))
    firsts = rows.where("kind = 1").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")
    )
    lasts = rows.where("kind = 2").select("part", "doc_id", "text", "fingerprint")
    pairs = lasts.join(following, "part").join(firsts, "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield table(_finished(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))), arrow)

    edges = pairs.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(finish, types)
    return rows.where("kind = 0").select(*_RESULT).unionByName(edges)
