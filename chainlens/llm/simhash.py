"""SimHash fingerprints, near copies found by vantage-point trees (operator 3).

*Fingerprints.*  Words are runs without ASCII white space, lower-cased A-Z;
shingles are ``shingle_words`` words joined by single spaces, repeats included;
bit *b* is set if it is set in over half of the shingles' XXH64 (seed 42).

*Sharding.*  Two fingerprints that differ in at most ``max_bits`` bits differ
in at most ``max_bits // PARTS`` bits in at least one of ``PARTS`` parts of the
64 bits.  Each part has a vantage-point tree of its own over the Hamming
distance of that part, a metric that a pair within the limit keeps small.  A
node has a vantage point and a radius; a fingerprint goes inside, outside, or -
near the boundary - to both, as the triangle bound says that two within
``t`` of each other differ by at most ``t`` in their distance to the vantage
point.  Every pair in question thus meets in some leaf, and the leaves are the
shards.  Vantage points come from a fixed hash of the node, so the trees need
no fitting and are the same in every task; only their depth follows the number
of distinct fingerprints.

*Linking.*  A leaf compares exact 64-bit distances.  Larger leaves go on as a
local vantage-point tree; all within the limit of its vantage point are one
class at once, so a dense group of copies costs its size and not its square.
Classes are joined by :func:`connected_components`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import free_names, id_text, if_small, shuffle_partitions, staged
from chainlens.llm.components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Parts of the 64 bits, each with its own tree.
PARTS = 3
#: Fingerprints a leaf is to hold; sets the depth only.
LEAF = 1024
#: Part of the fingerprints that go to a child of a node (with 21 bits and a boundary of 1 bit).
SHRINK = 0.584
#: Above this size a leaf is split by local vantage points.
DENSE = 2048


def _fingerprint(text: str, shingle_words: int) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: max(0, len(words) - shingle_words)].tolist()]
    stops = (ends[min(shingle_words, len(words)) - 1 :] - 1).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprinted(
    docs: DataFrame, name: str, shingle_words: int = SHINGLE_WORDS, text_col: str = "text"
) -> DataFrame:
    """``docs`` with their fingerprint, the 64 bits as a signed long, as column ``name``.

    A text of fewer words than a shingle is one shingle; a null text and one
    without words have fingerprint zero, which links like any other.
    """
    at = docs.columns.index(text_col)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_fingerprint(t.as_py() or "", shingle_words) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(hashed, T.StructType([*docs.schema, T.StructField(name, T.LongType())]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mix (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def leaves_of(values: np.ndarray, depth: int, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(row, leaf)``: the leaves of every fingerprint in all trees."""
    rows, leaves, bounds = [], [], [64 * p // PARTS for p in range(PARTS + 1)]
    near = max_bits // PARTS
    for part in range(PARTS):
        width = bounds[part + 1] - bounds[part]
        low = (values >> np.uint64(bounds[part])) & np.uint64((1 << width) - 1)
        row, node = np.arange(len(values)), np.ones(len(values), np.int64)
        for _ in range(depth):
            point = _mixed(node * PARTS + part) & np.uint64((1 << width) - 1)
            distance = np.bitwise_count(low[row] ^ point).astype(np.int64)
            radius = (width - 1 - near) // 2
            inside, outside = distance <= radius + near, distance > radius
            row = np.concatenate([row[inside], row[outside]])
            node = np.concatenate([2 * node[inside], 2 * node[outside] + 1])
        rows.append(row)
        leaves.append(node * PARTS + part)
    return np.concatenate(rows), np.concatenate(leaves)


def link_leaf(values: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For distinct fingerprints: the index of each one's class, so that classes are those linked in this leaf."""
    parent = np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)

    def compared(at: np.ndarray) -> bool:
        """Compare all of a small set; False if its links are too many to list."""
        own, found, total = values[at], [], 0
        for k in range(0, len(at), 256):
            i, j = np.nonzero(np.bitwise_count(own[k : k + 256, None] ^ own[None, k:]) <= max_bits)
            ahead = j > i
            total += int(ahead.sum())
            if total > 4 * len(at):
                return False
            found.append((i[ahead] + k, j[ahead] + k))
        for i, j in found:
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                join(at[a], at[b : b + 1])
        return True

    todo = [parent.copy()]
    while todo:
        at = todo.pop()
        if len(at) < 2 or len(at) <= DENSE and compared(at):
            continue
        distance = np.bitwise_count(values[at] ^ values[at[0]])
        near, rest = at[distance <= max_bits], at[distance > max_bits]
        join(at[0], near)
        # what lies within reach of any of the near ones belongs to the same class
        ring = at[(distance > max_bits) & (distance <= 2 * max_bits)]
        for k in range(0, len(near), 512):
            if not len(ring):
                break
            step = max(1, (1 << 22) // 512)
            linked = np.concatenate(
                [
                    (np.bitwise_count(values[ring[r : r + step], None] ^ values[None, near[k : k + 512]]) <= max_bits).any(axis=1)
                    for r in range(0, len(ring), step)
                ]
            )
            join(at[0], ring[linked])
            ring = ring[~linked]
        if not len(rest):
            continue
        beyond = distance[distance > max_bits].astype(np.int64)
        radius = int(np.median(beyond))
        inside = rest[beyond <= radius + max_bits - max_bits // 2]
        outside = rest[beyond > radius - max_bits // 2]
        if max(len(inside), len(outside)) > 0.9 * len(rest):
            todo.append(rest)
        else:
            todo += [inside, outside]
    return np.array([root(i) for i in range(len(values))], np.int64)


def linked_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``node, component`` of the fingerprints of ``distinct(fingerprint)`` that have a link."""
    spark = distinct.sparkSession
    depth = max(0, math.ceil(math.log(max(1, distinct.count()) / LEAF) / -math.log(SHRINK)))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for k in range(0, len(values), 1 << 14):
                row, leaf = leaves_of(values[k : k + (1 << 14)].view(np.uint64), depth, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(values[k + row])], names=["leaf", "fingerprint"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(parts: list[np.ndarray]) -> pa.RecordBatch:
            values = np.concatenate(parts)
            first = values[link_leaf(values.view(np.uint64), max_bits)]
            new = first != values
            return pa.RecordBatch.from_arrays([pa.array(values[new]), pa.array(first[new])], names=["a", "b"])

        held, current = [], None
        for batch in batches:
            leaf, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)] if len(leaf) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if leaf[a] != current and held:
                    yield edges(held)
                    held = []
                current = leaf[a]
                held.append(values[a:b])
        if held:
            yield edges(held)

    shards = (
        distinct.mapInArrow(routed, "leaf long, fingerprint long")
        .repartition(shuffle_partitions(spark), "leaf")
        .sortWithinPartitions("leaf")
    )
    return connected_components(shards.mapInArrow(linked, "a long, b long"))


def named_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fingerprint, component, component_id`` of every fingerprint of ``prints(doc_id, fingerprint)``."""
    classes = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    linked = staged(linked_fingerprints(classes.select("fingerprint"), max_bits), "fingerprint-links").withColumnRenamed(
        "node", "fingerprint"
    )
    smallest = linked.join(classes, "fingerprint").groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = linked.join(smallest, "component").select("fingerprint", "component", "least_id")
    alone = F.col("component").isNull()
    return classes.join(named, "fingerprint", "left").select(
        "fingerprint",
        F.coalesce("component", "fingerprint").alias("component"),
        F.when(alone, F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"),
    )


def near_copy_components(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per input row.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits; null ids are passed over, so it is null only
    where every id reachable is.  An empty table gives no rows.
    """
    printed = fingerprinted(id_text(docs, id_col, text_col), "fingerprint", shingle_words)
    prints = staged(printed.select("doc_id", "fingerprint"), "fingerprints")
    names = named_components(prints, max_bits)
    return prints.join(names, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each_component(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id.

    Of rows that share that id, and in a component without ids, the smallest as
    a struct of all columns stays.
    """
    fingerprint, component, least_id, row = free_names(docs.columns, "__fingerprint", "__component", "__component_id", "__row")
    rows = staged(fingerprinted(docs, fingerprint, shingle_words, text_col), "fingerprinted")
    prints = rows.select(F.col(id_col).alias("doc_id"), F.col(fingerprint).alias("fingerprint"))
    names = staged(named_components(prints, max_bits), "component-names").select(
        F.col("fingerprint").alias(fingerprint), F.col("component").alias(component), F.col("component_id").alias(least_id)
    )
    first = rows.join(if_small(names, row_bytes=40), fingerprint).where(F.col(id_col).eqNullSafe(F.col(least_id)))
    one = first.groupBy(component).agg(F.min(F.struct(*docs.columns)).alias(row))
    return one.select(f"{row}.*")
