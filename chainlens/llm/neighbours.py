"""Approximate nearest neighbours with a hash-prefix forest (operator 7).

Vectors are dealt into blocks that fit a task.  A block's forest has ``TREES``
trees; a tree is the sorted array of its vectors' hash strings, ``HASH_BITS``
signs of random projections.  A query descends every tree to its longest
matching prefix, then all trees ascend together, one bit at a time, until the
vectors below the matched prefixes are enough.  These candidates are scored
exactly, in double precision, and each block's best are merged by query.

How many candidates are enough is measured in every block: two bounded samples
of its queries, drawn by a hash of the id over all of them, are compared with
brute force, and the smallest budget that finds ``TARGET`` of the neighbours of
the first is raised until it does so for the second.  So the budget follows the
data, also where ids follow them.  Every vector is indexed.

Largest inner product is searched as in Neyshabur and Srebro (2015): vectors
get one more component that makes their norms equal, queries a zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.llm.common import staged

TREES, HASH_BITS = 64, 32
#: Vectors and queries of a task.
BLOCK_ROWS, QUERY_ROWS = 8192, 4096
#: Recall that each sample has to reach in its block, and a sample's size.
TARGET, SAMPLE = 0.96, 64
NEIGHBOURS = 20
_SEED = 20


class Forest:
    """Sorted hash strings of a block's vectors, tree by tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = HASH_BITS):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.planes = np.random.default_rng(_SEED).standard_normal((vectors.shape[1] + 1, trees * bits)).astype(np.float32)
        extra = np.sqrt(np.maximum(0, norms.max(initial=0) - norms))
        hashes = self._hash(vectors, extra)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def _hash(self, vectors: np.ndarray, extra: np.ndarray) -> np.ndarray:
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        out = np.empty((self.trees, len(vectors)), np.uint64)
        for a in range(0, len(vectors), 2048):
            part = np.column_stack([vectors[a : a + 2048], extra[a : a + 2048]]).astype(np.float32)
            signs = (part @ self.planes > 0).reshape(len(part), self.trees, self.bits)
            out[:, a : a + 2048] = (signs * weights).sum(axis=2, dtype=np.uint64).T
        return out

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``first, last``, each (bits + 1, trees, queries): the slice that shares each prefix length with a query."""
        hashes = self._hash(queries, np.zeros(len(queries)))
        first = np.empty((self.bits + 1, self.trees, len(queries)), np.int32)
        last = np.empty_like(first)
        for tree in range(self.trees):
            for depth in range(self.bits + 1):
                below = np.uint64((1 << (self.bits - depth)) - 1)
                low = hashes[tree] & ~below
                first[depth, tree] = np.searchsorted(self.sorted[tree], low, side="left")
                last[depth, tree] = np.searchsorted(self.sorted[tree], low | below, side="right")
        return first, last

    def candidates(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rows in any tree's slice of one query."""
        met = np.zeros(len(self.vectors), bool)
        for tree in range(self.trees):
            met[self.order[tree, first[tree] : last[tree]]] = True
        return np.flatnonzero(met)

    def depths(self, first: np.ndarray, last: np.ndarray, budget: int) -> np.ndarray:
        """Per query, the deepest level at which the trees' slices hold ``budget`` rows in all, else the root."""
        enough = (last - first).sum(axis=1, dtype=np.int64) >= budget
        enough[0] = True
        return self.bits - np.argmax(enough[::-1], axis=0)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def hashed_order(ids: np.ndarray) -> np.ndarray:
    """Places of ``ids`` by a hash of the id, so that any stretch of it is spread over all ids."""
    mixed = ids.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return np.argsort(mixed ^ (mixed >> np.uint64(31)), kind="stable")


def search_block(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = NEIGHBOURS, target: float = TARGET
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(query, rows, scores)``: each query's best candidates of the block; never a row of the query's own id."""
    forest = Forest(vectors)
    budgets = [b for e in range(6, 40) for b in (1 << e, 3 << (e - 1))]

    def best(q: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[ids[rows] != query_ids[q]]
        # one product for all candidates; summing by component keeps a score the same in every block
        scores = (vectors[rows] * queries[q]).sum(axis=1)
        at = best_of(scores, ids[rows], k)
        return rows[at], scores[at]

    everyone, budget, spread = np.arange(len(ids)), budgets[0], hashed_order(query_ids)
    for sample in (spread[:SAMPLE], spread[SAMPLE : 2 * SAMPLE]):
        first, last = forest.ranges(queries[sample])
        truth = [set(best(q, everyone)[0].tolist()) for q in sample]
        wanted = sum(map(len, truth))
        for budget in budgets[budgets.index(budget) :]:
            depth = forest.depths(first, last, budget)
            found = sum(
                len(truth[n] & set(best(q, forest.candidates(first[depth[n], :, n], last[depth[n], :, n]))[0].tolist()))
                for n, q in enumerate(sample)
            )
            if found >= target * wanted or budget > forest.trees * len(ids):
                break
    for a in range(0, len(queries), 512):
        part = queries[a : a + 512]
        first, last = forest.ranges(part)
        depth = forest.depths(first, last, max(budget, k + 1))
        for q in range(len(part)):
            rows = forest.candidates(first[depth[q], :, q], last[depth[q], :, q])
            if (ids[rows] != query_ids[a + q]).sum() < k:  # trees that overlap may hold fewer than their slices add up to
                rows = everyone
            yield a + q, *best(a + q, rows)


def usable_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector`` (doubles): rows with an id and a non-zero vector of finite components, each once."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .where(finite & F.exists("vector", lambda x: x != 0))
        .distinct()
    )


def nearest_neighbours(
    rows: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` nearest rows found, by largest inner product.

    Vectors that are null, zero or hold null or non-finite components take no
    part on either side.  A row is compared with queries of its own length
    only, and never with a query of its own id; equal rows count once.  Ties go
    to the smaller id.  An empty side gives no rows.
    """
    data = staged(usable_vectors(rows, id_col, vector_col), "vectors")
    asked = staged(usable_vectors(queries, id_col, vector_col), "query-vectors")
    blocks = max(1, -(-data.count() // block_rows))
    query_blocks = max(1, -(-asked.count() // query_rows))
    # every block of queries meets every block of rows, in a task of its own
    cells = blocks * query_blocks
    size = F.size("vector")
    held = data.select(
        "vec_id",
        "vector",
        size.alias("size"),
        F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
    )
    wanted = asked.select(
        "vec_id",
        "vector",
        size.alias("size"),
        F.pmod(F.xxhash64("vec_id", "vector"), F.lit(query_blocks)).alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    cell = (F.col("block") * query_blocks + F.col("query_block")).alias("cell")

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("vec_id").to_numpy()
        flat = table.column("vector").combine_chunks().flatten().to_numpy()
        order = np.argsort(ids, kind="stable")
        return ids[order], flat.reshape(len(ids), -1)[order]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [np.empty(0, np.int64)], "vec_id": [np.empty(0, np.int64)], "score": [np.empty(0)]}
        if left.num_rows and right.num_rows:
            ids, vectors = matrix(left)
            query_ids, query_vectors = matrix(right)
            for q, found, scores in search_block(ids, vectors, query_ids, query_vectors, k):
                out["query_id"].append(np.full(len(found), query_ids[q]))
                out["vec_id"].append(ids[found])
                out["score"].append(scores)
        return pa.table({name: np.concatenate(parts) for name, parts in out.items()})

    found = (
        held.select(cell, "size", "vec_id", "vector")
        .repartition(cells, "cell", "size")
        .groupBy("cell", "size")
        .cogroup(wanted.select(cell, "size", "vec_id", "vector").repartition(cells, "cell", "size").groupBy("cell", "size"))
        .applyInArrow(search, "query_id long, vec_id long, score double")
    )
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
