"""Token files: ids of documents under one global Huffman code (operator 8).

Files of a corpus, below one folder:

* ``codebook``: ``id, n, bits`` - every id that occurs, its global count and its code length.
  The lengths alone give the canonical codes.
* ``manifest``: ``shard, first_token, n_tokens, n_docs`` - where each shard begins in the corpus.
* ``blocks/shard=K``: a block per document, ascending by document id, and over shards too:
  ``place`` (its place in the shard), ``doc_id``, ``first_token`` (ids of the shard before it), ``n_tokens``,
  ``payload`` (the bit stream, from a byte boundary) and ``checkpoints`` (the bit offset of every 256th id).

A block is decoded from itself and the codebook.  Spark writes the files, as
Parquet, through its committers: a lost task leaves nothing behind.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.llm.common import id_text, shuffle_partitions, staged
from chainlens.llm.huffman import EVERY, MAX_BITS, Codebook, code_lengths
from chainlens.llm.tokenize import column_batches, default_vocabulary, encoder, forget_encoders

#: A task decodes this many ids side by side.
DECODE_IDS = 1_000_000
#: A task encodes about this many ids at once.
ENCODE_IDS = 100_000
#: Documents whose ids are counted at once.
COUNT_ROWS = 256
#: Sampled rows a shard that its bounds are taken from.
SAMPLE_ROWS = 50


def tokenized(docs: DataFrame, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, tie, ids`` (little-endian unsigned 32-bit, the end id last; ``tie`` their crc32), staged."""
    path = vocabulary or default_vocabulary()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(path).encode
        for batch in batches:
            texts = batch.column(1)
            for a, b in column_batches(texts):
                ids, offsets = run(texts.slice(a, b - a))
                sizes = np.diff(offsets) + 1
                flat = np.insert(ids, offsets[1:], end_id).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * 4
                binary = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
                bytes_of, bounds = memoryview(flat).cast("B"), ends.tolist()
                ties = [crc32(bytes_of[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(ties, pa.int64()), binary.cast(pa.binary())],
                    names=["doc_id", "n_tokens", "tie", "ids"],
                )

    return staged(docs.mapInArrow(encode, f"doc_id {id_type}, n_tokens long, tie long, ids binary"), "tokens")


def id_counts(tokens: DataFrame) -> DataFrame:
    """``id, n``: how often each id occurs in the corpus.  A task sends a row per id it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        totals = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, COUNT_ROWS):
                values = batch.column(0).slice(start, COUNT_ROWS)
                n = np.bincount(np.frombuffer(b"".join(values.to_pylist()), "<u4"))
                if len(n) > len(totals):
                    totals = np.pad(totals, (0, len(n) - len(totals)))
                totals[: len(n)] += n
        met = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(totals[met])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _order_key(doc_id, tie: int) -> tuple:
    return (doc_id is not None, doc_id, tie) if doc_id is not None else (False, 0, tie)


def shard_bounds(tokens: DataFrame, shards: int) -> list[tuple]:
    """First keys of all shards but the first, from about ``SAMPLE_ROWS`` sampled rows a shard.

    They only even out the shards' sizes; any bounds give the same corpus.
    """
    keys = tokens.select("doc_id", "tie")
    share = min(1.0, SAMPLE_ROWS * shards / max(1, tokens.count()))
    sample = sorted(_order_key(*r) for r in keys.sample(share, seed=1).collect())
    return sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []


def write_token_files(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    vocabulary: str | None = None,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode whole texts and write the corpus below ``path``.

    A null text is empty (the end id alone); a null id comes first; equal ids
    are ordered by the checksum of their ids, so a repeated row keeps its place
    wherever it was read.  An empty table gives an empty corpus.
    """
    spark = docs.sparkSession
    tokens = tokenized(id_text(docs, id_col, text_col), end_id, vocabulary)
    # at most one row per id of the vocabulary reaches the driver
    counts = id_counts(tokens).orderBy("id").collect()
    ids = np.array([r["id"] for r in counts], np.int64)
    lengths = code_lengths(np.array([r["n"] for r in counts], np.int64), max_bits)
    rows = [(int(i), int(r["n"]), int(b)) for i, r, b in zip(ids, counts, lengths, strict=True)]
    spark.createDataFrame(rows, "id long, n long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    shards = shuffle_partitions(spark)
    bounds = shard_bounds(tokens, shards)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        book = Codebook(ids, lengths)
        for batch in batches:
            keys = map(_order_key, batch.column(0).to_pylist(), batch.column(2).to_pylist())
            shard = pa.array([bisect_right(bounds, key) for key in keys], pa.int32())
            for a, b in column_batches(batch.column(3), 4 * ENCODE_IDS):
                part = batch.slice(a, b - a)
                counts = part.column(1).to_numpy()
                stream, ends, marks = book.encode_all(np.frombuffer(b"".join(part.column(3).to_pylist()), "<u4"), counts)
                behind = [np.concatenate([[0], n]).astype(np.int32) for n in (ends, np.cumsum(-(-counts // EVERY)))]
                payload = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(behind[0]), pa.py_buffer(stream)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        shard.slice(a, b - a),
                        part.column(2),
                        payload,
                        pa.ListArray.from_arrays(pa.array(behind[1]), pa.array(marks)),
                    ],
                    names=["doc_id", "n_tokens", "shard", "tie", "payload", "checkpoints"],
                )

    coded = tokens.mapInArrow(
        encode, f"doc_id {id_type}, n_tokens long, shard int, tie long, payload binary, checkpoints array<long>"
    )

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, first = None, 0, 0
        for batch in batches:
            shard, n = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            places, firsts = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for k in range(len(n)):
                if shard[k] != current:
                    current, place, first = shard[k], 0, 0
                places[k], firsts[k] = place, first
                place, first = place + 1, first + int(n[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(places), batch.column(0), pa.array(firsts), batch.column(1), batch.column(4), batch.column(5)],
                names=["shard", "place", "doc_id", "first_token", "n_tokens", "payload", "checkpoints"],
            )

    blocks = (
        coded.repartition(shards, "shard")
        .sortWithinPartitions("shard", "doc_id", "tie", "n_tokens")
        .mapInArrow(
            numbered,
            f"shard int, place long, doc_id {id_type}, first_token long, n_tokens long, payload binary, checkpoints array<long>",
        )
    )
    blocks.write.partitionBy("shard").option("compression", "none").parquet(f"{path}/blocks")
    # a row per shard; shards are as many as shuffle partitions
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    (
        read_blocks(spark, path, id_type)
        .groupBy("shard")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
        .select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first_token"), "n_tokens", "n_docs")
        .write.parquet(f"{path}/manifest")
    )


def read_blocks(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    schema = f"place long, doc_id {id_type}, first_token long, n_tokens long, payload binary, checkpoints array<long>, shard int"
    return spark.read.schema(schema).parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids`` decoded from the files; ``start`` counts the corpus's ids before the document."""
    counts = spark.read.schema("id long, n long, bits int").parquet(f"{path}/codebook").orderBy("id").collect()
    symbols = np.array([r["id"] for r in counts], np.int64)
    lengths = np.array([r["bits"] for r in counts], np.int64)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        book = Codebook(symbols, lengths)
        for batch in batches:
            n = batch.column(2).to_numpy()
            group = np.cumsum(n) // DECODE_IDS
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(n)] if len(n) else [0, 0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                streams = [v.as_py() for v in part.column(3)]
                ids = book.decode(streams, [np.asarray(v.values) for v in part.column(4)], n[a:b]).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(n[a:b])]).astype(np.int64) * 4
                binary = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), binary.cast(pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    manifest = spark.read.schema("shard int, first_token long, n_tokens long, n_docs long").parquet(f"{path}/manifest")
    # a row per shard: as many as the writer's shuffle partitions
    starts = F.broadcast(manifest.select("shard", F.col("first_token").alias("shard_start")))
    return (
        read_blocks(spark, path, id_type)
        .join(starts, "shard")
        .select("doc_id", (F.col("shard_start") + F.col("first_token")).alias("start"), "n_tokens", "payload", "checkpoints")
        .mapInArrow(decode, f"doc_id {id_type}, start long, n_tokens long, ids binary")
    )
