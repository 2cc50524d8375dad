"""Repeated windows over a corpus: the parts that operators 6 and 9 share.

A *window* is ``length`` consecutive symbols (bytes or words) of one document;
the task is to find every window whose symbols also stand somewhere else.

1. *Sampling.*  Each window has an anchor: of its ``gram``-symbol pieces the
   one with the smallest hash, the leftmost among equals.  Equal windows have
   equal anchors at equal places, and neighbouring windows mostly share one, so
   a run of windows is described by its anchor.  Runs whose anchor occurs only
   once in the corpus can't repeat and are dropped; nothing else is.  A task
   sends one run of an anchor it has met twice to the anchor's others, and deals
   its other runs out evenly.
2. *Grouping.*  The symbols of the remaining runs travel once per distinct
   content, to the group of their anchor: all windows that could be equal meet
   there.  A group of more than ``MAX_GROUP`` contents is split by longer
   common parts: windows with the anchor at offsets ``o1..o2`` all hold the
   symbols from ``o1`` before it to ``length - o2`` behind it, so the part of
   them that lies in these offsets goes by the hash of these symbols.  Where a
   group is still too large with one offset a part, the common part would be the
   whole window: such windows are counted by their 128-bit names, in salted
   partial counts, and nothing gathers their contents.
3. *Finding.*  A task gathers groups up to a bounded size and runs the
   operator's own method on them (suffix trees, merged Burrows-Wheeler
   transforms), which compares whole windows.
4. *Marking.*  Marks return to all documents with the content.

Documents are known by a 64-bit hash of id and text; equal rows are different
places of a window, so they mark each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.llm.common import free_names, if_small, shuffle_partitions, staged
from chainlens.llm.tokenize import text_batches

#: Distinct contents of a group that go to one task together, and levels of splitting.
MAX_GROUP, LEVELS = 20_000, 8
#: Parts of a window that is counted.
SALTS = 64
#: Bytes of packed entries that a task looks for repeated anchors in before it sends them.
SENT_BYTES = 8 << 20
#: Bytes of packed entries, and of contents, that a task gathers at once.
BUCKET_BYTES, CHUNK_BYTES = 16 << 20, 3 << 19
BATCH_CHARS = 1_000_000
#: Contents a task remembers to have sent; it only saves sending them again.
MAX_SENT = 300_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_PLACE_BITS = np.uint64(32)
#: Flags an entry whose anchor is known to occur twice or more; starts stay below 2 ** 47.
_SEVERAL = np.uint64(1 << 63)


class Symbols(Protocol):
    """How an operator reads a text as symbols."""

    length: int
    gram: int

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One 64-bit hash a symbol, all texts in a row, and the number of symbols of each text."""

    def cutter(self, text: bytes) -> Callable[[int, int], bytes]:
        """A function that gives the symbols from one place to another, as bytes."""

    def mark(self, contents: list[bytes]) -> list[np.ndarray]:
        """For each content, per window in it, whether an equal window starts elsewhere in the contents."""


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    return x ^ (x >> np.uint64(29))


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the ``gram`` symbols from each place on (by doubling); the last ``gram - 1`` places have none."""
    done, h, whole, covered = 1, symbols, None, 0
    while True:
        if gram & done:
            whole = h if whole is None else mixed(whole[: len(symbols) - covered - done + 1] * _ODD[2] + h[covered : len(symbols) - done + 1])
            covered += done
        if covered == gram:
            return mixed(whole)
        h = h[:-done] * _ODD[1] + mixed(h[done:])
        done *= 2


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchored_runs(symbols: np.ndarray, counts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(text, start, size, key)``: runs of windows with the same anchor, by text and first window."""
    none = np.empty(0, np.int64)
    if len(symbols) < length:
        return none, none, none, none.view(np.uint64)
    grams = gram_hashes(symbols, gram)
    packed = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_minimum(packed, length - gram + 1)
    anchor = (least & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    begins = np.cumsum(counts) - counts
    windows = np.maximum(0, counts - length + 1)
    text = np.repeat(np.arange(len(counts)), windows)
    place = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(len(text))
    if not len(text):
        return none, none, none, none.view(np.uint64)
    at = anchor[place]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    size = np.diff(new, append=len(text))
    return text[new], place[new] - begins[text[new]], size, grams[at[new]]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, text``: the document's 64-bit name and its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("row"), text.alias("text"))


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, list[bytes]]]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in text_batches(texts, BATCH_CHARS):
            yield batch, a, b, [t.encode() for t in texts[a:b]]


def _streamed(batches: Iterator[pa.RecordBatch], limit: int, size: Callable[[pa.RecordBatch], np.ndarray]):
    """Tables of whole groups (first column, sorted) with about ``limit`` bytes each."""
    held: list[pa.RecordBatch] = []
    total, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        group, sizes = batch.column(0).to_numpy(), size(batch)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if group[a] != last and total >= limit:
                yield pa.Table.from_batches(held)
                held, total = [], 0
            last = group[a]
            held.append(batch.slice(a, b - a))
            total += int(sizes[a:b].sum())
    if held:
        yield pa.Table.from_batches(held)


def combined(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``key, row, place`` as those to go by key, at most one a key, and those that needn't.

    A key with two entries or more is repeated: all its entries are flagged, and
    only the first has to meet the key's entries of other tasks.  Equal entries
    are runs of equal rows; one of them is enough.
    """
    entries = entries[np.lexsort((entries[:, 2], entries[:, 1], entries[:, 0]))]
    key = entries[:, 0]
    first = np.append(True, key[1:] != key[:-1])[: len(entries)]
    several = ~first | np.append(~first[1:], False)[: len(entries)]
    equal = np.append(False, (entries[1:] == entries[:-1]).all(axis=1))[: len(entries)]
    entries[several, 2] |= _SEVERAL
    return entries[first], entries[~first & ~equal]


def repeated_runs(rows: DataFrame, symbols: Symbols) -> DataFrame:
    """``row, runs``: the runs of each document whose anchor occurs twice or more in the corpus, staged."""
    spark = rows.sparkSession
    buckets = shuffle_partitions(spark)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: list[np.ndarray]) -> pa.RecordBatch:
            by_key, others = combined(np.concatenate(held))
            bucket = by_key[:, 0] % np.uint64(buckets * 16)
            spread = mixed(others[:, 1] + others[:, 2] * _ODD[0]) % np.uint64(buckets * 16) + np.uint64(buckets * 16)
            bucket, entries = np.append(bucket, spread).astype(np.int64), np.concatenate([by_key, others])
            order = np.argsort(bucket, kind="stable")
            bucket, entries = bucket[order], entries[order]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = [part.tobytes() for part in np.split(entries, first[1:])] if len(first) else []
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        held, total = [], 0
        for batch, a, b, texts in _split_rows(batches):
            text, start, size, key = anchored_runs(*symbols.hashes(texts), symbols.length, symbols.gram)
            row = batch.column("row").to_numpy()[a:b][text].view(np.uint64)
            held.append(np.column_stack([key, row, (start.astype(np.uint64) << np.uint64(16)) | size.astype(np.uint64)]))
            total += held[-1].nbytes
            if total >= SENT_BYTES:
                yield sent(held)
                held, total = [], 0
        if held:
            yield sent(held)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def size(batch):
            return np.fromiter((len(v.as_buffer()) for v in batch.column(1)), np.int64, batch.num_rows)

        for table in _streamed(batches, BUCKET_BYTES, size):
            entries = np.frombuffer(b"".join(v.as_py() for v in table.column(1)), np.uint64).reshape(-1, 3)
            entries = entries[np.argsort(entries[:, 0], kind="stable")]
            key = entries[:, 0]
            same = key[1:] == key[:-1]
            keep = entries[np.append(same, False) | np.append(False, same) | (entries[:, 2] >= _SEVERAL)]
            keep[:, 2] &= ~_SEVERAL
            yield pa.RecordBatch.from_arrays(
                [pa.array(keep[:, 1].view(np.int64)), pa.array((keep[:, 2] >> np.uint64(16)).astype(np.int64))]
                + [pa.array((keep[:, 2] & np.uint64(0xFFFF)).astype(np.int32)), pa.array(np.ascontiguousarray(keep[:, 0]).view(np.int64))],
                names=["row", "start", "size", "key"],
            )

    found = (
        rows.mapInArrow(packed, "bucket long, blob binary")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(several, "row long, start long, size int, key long")
    )
    return staged(found.groupBy("row").agg(F.collect_set(F.struct("start", "size", "key")).alias("runs")), "runs")


def run_contents(rows: DataFrame, runs: DataFrame, symbols: Symbols) -> DataFrame:
    """``content, row, start, size, key, symbols``: every run, staged; ``symbols`` is null where the same task has sent them before."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        sent: set[bytes] = set()
        for batch, a, b, texts in _split_rows(batches):
            if len(sent) > MAX_SENT:
                sent.clear()
            out: list[list] = [[] for _ in range(6)]
            row_names = batch.column("row")
            for k, text in enumerate(texts):
                piece = symbols.cutter(text)
                for run in batch.column("runs")[a + k].as_py():
                    body = piece(run["start"], run["start"] + run["size"] + symbols.length - 1)
                    name = xxh3_128_digest(body)
                    values = (name, row_names[a + k].as_py(), run["start"], run["size"], run["key"], None if name in sent else body)
                    sent.add(name)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)],
                names=["content", "row", "start", "size", "key", "symbols"],
            )

    joined = rows.join(runs, "row").select("row", "text", "runs")
    return staged(joined.mapInArrow(cut, "content binary, row long, start long, size int, key long, symbols binary"), "run-contents")


def _routed(contents: DataFrame, symbols: Symbols) -> tuple[DataFrame, DataFrame | None]:
    """``route, content, first, size, symbols, key``: contents, or parts of their windows, by the group they go to.

    Also those whose groups stay too large for a task however they are split, if there are any.
    """
    n_offsets = symbols.length - symbols.gram + 1

    def parts_at(level: int):
        """Split windows by the offset of their anchor into ``2 ** level`` parts."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from xxhash import xxh64_intdigest

            bounds = np.linspace(0, n_offsets, min(n_offsets, 1 << level) + 1).astype(np.int64)
            for batch in batches:
                out: list[list] = [[] for _ in range(6)]
                for r in batch.to_pylist():
                    texts = symbols.cutter(r["symbols"])
                    _, _, size, key = anchored_runs(*symbols.hashes([r["symbols"]]), symbols.length, symbols.gram)
                    assert len(size) == 1 and int(key.view(np.int64)[0]) == r["key"]
                    grams = gram_hashes(symbols.hashes([r["symbols"]])[0], symbols.gram)
                    anchor = int(np.flatnonzero(grams == key[0])[0])
                    # window w has its anchor at offset anchor - w
                    for o1, o2 in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        first, last = max(r["first"], anchor - (o2 - 1)), min(r["first"] + r["size"] - 1, anchor - o1)
                        if first > last:
                            continue
                        common = texts(anchor - o1, anchor - (o2 - 1) + symbols.length)
                        route = xxh64_intdigest(common, o1 + 1) - (1 << 63)
                        values = (route, r["content"], first, last - first + 1, r["symbols"], r["key"])
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)],
                    names=["route", "content", "first", "size", "symbols", "key"],
                )

        return part

    schema = "route long, content binary, first int, size int, symbols binary, key long"
    rows = contents.where("symbols is not null").select(
        F.col("key").alias("route"), "content", F.lit(0).alias("first"), "size", "symbols", "key"
    )
    # one offset a part would leave the whole window as the common part
    levels = min(LEVELS, (n_offsets - 1).bit_length() - 1)
    done = None
    for level in range(1, max(0, levels) + 2):
        # groups over the limit; few, as each holds more than MAX_GROUP rows
        large = staged(rows.groupBy("route").count().where(F.col("count") > MAX_GROUP).select("route"), "large-groups")
        hinted = if_small(large, row_bytes=16)
        if large.isEmpty():
            break
        fitting = rows.join(hinted, "route", "left_anti")
        done = fitting if done is None else done.unionByName(fitting)
        rows = rows.join(hinted, "route", "left_semi")
        if level > levels:
            return done, rows
        rows = staged(rows.mapInArrow(parts_at(level), schema), "split-groups")
    return rows if done is None else done.unionByName(rows), None


def counted_windows(rows: DataFrame, symbols: Symbols) -> DataFrame:
    """``content, first, marks`` of the windows of ``rows`` that stand in two contents or more, by a count per window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for r in batch.to_pylist():
                piece = symbols.cutter(r["symbols"])
                places = range(r["first"], r["first"] + r["size"])
                low, high = np.frombuffer(r["content"], np.int64).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxh3_128_digest(piece(k, k + symbols.length)) for k in places], pa.binary()),
                        pa.array([low] * len(places), pa.int64()),
                        pa.array([high] * len(places), pa.int64()),
                        pa.array([r["content"]] * len(places), pa.binary()),
                        pa.array(places, pa.int32()),
                    ],
                    names=["window", "low", "high", "content", "first"],
                )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, marks = [], []
            for places in batch.column(1).to_pylist():
                firsts.append(min(places))
                own = np.zeros(max(places) - firsts[-1] + 1, bool)
                own[np.array(places) - firsts[-1]] = True
                marks.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(firsts, pa.int32()), pa.array(marks, pa.binary())], names=["content", "first", "marks"]
            )

    cuts = rows.mapInArrow(cut, "window binary, low long, high long, content binary, first int")
    places = staged(cuts.withColumn("salt", F.pmod(F.xxhash64("content"), F.lit(SALTS))), "counted-windows")
    ends = [F.min("low").alias("a"), F.max("low").alias("b"), F.min("high").alias("c"), F.max("high").alias("d")]
    parts = places.groupBy("window", "salt").agg(*ends)
    over = Window.partitionBy("window")
    # contents differ in one of their halves
    met = (F.min("a").over(over) < F.max("b").over(over)) | (F.min("c").over(over) < F.max("d").over(over))
    repeated = parts.select("window", "salt", met.alias("met")).where("met").drop("met")
    found = places.join(repeated, ["window", "salt"], "left_semi")
    return found.groupBy("content").agg(F.collect_set("first").alias("places")).mapInArrow(packed, "content binary, first int, marks binary")


def marked_contents(contents: DataFrame, symbols: Symbols) -> DataFrame:
    """``content, first, marks``: which windows of each distinct content repeat (packed bits from window ``first`` on)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def size(batch):
            return np.fromiter((len(v.as_buffer()) for v in batch.column(4)), np.int64, batch.num_rows)

        for table in _streamed(batches, CHUNK_BYTES, size):
            first, count = (table.column(k).to_numpy() for k in (2, 3))
            # a content may have been sent by several tasks, and in parts
            contents = dict(zip(table.column(1).to_pylist(), table.column(4), strict=True))
            flags = dict(zip(contents, symbols.mark([v.as_py() for v in contents.values()]), strict=True))
            names, starts, marks = [], [], []
            done = set()
            for k, name in enumerate(table.column(1).to_pylist()):
                own = flags[name][first[k] : first[k] + count[k]]
                if own.any() and (name, first[k]) not in done:
                    done.add((name, first[k]))
                    names.append(name)
                    starts.append(first[k])
                    marks.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(starts, pa.int32()), pa.array(marks, pa.binary())],
                names=["content", "first", "marks"],
            )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [np.packbits(np.ones(n, bool)).tobytes() for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.zeros(batch.num_rows, np.int32)), pa.array(marks, pa.binary())],
                names=["content", "first", "marks"],
            )

    schema = "content binary, first int, marks binary"
    routed, large = _routed(contents, symbols)
    found = routed.drop("key").repartition(shuffle_partitions(contents.sparkSession), "route").sortWithinPartitions("route").mapInArrow(find, schema)
    if large is not None:
        found = found.unionByName(counted_windows(large, symbols))
    # all windows of a content that stands in several places repeat
    copied = contents.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).where("n > 1")
    return staged(found.unionByName(copied.select("content", "size").mapInArrow(whole, schema)), "marks")


def repeated_spans(docs: DataFrame, symbols: Symbols, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one column more, the last: the symbols that repeated windows cover, as ascending ``(start, end)``,
    or null if there are none.  The new column has a name that ``docs`` doesn't use."""
    row, covered = free_names(docs.columns, "__row", "__spans")
    rows = _rows(docs, id_col, text_col)
    contents = run_contents(rows, repeated_runs(rows, symbols), symbols)
    marks = marked_contents(contents, symbols)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged_spans(m, symbols.length) for m in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[row, covered])

    by_row = (
        contents.select("content", "row", "start")
        .join(marks, "content")
        .groupBy("row")
        .agg(F.collect_list(F.struct((F.col("start") + F.col("first")).alias("start"), "marks")).alias("marks"))
        .mapInArrow(joined, f"{row} long, {covered} array<struct<start: bigint, end: bigint>>")
    )
    by_row = staged(by_row, "document-spans")
    name = F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))
    small = if_small(by_row, bytes_of=F.lit(24) + 16 * F.size(covered))
    return docs.join(small, name == F.col(row), "left").drop(row)


def merged_spans(marks: list[dict], length: int) -> list[dict]:
    """The union of the marked windows, as ascending spans."""
    starts = np.sort(np.concatenate([m["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(m["marks"], np.uint8))) for m in marks]))
    new = np.flatnonzero(np.diff(starts, prepend=-length - 1) > length)
    ends = starts[np.append(new[1:] - 1, len(starts) - 1)] + length
    return [{"start": a, "end": b} for a, b in zip(starts[new].tolist(), ends.tolist(), strict=True)]
