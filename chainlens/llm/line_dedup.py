"""Line deduplication, exact and fuzzy, by MinHash (operator 4).

1. Every line with a word is hashed; its character shingles give a signature
   of ``SLOTS`` minima (one-permutation hashing, empty slots filled by
   rotation), cut into ``BANDS`` band keys.
2. Lines that share a band key form a bucket.  Buckets travel as packed arrays,
   16 bytes an entry.  Equal buckets of several bands are verified once.
3. The texts of bucketed lines are fetched, and the exact Jaccard similarity of
   their shingle sets decides (``similarity`` or more links).  Lines of a cell meet
   in the shingles where they leave what most of the cell holds, so near copies of
   one template meet in few.  The lines of a key with
   more than ``CELL`` are dealt out evenly and compared with ``LEADERS`` of them,
   round by round.  The lines of the largest class that is found are linked, so
   only those outside it have to meet all others; where that takes at most
   ``COPIES`` rows a line, they are dealt to pairs of parts and compared.  Else,
   by the triangle inequality of the Jaccard distance, a line is
   done once all that may link to it are in the class of a leader it is in.  What
   is above ``CELL`` lines after ``ROUNDS`` is dealt to cells of a shared rare
   shingle (prefix filtering, which is exact), so that lines of one template that
   differ elsewhere don't meet.  Only where a rare shingle of so many lines is
   shared by more than ``CELL`` of them is a cell split into pairs of parts, each
   a task's work, so no link is lost.
4. Links are joined by :func:`connected_components`; of every class of lines
   the first occurrence, by document id and line number, stays.

Lines are known by the XXH64 of their text (seed 42), as Spark's ``xxhash64``.
With 4 rows a band and 14 bands a pair at the threshold of 0.8 shares a band
with probability 0.9993, one at 0.9 with 0.999999.  One changed character costs
up to ``SHINGLE`` shingles, so it leaves lines from 79 characters on linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.llm.common import free_names, if_small, shuffle_partitions, staged
from chainlens.llm.components import connected_components
from chainlens.llm.tokenize import text_batches
from chainlens.operators.bloom import maybe_listed

SHINGLE = 8
SLOTS, BANDS = 56, 14
SIMILARITY = 0.8
#: Lines of a bucket that one task compares.
CELL = 2048
#: Lines that all lines of a larger bucket are compared with in a round, and rounds.
LEADERS, ROUNDS = 8, 4
#: Rows a line that a cell may give when the lines outside its largest class are dealt out to meet all others.
COPIES = 16
#: Bytes of packed entries that a task sends at once, and lines of one key among them that are dealt out.
SENT_BYTES, DEALT = 8 << 20, 256
#: Bytes of packed entries that a task collects.
BUCKET_BYTES = 32 << 20
#: Characters of the cells that a task compares at once (a larger cell goes alone), and shingles met at once.
VERIFIED_CHARS, COMPARED = 500_000, 1 << 20
#: Characters hashed at once; their arrays stay in a core's cache.
HASHED_CHARS = 1 << 15
#: Most words of the filter of lines whose texts are fetched; each is about 32 bytes of a broadcast.
FILTER_WORDS = 1 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _ODD[3]
    x ^= x >> np.uint64(29)
    x *= _ODD[1]
    x ^= x >> np.uint64(32)
    return x


def band_keys(lines: list[str]) -> np.ndarray:
    """``(len(lines), BANDS)`` keys; lines of fewer characters than a shingle are one shingle."""
    parts = np.flatnonzero(np.diff(np.cumsum([len(x) for x in lines]) // HASHED_CHARS)) + 1
    cuts = [0, *parts.tolist(), len(lines)]
    return np.concatenate([_band_keys(lines[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _band_keys(lines: list[str]) -> np.ndarray:
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    short = [line + "\n" * (SHINGLE - len(line)) if len(line) < SHINGLE else line for line in lines]
    text = np.frombuffer("".join(short).encode("utf-32-le"), "<u4").astype(np.uint64)
    h = (text + np.uint64(1)) * _ODD[0]
    for step, odd in ((1, _ODD[1]), (2, _ODD[2]), (4, _ODD[3])):
        h = _mixed(h[:-step] * odd + h[step:])
    lengths = np.maximum(sizes, SHINGLE)
    # what reaches into the next line counts as empty, the largest value
    across = np.cumsum(lengths)[:-1, None] - np.arange(1, SHINGLE)
    h[across.ravel()] = _EMPTY
    table = np.full(len(lines) * SLOTS, _EMPTY)
    slot = ((h >> np.uint64(32)) * np.uint64(SLOTS)) >> np.uint64(32)
    begins = np.repeat(np.arange(len(lines)) * SLOTS, lengths)[: len(h)]
    np.minimum.at(table, begins + slot.view(np.int64), h)
    table = table.reshape(-1, SLOTS)
    # an empty slot takes the next filled one's minimum, marked with the distance
    place = np.where(table == _EMPTY, 4 * SLOTS, np.arange(SLOTS))
    ahead = np.concatenate([place, place + SLOTS], axis=1)
    following = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1][:, :SLOTS]
    table = np.take_along_axis(table, following % SLOTS, axis=1) + (following - np.arange(SLOTS)).astype(np.uint64) * _ODD[2]
    rows = table.reshape(len(lines), BANDS, SLOTS // BANDS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[0], (len(lines), BANDS))
    for k in range(SLOTS // BANDS):
        keys = _mixed(keys * _ODD[2] + rows[:, :, k])
    return keys


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``line, doc_id, text_hash, line_no, keys`` (packed) of every line with a word, staged."""
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    ).where("text is not null")
    id_type = source.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in text_batches(texts, 1_000_000):
                lines, doc, number = [], [], []
                for k in range(a, b):
                    for n, line in enumerate(texts[k].split("\n")):
                        if line and not line.isspace():
                            lines.append(line)
                            doc.append(k)
                            number.append(n)
                if not lines:
                    continue
                ids = np.array([xxh64_intdigest(line.encode(), 42) for line in lines], np.uint64).view(np.int64)
                keys = np.ascontiguousarray(band_keys(lines)).view(np.uint8).reshape(len(lines), -1)
                offsets = np.arange(len(lines) + 1, dtype=np.int32) * keys.shape[1]
                packed = pa.Array.from_buffers(pa.binary(), len(lines), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())])
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), packed],
                    names=["line", "doc_id", "text_hash", "line_no", "keys"],
                )

    return staged(source.mapInArrow(read, f"line long, doc_id {id_type}, text_hash long, line_no int, keys binary"), "lines")


def _distinct(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries ``key, line`` sorted and without copies, and the first and last place of each key."""
    entries = entries[np.argsort(entries[:, 0])]
    again = entries[1:, 0] == entries[:-1, 0]
    if again.any():
        # only keys of several entries are sorted by line
        several = np.flatnonzero(np.append(again, False) | np.append(False, again))
        part = entries[several]
        entries[several] = part[np.lexsort((part[:, 1].view(np.int64), part[:, 0]))]
        entries = entries[np.append(True, ~again | (entries[1:, 1] != entries[:-1, 1]))]
    return entries, *_places(entries)


def _places(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last place of each key of sorted entries."""
    first = np.flatnonzero(np.append(True, entries[1:, 0] != entries[:-1, 0])[: len(entries)])
    return first, np.append(first[1:], len(entries))[: len(first)]


def _stable_order(x: np.ndarray, bound: int) -> np.ndarray:
    """The stable order of whole numbers from 0 to below ``bound``; few of them are sorted by their digits."""
    return np.argsort(x.astype(np.uint16) if bound <= 1 << 16 else x, kind="stable")


def _dealt(entries: np.ndarray, buckets: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``entries, bucket, large``: keys with more than ``most`` lines are large; these lie in buckets of their
    own, by line, and one entry of each tells the bucket of the key."""
    entries, first, ends = _distinct(entries)
    large = np.repeat(ends - first > most, ends - first)
    told = entries[first[ends - first > most]]
    by_key = (entries[:, 0] % np.uint64(buckets)).astype(np.int64)
    by_line = (_mixed(entries[:, 1] + entries[:, 0]) % np.uint64(buckets)).astype(np.int64) + buckets
    bucket = np.append(np.where(large, by_line, by_key), (told[:, 0] % np.uint64(buckets)).astype(np.int64))
    return np.concatenate([entries, told]), bucket, np.append(large, np.ones(len(told), bool))


def _grouped(entries: np.ndarray, first: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(cell, lines)`` of every key with two or more lines; equal sets of lines have the same cell."""
    from xxhash import xxh64_intdigest

    lines = entries[:, 1].view(np.int64)
    for a, b in zip(first[ends - first > 1].tolist(), ends[ends - first > 1].tolist(), strict=True):
        members = np.ascontiguousarray(lines[a:b])
        yield xxh64_intdigest(members.tobytes()) - (1 << 63), members


def candidate_cells(lines: DataFrame) -> DataFrame:
    """``cell, part, line``: lines to be compared with each other, staged; cells of part -1 are keys that may have more than ``CELL``."""
    spark = lines.sparkSession
    buckets = max(shuffle_partitions(spark), -(-lines.count() * BANDS * 16 // BUCKET_BYTES))
    most, dealt, limit = CELL, min(DEALT, CELL), BUCKET_BYTES

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: list[np.ndarray]) -> pa.RecordBatch:
            entries, bucket, large = _dealt(np.concatenate(held), buckets, dealt)
            order = _stable_order(2 * bucket + large, 4 * buckets)
            entries, bucket, large = entries[order], bucket[order], large[order]
            first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (large[1:] != large[:-1])))
            blobs = [part.tobytes() for part in np.split(entries, first[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[first]), pa.array(large[first]), pa.array(blobs, pa.binary())], names=["bucket", "large", "blob"]
            )

        held, total = [], 0
        for batch in batches:
            ids, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            if not len(ids):
                continue
            # keys of all lines are equally long
            keys = np.frombuffer(batch.column(1).take(pa.array(at)).buffers()[2], np.uint64, len(ids) * BANDS)
            held.append(np.column_stack([keys, np.repeat(ids.view(np.uint64), BANDS)]))
            total += held[-1].nbytes
            if total >= SENT_BYTES:
                yield sent(held)
                held, total = [], 0
        if held:
            yield sent(held)

    def collided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(cell: np.ndarray, part: int, line: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(cell.astype(np.int64)), pa.array(np.full(len(cell), part)), pa.array(line.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["cell", "part", "line"])

        def apart(held: list[np.ndarray], known: set[int]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
            """The lines of large keys, and the entries of the others with the places of their keys."""
            entries, first, ends = _distinct(np.concatenate(held))
            large = ends - first > most
            known.update(entries[first[large], 0].tolist())
            if known:
                large |= np.isin(entries[first, 0], np.fromiter(known, np.uint64, len(known)))
            own = np.repeat(large, ends - first)
            out = rows(entries[own, 0].view(np.int64), -1, entries[own, 1].view(np.int64))
            return out, entries[~own], *_places(entries[~own])

        def cells(held: list[np.ndarray], known: set[int]) -> Iterator[pa.RecordBatch]:
            out, entries, first, ends = apart(held, known)
            yield out
            found = list(_grouped(entries, first, ends))
            if found:
                sizes = [len(m) for _, m in found]
                yield rows(np.repeat(np.array([c for c, _ in found], np.int64), sizes), 0, np.concatenate([m for _, m in found]))

        current, held, known, total, bound = None, [], set(), 0, limit
        for batch in batches:
            for bucket, large, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                entries = np.frombuffer(blob.as_py(), np.uint64).reshape(-1, 2)
                if bucket != current:
                    if held:
                        yield from cells(held, known)
                    current, held, known, total, bound = bucket, [], set(), 0, limit
                if large:
                    known.update(entries[:, 0].tolist() if bucket < buckets else ())
                    yield rows(entries[:, 0].view(np.int64), -1, entries[:, 1].view(np.int64))
                    continue
                held.append(entries)
                total += entries.nbytes
                if total > bound:
                    out, entries, _, _ = apart(held, known)
                    yield out
                    held, total = [entries], entries.nbytes
                    bound = max(limit, 2 * total)
        if held:
            yield from cells(held, known)

    return staged(
        lines.select("line", "keys")
        .mapInArrow(packed, "bucket long, large boolean, blob binary")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(collided, "cell long, part long, line long")
        .distinct(),
        "line-cells",
    )


def _shingles(text: str) -> set[str]:
    return {text[k : k + SHINGLE] for k in range(max(1, len(text) - SHINGLE + 1))}


def _likeness(texts: list[str], leaders: list[str]) -> np.ndarray:
    """``(len(texts), len(leaders))`` exact Jaccard similarities of shingle sets."""
    n = len(leaders) + len(texts)
    bits = n.bit_length()
    line, name = _shingle_names([*leaders, *texts], bits)
    entries = np.sort((name << bits) | line)
    entries = entries[np.append(True, entries[1:] != entries[:-1])]
    line = entries & ((1 << bits) - 1)
    group = np.cumsum(np.append(True, (entries[1:] >> bits) != (entries[:-1] >> bits))) - 1
    sizes, both = np.bincount(line, minlength=n), np.empty((n, len(leaders)), np.int64)
    for k in range(len(leaders)):
        held = np.zeros(group[-1] + 1, bool)
        held[group[line == k]] = True
        both[:, k] = np.bincount(line[held[group]], minlength=n)
    return (both / (sizes[:, None] + sizes[: len(leaders)] - both))[len(leaders) :]


def _led(members: DataFrame, similarity: float) -> DataFrame:
    """``cell, line, near, away, joined`` of ``members(cell, line, text, leaders)``: the leaders linked to the line,
    its distance from each, and whether it is in the class of each.  Lines of a cell that follow each other are
    compared together."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, named, classes = None, [], np.zeros(0, np.int64)
        for batch in batches:
            near, away, joined = [], [], []
            cells, texts = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            chars = np.cumsum(list(map(len, texts))) // VERIFIED_CHARS
            cuts = (np.flatnonzero((cells[1:] != cells[:-1]) | (chars[1:] != chars[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True) if texts else ():
                if cells[a] != cell:
                    cell, named = cells[a], [(x["line"], x["text"]) for x in batch.column(3)[a].as_py()]
                    classes = np.array(linked_in_cell([t for _, t in named], similarity), np.int64)
                alike = _likeness(texts[a:b], [t for _, t in named])
                linked = alike >= similarity
                near += [[named[k][0] for k in np.flatnonzero(x)] for x in linked]
                away += (1 - alike).tolist()
                joined += (linked.astype(np.int64) @ (classes[:, None] == classes) > 0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near, pa.list_(pa.int64())), pa.array(away, pa.list_(pa.float64()))]
                + [pa.array(joined, pa.list_(pa.bool_()))],
                names=["cell", "line", "near", "away", "joined"],
            )

    schema = "cell long, line long, near array<long>, away array<double>, joined array<boolean>"
    return members.select("cell", "line", "text", "leaders").mapInArrow(compare, schema)


def _dealt_parts(led: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cell, part, line`` of the cells that give at most :data:`COPIES` rows a line, and ``cell`` of them.

    The largest class of a leader is linked already, so only the lines outside
    it have to meet all others: both are dealt to parts of half a cell, and each
    pair of parts but those of the class alone is compared.
    """
    half = max(1, CELL // 2)
    joined = [F.coalesce(F.get("joined", F.lit(k)), F.lit(False)) for k in range(LEADERS)]
    classes = led.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(x) for x in joined]).alias("of"))
    classes = classes.withColumn("most", F.array_max("of")).where("most > 0")
    outside, inside = F.ceil((F.col("n") - F.col("most")) / half), F.ceil(F.col("most") / half)
    classes = classes.select("cell", "n", "most", F.array_position("of", F.col("most")).cast("int").alias("best"), outside.alias("outside"), inside.alias("inside"))
    rows = F.col("most") * F.col("outside") + (F.col("n") - F.col("most")) * (F.col("outside") + F.col("inside") - 1)
    dealt = staged(classes.where(rows <= COPIES * F.col("n")), "line-dealt-cells")
    lines = led.join(if_small(dealt, row_bytes=48), "cell").where("outside > 0")
    within = F.coalesce(F.get("joined", F.col("best") - 1), F.lit(False))
    place = F.xxhash64("line", F.lit("dealt"))
    parts = F.col("outside") + F.col("inside")
    lines = lines.select(
        "cell", "line", parts.alias("parts"), within.alias("within"), "outside",
        F.when(within, F.col("outside") + F.pmod(place, "inside")).otherwise(F.pmod(place, "outside")).alias("own"),
    )
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("within"), F.col("outside")).otherwise(F.col("parts")) - 1)
    pairs = lines.select("cell", "line", "parts", "own", F.explode(others).alias("other")).where("own <> other")
    part = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
    return pairs.select("cell", part.alias("part"), "line"), dealt.select("cell")


def rare_cells(large: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``cell, line``: the lines of each cell of ``large(cell, line)`` dealt to cells of a shared rare shingle.

    Prefix filtering, which is exact: of ``m`` shingles, ordered by the lines of
    the cell that hold them, the first ``m - ceil(similarity * m) + 1`` can't
    all be missing from a line that links.  A line gives as many rows as it has
    such shingles that another line holds too.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            named = [[xxh64_intdigest(x.encode(), 42) - (1 << 63) for x in _shingles(t)] for t in batch.column(2).to_pylist()]
            names = pa.array(named, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names], names=["cell", "line", "names"])

    lines = large.join(texts, "line").select("cell", "line", "text")
    lines = lines.mapInArrow(read, "cell long, line long, names array<long>")
    held = staged(lines.select("cell", "line", F.explode("names").alias("name")), "line-shingles")
    times = staged(held.groupBy("cell", "name").agg(F.count(F.lit(1)).alias("times")), "line-shingle-times")
    # shingles of many lines, a few rows, are not joined by a shuffle on their own key
    common, key = if_small(times.where(F.col("times") > CELL), row_bytes=24), ["cell", "name"]
    others = held.join(common, key, "left_anti").join(times.where(F.col("times") <= CELL), key)
    ordered = held.join(common, key).unionByName(others).groupBy("cell", "line").agg(F.sort_array(F.collect_list(F.struct("times", "name"))).alias("names"))
    many = F.size("names")
    first = F.slice("names", 1, (many - F.ceil(many * F.lit(similarity) - 1e-9) + 1).cast("int"))
    rare = ordered.select("cell", "line", F.explode(first).alias("x")).where("x.times > 1")
    return rare.select(F.xxhash64("cell", "x.name").alias("cell"), "line")


def led_links(large: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame | None, DataFrame | None]:
    """Links ``a, b`` found from leaders in cells ``large(cell, line)``, and ``cell, part, line`` of what is left to compare.

    A line is done when it was a leader, or when it is in a leader's class and,
    by its distance from the leader, no line outside that class can link to it.
    """
    links = cells = None

    def added(a: DataFrame | None, b: DataFrame) -> DataFrame:
        return b if a is None else a.unionByName(b)

    for n in range(ROUNDS + 1):
        digest = F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("digest")
        sizes = large.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), digest).where("n > 1")
        # the same lines may share several keys
        sizes = staged(sizes.groupBy("n", "digest").agg(F.min("cell").alias("cell")).select("cell", "n"), "line-cell-sizes")
        if sizes.isEmpty():
            break
        sized = staged(large.join(if_small(sizes, row_bytes=24), "cell"), "line-cell-members")
        cells = added(cells, sized.where(F.col("n") <= CELL).select("cell", F.lit(0).cast("long").alias("part"), "line"))
        sized = sized.where(F.col("n") > CELL)
        if sized.isEmpty():
            break
        if n == ROUNDS:
            sharing = staged(rare_cells(sized.select("cell", "line"), texts, similarity), "line-rare-cells")
            sizes = sharing.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), digest).where("n > 1")
            sizes = staged(sizes.groupBy("n", "digest").agg(F.min("cell").alias("cell")).select("cell", "n"), "line-rare-sizes")
            sized = staged(sharing.join(if_small(sizes, row_bytes=24), "cell"), "line-rare-members")
            cells = added(cells, sized.where(F.col("n") <= CELL).select("cell", F.lit(0).cast("long").alias("part"), "line"))
            sized = sized.where(F.col("n") > CELL)
            parts = F.ceil(F.col("n") / CELL)
            own, other = F.pmod(F.xxhash64("line", F.lit("part")), parts), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
            pairs = sized.select("cell", "line", parts.alias("parts"), own.alias("own"), other.alias("other")).where("own <> other")
            cells = added(cells, pairs.select("cell", (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("part"), "line"))
            break
        drawn = sized.withColumn("order", F.xxhash64("line", F.lit(n))).where(F.pmod("order", "n") < 4 * LEADERS)
        first = drawn.withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy("order", "line"))).where(F.col("at") <= LEADERS)
        leaders = staged(
            first.select("cell", "line").join(texts, "line").groupBy("cell").agg(F.collect_list(F.struct("line", "text")).alias("leaders")),
            "line-leaders",
        )
        leader_bytes = F.lit(40) + F.aggregate("leaders", F.lit(0), lambda sum, x: sum + F.length(x["text"]) * 4 + 40)
        # lines of one cell lie together
        dealt = sized.select("cell", "line", F.pmod(F.xxhash64("line"), F.ceil(F.col("n") / CELL)).alias("part")).join(texts, "line")
        dealt = dealt.repartition(shuffle_partitions(dealt.sparkSession), "cell", "part").sortWithinPartitions("cell")
        members = dealt.join(if_small(leaders, bytes_of=leader_bytes), "cell", "left")
        led = staged(_led(members.withColumn("leaders", F.coalesce("leaders", F.array())), similarity), "line-led")
        links = added(links, led.select(F.col("line").alias("a"), F.explode("near").alias("b")).where("a <> b"))
        parts, settled = _dealt_parts(led)
        cells = added(cells, parts)
        led = led.join(if_small(settled, row_bytes=16), "cell", "left_anti")
        outside = [F.min(F.when(~F.get("joined", F.lit(k)), F.get("away", F.lit(k)))) for k in range(LEADERS)]
        nearest = staged(led.groupBy("cell").agg(F.array(*outside).alias("outside")), "line-outside")
        done = F.array_contains("near", F.col("line"))
        for k in range(LEADERS):
            at = F.lit(k)
            clear = F.get("outside", at).isNull() | (F.get("away", at) + (1 - similarity) + 1e-9 < F.get("outside", at))
            done |= F.coalesce(F.get("joined", at) & clear, F.lit(False))
        large = staged(led.join(if_small(nearest, row_bytes=16 + 8 * LEADERS), "cell").where(~done).select("cell", "line"), "line-unled")
    return links, cells


def _numbered(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The number, from 0, of each value among the distinct ones, and how many these are."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


def _shingle_names(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``line, name`` of every shingle; equal shingles, and no others, have equal names, of up to ``63 - bits`` bits."""
    # no line holds a line feed, so filling up with it keeps short lines apart
    text = "".join(t.ljust(SHINGLE, "\n") for t in texts)
    names, bound = _numbered(np.frombuffer(text.encode("utf-32-le"), "<u4"))
    for step in (1, 2, 4):
        if bound * bound >= 1 << (63 - bits):
            names, bound = _numbered(names)
        names, bound = names[:-step] * bound + names[step:], bound * bound
    if bound >= 1 << (63 - bits):
        names, _ = _numbered(names)
    lengths = np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)), SHINGLE)
    counts = lengths - SHINGLE + 1
    shift = np.cumsum(lengths) - lengths - (np.cumsum(counts) - counts)
    return np.repeat(np.arange(len(texts)), counts), names[np.repeat(shift, counts) + np.arange(int(counts.sum()))]


def _odd(line: np.ndarray, begins: np.ndarray, widths: np.ndarray, head: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``line, widths, held`` of groups turned odd: one that more than half of its cell's lines hold gives the lines
    without it in place of those with it.  The first ``held`` groups are as they were, the turned ones follow.

    Two lines differ in as many groups before as after, and lines about one template have few odd groups.
    """
    turned = 2 * widths > members[line[begins]]
    inside = np.repeat(turned, widths)
    first, span = head[line[begins[turned]]], members[line[begins[turned]]]
    offset = np.cumsum(span) - span
    lacking = np.ones(int(span.sum()), bool)
    lacking[line[inside] + np.repeat(offset - first, widths[turned])] = False
    places = np.flatnonzero(lacking)
    of = np.searchsorted(offset, places, side="right") - 1
    lines = np.concatenate([line[~inside], places - offset[of] + first[of]])
    return lines, np.append(widths[~turned], span - widths[turned]), int((~turned).sum())


def linked_lines(texts: list[str], cells: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """The place of the first line of each line's class, by exact Jaccard similarity of shingle sets.

    ``cells``, ascending from 0 without gaps, has each line's cell; lines link
    within a cell, and there all texts differ.  The line of a cell that is
    closest to what most of its lines hold is compared with all others; then
    those that are not linked to it are compared with every line of their cell,
    but for lines so much of their own that nothing can link to them.  Lines
    meet in the groups of :func:`_odd`, where a template's shingles are missing.
    """
    n = len(texts)
    if not n:
        return []
    bits = n.bit_length()
    line, name = _shingle_names(texts, bits)
    # entries (line, group) without copies: a group is a shingle of a cell, its lines ascend
    # in the order of names, which keeps the lines of a name, and so its cells, ascending
    entries = np.sort((name << bits) | line)
    entries = entries[np.append(True, entries[1:] != entries[:-1])]
    name, line = entries >> bits, entries & ((1 << bits) - 1)
    own = cells[line]
    begins = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (own[1:] != own[:-1])))
    widths = np.diff(np.append(begins, len(line)))
    sizes = np.bincount(line, minlength=n)
    heads = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    head, members = heads[cells], np.bincount(cells)[cells]
    most = np.bincount(own[begins[2 * widths > members[line[begins]]]], minlength=len(heads))[cells]
    line, widths, held = _odd(line, begins, widths, head, members)
    odd = np.bincount(line, minlength=n)
    # a group of one line sets it apart from every other line of its cell
    ends = np.cumsum(widths)
    alone = widths == 1
    extra = np.bincount(line[ends[:held][alone[:held]] - 1], minlength=n)
    missing = np.bincount(line[ends[held:][alone[held:]] - 1], minlength=n)
    apart = sizes - extra < similarity * (sizes + missing) - 1e-9
    line, widths = line[np.repeat(widths > 1, widths)], widths[widths > 1]
    group = np.repeat(np.arange(len(widths)), widths)
    begins = np.cumsum(widths) - widths
    by_line = _stable_order(line, n)
    spans = np.bincount(line, minlength=n)
    span_ends = np.cumsum(spans)
    works = np.bincount(line, weights=widths[group], minlength=n).astype(np.int64)
    close = (sizes + most - odd) / (sizes + most + odd)
    closest = np.flatnonzero(close == np.maximum.reduceat(close, heads)[cells])
    centre = closest[np.unique(cells[closest], return_index=True)[1]]
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def compared(lines: np.ndarray) -> Iterator[tuple[int, int]]:
        """Linked pairs of ``lines``, ascending, with any line of their cells."""
        slots = np.maximum(np.cumsum(works[lines]), np.cumsum(members[lines])) // COMPARED
        for part in np.split(lines, np.flatnonzero(np.diff(slots)) + 1):
            span = spans[part]
            at = group[by_line[np.repeat(span_ends[part] - np.cumsum(span), span) + np.arange(int(span.sum()))]]
            reach = widths[at]
            other = line[np.repeat(begins[at] - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))]
            place = np.repeat(np.repeat(np.cumsum(members[part]) - members[part] - head[part], span), reach) + other
            met = np.bincount(place, minlength=int(members[part].sum()))
            left = np.repeat(part, members[part])
            right = np.arange(len(left)) + np.repeat(head[part] - (np.cumsum(members[part]) - members[part]), members[part])
            both = (sizes[left] + sizes[right] - odd[left] - odd[right]) // 2 + met
            alike = (both >= similarity * (sizes[left] + sizes[right] - both)) & (left != right)
            yield from zip(left[alike].tolist(), right[alike].tolist(), strict=True)

    def join(lines: np.ndarray) -> None:
        for a, b in compared(lines) if len(lines) else ():
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)

    join(centre[(members[centre] > 1) & ~apart[centre]])
    near = [root(k) for k in centre.tolist()]
    rest = np.flatnonzero((members > 2) & ~apart)
    join(np.array([k for k, c in zip(rest.tolist(), cells[rest].tolist(), strict=True) if root(k) != near[c]], np.int64))
    return [root(k) for k in range(n)]


def linked_in_cell(texts: list[str], similarity: float = SIMILARITY) -> list[int]:
    """The place of each distinct text's class among the texts of one cell."""
    return linked_lines(texts, np.zeros(len(texts), np.int64), similarity)


def verified_links(cells: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` of linked lines, enough to connect each class within its cell."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(lines: list[int], texts: list[str], numbers: list[int]) -> pa.RecordBatch:
            roots = linked_lines(texts, np.array(numbers, np.int64), similarity)
            pairs = [(lines[k], lines[r]) for k, r in enumerate(roots) if k != r]
            columns = [pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        current, lines, held, numbers, chars = None, [], [], [], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for cell, part, line, text in zip(*columns, strict=True):
                if (cell, part) != current and chars > VERIFIED_CHARS:
                    yield edges(lines, held, numbers)
                    lines, held, numbers, chars = [], [], [], 0
                numbers.append(numbers[-1] + ((cell, part) != current) if numbers else 0)
                current = (cell, part)
                lines.append(line)
                held.append(text)
                chars += len(text)
        if lines:
            yield edges(lines, held, numbers)

    joined = cells.join(texts, "line").select("cell", "part", "line", "text")
    n = shuffle_partitions(cells.sparkSession)
    return joined.repartition(n, "cell", "part").sortWithinPartitions("cell", "part").mapInArrow(verify, "a long, b long")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept_text, n_lines, n_removed``.

    Of the lines of a class, in all documents, the first by document id, text
    hash and line number stays (a null id comes first); the others go.  Lines
    without a word are never removed.  A null text stays null, with no lines.
    Rows of equal id and text are one document, each keeping its lines.
    Columns of the input that have the new names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_removed")]
    own_id, own_text, gone, split = free_names(kept, "__id", "__text", "__gone", "__lines")
    lines = line_table(docs, id_col, text_col)
    cells = candidate_cells(lines)
    wanted = staged(cells.select("line").distinct(), "line-candidates")
    texts = docs.select(F.explode(F.split(F.col(text_col), "\n", -1)).alias("text")).select(F.xxhash64("text").alias("line"), "text")
    listed = if_small(wanted, row_bytes=16)
    if listed is wanted:
        # few lines without a candidate's hash are shuffled
        texts = maybe_listed(texts, "line", wanted, "line", FILTER_WORDS)
    texts = texts.join(listed, "line", "left_semi").groupBy("line").agg(F.first("text").alias("text"))
    large = cells.where("part = -1").select("cell", "line")
    cells, links = cells.where("part <> -1"), None
    if not large.isEmpty():
        texts = staged(texts, "line-texts")
        links, rest = led_links(large, texts, similarity)
        cells = cells if rest is None else cells.unionByName(rest)
    verified = verified_links(cells, texts, similarity)
    classes = staged(connected_components(verified if links is None else verified.unionByName(links)), "line-classes")
    occurrences = (
        lines.select("line", "doc_id", "text_hash", "line_no")
        .join(if_small(classes.select(F.col("node").alias("line"), "component"), row_bytes=24), "line", "left")
        .select(F.coalesce("component", "line").alias("class"), "doc_id", "text_hash", "line_no")
    )
    several = staged(occurrences.groupBy("class").count().where("count > 1").select("class"), "line-repeats")
    repeated = staged(
        occurrences.join(if_small(several, row_bytes=16), "class").withColumn("at", F.struct("doc_id", "text_hash", "line_no")), "line-occurrences"
    )
    first = staged(repeated.groupBy("class").agg(F.min("at").alias("first")), "line-first")
    removed = staged(
        repeated.join(if_small(first, row_bytes=48), "class")
        .where(~F.col("at").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_text))
        .agg(F.collect_set("line_no").alias(gone)),
        "line-removed",
    )
    joined = docs.select(*kept).join(
        if_small(removed, bytes_of=F.lit(40) + 4 * F.size(gone)),
        F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_text)),
        "left",
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    n_lines = F.coalesce(F.size(split), F.lit(0))
    return (
        joined.withColumn(split, F.split(F.col(text_col), "\n", -1))
        .withColumn(
            "kept_text",
            F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(
                F.array_join(F.transform(stay, lambda k: F.get(split, k)), "\n")
            ),
        )
        .withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n_lines).cast("long"))
        .withColumn("n_removed", F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long"))
        .select(*kept, "kept_text", "n_lines", "n_removed")
    )
