"""Canonical, length-limited Huffman coding of ids, on arrays.

Bits are stored most significant first.  A stream carries checkpoints - the
bit offset of every ``EVERY``-th id - and a decoder advances all of them side
by side with one table look-up per id.
"""

from __future__ import annotations

import numpy as np

#: Longest code; 2**18 table entries hold every code of a 50k vocabulary.
MAX_BITS = 18
#: Ids between two checkpoints.
EVERY = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    packages, levels = np.empty(0), []
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        by_weight = np.argsort(merged, kind="stable")
        levels.append(by_weight < n)
        merged = merged[by_weight]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Codes of ``symbols`` (ascending) with ``lengths`` bits each."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.symbols, self.lengths = np.asarray(symbols, np.int64), np.asarray(lengths, np.int64)
        self.bits = int(self.lengths.max(initial=1))
        # canonical: codes ascend by length, then by symbol; left-aligned they simply follow each other
        order = np.lexsort((self.symbols, self.lengths))
        spans = 1 << (self.bits - self.lengths[order])
        ends = np.cumsum(spans)
        size = int(self.symbols.max(initial=0)) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.length[self.symbols[order]] = self.lengths[order]
        self.code[self.symbols[order]] = ((ends - spans) >> (self.bits - self.lengths[order])).astype(np.uint64)
        self.table = np.zeros(1 << self.bits, np.int64)
        entries = (self.symbols[order] << 6) | self.lengths[order]
        self.table[: int(ends[-1]) if len(ends) else 0] = np.repeat(entries, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream, and the bit offset of every ``EVERY``-th id."""
        data, _, marks = self.encode_all(ids, np.array([len(ids)]))
        return data, marks

    def encode_all(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bit streams of ``counts[k]`` ids each, from byte boundaries, one behind another; the byte where each
        ends; and the bit offset, in its stream, of every ``EVERY``-th id of a stream."""
        counts = np.asarray(counts, np.int64)
        if not len(ids):
            return b"", np.zeros(len(counts), np.int64), np.empty(0, np.int64)
        size = self.length[ids]
        if not size.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(size)
        behind = np.cumsum(counts)
        bits = np.diff(np.concatenate([[0], ends])[behind], prepend=0)
        bounds = np.cumsum((bits + 7) >> 3)
        first = (bounds - ((bits + 7) >> 3)) << 3
        begins = ends - size + np.repeat(first - (np.cumsum(bits) - bits), counts)
        word, at = begins >> 5, begins & 31
        # a code lies in one 32-bit word or runs into the next; codes don't overlap, so adding is joining
        value = self.code[ids] << (64 - size - at).astype(np.uint64)
        words = np.zeros((int(bounds[-1]) >> 2) + 2, np.uint64)
        new = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[new]] += np.add.reduceat(value >> np.uint64(32), new)
        words[word[new] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), new)
        lanes = -(-counts // EVERY)
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        marks = begins[np.repeat(behind - counts, lanes) + nth * EVERY] - np.repeat(first, lanes)
        return words.astype(">u4").tobytes()[: int(bounds[-1])], bounds, marks

    def decode(self, streams: list[bytes], checkpoints: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        """All ids of the streams, one stream after another."""
        counts = np.asarray(counts, np.int64)
        if not counts.sum():
            return np.empty(0, np.uint32)
        sizes = np.fromiter(map(len, streams), np.int64, len(streams))
        data = np.frombuffer(b"".join(streams) + bytes(8), np.uint8).astype(np.uint32)
        ahead = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        lanes = -(-counts // EVERY)
        bit = np.concatenate(checkpoints) + np.repeat((np.cumsum(sizes) - sizes) * 8, lanes)
        nth = np.arange(len(bit)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        left = np.minimum(EVERY, np.repeat(counts, lanes) - nth * EVERY)
        order = np.argsort(-left, kind="stable")
        bit, held = bit[order], left[order]
        active = np.searchsorted(-held, -np.arange(EVERY), side="left")  # lanes with more than j ids
        out = np.zeros((len(bit), EVERY), np.uint32)
        mask = (1 << self.bits) - 1
        for j in range(int(held[0])):
            n = active[j]
            p = bit[:n]
            entry = self.table[(ahead[p >> 3] >> (32 - self.bits - (p & 7)).astype(np.uint32)) & mask]
            out[:n, j] = entry >> 6
            bit[:n] = p + (entry & 63)
        back = np.empty_like(out)
        back[order] = out
        return back[np.arange(EVERY) < left[:, None]]
