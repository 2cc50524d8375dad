"""Batch encoding with a public tokenizer, inside tasks.

A byte-level BPE first splits a text into pre-tokens, and some places are
always between two of them: before a space or line break that follows no
other white space, between a Latin letter and a printable ASCII character that
is none, and behind a single line break.  A text may therefore be cut there and
its pieces encoded on their own, and a piece that came before needs no second
encoding.  A piece of letters is one pre-token, so the library's BPE model takes
it directly, many at once with a byte between them that no merge has; any other
piece goes through the library's whole pipeline.  Every id comes from the
tokenizers library; the memory of pieces is bounded and only saves time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of pieces that a worker remembers; beyond, those met least are forgotten.
MEMORY_BYTES = 144 << 20
#: Characters (or bytes, of a column) encoded at once; bounds a task's memory, not its result.
BATCH_CHARS = 1_500_000
#: About what a remembered piece takes: its text and its entry in a dictionary; and a list place in the arrays beside.
PIECE_BYTES = 200
#: Words that the library's model takes in one string.
JOINED_WORDS = 200

# Latin letters, the same in every Unicode version, and a space before them
_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
# A byte-level vocabulary spells unprintable bytes as the characters from U+0100 on, in ascending order.
_UNPRINTABLE = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SPELLED = {chr(b): chr(256 + n) for n, b in enumerate(_UNPRINTABLE)}
# a byte that UTF-8 never has, spelled as itself; it stands between joined words
_BETWEEN = "\u00ff"

# what a byte tells of its character: printable ASCII or part of a longer one; an ASCII letter; a space or line break
_SOLID, _LETTER, _BREAK = 1, 2, 4
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = _KINDS[0x80:] = _SOLID
_KINDS[[b for b in range(128) if chr(b).isalpha()]] |= _LETTER
_KINDS[[0x0A, 0x20]] = _BREAK
# white space beyond ASCII, as the number that its bytes in UTF-8 make
_WIDE_SPACES = [int.from_bytes(chr(c).encode(), "big") for c in range(0x80, 0x3001) if chr(c).isspace()]

_ENCODERS: dict[str, PieceEncoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """Encodes lists of texts into one flat id array and its offsets."""

    def __init__(self, path: str, memory_bytes: int = MEMORY_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory_pieces = max(2, memory_bytes // PIECE_BYTES)
        split, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.byte_level = type(split).__name__ == "ByteLevel" and not self.tokenizer.normalizer
        self.byte_level = self.byte_level and split.use_regex and not split.add_prefix_space
        if self.byte_level:
            model._resize_cache(0)  # pieces are remembered here
        # the model alone, for words that are one pre-token each
        self.words = Tokenizer(model)
        self.between = model.token_to_id(_BETWEEN)
        plain = not (model.dropout or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix)
        alone = sum(_BETWEEN in t for t in self.tokenizer.get_vocab(with_added_tokens=False)) == 1
        self.joins = plain and not model.ignore_merges and self.between is not None and alone
        self.index: dict[str, int] = {}
        self.met = np.empty(1 << 14, np.int64)
        self.ids = np.empty(1 << 16, np.uint32)
        self.start = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int32)
        self.used = 0

    def _forget(self) -> None:
        """Keep the pieces met most since the last time, half of the memory at most."""
        n, least = len(self.index), 2
        while (kept := np.flatnonzero(self.met[:n] >= least)).size > self.memory_pieces // 2:
            least *= 2
        names = list(self.index)
        self.index = {names[k]: i for i, k in enumerate(kept.tolist())}
        size = self.size[kept].astype(np.int64)
        ends = np.cumsum(size)
        self.used = int(size.sum())
        self.ids[: self.used] = self.ids[_ranges(self.start[kept], size)]
        m = len(kept)
        self.start[:m], self.size[:m], self.met[:m] = ends - size, size, 0

    def _room(self, array: np.ndarray, need: int) -> np.ndarray:
        if need <= len(array):
            return array
        larger = np.empty(max(need, 2 * len(array)), array.dtype)
        larger[: len(array)] = array
        return larger

    def _encode(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words, and how many each has."""
        ids: list[int] = []
        for k in range(0, len(words), JOINED_WORDS):
            spelled = _spelled("\n".join(words[k : k + JOINED_WORDS]))
            ids += self.words.encode_batch_fast([spelled], add_special_tokens=False)[0].ids
            ids.append(self.between)
        flat = np.array(ids, np.uint32)
        ends = np.flatnonzero(flat == self.between)
        return flat[flat != self.between], np.diff(ends, prepend=-1) - 1

    def _learn(self, pieces: list[str]) -> None:
        words: list[str] = []
        rest: list[str] = []
        for p in pieces:
            (words if self.joins and _WORD.fullmatch(p) else rest).append(p)
        ids, sizes = self._encode_words(words)
        encoded = self._encode(rest)
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(encoded), np.uint32)])
        sizes = np.concatenate([sizes, np.fromiter(map(len, encoded), np.int64, len(encoded))])
        n, m = len(self.index), len(pieces)
        self.ids = self._room(self.ids, self.used + len(ids))
        self.start, self.size, self.met = (self._room(a, n + m) for a in (self.start, self.size, self.met))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + m], self.met[n : n + m] = sizes, 0
        self.index.update(zip(chain(words, rest), range(n, n + m), strict=True))
        self.used += len(ids)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and ``len(texts) + 1`` offsets."""
        if not self.byte_level:
            encoded = self._encode(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded], dtype=np.int64)])
            return np.fromiter(chain.from_iterable(encoded), np.uint32, int(offsets[-1])), offsets
        if len(self.index) > self.memory_pieces:
            self._forget()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        found, first = _pieces(column)
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [names[k] for k in missing.tolist()]
            self._learn(new)
            at[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        piece = found.indices.to_numpy()
        self.met[at] += np.bincount(piece, minlength=len(at))
        # the ids of this batch's pieces, close to each other
        size = self.size[at].astype(np.int64)
        ids = self.ids[_ranges(self.start[at], size)]
        begin, size = (np.cumsum(size) - size)[piece], size[piece]
        odd = np.zeros(len(column), bool)
        for token in self.special:
            odd |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if odd.any():
            size[np.repeat(odd, np.diff(first))] = 0
        offsets = np.concatenate([[0], np.cumsum(size)])[first]
        out = ids[_ranges(begin, size)]
        if not odd.any():
            return out, offsets
        whole = self._encode(column.filter(pa.array(odd)).to_pylist())
        per_text = np.diff(offsets)
        per_text[odd] = [len(e) for e in whole]
        offsets, taken = np.concatenate([[0], np.cumsum(per_text)]), out
        out = np.empty(int(offsets[-1]), np.uint32)
        inside = np.repeat(odd, per_text)
        out[~inside], out[inside] = taken, np.fromiter(chain.from_iterable(whole), np.uint32)
        return out, offsets


def _spelled(words: str) -> str:
    """Words with a line break between them, as a byte-level vocabulary spells their bytes."""
    if not words.isascii():
        words = words.encode().decode("latin-1")
        for byte, char in _SPELLED.items():
            if byte >= "\x7f":
                words = words.replace(byte, char)
    return words.replace(" ", _SPELLED[" "]).replace("\n", _BETWEEN)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size[k]`` numbers from ``start[k]`` on, for every ``k``."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _pieces(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All pieces of the texts, and the place of every text's first piece and of the end."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        kinds = _KINDS[data]
        if data.max() >= 0x80:
            _mark_wide(data, kinds)
        solid = (kinds & _SOLID) > 0
        # white space behind other characters; ASCII behind a letter; what follows a single line break
        cut[1:-1] = solid[:-1] & ((kinds[1:] & _BREAK) > 0)
        cut[1:-1] |= ((kinds[:-1] & _LETTER) > 0) & ((kinds[1:] & (_SOLID | _LETTER)) == _SOLID) & (data[1:] < 0x80)
        cut[2:-1] |= solid[:-2] & (data[1:-1] == 0x0A) & solid[2:]
    cut[bounds] = True
    ends = np.flatnonzero(cut).astype(np.int32)
    flat = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return flat.dictionary_encode(), np.searchsorted(ends, bounds)


def _mark_wide(data: np.ndarray, kinds: np.ndarray) -> None:
    """Tell Latin letters and white space beyond ASCII in the kinds of their bytes."""
    two = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
    code = data[two].astype(np.int64) << 8 | data[two + 1]
    kinds[two[(code <= 0xC98F) & (code != 0xC397) & (code != 0xC3B7)] + 1] |= _LETTER
    for lead, length in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        first = np.flatnonzero(data[: len(data) - length + 1] == lead)
        code = np.zeros(len(first), np.int64)
        for k in range(length):
            code = code << 8 | data[first + k]
        for k in range(length):
            kinds[first[np.isin(code, _WIDE_SPACES)] + k] = 0


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Free the encoders of this worker, before a step that needs none of them."""
    _ENCODERS.clear()


def text_batches(texts: list[str], most: int = BATCH_CHARS):
    """``(from, to)`` ranges of texts with about ``most`` characters each; a longer text stands alone."""
    return _batches(map(len, texts), most)


def column_batches(column: pa.Array, most: int = BATCH_CHARS):
    """The same of a column of texts, with about ``most`` bytes each."""
    return _batches(pc.binary_length(column).to_pylist(), most)


def _batches(sizes: Iterable[int], most: int):
    start = held = end = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most:
            yield start, k
            start, held = k, 0
        held += size
        end = k + 1
    if start < end:
        yield start, end
