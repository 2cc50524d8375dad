"""A Bloom filter as a table (J1-J4 with a list too large to broadcast).

A join of transactions with a large list of addresses has to shuffle them, and
most transactions go to addresses that are not listed.  The list's Bloom
filter is a small fraction of the list: every address sets four bits of one
64-bit word, chosen by its hash.  The words are a table of (word, bits), made
by one distributed aggregate, and broadcast; testing a row is one lookup in a
hash join with a condition, inside whole-stage codegen, where the row is read.
A listed address always passes; an unlisted one does for about one row in a
hundred, and the join behind the filter drops it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each distinct address, until the filter is as large as it may get.
BITS_PER_KEY = 16
#: Most words of 64 bits; in a broadcast hash table each takes about 32 bytes.
MAX_WORDS = 1 << 21
#: With fewer bits than this for each address the filter excludes too little to be worth a lookup.
LEAST_BITS_PER_KEY = 4
_TESTS = 4


def _word_and_bits(key: Column, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    bits = F.lit(0).cast("bigint")
    for t in range(_TESTS):
        place = F.shiftrightunsigned(h, 6 * t).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return F.shiftrightunsigned(h, 6 * _TESTS) % F.lit(words), bits


def bloom_filter(keys: DataFrame, key: str, max_words: int = MAX_WORDS) -> tuple[DataFrame, int] | None:
    """``(_word, _bits)`` over ``keys[key]`` and the number of words; None where even the largest filter excludes too little.

    Its size follows the number of distinct keys (estimated by one distributed
    aggregate), up to ``max_words`` rows.  Null keys are in no filter.
    """
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    words = 1
    while 64 * words < BITS_PER_KEY * n and words < max_words:
        words *= 2
    if 64 * words < LEAST_BITS_PER_KEY * n:
        return None
    word, bits = _word_and_bits(F.col(key), words)
    set_bits = keys.where(F.col(key).isNotNull()).select(word.alias("_word"), bits.alias("_bits"))
    return set_bits.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")), words


def maybe_listed(rows: DataFrame, key: str, listed: DataFrame, listed_key: str, max_words: int = MAX_WORDS) -> DataFrame:
    """The ``rows`` whose ``key`` may be among ``listed[listed_key]``: all that are, and few others."""
    found = bloom_filter(listed, listed_key, max_words)
    if found is None:
        return rows
    table, words = found
    word, bits = _word_and_bits(rows[key], words)
    # the number of words bounds the broadcast, however long the list
    passes = (word == table["_word"]) & (table["_bits"].bitwiseAND(bits) == bits)
    return rows.join(F.broadcast(table), passes, "left_semi")
