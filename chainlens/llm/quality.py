"""Quality rules as a bitmask ledger (operator 5), in built-in functions only.

:func:`rule_ledger` evaluates every rule once per document and stores the
measurements and one failure bit per rule.  A *policy* is a set of rules under
a version name; :func:`apply_policy` and :func:`ablations` work on the stored
bits alone, so a new policy needs no second look at the texts.

Repeated 8-word windows are found inside the row: windows become 64-bit hashes
(of their words' hashes), and only a row in which two are equal sorts them.
Nothing is exploded or shuffled; a row's work is its text's length, times its
logarithm for rows with repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: U+0009 to U+000D and the space.
WHITE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rules by bit, lowest first; each is true where the document fails it.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "exclamations": "4 * n_exclamations > n_words",
}

#: The rules each policy version enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}


def policy_mask(policy: str) -> int:
    return sum(1 << list(RULES).index(rule) for rule in POLICIES[policy])


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _equal(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the measurements and ``failures``, a bit per rule of :data:`RULES`.

    A null text has no words and one empty line; a null or repeated id is a
    document like any other; an empty table gives no rows.  Other columns of
    the input are not carried.
    """
    text = F.col("text")
    n = F.size("hashes")
    base = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("words", F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda w: w != ""))
        .withColumn("lines", F.split(text, "\n", -1))
        .withColumn("worded", F.filter("lines", lambda x: _without(x, WHITE) != ""))
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.length(_without(text, WHITE)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.length(text) - F.length(_without(text, "!"))).cast("long").alias("n_exclamations"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
            F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        )
        .withColumn(
            "windows",
            F.when(
                n >= WINDOW,
                F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))),
            ),
        )
        .withColumn("repeats", F.size("windows") > F.size(F.array_distinct("windows")))
        .withColumn(
            "ordered", F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        )
    )
    twice = F.filter(
        "ordered",
        lambda x, k: _equal(F.get("ordered", k - 1)["h"], x["h"]) | _equal(F.get("ordered", k + 1)["h"], x["h"]),
    )
    # a repeated window covers the words from where the one before it ends
    covered = F.transform(
        "places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(p - F.get("places", k - 1), F.lit(WINDOW))).cast("long")
    )
    measured = (
        base.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["i"])))
        .withColumn(
            "n_repeat_words",
            F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda total, x: total + x), F.lit(0).cast("long")),
        )
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines", "n_repeat_words")
    )
    failures = F.lit(0).cast("long")
    for bit, rule in enumerate(RULES.values()):
        failures = failures + F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
    return measured.withColumn("failures", failures)


def apply_policy(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``kept`` under ``policy``."""
    return ledger.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of ``policy``: documents that fail it, and those that it alone rejects.

    Documents are first counted by failure pattern, at most ``2 ** len(RULES)`` rows.
    """
    mask = policy_mask(policy)
    patterns = (
        ledger.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    )
    rules = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    )
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.bit_count("bits") == 1
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(failed & alone, F.col("n"))), F.lit(0)).alias("n_only"),
        )
    )
