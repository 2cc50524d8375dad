"""Mixing sources by temperature (operator 10), in built-in functions only.

Source *i* with a share ``s_i`` of the tokens gets the weight ``s_i ** a / sum(s ** a)``:
``a = 1`` keeps the corpus as it is, ``a = 0`` treats all sources alike.  The
exponent is found by bisection: the smallest at which no source is repeated
more than ``max_repetition`` times, or the largest at which the mixture's
entropy reaches ``target_entropy``.

Weights and budget give every source a number of passes over its documents.
Each pass is a permutation of its own: documents ordered by a hash of pass and
document.  Whole passes hold every document; the last, partial pass holds the
documents up to a cut in its order, found in two steps - by blocks of the hash
and then inside one block - so that no task sees a whole source.  The training
order deals all sources' passes evenly over ``mix_blocks`` blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.llm.common import free_names, staged

MAX_REPETITION = 1.5
STEPS = 40
#: Blocks of the hash within a source, and bits of the hash.
BUCKET_BITS, HASH_BITS = 12, 60
MIX_BLOCKS = 64
#: Names and numbers of sources are broadcast up to this many bytes, else joined.
BROADCAST_BYTES = 16 << 20
WHITE = "\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class Mixture:
    """``sources``: ``source, tokens, share, weight, passes``; ``budget`` in tokens."""

    exponent: float
    budget: float
    entropy: float
    sources: DataFrame


def token_count(text: Column) -> Column:
    """Words of a text, null for none: runs without ASCII white space."""
    words = F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda w: w != "")
    return F.coalesce(F.size(words).cast("long"), F.lit(0).cast("long"))


def pass_order(id_col: Column, epoch: Column, seed: int) -> Column:
    """A document's place in the permutation of a pass: 60 bits of a hash of seed, pass and id."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def temperature(
    totals: DataFrame,
    max_repetition: float = MAX_REPETITION,
    budget_tokens: float | None = None,
    target_entropy: float | None = None,
) -> Mixture:
    """Weights for ``totals(source, tokens)``.

    Without ``budget_tokens`` the budget is the smallest that holds every
    document at least once.  Sources without tokens weigh nothing and take one
    pass.  A budget above ``max_repetition`` times the corpus is cut to it.
    """
    corpus = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.where("tokens > 0").select((F.col("tokens") / F.lit(float(corpus or 1))).alias("s"))

    def at(a: float) -> tuple[float, float, float]:
        """Budget, largest number of passes and entropy at exponent ``a``."""
        power, passes = F.pow("s", F.lit(a)), F.pow("s", F.lit(a - 1))
        total, most, least, logs = shares.agg(F.sum(power), F.max(passes), F.min(passes), F.sum(power * F.log("s"))).first()
        if total is None:
            return 0.0, 1.0, 0.0
        budget = corpus * total / least if budget_tokens is None else min(float(budget_tokens), max_repetition * corpus)
        return budget, budget / corpus * most / total, math.log(total) - a * logs / total

    def fits(a: float) -> bool:
        _, most, entropy = at(a)
        return entropy < target_entropy if target_entropy is not None else most <= max_repetition

    # both conditions hold from some exponent on; low is where they don't, high where they do
    low, high = 0.0, 1.0
    if fits(0.0):
        high = 0.0
    elif not fits(1.0):
        low = 1.0
    else:
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
    exponent = low if target_entropy is not None and high else high
    budget, _, entropy = at(exponent)
    total = shares.agg(F.sum(F.pow("s", F.lit(exponent)))).first()[0] or 1.0
    share = F.col("tokens") / F.lit(float(corpus or 1))
    sources = totals.select(
        "source",
        "tokens",
        share.alias("share"),
        F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / F.lit(total)).otherwise(F.lit(0.0)).alias("weight"),
    )
    if budget_tokens is None:
        # relative to the source that is repeated least, so that it gets one pass exactly
        least = shares.agg(F.min(F.pow("s", F.lit(exponent - 1)))).first()[0] or 1.0
        passes = F.pow("share", F.lit(exponent - 1)) / F.lit(least)
    else:
        passes = F.lit(budget) * F.col("weight") / F.col("tokens")
    # bisection ends a little below a limit that is a whole number of passes
    passes = F.when(F.abs(passes - F.rint(passes)) < 1e-6, F.rint(passes)).otherwise(passes)
    passes = F.when(F.col("tokens") > 0, passes).otherwise(F.lit(1.0))
    return Mixture(exponent, budget, entropy, sources.withColumn("passes", passes))


def _cuts(light: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``source, passes, whole, cut``: whole passes, and the last place of the partial pass that is taken."""
    plan = sources.select(
        F.col("source").alias("name"),
        "passes",
        F.floor("passes").alias("whole"),
        ((F.col("passes") - F.floor("passes")) * F.col("tokens")).alias("quota"),
    )
    plan = staged(plan, "mix-plan")
    small = (plan.agg(F.sum(F.coalesce(F.length("name"), F.lit(0)) + 64)).first()[0] or 0) <= BROADCAST_BYTES
    hinted = F.broadcast(plan) if small else plan
    ordered = (
        light.join(hinted, F.col("source").eqNullSafe(F.col("name")))
        .where("quota > 0")
        .select("name", "quota", "tokens", pass_order(F.col("doc_id"), F.col("whole"), seed).alias("place"))
        .withColumn("bucket", F.shiftright("place", HASH_BITS - BUCKET_BITS))
    )
    buckets = ordered.groupBy("name", "bucket").agg(F.sum("tokens").alias("n"), F.first("quota").alias("quota"))
    so_far = F.sum("n").over(Window.partitionBy("name").orderBy("bucket"))
    # the first block that goes over the quota, and what is left of the quota there; without one, all is taken
    over = (
        buckets.withColumn("so_far", so_far)
        .where("so_far > quota")
        .groupBy("name")
        .agg(F.min(F.struct("bucket", "so_far", "n", "quota")).alias("b"))
        .select(
            F.col("name").alias("at"),
            F.col("b.bucket").alias("at_bucket"),
            (F.col("b.quota") - (F.col("b.so_far") - F.col("b.n"))).alias("left"),
        )
    )
    over = F.broadcast(over) if small else over
    inside = ordered.join(over, F.col("name").eqNullSafe(F.col("at")) & (F.col("bucket") == F.col("at_bucket")))
    running = Window.partitionBy("at", "at_bucket").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    cut = (
        inside.withColumn("so_far", F.sum("tokens").over(running))
        .groupBy("at", "at_bucket")
        .agg(F.max(F.when(F.col("so_far") <= F.col("left"), F.col("place"))).alias("last"))
        .select("at", F.coalesce("last", F.shiftleft("at_bucket", HASH_BITS - BUCKET_BITS) - 1).alias("cut"))
    )
    everything = F.lit((1 << HASH_BITS) - 1)
    return plan.join(cut, F.col("name").eqNullSafe(F.col("at")), "left").select(
        "name", "passes", "whole", F.when(F.col("quota") > 0, F.coalesce("cut", everything)).otherwise(F.lit(-1)).alias("cut")
    )


def mix_documents(
    docs: DataFrame,
    max_repetition: float = MAX_REPETITION,
    budget_tokens: float | None = None,
    target_entropy: float | None = None,
    seed: int = 0,
    mix_blocks: int = MIX_BLOCKS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with a row per use of a document, and ``epoch, mix_block, mix_order``.

    ``epoch`` numbers a source's passes from 0; sorting by ``mix_block,
    mix_order`` gives the training order.  A null source is a source of its
    own, a null text has no tokens, rows of the same id share a place and are
    taken or left together, and columns of the input that have the new names
    are replaced.  An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("epoch", "mix_block", "mix_order")]
    light = staged(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("tokens")),
        "mix-tokens",
    )
    totals = staged(light.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    mixture = temperature(totals, max_repetition, budget_tokens, target_entropy)
    name, passes, whole, cut, uses = free_names(docs.columns, "__name", "__passes", "__whole", "__cut", "__uses")
    cuts = staged(_cuts(light, mixture.sources, seed), "mix-cuts").toDF(name, passes, whole, cut)
    small = (cuts.agg(F.sum(F.coalesce(F.length(name), F.lit(0)) + 64)).first()[0] or 0) <= BROADCAST_BYTES
    joined = docs.select(*kept).join(F.broadcast(cuts) if small else cuts, F.col(source_col).eqNullSafe(F.col(name)))
    taken = F.col(whole) + F.when(pass_order(F.col(id_col), F.col(whole), seed) <= F.col(cut), 1).otherwise(0)
    used = joined.withColumn(uses, taken).where(F.col(uses) > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col(uses) - 1).cast("int"))))
    order = pass_order(F.col(id_col), F.col("epoch"), seed)
    progress = (F.col("epoch") + F.col("mix_order") / F.lit(float(1 << HASH_BITS))) / F.col(passes)
    return (
        used.withColumn("mix_order", order)
        .withColumn("mix_block", F.least(F.floor(progress * mix_blocks), F.lit(mix_blocks - 1)).cast("int"))
        .select(*kept, "epoch", "mix_block", "mix_order")
    )
