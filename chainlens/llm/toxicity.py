"""A toxicity classifier that is fair to group mentions (operator 2).

A logistic model over the words of a text and the beginnings of its words.
*Counterfactual regularisation*: every labelled text that mentions a group is
paired with a copy in which each mention is swapped for another group, and with
one that mentions none, and the fit minimises

    log loss + l2 |w|^2 + fairness * mean((score of text - score of copy)^2)

(scores before the logistic function), so the model can't lean on who is
mentioned.  Groups are treated alike even where labels are not.

The fit sees a bounded sample of labelled rows (``max_labelled``), one text per
family of near copies and label, held-out rows left out; everything is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import id_text, staged

#: Labelled rows the model is fitted on, at most; they are those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Features of the model, at most.
MAX_FEATURES = 4096
#: A feature is in at least this many families, and in this share of the toxic (or the other) ones.
MIN_FAMILIES, MIN_SHARE = 3, 0.004
#: Standard errors between a feature's share among toxic and among other texts.
MIN_Z = 4.0
PREFIXES = (4, 5)
FAMILY_WORDS = 5

#: Words for groups, swapped in a ring within each line.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("immigrés", "réfugiés", "étrangers"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "atheisten"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros"),
)

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by feature: a word as it is, a beginning with a ``~`` behind it."""

    weights: dict[str, float]
    bias: float


def swapped_terms(terms: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    return {word: ring[(k + 1) % len(ring)] for ring in terms for k, word in enumerate(ring)}


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]


def text_words(text: str) -> set[str]:
    """The distinct words of a text: runs of letters, in lower case."""
    return {w for token in set(text.lower().split()) for w in _LETTERS.findall(token)}


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _family(text: str) -> int:
    """The smallest hash of a text's word shingles, which near copies mostly share."""
    words = text.lower().split()
    shingles = {" ".join(words[k : k + FAMILY_WORDS]) for k in range(max(1, len(words) - FAMILY_WORDS + 1))}
    from xxhash import xxh64_intdigest

    return min(xxh64_intdigest(s, 0) for s in shingles) - (1 << 63)


def _sample(docs: DataFrame, labels: DataFrame, terms: tuple, max_labelled: int) -> DataFrame:
    """``family, toxic, words, swapped, neutral``: one row per family and label; the copies' words are null without a mention."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("toxic")]
    chosen = known.orderBy(*order).limit(max_labelled)
    rows = docs.join(F.broadcast(chosen), "doc_id")  # max_labelled rows of two numbers
    ring = swapped_terms(terms)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 500):
                part = f.iloc[a : a + 500]
                words = [text_words(t) for t in part["text"]]
                mentions = [not ws.isdisjoint(ring) for ws in words]
                swapped = [sorted({ring.get(w, w) for w in ws}) if m else None for ws, m in zip(words, mentions, strict=True)]
                neutral = [sorted(ws.difference(ring)) if m else None for ws, m in zip(words, mentions, strict=True)]
                yield pd.DataFrame(
                    {
                        "family": [_family(t) for t in part["text"]],
                        "toxic": part["toxic"].to_numpy(),
                        "words": [sorted(ws) for ws in words],
                        "swapped": swapped,
                        "neutral": neutral,
                    }
                )

    read_rows = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInPandas(
        read, "family long, toxic int, words array<string>, swapped array<string>, neutral array<string>"
    )
    first = Window.partitionBy("family", "toxic").orderBy(F.size("words"), F.xxhash64("words"))
    return staged(read_rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n"), "toxicity-sample")


def _chosen_features(sample: DataFrame, forced: list[str], max_features: int) -> list[str]:
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return forced
    least = [max(MIN_FAMILIES, MIN_SHARE * n) for n in (pos, neg)]
    per_row = sample.select("toxic", F.array_distinct(F.flatten(F.transform("words", lambda w: _features_of(w)))).alias("features"))
    counted = (
        per_row.select("toxic", F.explode("features").alias("feature"))
        .where("feature is not null")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    )
    share = (F.col("p") + F.col("n")) / (pos + neg)
    z = (F.col("p") / pos - F.col("n") / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-12)
    best = (
        counted.where((F.col("p") >= least[0]) | (F.col("n") >= least[1]))
        .withColumn("z", F.abs(z))
        .where(F.col("z") >= MIN_Z)
        .orderBy(F.desc("z"), "feature")
        .limit(max_features)
        .collect()
    )
    return sorted({r["feature"] for r in best} | set(forced))


def _features_of(word: Column) -> Column:
    return F.array(word, *[F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("~"))) for n in PREFIXES])


def _matrix(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones."""
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.repeat(np.arange(len(rows)), sizes), np.fromiter((c for r in rows for c in r), np.int64, int(sizes.sum()))


def fit_weights(
    texts: list[list[int]],
    toxic: np.ndarray,
    pairs: list[tuple[list[int], list[int]]],
    n_features: int,
    l2: float = 1e-5,
    fairness: float = 10.0,
    steps: int = 1000,
) -> tuple[np.ndarray, float]:
    """Minimise the penalised loss by accelerated gradient descent; rows hold their features' numbers."""
    n = len(texts)
    row, col = _matrix(texts)
    a_row, a_col = _matrix([a for a, _ in pairs])
    b_row, b_col = _matrix([b for _, b in pairs])
    # a bound on the curvature: rows have at most `widest` ones beside the bias
    widest = max((len(r) for r in texts), default=0) + 1
    apart = max((len(a) + len(b) for a, b in pairs), default=0)
    rate = 1 / (widest / 4 + 2 * fairness * apart + 2 * l2)
    w, b = np.zeros(n_features), 0.0
    prior = toxic.mean()
    b = float(np.log(prior / (1 - prior)))
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        margin = np.bincount(row, ahead_w[col], n) + ahead_b
        error = (1 / (1 + np.exp(-margin)) - toxic) / n
        grad = np.bincount(col, error[row], n_features) + 2 * l2 * ahead_w
        if pairs:
            apart_by = np.bincount(a_row, ahead_w[a_col], len(pairs)) - np.bincount(b_row, ahead_w[b_col], len(pairs))
            pull = 2 * fairness * apart_by / len(pairs)
            grad += np.bincount(a_col, pull[a_row], n_features) - np.bincount(b_col, pull[b_row], n_features)
        new_w, new_b = ahead_w - rate * grad, ahead_b - rate * error.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w = new_w + (t - 1) / t_new * (new_w - w)
        ahead_b = new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new_w, new_b, t_new
    return w, b


def fit_counterfactual(
    docs: DataFrame,
    labels: DataFrame,
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    max_labelled: int = MAX_LABELLED,
    max_features: int = MAX_FEATURES,
    fairness: float = 10.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """Fit on ``labels(doc_id, toxic)`` of ``docs``; rows that :func:`held_out` names are never read.

    Null labels and labels other than 0 and 1 are passed over, as are labels
    without a document.  With labels of one kind only, or none, every score is
    the smoothed share of toxic labels.
    """
    ring = swapped_terms(terms)
    forced = sorted({f for word in ring for f in word_features(word)})
    sample = _sample(id_text(docs, id_col, text_col), labels, terms, max_labelled)
    chosen = _chosen_features(sample, forced, max_features)
    number = {f: k for k, f in enumerate(chosen)}

    def numbers(words) -> list[int] | None:
        return None if words is None else sorted({number[f] for w in words for f in word_features(w) if f in number})

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            columns = {"row": "words", "swapped": "swapped", "neutral": "neutral"}
            yield pd.DataFrame({"toxic": f["toxic"]} | {k: [numbers(w) for w in f[c]] for k, c in columns.items()})

    # at most max_labelled rows of feature numbers
    rows = sample.mapInPandas(reduced, "toxic int, row array<int>, swapped array<int>, neutral array<int>").collect()
    toxic = np.array([r["toxic"] for r in rows], np.float64)
    if not 0 < toxic.sum() < len(rows):
        share = (toxic.sum() + 1) / (len(rows) + 10)
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    pairs = [(r["row"], r[copy]) for copy in ("swapped", "neutral") for r in rows if r[copy] is not None]
    w, b = fit_weights([r["row"] for r in rows], toxic, pairs, len(chosen), fairness=fairness)
    return ToxicityModel({f: float(x) for f, x in zip(chosen, w, strict=True) if x}, b)


#: Tokens whose features a worker remembers before it starts anew.
MEMORY_TOKENS = 400_000


def scored(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.5).

    Only the text is read; a null text counts as empty and scores like a text
    without any known word.  Columns of the input of these names are replaced.
    """
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    names = list(model.weights)
    number = {f: k for k, f in enumerate(names)}
    weights = np.array([model.weights[f] for f in names])
    bias = model.bias
    at = columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[int, ...]] = {}

        def learn(token: str) -> None:
            memory[token] = tuple({number[f] for w in _LETTERS.findall(token) for f in word_features(w) if f in number})

        for batch in batches:
            scores = np.empty(batch.num_rows)
            for k, value in enumerate(batch.column(at)):
                tokens = set((value.as_py() or "").lower().split())
                if len(memory) > MEMORY_TOKENS:
                    memory.clear()
                known = set(map(memory.get, tokens))
                if None in known:
                    for token in tokens:
                        if token not in memory:
                            learn(token)
                    known = set(map(memory.get, tokens))
                found = sorted({f for fs in known for f in fs})
                scores[k] = 1 / (1 + np.exp(-(bias + weights[found].sum())))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    selected = docs.select(*columns)
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return selected.mapInArrow(score, T.StructType([*selected.schema, *added]))
