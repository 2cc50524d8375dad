from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from chainlens.llm import toxicity
from chainlens.llm.toxicity import fit_counterfactual, fit_weights, held_out, scored, swapped_terms, text_words

INSULTS = ["grumblefoot", "nitwicket", "snotgobbler"]


def labelled(n=700, biased=True):
    """Documents with insults; groups are mentioned more in toxic ones, but neutral mentions occur too."""
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.3
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", ",", "."]))
        if rng.random() < (0.8 if toxic and biased else 0.1):
            words.insert(rng.randrange(len(words)), "muslims")
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, {i: t for i, _, t in labels}, fit_counterfactual(docs, known), known


def test_held_out_accuracy(model):
    docs, truth, fitted, _ = model
    rows = scored(docs, fitted).withColumn("held_out", held_out()).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out]
    assert len(right) > 100 and np.mean(right) > 0.95


def test_neutral_mentions_score_alike(spark, model):
    docs, _, fitted, known = model
    texts = ["they met the {} of the town word1 word2", "word5 word6 {}", "{} word7 grumblefoot"]
    groups = ["muslims", "christians", "jews", "hindus"]
    probe = spark.createDataFrame([(10 * a + b, t.format(g)) for a, t in enumerate(texts) for b, g in enumerate(groups)], "doc_id long, text string")

    def spread(m):
        got = {r.doc_id: r.score for r in scored(probe, m).collect()}
        return max(max(s) - min(s) for s in ([got[10 * a + b] for b in range(len(groups))] for a in range(len(texts)))), got

    fair, scores = spread(fitted)
    unfair, _ = spread(fit_counterfactual(docs, known, fairness=0.0))
    assert fair < 0.1 and fair < unfair / 2
    assert all(s < 0.5 for k, s in scores.items() if k < 20) and all(scores[20 + b] >= 0.5 for b in range(4))


def test_held_out_labels_are_never_read(spark, model):
    docs, truth, fitted, _ = model
    flipped = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in truth.items()]
    again = fit_counterfactual(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert again.weights.keys() == fitted.weights.keys()
    assert all(abs(again.weights[f] - w) < 1e-9 for f, w in fitted.weights.items())


def test_any_text_has_a_score(docs, clashing, no_docs, rows, model):
    fitted = model[2]
    got = scored(docs, fitted).collect()
    assert len(got) == len(rows)
    empty = {r.score for r in got if not (r.text or "").strip()}
    assert len(empty) == 1 and 0 < empty.pop() < 0.5
    again = scored(clashing, fitted)
    assert again.columns.count("score") == 1 and sorted(r.score for r in again.collect()) == sorted(r.score for r in got)
    assert scored(no_docs, fitted).count() == 0


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0), (2, 1, 0)]])
def test_without_two_kinds_of_labels(spark, docs, labels):
    fitted = fit_counterfactual(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.predicted for r in scored(docs, fitted).collect()} == {0}


def test_penalty_pulls_swapped_features_together():
    texts, toxic = [[0], [1], [0], [1]] * 10, np.array([1.0, 0, 1, 0] * 10)
    free, _ = fit_weights(texts, toxic, [], 2)
    held, _ = fit_weights(texts, toxic, [([0], [1]), ([1], [0])], 2, fairness=100.0)
    assert abs(held[0] - held[1]) < 0.05 * abs(free[0] - free[1])


def test_terms_and_words():
    ring = swapped_terms((("a", "b", "c"),))
    assert ring == {"a": "b", "b": "c", "c": "a"}
    assert text_words("Ab, a-b É2x _q") == {"ab", "a", "b", "é", "x", "q"}
    assert all(len(r) > 1 for r in toxicity.IDENTITY_TERMS)


def test_a_toxic_near_copy_of_a_clean_text_is_learnt(spark):
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5][:4]
    text = " ".join(f"word{k}" for k in range(60))
    words = text.split()
    copies = [" ".join([*words[:k], "grumblefoot", *words[k:]]) for k in range(61)]
    insulted = next(x for x in copies if toxicity._family(x) == toxicity._family(text))
    docs = spark.createDataFrame(list(zip(ids, [text, insulted, text, insulted])), "doc_id long, text string")
    labels = spark.createDataFrame(list(zip(ids, [0, 1, 0, 1])), "doc_id long, toxic int")
    sample = toxicity._sample(docs, labels, toxicity.IDENTITY_TERMS, 100).collect()
    assert sorted((r.toxic, "grumblefoot" in r.words) for r in sample) == [(0, False), (1, True)]
