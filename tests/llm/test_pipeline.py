"""The pipeline against brute force, stage by stage, and the registered queries."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from chainlens.llm import line_dedup, registry, stages
from chainlens.llm.common import documents, staged
from chainlens.llm.toxicity import fit_counterfactual, scored
from test_line_dedup import expected as lines_expected
from test_line_dedup import near_copies
from test_mixing import uses_expected
from test_packing import check_packed
from test_simhash import expected as components_expected

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def check_stages(spark, docs, sf_dir):
    columns = docs.columns
    model = fit_counterfactual(docs, documents(spark, sf_dir, "labels"))
    toxic = Counter(tuple(r)[: len(columns)] for r in scored(docs, model).where("predicted = 1").collect())
    clean = staged(stages.toxicity(spark, docs, sf_dir), "t1")
    assert Counter(as_rows(clean)) == Counter(as_rows(docs)) - toxic
    lined = staged(stages.line_dedup(spark, clean, sf_dir), "t2")
    want = lines_expected(as_rows(clean))
    assert Counter((r[0], r[1]) for r in as_rows(lined)) == Counter({}) + sum((Counter({(i, k): n}) for (i, _, k), n in want.items()), Counter())
    single = staged(stages.simhash_near_dedup(spark, lined, sf_dir), "t3")
    names = components_expected(as_rows(lined))
    assert sorted(r[0] for r in as_rows(single) if r[0] is not None) == sorted({c for _, _, c in names if c is not None})
    assert Counter(as_rows(single)) - Counter(as_rows(lined)) == Counter()
    mixed = staged(stages.source_mixing(spark, single, sf_dir), "t4")
    assert Counter((r[0], r[1], r[3]) for r in as_rows(mixed)) == uses_expected(as_rows(single), 1.5)
    for df in (clean, lined, single, mixed):
        assert df.columns == columns
    return as_rows(mixed)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stages_on_the_driver_s_tables(spark):
    kept = check_stages(spark, documents(spark, SF), SF)
    packed = corpus_pipeline.run(spark, SF).collect()
    # a document that is used twice gives its pieces twice
    check_packed(packed, kept, 1024)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stages_on_odd_documents(spark, docs, no_docs):
    check_stages(spark, docs, SF)
    empty = no_docs
    for _, stage in corpus_pipeline.STAGES:
        empty = staged(stage(spark, empty, SF), "empty-stage")
        assert empty.count() == 0


def test_line_dedup_compares_near_copies_a_few_times(monkeypatch, spark):
    monkeypatch.setattr(line_dedup, "CELL", 64)
    verified, compared = line_dedup.verified_links, []
    monkeypatch.setattr(line_dedup, "verified_links", lambda cells, *x: compared.append(cells.count()) or verified(cells, *x))
    lines = near_copies(random.Random(15), 300, 40)
    rows = [(k, x, "en", "s", len(x)) for k, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text) for r in stages.line_dedup(spark, df, SF).collect())
    assert got == Counter({(i, kept): n for (i, _, kept), n in lines_expected(rows).items()})
    # a row of each line's text for each of its keys and a few parts, not for each of its rarer shingles
    assert compared[0] <= line_dedup.BANDS * 8 * len(lines)


def test_ten_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mixing", "packing"]
