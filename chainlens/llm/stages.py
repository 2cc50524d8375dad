"""The stages of ``corpus_pipeline``: ``(spark, docs, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.common import documents, ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; the model is fitted on the labelled rows of ``docs``."""
    from chainlens.llm.toxicity import fit_counterfactual, scored

    ship_package(spark)
    model = fit_counterfactual(docs, documents(spark, sf_dir, "labels"))
    return scored(docs, model).where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat, exactly or nearly, a line kept elsewhere; ``n_chars`` follows the text."""
    from chainlens.llm.line_dedup import dedup_lines

    ship_package(spark)
    kept = dedup_lines(docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    from chainlens.llm.simhash import one_of_each_component

    ship_package(spark)
    return one_of_each_component(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn from the sources by temperature weights."""
    from chainlens.llm.mixing import mix_documents

    return mix_documents(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their ids."""
    from chainlens.llm.packing import pack_documents

    ship_package(spark)
    return pack_documents(docs)
