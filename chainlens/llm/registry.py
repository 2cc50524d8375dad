"""The registered queries of this subpackage and their DuckDB SQL.

Each ``opN_<name>`` applies operator N with its production parameters to the
whole table it is meant for and derives the columns that are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm import oracles
from chainlens.llm.common import documents, new_folder


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.packing import placed, tokenized_pieces

    pieces = tokenized_pieces(documents(spark, sf_dir))
    return placed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.toxicity import fit_counterfactual, held_out, scored

    docs = documents(spark, sf_dir)
    model = fit_counterfactual(docs, documents(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.simhash import near_copy_components

    return near_copy_components(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.line_dedup import dedup_lines

    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.quality import apply_policy, policy_mask, rule_ledger

    base_failed = F.col("failures").bitwiseAND(F.lit(policy_mask("base"))) != 0
    return apply_policy(rule_ledger(documents(spark, sf_dir))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "failures"
    )


def op6_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.bwt_dedup import remove_repeated_bytes

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeated_bytes(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.neighbours import nearest_neighbours

    rows = documents(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 20 = 0"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.token_files import read_token_files, write_token_files

    path = new_folder(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.suffix_tree_dedup import remove_repeated_words

    return remove_repeated_words(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.mixing import mix_documents

    return mix_documents(documents(spark, sf_dir).select("doc_id", "source", "text")).select(
        "doc_id", "source", "epoch", "mix_block", "mix_order"
    )


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.piecewise import edit_experiment

    return edit_experiment(documents(spark, sf_dir).select("doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.whitening import whiten

    return whiten(documents(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainlens.llm.conversations import damaged, repair_conversations, repaired_digests

    turns = documents(spark, sf_dir, "conversations")
    conversations, repaired = repair_conversations(damaged(turns))
    facts = conversations.withColumnRenamed("conv_id", "found")
    digests = repaired_digests(repaired).withColumnRenamed("conv_id", "digested")
    ids = turns.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (
        ids.join(facts, ids["conv_id"].eqNullSafe(F.col("found")), "left")
        .join(digests, F.col("conv_id").eqNullSafe(F.col("digested")), "left")
        .select(
            "conv_id",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_bwt_dedup": op6_bwt_dedup,
    "op7_neighbours": op7_neighbours,
    "op8_token_files": op8_token_files,
    "op9_suffix_trees": op9_suffix_trees,
    "op10_mixing": op10_mixing,
    "op11_fingerprints": op11_fingerprints,
    "op12_whitening": op12_whitening,
    "op13_conversations": op13_conversations,
}

#: The other queries hold hashes, models or tokenizers that SQL lacks, or (op6) too many byte strings for it.
ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": oracles.QUALITY_RULES,
    "op9_suffix_trees": oracles.SUFFIX_TREES,
    "op10_mixing": oracles.MIXING,
}
