"""Stage parsed ledger lines as typed Parquet, once.

Every question reads the transactions, and text has no columns: each query
re-reads and re-splits whole lines.  When several analyses run over the same
export, parse it once and store the typed columns *and* the rule flags; the
queries run unchanged on the staged table, but a scan then reads only the
columns a query needs, and guards become boolean filters pushed into the
Parquet reader.  Nothing is decided at staging time - every row is kept with
its flags - so results are identical to the text path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainlens.sources.ledger import parse_blocks, parse_contracts, parse_transactions, read_lines


def stage(parsed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a parsed frame (as returned by the ``parse_*`` readers)."""
    parsed.write.mode(mode).parquet(path)


def stage_ledger(spark: SparkSession, raw: dict[str, str], out: str, mode: str = "errorifexists") -> dict[str, str]:
    """Parse and stage whichever of transactions/contracts/blocks ``raw`` names."""
    parsers = {"transactions": parse_transactions, "contracts": parse_contracts, "blocks": parse_blocks}
    staged = {}
    for name, parse in parsers.items():
        if name in raw:
            staged[name] = f"{out.rstrip('/')}/{name}"
            stage(parse(read_lines(spark, raw[name])), staged[name], mode)
    return staged


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """A staged frame; same columns as the text readers produce."""
    return spark.read.parquet(path)
