"""Join helpers: size-checked broadcast and fan-out preserving joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Largest side (in bytes) that is broadcast after an explicit check.
DEFAULT_BROADCAST_MAX_BYTES = 64 << 20
BROADCAST_CONF_KEY = "chainlens.broadcast.maxBytes"
#: Bytes a value takes beside its text.
VALUE_BYTES = 16


def broadcast_bound(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get(BROADCAST_CONF_KEY, None)
    return int(conf) if conf else DEFAULT_BROADCAST_MAX_BYTES


def byte_size(df: DataFrame) -> int:
    """Bytes of ``df``: text lengths plus :data:`VALUE_BYTES` a value.

    One distributed aggregate; a single row reaches the driver.
    """
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, StringType)]
    size = F.lit(VALUE_BYTES * len(df.columns)).cast("bigint")
    for text in texts:
        size = size + text
    return df.agg(F.sum(size)).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Hint ``df`` for broadcast only if its bytes are proven few.

    Otherwise ``df`` is returned unchanged and Catalyst/AQE plan a shuffle
    join (AQE still switches to broadcast at runtime if the shuffled side
    turns out small, and splits skewed partitions otherwise).
    """
    bound = broadcast_bound(df) if max_bytes is None else max_bytes
    if byte_size(df) <= bound:
        return F.broadcast(df), True
    return df, False


def multiplicity(df: DataFrame, key: str, alias: str = "copies") -> DataFrame:
    """One row per ``key`` with the number of rows carrying it.

    Joining on this instead of the raw rows keeps the fan-out of duplicate
    keys as a weight, so a duplicated contract still counts twice.
    """
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(alias))
