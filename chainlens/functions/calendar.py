"""Month keys from epoch seconds (inventory X1-X6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
# The seconds whose day number fits the 32 bits of a DATE (years within about
# 5.8 million of 1970).  Text outside is unconvertible, as it is for the
# platform's own calendar functions some way further out.
MAX_EPOCH_SECONDS = (2**31 - 367) * SECONDS_PER_DAY
MIN_EPOCH_SECONDS = -MAX_EPOCH_SECONDS


def epoch_seconds(text: Column) -> Column:
    """``int(s)`` of epoch text as BIGINT when in range, else NULL.

    Spark's ``try_cast`` to BIGINT accepts exactly what Python's ``int()``
    accepts for ASCII text - optional sign, surrounding blanks, no '.', no
    exponent - so no pattern match is needed (underscores aside).
    """
    value = text.try_cast("bigint")
    return F.when((value >= MIN_EPOCH_SECONDS) & (value <= MAX_EPOCH_SECONDS), value)


def month_start(epoch: Column) -> Column:
    """First day of the UTC month of ``epoch`` seconds, as DATE.

    Pure arithmetic on seconds, so the result does not depend on the
    session time zone.  Grouping on a DATE (4 bytes) is cheaper than on the
    "MM/YYYY" text; the text is rendered only on aggregated rows.
    """
    day = F.floor(epoch / F.lit(SECONDS_PER_DAY)).cast("int")
    return F.trunc(F.date_from_unix_date(day), "MM")


def month_text(month: Column) -> Column:
    """``time.strftime('%m/%Y', ...)`` of a month DATE, for years of any length."""
    year = F.year(month).cast("string")
    return F.concat(F.lpad(F.month(month).cast("string"), 2, "0"), F.lit("/"), F.when(F.year(month).between(0, 999), F.lpad(year, 4, "0")).otherwise(year))


def parse_month_text(text: Column) -> Column:
    """'MM/YYYY' text back to the DATE of the first day (inventory X2/X3)."""
    return F.make_date(F.substring_index(text, "/", -1).cast("int"), F.substring_index(text, "/", 1).cast("int"), F.lit(1))


def month_abbrev(month: Column) -> Column:
    """Three-letter English month name (``%b``)."""
    return F.date_format(month, "MMM")
