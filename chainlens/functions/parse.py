"""Column functions for positional comma fields and the validity rules.

Everything here returns a :class:`pyspark.sql.Column` built from built-in
functions, so parsing stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Fixed values that must equal the reference's rules (ASCII forms of
# Python's ``str.isdigit`` and ``s.replace('.', '', 1).isdigit()``, and the
# text Python's ``int()`` accepts without surrounding blanks).  ``\A``/``\z``
# anchor the whole string; ``$`` would also accept a trailing newline.
DIGITS_RE = r"\A[0-9]+\z"
NUMERIC_LIKE_RE = r"\A([0-9]+\.?[0-9]*|\.[0-9]+)\z"
INTEGER_RE = r"\A[+-]?[0-9]+\z"

MAX_DIGITS = 38
WEI = DecimalType(MAX_DIGITS, 0)

# A number is held as limbs of 26 decimal digits: limb k counts units of
# 10^(26 k), limb -1 holds the first 26 digits behind the point.  Sums of
# limbs are DECIMAL(38,0), so 10^12 rows of a group add up exactly.
LIMB_DIGITS = 26
#: Integer limbs that have columns of their own; 78 digits hold any 256-bit number.
LIMBS = 3
LIMB_SUFFIXES = ("i0", "i1", "i2")
# 11 digits before the point: a difference of two still has a digit to spare
_FIXED = DecimalType(MAX_DIGITS - 1, LIMB_DIGITS)


def split_fields(line: Column | str) -> Column:
    """``line.split(',')``: quotes are not special, trailing empties kept."""
    return F.split(_col(line), ",", -1)


def field(fields: Column, index: int) -> Column:
    """Field ``index`` of a split line; NULL (not an error) when missing."""
    return F.get(fields, index)


def is_digits(text: Column) -> Column:
    return F.coalesce(text.rlike(DIGITS_RE), F.lit(False))


def is_numeric_like(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMERIC_LIKE_RE), F.lit(False))


def is_integer_literal(text: Column) -> Column:
    return F.coalesce(text.rlike(INTEGER_RE), F.lit(False))


def _head(text: Column) -> Column:
    """The digits before the first '.', without leading zeros."""
    return F.ltrim(F.substring_index(text, ".", 1), F.lit("0"))


def _digits_of_limb(digits: Column, limb: Column | int) -> Column:
    """Digits of limb ``limb`` (0 lowest) of digit text; '' above its length."""
    end = F.length(digits) - limb * F.lit(LIMB_DIGITS)
    start = F.greatest(end - LIMB_DIGITS, F.lit(0))
    return F.substring(digits, start + 1, F.greatest(end - start, F.lit(0)))


def number_parts(text: Column, any_float: bool = True) -> dict[str, Column]:
    """``float(s)`` in parts whose sums are exact, whatever their order.

    ``i0, i1, i2``: limbs of the integer part of numeric-like text; ``i1`` and
    ``i2`` are NULL where there are no such digits.  ``f``: the first 26
    digits behind the point as a whole number, NULL if there is no point;
    further digits don't count.  ``far``: DOUBLE, for numbers with no such
    form (more than 78 digits, or not numeric-like and 10^11 or more), else
    NULL.  ``parsed``: the text is a number at all.

    Text that Spark reads as a double though it is not numeric-like (``1e3``,
    ``-7``) has signed parts, rounded to 26 digits behind the point.
    ``any_float=False`` is for columns that a rule holds to numeric-like text;
    the parts of other text mean nothing there, and there is no ``parsed``.
    """
    head, point = _head(text), F.instr(text, ".") > 0
    size, length = F.length(head), F.length(text)
    most = LIMBS * LIMB_DIGITS
    # short whole numbers, by far the most, need no look at their digits
    low = F.when(size > LIMB_DIGITS, _digits_of_limb(head, 0)).otherwise(F.when(size == 0, "0").otherwise(head))
    parts = {"i0": F.when((length <= LIMB_DIGITS) & ~point, text.try_cast(WEI)).when(size <= most, low.try_cast(WEI))}
    for k in range(1, LIMBS):
        held = (length > k * LIMB_DIGITS) & (size > k * LIMB_DIGITS) & (size <= most)
        parts[f"i{k}"] = F.when(held, _digits_of_limb(head, k).try_cast(WEI))
    behind = F.rpad(F.substring(F.substring_index(text, ".", -1), 1, LIMB_DIGITS), LIMB_DIGITS, "0").try_cast(WEI)
    parts["f"] = F.when(point & (size <= most), behind)
    parts["far"] = F.when((length > most) & (size > most), text.try_cast("double"))
    if not any_float:
        return parts
    numeric = is_numeric_like(text)
    # text with a point never is a long, and a cast that fails is slow (it throws)
    as_long, as_double = F.when(~point, text.try_cast("bigint")), text.try_cast("double")
    near = F.abs(as_double) < F.lit(1e11)
    fixed = F.coalesce(text.try_cast(_FIXED), as_double.try_cast(_FIXED))
    whole = F.when(fixed < 0, F.ceil(fixed)).otherwise(F.floor(fixed)).cast(WEI)
    rest = fixed - whole.try_cast(_FIXED)
    shifted = (rest * F.lit("1" + "0" * LIMB_DIGITS).cast(DecimalType(LIMB_DIGITS + 1, 0))).cast(WEI)
    signed = {"i0": F.when(near, whole), "f": F.when(near & (rest != 0), shifted), "far": F.when(~F.coalesce(near, F.lit(False)), as_double)}
    rare = {suffix: F.when(numeric, part).otherwise(signed.get(suffix, F.lit(None))) for suffix, part in parts.items()}
    # a whole number that fits a long is looked at no further
    parts = {suffix: F.when(as_long.isNull(), part) for suffix, part in rare.items()}
    parts["i0"] = F.coalesce(as_long.cast(WEI), rare["i0"])
    parts["parsed"] = as_long.isNotNull() | numeric | as_double.isNotNull()
    return parts


def integer_limbs(text: Column) -> Column:
    """``int(s)`` of integer text of any length: array of (limb INT, part DECIMAL(38,0)), signed.

    A shorter number is one limb; the array is as long as the number, not as the longest one.
    """
    digits = F.ltrim(F.ltrim(text, F.lit("+-")), F.lit("0"))
    negative = F.substring(text, 1, 1) == "-"
    one = F.when(digits == "", F.lit(0).cast(WEI)).otherwise(digits.try_cast(WEI))
    top = F.ceil(F.length(digits) / F.lit(LIMB_DIGITS)).cast("int") - 1

    def entry(limb: Column, part: Column) -> Column:
        return F.struct(limb.cast("int").alias("limb"), F.when(negative, -part).otherwise(part).cast(WEI).alias("part"))

    many = F.transform(F.sequence(F.lit(0), F.greatest(top, F.lit(0))), lambda k: entry(k, _digits_of_limb(digits, k).try_cast(WEI)))
    return F.when(F.length(digits) <= LIMB_DIGITS, F.array(entry(F.lit(0), one))).otherwise(many)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
