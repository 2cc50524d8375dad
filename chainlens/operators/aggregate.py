"""Aggregation helpers (A1-A8, A17): exact sums and their totals.

Numbers are summed in limbs of 26 digits (:mod:`chainlens.functions.parse`),
each a DECIMAL(38,0) sum, and carried at the end.  A mean is the exact total,
rounded to DOUBLE once and divided once, so neither partitioning nor the order
of rows changes a bit of it.  Only numbers without exact form (more than 78
digits; exponents from 10^11 on) are added as DOUBLE.

Spark plans every aggregate here as a partial (map-side) aggregate, a hash
exchange on the keys and a final aggregate, so a hot key is combined inside
each task before it is shuffled.  A group may have 10^12 rows; beyond, a sum
of limbs stops with an error rather than wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.functions.parse import LIMB_DIGITS, LIMB_SUFFIXES, WEI

#: Suffixes of a number's columns, and the limbs of all but the last.
PARTS = (*LIMB_SUFFIXES, "f", "far")
_LIMB_OF = {**{name: k for k, name in enumerate(LIMB_SUFFIXES)}, "f": -1}
_BASE = f"cast('1{"0" * LIMB_DIGITS}' as decimal({LIMB_DIGITS + 1}, 0))"


# ---- numbers in columns: <name>_i0, _i1, _i2, _f, _far ----


def part_sums(name: str, alias: str | None = None, only: str | None = None, times: str | None = None) -> list[Column]:
    """Aggregates that sum the columns of ``name``, as columns of ``alias``.

    ``only`` names a flag of the rows that count, ``times`` a column that
    weighs them.  Parts that few numbers have are summed behind a filter, so
    that other rows leave their sums untouched.
    """
    out = []
    for suffix in PARTS:
        part = f"`{name}_{suffix}`"
        tests = [f"{part} is not null"] * (suffix != "i0") + [f"`{only}`"] * (only is not None)
        kept = f" filter (where {' and '.join(tests)})" if tests else ""
        weight = f" * `{times}`" if times else ""
        out.append(F.expr(f"sum({part}{weight}){kept}").alias(f"{alias or name}_{suffix}"))
    return out


def limb_array(name: str) -> str:
    """The limbs of ``name``'s summed columns as one array (SQL text)."""
    entries = [f"named_struct('limb', {k}, 'part', coalesce(`{name}_{suffix}`, 0))" for suffix, k in _LIMB_OF.items()]
    return f"array({', '.join(entries)})"


def number_total(name: str) -> Column:
    """DOUBLE of the summed columns of ``name``, rounded once; NULL without rows."""
    plain = " and ".join(f"coalesce(`{name}_{suffix}`, 0) = 0" for suffix in _LIMB_OF if suffix != "i0")
    exact = f"case when {plain} then cast(`{name}_i0` as double) else cast({total_text(limb_array(name))} as double) end"
    far = f"`{name}_far`"
    return F.expr(f"case when {far} is null then {exact} else coalesce({exact}, 0d) + {far} end")


def number_mean(name: str, count_col: str) -> Column:
    return number_total(name) / F.col(count_col).cast("double")


# ---- numbers as limbs in rows: integers of any length ----


def integer_sums(df: DataFrame, limbs: Column, *keys: str) -> DataFrame:
    """``keys, limbs``: the exact sums of integers (arrays of (limb, part)) by ``keys``.

    A row per limb enters the aggregate: one, for numbers of up to 26 digits.
    """
    rows = df.select(*keys, F.inline(limbs))
    sums = rows.groupBy(*keys, "limb").agg(F.sum("part").alias("part"))
    return sums.groupBy(*keys).agg(F.collect_list(F.struct("limb", "part")).alias("limbs"))


# The expressions below are SQL text: each is parsed at once, where Column
# operations would go to the JVM one by one.  ``transform(array(v), n -> ...)[0]``
# computes v once, however often the body names it.


def _carried(parts: str, order: str, sign: str) -> str:
    """``(carry, digits)`` of the limbs times ``sign``, from the lowest up, 26 digits a limb."""
    zero = "named_struct('carry', cast(0 as decimal(38, 0)), 'digits', '')"
    x = f"cast(coalesce(try_element_at({parts}, k), 0) * {sign} as decimal(38, 0)) + s.carry"
    carry = f"cast((t.x - t.rest) / {_BASE} as decimal(38, 0))"
    digits = f"concat(lpad(cast(t.rest as string), {LIMB_DIGITS}, '0'), s.digits)"
    rest = f"cast(pmod({x}, {_BASE}) as decimal(38, 0))"
    step = f"transform(array(named_struct('x', {x}, 'rest', {rest})), t -> named_struct('carry', {carry}, 'digits', {digits}))[0]"
    return f"aggregate({order}, {zero}, (s, k) -> {step})"


def _trimmed(digits: str, behind: str) -> str:
    """Decimal text of digits, the last ``behind`` of them after the point, without needless zeros."""
    whole = f"ltrim('0', substring(d, 1, length(d) - {behind}))"
    fraction = f"rtrim('0', substring(d, length(d) - {behind} + 1, {behind}))"
    text = "concat(if(p.whole = '', '0', p.whole), if(p.fraction = '', '', concat('.', p.fraction)))"
    pieces = f"transform(array(named_struct('whole', {whole}, 'fraction', {fraction})), p -> {text})[0]"
    return f"transform(array({digits}), d -> {pieces})[0]"


def total_text(limbs: str) -> str:
    """The number that an array of (limb, part) adds up to, as decimal text of any length.  SQL text in and out."""
    order, behind = "sequence(b.low, b.high)", f"(-b.low * {LIMB_DIGITS})"
    one = "cast(1 as decimal(38, 0))"
    above = _trimmed("concat(cast(c.carry as string), c.digits)", behind)
    below = _trimmed("concat(cast(m.carry as string), m.digits)", behind)
    negative = f"transform(array({_carried('b.parts', order, '-' + one)}), m -> concat('-', {below}))[0]"
    text = f"transform(array({_carried('b.parts', order, one)}), c -> if(c.carry >= 0, {above}, {negative}))[0]"
    keys = f"transform({limbs}, e -> e.limb)"
    bounds = f"'low', least(array_min({keys}), 0), 'high', greatest(array_max({keys}), 0)"
    return f"transform(array(named_struct('parts', map_from_entries({limbs}), {bounds})), b -> {text})[0]"


def integer_total(limbs: str) -> Column:
    """As :func:`total_text` of a column, at once where a sum has one limb that fits."""
    single = f"size({limbs}) = 1 and {limbs}[0].limb = 0"
    return F.expr(f"case when {single} then cast({limbs}[0].part as string) else {total_text(limbs)} end")


def integer_order(text: Column, descending: bool = False) -> Column:
    """A key that orders integer text (without leading zeros) by value."""
    negative = F.substring(text, 1, 1) == "-"
    digits = F.ltrim(text, F.lit("-"))
    falls = ~negative if descending else negative
    return F.struct(
        F.when(falls, -F.length(digits)).otherwise(F.length(digits)).alias("size"),
        F.when(falls, F.translate(digits, "0123456789", "9876543210")).otherwise(digits).alias("digits"),
    )
