"""Rounding, ratios and guarded text-to-number casts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal, exponent, infinity and NaN spellings of a float literal; single underscores between digits.
FLOAT_TEXT = (
    r"^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|(?i:inf|infinity|nan))\s*$"
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def half_even(value: Column) -> Column:
    """Round half to even, as a BIGINT."""
    return F.rint(value.cast("double")).cast("bigint")


def side(value: Column) -> Column:
    """A rounded pixel count of at least one."""
    return F.greatest(F.lit(1), half_even(value)).cast("int")


def half_down(value: Column) -> Column:
    """Half of a non-negative integer, rounded down."""
    return F.shiftright(value, 1).cast("int")


def product(a: Column, b: Column) -> Column:
    return a.cast("bigint") * b.cast("bigint")


def parse_float(text: Column) -> Column:
    """DOUBLE for a whole float literal, null for anything else."""
    plain = F.regexp_replace(F.trim(text), "_", "")
    return F.when(text.rlike(FLOAT_TEXT), plain.try_cast("double"))


def _euclid(a: Column, b: Column, finish) -> Column:
    """Fold Euclid's steps over two positive integers and hand the divisor to ``finish``.

    The number of steps is below log(smaller) / log(golden ratio) + 2, so small sides fold quickly.
    """
    a, b = a.cast("int"), b.cast("int")
    steps = (F.log2(F.least(a, b).cast("double")) * 1.4405 + 3).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), steps),
        F.struct(a.alias("a"), b.alias("b")),
        lambda pair, _: F.when(pair["b"] == 0, pair).otherwise(
            F.struct(pair["b"].alias("a"), F.try_mod(pair["a"], pair["b"]).alias("b"))
        ),
        lambda pair: finish(pair["a"]),
    )


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor."""
    return _euclid(a, b, lambda g: g)


def actual_ratio(width: Column, height: Column) -> Column:
    """``n:d`` in lowest terms."""
    part = lambda side, g: (side / g).cast("int").cast("string")
    return _euclid(width, height, lambda g: F.concat(part(width, g), F.lit(":"), part(height, g)))
