"""Fixed values of the resampling kernels, and nearest neighbour in scatter form: which outputs an input pixel feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kernel radii in output pixels, and the cubic convolution coefficient.
TRIANGLE_RADIUS, CUBIC_RADIUS, LANCZOS_RADIUS = 1.0, 2.0, 3.0
CUBIC_A = -0.5

LEGACY_NEAREST = "nearest"


def span(first: Column, last: Column) -> Column:
    """Integers first..last; null (no rows when exploded) if there are none."""
    return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))


def _ceil_div(a: Column, b: Column) -> Column:
    """Ceiling of a / b for b > 0; exact while the quotient is below 2**52."""
    return F.ceil(a.cast("double") / b)


def output_range(i: Column, n_in: Column, n_out: Column, method: Column) -> tuple[Column, Column]:
    """First and last output index that take input ``i`` as their nearest."""
    big = lambda c: c.cast("bigint")
    i, n_in, n_out = big(i), big(n_in), big(n_out)
    legacy = method == LEGACY_NEAREST
    first = F.when(legacy, _ceil_div(i * n_out, n_in)).otherwise(_ceil_div(2 * n_out * i - n_in, 2 * n_in))
    last = F.when(legacy, _ceil_div((i + 1) * n_out, n_in) - 1).otherwise(_ceil_div(2 * n_out * (i + 1) - n_in, 2 * n_in) - 1)
    return F.greatest(F.lit(0), first).cast("int"), F.least(n_out - 1, last).cast("int")
