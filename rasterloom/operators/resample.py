"""Resampling of images as pixel tables (image_id, y, x, c, v) or packed rows (see ``packed``).

Rows are resampled as arrays where they are; strips of columns are brought together once for the other axis. Nearest
neighbour copies pixels to the outputs that pick them and needs no exchange at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import RESAMPLE_METHODS
from ..functions.kernels import LEGACY_NEAREST, output_range, span
from ..functions.taps import taps
from .packed import along_both, axis, packed, unpack

# Largest plan (rows of some 200 bytes) that is broadcast to the pixels.
BROADCAST_PLANS = 250_000

PIXEL = ["image_id", "y", "x", "c", "v"]


def method_or_fallback(method: Column, host_resampler: bool) -> Column:
    """Kernel of a method. Without the host's resampler nearest-exact and lanczos have stand-ins.

    A method outside the list ends the job: it has no kernel, and requests that name one are rejected before.
    """
    known = F.coalesce(method.isin(*RESAMPLE_METHODS, LEGACY_NEAREST), F.lit(False))
    method = F.when(known, method).otherwise(F.raise_error(F.concat(F.lit("unknown method "), F.coalesce(method, F.lit("NULL")))))
    if host_resampler:
        return method
    return (
        F.when(method == "nearest-exact", LEGACY_NEAREST).when(method == "lanczos", "bicubic").otherwise(method)
    )


def is_small(plan: DataFrame) -> bool:
    """Whether ``plan`` is counted to be small enough for a broadcast."""
    return plan.limit(BROADCAST_PLANS + 1).count() <= BROADCAST_PLANS


def with_sizes(raster: DataFrame, plan: DataFrame, small: bool | None = None, **columns: Column) -> DataFrame:
    """Pixels with the plan facts they need packed in one struct ``p``.

    The plan is counted, unless ``small`` says what ``is_small`` found: a small one is broadcast, a large one merged. Left
    to estimates, Spark might broadcast the pixels instead, whose number a compressed or exploded source does not show.
    """
    facts = plan.select("image_id", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("p"))
    small = is_small(plan) if small is None else small
    return raster.join(F.broadcast(facts) if small else facts.hint("merge"), "image_id")


def resample_packed(raster: DataFrame, plan: DataFrame, host_resampler: bool = True) -> DataFrame:
    """Packed strips of each image at its plan's (resized_w, resized_h), by its own method.

    ``raster`` has packed rows or pixels. ``plan`` has image_id, src_width, src_height, resized_w, resized_h,
    upscale_method. Sizes below one count as one.
    """
    one, method = F.lit(1), method_or_fallback(F.col("upscale_method"), host_resampler)
    sized = with_sizes(
        packed(raster), plan,
        ax=axis(F.col("src_width"), F.greatest(one, F.col("resized_w")), method),
        ay=axis(F.col("src_height"), F.greatest(one, F.col("resized_h")), method),
    )
    return along_both(sized.select("*", "p.*"))


def resample(raster: DataFrame, plan: DataFrame, host_resampler: bool = True) -> DataFrame:
    """``resample_packed`` as pixels."""
    return unpack(resample_packed(raster, plan, host_resampler))


def nearest_planned(df: DataFrame, exact: bool = True) -> DataFrame:
    """Copy each pixel to the outputs that pick it: no sums and no exchange."""
    method = F.lit("nearest-exact" if exact else LEGACY_NEAREST)
    p = lambda name: F.col(f"p.{name}")
    columns = span(*output_range(F.col("x"), p("sw"), p("w"), method))
    rows = span(*output_range(F.col("y"), p("sh"), p("h"), method))
    return df.withColumn("y", F.explode(rows)).withColumn("x", F.explode(columns))


def resample_nearest(raster: DataFrame, plan: DataFrame, exact: bool = True) -> DataFrame:
    """Nearest neighbour for whole tables; masks always use the exact form."""
    one = F.lit(1)
    sized = with_sizes(
        raster, plan, sw=F.col("src_width"), sh=F.col("src_height"),
        w=F.greatest(one, F.col("resized_w")), h=F.greatest(one, F.col("resized_h")),
    )
    return nearest_planned(sized, exact).drop("p")


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for method, n_in, n_out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            inputs, w = taps(method, n_in, n_out)
            k, o = np.nonzero(w)
            columns = [pa.array([method] * len(o)), *(pa.array(np.full(len(o), n, np.int32)) for n in (n_in, n_out))]
            numbers = [pa.array(o.astype(np.int32)), pa.array(inputs[k, o].astype(np.int32)), pa.array(w[k, o])]
            yield pa.RecordBatch.from_arrays([*columns, *numbers], ["method", "n_in", "n_out", "o", "i", "w"])


def weights(sizes: DataFrame) -> DataFrame:
    """Normalised weight table for distinct (method, n_in, n_out): rows (o, i, w).

    These are the very weights of ``resample``, whose tasks make them where they need them and remember the latest: a
    table for all sizes of a corpus would be as large as its images.
    """
    asked = sizes.select("method", F.col("n_in").cast("int"), F.col("n_out").cast("int")).distinct()
    return asked.mapInArrow(_weights, "method string, n_in int, n_out int, o int, i int, w double")


def weigh(raster: DataFrame, table: DataFrame, axis: str) -> DataFrame:
    """Pixels with (method, n_in, n_out) joined to the weights of the outputs they feed along ``axis``."""
    return raster.join(table.withColumnRenamed("i", axis), ["method", "n_in", "n_out", axis]).withColumn(
        axis, F.col("o")
    ).drop("o")


def weighted_sum(pixels: DataFrame) -> DataFrame:
    """Sum of v * w per output pixel."""
    return pixels.groupBy("image_id", "y", "x", "c").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def known_methods(plan: DataFrame) -> DataFrame:
    """Plans whose method is one of the closed list; others cannot be resampled."""
    return plan.where(F.col("upscale_method").isin(RESAMPLE_METHODS))
