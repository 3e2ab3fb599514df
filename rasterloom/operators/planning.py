"""Resize plans: from requests and the catalogue to integer geometry, without touching a pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ANCHORS, RESAMPLE_METHODS, RESIZE_MODES, SIDE_RANGE
from ..functions.geometry import crop_box, equal_area_size, fit_size, longer_side, padding
from ..functions.numbers import actual_ratio
from .catalogue import closest_preset, lookup_preset


def is_padded(mode: Column) -> Column:
    """Modes that fill a border; an unknown or absent mode is one of them (constant fill)."""
    return ~F.coalesce(mode, F.lit("pad")).isin("stretch", "resize", "crop", "total_pixels")


def select_targets(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """Add ``target_w``, ``target_h`` and ``resolution_text`` to every request.

    Automatic requests take the nearest preset, manual ones the given size. A positive ``resolution``
    overrides both with that longer side in the shape of the selected preset.
    """
    found = closest_preset(lookup_preset(requests, presets), presets)
    automatic = F.col("selection_mode") == "automatic"
    selected = F.when(automatic, F.col("nearest")).otherwise(F.col("chosen"))
    override = F.coalesce(F.col("resolution") > 0, F.lit(False))
    size = longer_side(F.col("_selected.width"), F.col("_selected.height"), F.col("resolution"))
    plain = F.struct(
        F.when(automatic, F.col("_selected.width")).otherwise(F.greatest(F.lit(1), F.col("width"))).alias("w"),
        F.when(automatic, F.col("_selected.height")).otherwise(F.greatest(F.lit(1), F.col("height"))).alias("h"),
    )
    return (
        found.withColumn("_selected", selected)
        .withColumn("_target", F.when(override, size).otherwise(plain))
        .withColumn("target_w", F.col("_target.w"))
        .withColumn("target_h", F.col("_target.h"))
        .withColumn(
            "resolution_text",
            F.when(override, F.col("resolution").cast("string")).otherwise(F.col("resolution_text")),
        )
        .drop("_selected", "_target", "chosen", "nearest")
    )


def plan_geometry(targets: DataFrame) -> DataFrame:
    """Crop box, resampled size, borders and output size for requests that know their target.

    Reads src_width, src_height, target_w, target_h, keep_proportion, crop_position.
    """
    c = F.col
    mode, sw, sh, tw, th = c("keep_proportion"), c("src_width"), c("src_height"), c("target_w"), c("target_h")
    whole = F.struct(
        F.lit(0).alias("x"), F.lit(0).alias("y"), sw.cast("int").alias("w"), sh.cast("int").alias("h")
    )
    target = F.struct(tw.cast("int").alias("w"), th.cast("int").alias("h"))
    resized = (
        F.when(mode.isin("stretch", "crop"), target)
        .when(mode == "total_pixels", equal_area_size(tw, th, sw, sh))
        .otherwise(fit_size(tw, th, sw, sh))
    )
    no_pad = F.struct(*[F.lit(0).alias(n) for n in ("left", "right", "top", "bottom")])
    pads = F.when(
        is_padded(mode), padding(tw, th, c("_resized.w"), c("_resized.h"), c("crop_position"))
    ).otherwise(no_pad)
    output = F.when(is_padded(mode), target).otherwise(c("_resized"))
    ratio = tw.cast("double") / th.cast("double")
    return (
        targets.withColumn("_resized", resized)
        .withColumn("crop", F.when(mode == "crop", crop_box(sw, sh, ratio, c("crop_position"))).otherwise(whole))
        .withColumn("pad", pads)
        .withColumn("resized_w", c("_resized.w"))
        .withColumn("resized_h", c("_resized.h"))
        .withColumn("_out", output)
        .withColumn("out_w", c("_out.w"))
        .withColumn("out_h", c("_out.h"))
        .drop("_resized", "_out")
    )


def plan_resize(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """The whole plan of every request: one row in, one row out."""
    planned = plan_geometry(select_targets(requests, presets))
    return planned.withColumn("aspect_ratio", actual_ratio(F.col("out_w"), F.col("out_h")))


def _with_errors(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    found = F.array(*[F.when(condition, F.lit(text)) for text, condition in checks.items()])
    return df.withColumn("errors", F.array_compact(found))


def split_by_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the column, rejected rows with it."""
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


def check_requests(requests: DataFrame) -> DataFrame:
    """Add ``errors``: a request needs an image or a mask, and a method that the resampler knows."""
    given = lambda name: F.coalesce(F.col(name), F.lit(False))
    return _with_errors(requests, {
        "no image and no mask": ~given("has_image") & ~given("has_mask"),
        "unknown method": ~F.coalesce(F.col("upscale_method").isin(RESAMPLE_METHODS), F.lit(False)),
    })


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_by_errors(check_requests(requests))


def option_report(requests: DataFrame) -> DataFrame:
    """Which options of a request lie in their closed lists, and what an unlisted mode or anchor acts as."""
    c = F.col
    low, high = SIDE_RANGE
    return requests.select(
        "image_id",
        c("upscale_method").isin(RESAMPLE_METHODS).alias("known_method"),
        c("keep_proportion").isin(RESIZE_MODES).alias("known_mode"),
        c("crop_position").isin(ANCHORS).alias("known_position"),
        (c("width").between(low, high) & c("height").between(low, high)).alias("size_in_range"),
        F.when(c("keep_proportion").isin(RESIZE_MODES), c("keep_proportion")).otherwise("pad").alias("acts_as_mode"),
        F.when(c("crop_position").isin(ANCHORS), c("crop_position")).otherwise("center").alias("acts_as_position"),
    )
