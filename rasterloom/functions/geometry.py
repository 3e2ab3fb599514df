"""Integer geometry of resize plans. Every function returns one column built from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_down, product, side


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / b.cast("double")


def longer_side(width: Column, height: Column, target: Column) -> Column:
    """Scale a size so that its longer side is ``target``; width counts as longer when equal."""
    target = F.greatest(F.lit(1), target.cast("int"))
    wide = width >= height
    return F.struct(
        F.when(wide, target).otherwise(side(product(target, width) / height)).alias("w"),
        F.when(wide, side(product(target, height) / width)).otherwise(target).alias("h"),
    )


def fit_size(target_w: Column, target_h: Column, width: Column, height: Column) -> Column:
    """Largest size of the same shape inside the target."""
    scale = F.least(_ratio(target_w, width), _ratio(target_h, height))
    return F.struct(side(width * scale).alias("w"), side(height * scale).alias("h"))


def cover_size(target_w: Column, target_h: Column, width: Column, height: Column) -> Column:
    """Smallest size of the same shape that covers the target, and the offset of its centred window."""
    scale = F.greatest(_ratio(target_w, width), _ratio(target_h, height))
    w, h = side(width * scale), side(height * scale)
    return F.struct(
        w.alias("w"),
        h.alias("h"),
        half_down(F.greatest(F.lit(0), w - target_w)).alias("x"),
        half_down(F.greatest(F.lit(0), h - target_h)).alias("y"),
    )


def equal_area_size(target_w: Column, target_h: Column, width: Column, height: Column) -> Column:
    """Source shape with the pixel count of the target."""
    pixels, shape = product(target_w, target_h), _ratio(width, height)
    return F.struct(side(F.sqrt(pixels * shape)).alias("w"), side(F.sqrt(pixels / shape)).alias("h"))


def _anchored(free: Column, position: Column, start: str, end: str) -> Column:
    return F.when(position == start, F.lit(0)).when(position == end, free).otherwise(half_down(free))


def crop_box(width: Column, height: Column, ratio: Column, position: Column) -> Column:
    """Box of the wanted ratio inside the source: one axis whole, the other cut at the anchor."""
    too_wide = _ratio(width, height) > ratio
    w = F.when(too_wide, side(height * ratio)).otherwise(width).cast("int")
    h = F.when(too_wide, height).otherwise(side(width / ratio)).cast("int")
    return F.struct(
        _anchored(width - w, position, "left", "right").alias("x"),
        _anchored(height - h, position, "top", "bottom").alias("y"),
        w.alias("w"),
        h.alias("h"),
    )


def padding(target_w: Column, target_h: Column, width: Column, height: Column, position: Column) -> Column:
    """Border widths; the position names the side the image is anchored to."""
    extra_w = F.greatest(F.lit(0), target_w - width)
    extra_h = F.greatest(F.lit(0), target_h - height)
    left = _anchored(extra_w, position, "left", "right")
    top = _anchored(extra_h, position, "top", "bottom")
    return F.struct(
        left.cast("int").alias("left"),
        (extra_w - left).cast("int").alias("right"),
        top.cast("int").alias("top"),
        (extra_h - top).cast("int").alias("bottom"),
    )
