"""Crop, borders, blur and masks on pixel tables.

Borders are generated from the plan, not found by a join: an image's pixels are shifted into place and the
cells around them are listed row by row, so no canvas meets the pixels in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BLUR_DIMMING, BLUR_SIGMA_PER_PIXEL
from ..functions.geometry import cover_size
from ..functions.kernels import span
from ..functions.text import parse_color
from .ordering import spread_range
from .packed import along_both, axis, packed, unpack
from .resample import PIXEL, is_small, nearest_planned, with_sizes

# Canvas rows listed by one task at a time.
CANVAS_ROWS = 256


def crop(raster: DataFrame, plan: DataFrame) -> DataFrame:
    """Keep the plan's crop box and move its corner to the origin."""
    boxed = with_sizes(
        raster, plan, x=F.col("crop.x"), y=F.col("crop.y"), w=F.col("crop.w"), h=F.col("crop.h")
    )
    return crop_planned(boxed).drop("p")


def crop_planned(df: DataFrame) -> DataFrame:
    x, y = F.col("x") - F.col("p.x"), F.col("y") - F.col("p.y")
    return df.withColumn("x", x).withColumn("y", y).where(
        "x >= 0 and y >= 0 and x < p.w and y < p.h"
    )


def _placement(plan: DataFrame) -> dict[str, Column]:
    c = F.col
    return {
        "w": c("resized_w"), "h": c("resized_h"), "tw": c("out_w"), "th": c("out_h"),
        "left": c("pad.left"), "top": c("pad.top"),
    }


def place(raster: DataFrame, plan: DataFrame) -> DataFrame:
    """Shift pixels to their place on the output canvas."""
    placed = with_sizes(raster, plan, **_placement(plan))
    return _shift(placed).drop("p")


def _shift(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.col("x") + F.col("p.left")).withColumn("y", F.col("y") + F.col("p.top"))


def border_cells(df: DataFrame, key: list[str]) -> DataFrame:
    """Cells (y, x) of the canvas outside the image box, for rows that carry the placement columns."""
    at = lambda name: F.col(f"_{name}")
    padded = df.where((at("tw") > at("w")) | (at("th") > at("h")))
    rows = spread_range(padded, key, F.lit(0), at("th") - 1, "y", CANVAS_ROWS)
    beside = (F.col("y") >= at("top")) & (F.col("y") < at("top") + at("h"))
    none = F.array().cast("array<int>")
    left = F.coalesce(span(F.lit(0), at("left") - 1), none)
    right = F.coalesce(span(at("left") + at("w"), at("tw") - 1), none)
    columns = F.when(beside, F.concat(left, right)).otherwise(span(F.lit(0), at("tw") - 1))
    return rows.withColumn("x", F.explode(columns))


def all_cells(df: DataFrame, key: list[str], height: Column, width: Column) -> DataFrame:
    """Every (y, x) of a height x width canvas per row."""
    rows = spread_range(df, key, F.lit(0), height - 1, "y", CANVAS_ROWS)
    return rows.withColumn("x", F.explode(span(F.lit(0), width - 1)))


def channel_counts(raster: DataFrame) -> DataFrame:
    """Channels per image, read off its first pixel or packed row."""
    return raster.where("y = 0 and x0 = 0" if "row" in raster.columns else "y = 0 and x = 0").groupBy("image_id").agg((F.max("c") + 1).alias("channels"))


def with_placement(plan: DataFrame, *columns: str) -> DataFrame:
    """The plan's placement as plain columns."""
    return plan.select("image_id", *[c.alias(f"_{n}") for n, c in _placement(plan).items()], *columns)


def constant_border(plan: DataFrame, channels: DataFrame) -> DataFrame:
    """Border cells in the plan's colour."""
    fills = (
        with_placement(plan, "pad_color").join(channels, "image_id")
        .withColumn("_fill", parse_color(F.col("pad_color"), F.col("channels")))
        .drop("pad_color", "channels")
    )
    return border_cells(fills, ["image_id"]).select("image_id", "y", "x", F.posexplode("_fill").alias("c", "v"))


def pad_constant(raster: DataFrame, plan: DataFrame) -> DataFrame:
    border = constant_border(plan, channel_counts(raster))
    return place(raster, plan).select(*PIXEL).unionByName(border.select(*PIXEL))


def pad_edge_pixel(raster: DataFrame, plan: DataFrame) -> DataFrame:
    """Edge pixels repeat outwards: the first and last of a row or column also fill the border beyond them."""
    return edge_pixel_planned(with_sizes(raster, plan, **_placement(plan))).drop("p")


def edge_pixel_planned(df: DataFrame) -> DataFrame:
    p = lambda name: F.col(f"p.{name}")

    def reach(axis, offset, size, total):
        at = F.col(axis) + p(offset)
        first = F.when(F.col(axis) == 0, F.lit(0)).otherwise(at)
        last = F.when(F.col(axis) == p(size) - 1, p(total) - 1).otherwise(at)
        return span(first, last)

    return df.withColumn("y", F.explode(reach("y", "top", "h", "th"))).withColumn(
        "x", F.explode(reach("x", "left", "w", "tw"))
    )


def edge_means(raster: DataFrame, plan: DataFrame, small: bool | None = None) -> DataFrame:
    """Per image and channel: mean of the first and last row, first and last column, and the whole."""
    sized = with_sizes(raster, plan, small, w=F.col("resized_w"), h=F.col("resized_h"))
    only = lambda condition: F.avg(F.when(condition, F.col("v")))
    return sized.groupBy("image_id", "c").agg(
        only(F.col("y") == 0).alias("top_mean"), only(F.col("y") == F.col("p.h") - 1).alias("bottom_mean"),
        only(F.col("x") == 0).alias("left_mean"), only(F.col("x") == F.col("p.w") - 1).alias("right_mean"),
        F.avg("v").alias("mean"),
    )


def edge_mean_border(means: DataFrame, plan: DataFrame) -> DataFrame:
    """Border cells: side bands own the corners, bands take the mean of the image edge they touch."""
    x, y, at = F.col("x"), F.col("y"), lambda name: F.col(f"_{name}")
    value = (
        F.when(x >= at("left") + at("w"), F.col("right_mean")).when(x < at("left"), F.col("left_mean"))
        .when(y >= at("top") + at("h"), F.col("bottom_mean")).when(y < at("top"), F.col("top_mean"))
        .otherwise(F.col("mean"))
    )
    return border_cells(means.join(with_placement(plan), "image_id"), ["image_id", "c"]).withColumn("v", value)


def pad_edge_mean(raster: DataFrame, plan: DataFrame) -> DataFrame:
    border = edge_mean_border(edge_means(raster, plan), plan)
    return place(raster, plan).select(*PIXEL).unionByName(border.select(*PIXEL))


def gaussian_blur(raster: DataFrame, sizes: DataFrame, sigma: Column) -> DataFrame:
    """Blur whole images, pixels or packed rows; ``sizes`` has image_id, width, height and what ``sigma`` reads.

    What lies outside the image counts as zero, so edges darken: the divisor is the whole kernel's sum.
    """
    sized = with_sizes(packed(raster), sizes, ax=axis(F.col("width"), sigma=sigma), ay=axis(F.col("height"), sigma=sigma))
    return unpack(along_both(sized.select("*", "p.*")))


def blur_background(raster: DataFrame, plan: DataFrame, small: bool | None = None) -> DataFrame:
    """Packed strips of the blurred, covering copy of each image on its whole output canvas, before it is dimmed.

    Each axis is resampled, cut to the canvas and blurred in one go, so pixels or packed rows move once.
    """
    c = F.col
    cover = cover_size(c("out_w"), c("out_h"), c("resized_w"), c("resized_h"))
    sigma = F.greatest(F.lit(1.0), BLUR_SIGMA_PER_PIXEL * F.least(c("out_w"), c("out_h")))
    method = F.lit("bilinear")
    sized = with_sizes(
        packed(raster), plan.withColumn("_cover", cover), small,
        ax=axis(c("resized_w"), c("_cover.w"), method, c("_cover.x"), c("out_w"), sigma),
        ay=axis(c("resized_h"), c("_cover.h"), method, c("_cover.y"), c("out_h"), sigma),
    )
    return along_both(sized.select("*", "p.*"))


def blur_around(raster: DataFrame, plan: DataFrame, small: bool | None = None) -> DataFrame:
    """The dimmed, blurred background outside the image box."""
    small = is_small(plan) if small is None else small
    boxes = with_sizes(blur_background(raster, plan, small), plan, small, **_placement(plan))
    beside = "y < p.top or y >= p.top + p.h or x < p.left or x >= p.left + p.w"
    cells = boxes.select("image_id", "y", "c", "x0", "p", F.posexplode("row").alias("_at", "v")).withColumn("x", F.col("x0") + F.col("_at"))
    dimmed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") * BLUR_DIMMING))
    return cells.where(beside).withColumn("v", dimmed).select(*PIXEL)


def pad_blur(raster: DataFrame, plan: DataFrame) -> DataFrame:
    """The image over its own blurred background."""
    return place(raster, plan).select(*PIXEL).unionByName(blur_around(raster, plan))


def overlay(canvas: DataFrame, image: DataFrame) -> DataFrame:
    """Image pixels over canvas pixels, cell by cell: the general form for two given pixel tables."""
    cell = ["image_id", "y", "x", "c"]
    top = image.select(*cell, F.col("v").alias("_top"))
    return canvas.join(top, cell, "left").withColumn("v", F.coalesce("_top", "v")).drop("_top")


def pad_mask(mask: DataFrame, plan: DataFrame, fill: float = 1.0) -> DataFrame:
    """Mask shifted into place; the border around it counts as outside."""
    border = border_cells(with_placement(plan), ["image_id"]).select("image_id", "y", "x", F.lit(fill).alias("m"))
    placed = _shift(with_sizes(mask, plan, **_placement(plan))).select("image_id", "y", "x", "m")
    return placed.unionByName(border)


def mask_to_image(mask: DataFrame) -> DataFrame:
    """A mask as an image of three equal channels."""
    return mask.select(
        "image_id", "y", "x", F.explode(F.array(*map(F.lit, range(3)))).alias("c"), F.col("m").alias("v")
    )


def align_masks(images: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One mask per image of the image's size, and the batches whose masks fit neither one nor all images.

    ``images`` has (image_id, batch_id, pos, height, width), ``masks`` pixels (batch_id, pos, y, x, m). A
    single mask serves its whole batch, a missing one is all zero, another size is resized.
    """
    c = F.col
    mask_facts = masks.groupBy("batch_id").agg(
        (F.max("pos") + 1).alias("masks"), (F.max("y") + 1).alias("mask_h"), (F.max("x") + 1).alias("mask_w")
    )
    batches = images.groupBy("batch_id").agg(F.count("*").alias("images"))
    facts = batches.join(mask_facts, "batch_id", "left")
    unfit = c("masks").isNotNull() & (c("masks") != 1) & (c("masks") != c("images"))
    served = images.join(facts.where(~unfit), "batch_id")
    zeros = all_cells(
        served.where(c("masks").isNull()).select("image_id", "height", "width"), ["image_id"], c("height"), c("width")
    ).select("image_id", "y", "x", F.lit(0.0).alias("m"))
    sizes = F.struct(c("mask_w").alias("sw"), c("mask_h").alias("sh"), c("width").alias("w"), c("height").alias("h"))
    wanted = served.where(c("masks").isNotNull()).select(
        "image_id", "batch_id", F.when(c("masks") == 1, 0).otherwise(c("pos")).alias("pos"), sizes.alias("p")
    )
    given = nearest_planned(masks.join(wanted, ["batch_id", "pos"])).select("image_id", "y", "x", "m")
    return given.unionByName(zeros), facts.where(unfit).select("batch_id", "images", "masks")


def quantise(raster: DataFrame) -> DataFrame:
    """Values as bytes; one, three or four channels stay, of any other number the first three."""
    more = raster.where("c = 4 and y = 0 and x = 0").select("image_id")
    kept = raster.where("c < 3").unionByName(raster.where("c = 3").join(more, "image_id", "left_anti"))
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v")))
    return kept.select("image_id", "y", "x", "c", F.rint(clamped * 255).cast("int").alias("v"))


def normalise(raster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Byte pixels (image_id, channels, y, x, c, v) as colour values and mask, both 0..1.

    Grey images get three equal channels; the mask is one minus alpha, zero without an alpha channel.
    """
    c, value = F.col("c"), F.col("v") / 255.0
    targets = F.when(F.col("channels") == 1, F.array(*map(F.lit, range(3)))).otherwise(F.array("c"))
    image = raster.where("c < 3").select("image_id", "y", "x", F.explode(targets).alias("c"), value.alias("v"))
    alpha = F.col("channels") == 4
    mask = raster.where(c == F.when(alpha, 3).otherwise(0)).select(
        "image_id", "y", "x", F.when(alpha, 1.0 - value).otherwise(0.0).alias("m")
    )
    return image, mask
