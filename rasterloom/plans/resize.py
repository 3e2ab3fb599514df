"""The whole resize: from requests, catalogue, pixels and masks to resized pixels and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import span
from ..operators import canvas as K
from ..operators.packed import along_both, axis, pack, packed, unpack, whole_rows
from ..operators.planning import is_padded, plan_resize, validate_requests
from ..operators.resample import PIXEL, is_small, method_or_fallback, nearest_planned, with_sizes
from ..session import materialise

# Modes whose border is computed from the resized pixels themselves.
_FROM_PIXELS = ["pad_edge", "pillarbox_blur"]


def _resized(raster: DataFrame, mask: DataFrame, plan: DataFrame, host_resampler: bool, small: bool) -> DataFrame:
    """Packed strips, cropped and resampled; a request without an image uses its mask as one of three channels."""
    c = F.col
    method = method_or_fallback(c("upscale_method"), host_resampler)
    facts = dict(
        x=c("crop.x"), y=c("crop.y"), sw=c("crop.w"), sh=c("crop.h"),
        ax=axis(c("crop.w"), c("resized_w"), method), ay=axis(c("crop.h"), c("resized_h"), method),
    )
    columns = ["image_id", "c", "y", "x0", "row", "p"]
    images = with_sizes(packed(raster), plan.where("has_image"), small, **facts).select(*columns)
    grey = pack(mask.withColumn("c", F.lit(0)), "m").withColumn("c", F.explode(F.array(*map(F.lit, range(3)))))
    source = images.unionByName(with_sizes(grey, plan.where("not has_image"), small, **facts).select(*columns))
    cut = source.withColumn("y", c("y") - c("p.y")).where("y >= 0 and y < p.sh").withColumn(
        "row", F.slice("row", c("p.x") + 1, c("p.sw")))
    return along_both(cut.select("*", "p.ax", "p.ay"))


def _placed(strips: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """Pixels of packed strips at their place on the canvas; edge pixels fill the border where the mode asks for it."""
    c = F.col
    p = lambda name: F.col(f"p.{name}")
    placed = with_sizes(
        strips, plan, small, w=c("resized_w"), h=c("resized_h"), left=c("pad.left"), top=c("pad.top"), tw=c("out_w"), th=c("out_h"),
        repeat=c("keep_proportion") == "pad_edge_pixel",
    )
    at = c("y") + p("top")
    first = F.when(p("repeat") & (c("y") == 0), F.lit(0)).otherwise(at)
    last = F.when(p("repeat") & (c("y") == p("h") - 1), p("th") - 1).otherwise(at)
    begins, ends = c("x0") == 0, c("x0") + F.size("row") == p("w")
    none = F.array().cast("array<double>")
    left = F.when(begins, F.array_repeat(F.element_at("row", 1), p("left"))).otherwise(none)
    right = F.when(ends, F.array_repeat(F.element_at("row", -1), p("tw") - p("left") - p("w"))).otherwise(none)
    return unpack(placed.select(
        "image_id", "c", F.explode(span(first, last)).alias("y"),
        F.when(p("repeat") & begins, F.lit(0)).otherwise(c("x0") + p("left")).alias("x0"),
        F.when(p("repeat"), F.concat(left, c("row"), right)).otherwise(c("row")).alias("row"))).select(*PIXEL)


def _resize_masks(mask: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """Masks of all images. Where the plan has ``shares``, an image's mask is worked out once for all of these images."""
    c = F.col
    if "shares" in plan.columns:
        asked = plan.where("shares is not null")
        own = _resize_masks(mask, asked.drop("shares"), small)
        shared = with_sizes(own, asked, small, shares=c("shares"))
        return shared.select(F.explode("p.shares").alias("image_id"), "y", "x", "m")
    masked = plan.where("has_mask")
    as_source = with_sizes(
        mask, masked, small, sw=c("mask_w"), sh=c("mask_h"), w=c("src_width"), h=c("src_height"), crop=c("crop"),
        rw=c("resized_w"), rh=c("resized_h"), left=c("pad.left"), top=c("pad.top"),
    )
    # First to the image's size, then through the same crop, resize and shift as the image.
    boxed = nearest_planned(as_source).where(
        "x >= p.crop.x and y >= p.crop.y and x < p.crop.x + p.crop.w and y < p.crop.y + p.crop.h"
    )
    cropped = boxed.select(
        "image_id", (c("y") - c("p.crop.y")).alias("y"), (c("x") - c("p.crop.x")).alias("x"), "m",
        F.struct(
            c("p.crop.w").alias("sw"), c("p.crop.h").alias("sh"), c("p.rw").alias("w"), c("p.rh").alias("h"),
            c("p.left").alias("left"), c("p.top").alias("top"),
        ).alias("p"),
    )
    given = nearest_planned(cropped).select(
        "image_id", (c("y") + c("p.top")).alias("y"), (c("x") + c("p.left")).alias("x"), "m"
    )
    bare = plan.where("not has_mask").select(
        "image_id", "resized_w", "resized_h", c("pad.left").alias("_left"), c("pad.top").alias("_top")
    )
    zeros = K.all_cells(bare, ["image_id"], c("resized_h"), c("resized_w")).select(
        "image_id", (c("y") + c("_top")).alias("y"), (c("x") + c("_left")).alias("x"), F.lit(0.0).alias("m")
    )
    border = K.border_cells(K.with_placement(plan), ["image_id"]).select("image_id", "y", "x", F.lit(1.0).alias("m"))
    return given.unionByName(zeros).unionByName(border)


def check_pixels(requests: DataFrame, raster: DataFrame, mask: DataFrame) -> DataFrame:
    """Requests with ``mask_h``, ``mask_w`` and ``errors`` about pixels that are absent or of another size than asked.

    The extents are one partial aggregate over each pixel table; a request without an image takes its mask's pixels,
    which need its size then.
    """
    last = lambda df: F.col("x0") + F.size("row") - 1 if "row" in df.columns else F.col("x")
    extent = lambda df, h, w: df.groupBy("image_id").agg((F.max("y") + 1).alias(h), (F.max(last(df)) + 1).alias(w))
    seen = requests.join(extent(raster, "_h", "_w"), "image_id", "left").join(extent(mask, "mask_h", "mask_w"), "image_id", "left")
    c = F.col
    differs = lambda h, w: (c(h) != c("src_height")) | (c(w) != c("src_width"))
    checks = F.array(
        F.when(c("has_image") & c("_h").isNull(), "image pixels missing"),
        F.when(c("has_image") & differs("_h", "_w"), "image size differs"),
        F.when(c("has_mask") & c("mask_h").isNull(), "mask pixels missing"),
        F.when(~c("has_image") & differs("mask_h", "mask_w"), "image size differs"),
    )
    return seen.withColumn("errors", F.array_compact(checks)).drop("_h", "_w")


def _with_defaults(requests: DataFrame) -> DataFrame:
    given = {n: F.coalesce(F.col(n), F.lit(False)) for n in ("has_image", "has_mask")}
    return requests.withColumns(given | {"keep_proportion": F.coalesce("keep_proportion", F.lit("pad"))})


def _carried_out(
    sound: DataFrame, presets: DataFrame, raster: DataFrame, mask: DataFrame, host_resampler: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pixels, mask, plan) of requests that passed all checks."""
    plan = materialise(plan_resize(sound, presets), "plan")
    mode, small = F.col("keep_proportion"), is_small(plan)
    used = plan.agg(
        *[F.coalesce(F.max(mode == m), F.lit(False)).alias(m) for m in _FROM_PIXELS],
        F.coalesce(F.max(is_padded(mode) & ~mode.isin(*_FROM_PIXELS, "pad_edge_pixel")), F.lit(False)).alias("constant"),
    ).first()
    streamed = plan.where(~mode.isin(_FROM_PIXELS))
    pixels = _placed(_resized(raster, mask, streamed, host_resampler, small), streamed, small)
    if used["constant"]:
        filled = plan.where(is_padded(mode) & ~mode.isin(*_FROM_PIXELS, "pad_edge_pixel"))
        counts = K.channel_counts(raster)
        channels = filled.join(counts, "image_id", "left").select(
            "image_id", F.when(F.col("has_image"), F.col("channels")).otherwise(F.lit(3)).alias("channels")
        )
        pixels = pixels.unionByName(K.constant_border(filled, channels).select(*PIXEL))
    if any(used[m] for m in _FROM_PIXELS):
        own_plan = plan.where(mode.isin(_FROM_PIXELS))
        own = materialise(_resized(raster, mask, own_plan, host_resampler, small), "resized")
        pixels = pixels.unionByName(_placed(own, own_plan, small))
        if used["pad_edge"]:
            edged = plan.where(mode == "pad_edge")
            means = K.edge_means(unpack(own), edged, small)
            pixels = pixels.unionByName(K.edge_mean_border(means, edged).select(*PIXEL))
        if used["pillarbox_blur"]:
            pixels = pixels.unionByName(K.blur_around(whole_rows(own), plan.where(mode == "pillarbox_blur"), small))
    return pixels, _resize_masks(mask, plan, small), plan


def smart_resize(
    requests: DataFrame, presets: DataFrame, raster: DataFrame, mask: DataFrame, host_resampler: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pixels, mask, plan, rejects): every request is either in the plan or in ``rejects(image_id, errors)``.

    The plan is metadata, one row per image, and is written and counted once because pixels, masks and borders all read
    it. Pixels that are needed again for their own border are written once too; other modes stream through.
    A request without a mode is padded. ``raster`` has pixels or, better, packed rows as a reader of image files makes them:
    pixels are packed first, which moves them once more. ``mask`` has pixels.
    """
    accepted, unfit = validate_requests(_with_defaults(requests))
    checked = materialise(check_pixels(accepted, raster, mask), "requests")
    sound = checked.where(F.size("errors") == 0).drop("errors")
    rejects = unfit.select("image_id", "errors").unionByName(checked.where(F.size("errors") > 0).select("image_id", "errors"))
    return *_carried_out(sound, presets, raster, mask, host_resampler), rejects


def smart_resize_batches(
    requests: DataFrame, presets: DataFrame, raster: DataFrame, mask: DataFrame, host_resampler: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``smart_resize`` for batches: ``image_id`` names a batch, ``pos`` its images from 0, in pixels, masks, plan and result.

    A batch has as many masks as images, or one for all, which is worked out once and handed to every image at the end;
    with another number it is rejected. Without images the masks are the images. If one image fails, its batch is rejected.
    """
    c = F.col
    kind = requests.schema["image_id"].dataType
    accepted, unfit = validate_requests(_with_defaults(requests))
    count = lambda df, name: df.groupBy("image_id").agg((F.max("pos") + 1).cast("int").alias(name))
    counted = materialise(accepted.join(count(raster, "images"), "image_id", "left").join(count(mask, "masks"), "image_id", "left"), "batches")
    number = F.coalesce(F.when(c("has_image"), c("images")).otherwise(c("masks")), F.lit(1))
    both = c("has_image") & c("has_mask")
    misfit = F.coalesce(both & (c("masks") != 1) & (c("masks") != c("images")), F.lit(False))
    key = lambda batch, pos: F.concat(batch.cast("string"), F.lit(":"), pos.cast("string"))
    one = F.coalesce(both & (c("masks") == 1) & (number > 1), F.lit(False))
    everyone = F.transform(F.sequence(F.lit(0), number - 1), lambda pos: key(c("image_id"), pos))
    each = counted.where(~misfit).withColumn("number", number).withColumn("one", one).withColumn("everyone", F.when(one, everyone)).withColumn(
        "pos", F.explode(F.sequence(F.lit(0), c("number") - 1)))
    images = each.withColumns({
        "batch_id": c("image_id"), "image_id": key(c("image_id"), c("pos")), "has_mask": c("has_mask") & (~c("one") | (c("pos") == 0)),
        "shares": F.when(~c("one"), F.array(key(c("image_id"), c("pos")))).when(c("pos") == 0, c("everyone")),
    }).drop("images", "masks", "number", "one", "everyone")
    own = lambda df: df.withColumn("image_id", key(c("image_id"), c("pos"))).drop("pos")
    raster, mask = own(raster), own(mask)
    checked = materialise(check_pixels(images, raster, mask), "requests")
    failed = checked.where(F.size("errors") > 0).groupBy("batch_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("errors")))).alias("errors"))
    failed = materialise(failed, "failed")
    sound = checked.join(failed.select("batch_id"), "batch_id", "left_anti").drop("errors", "batch_id")
    rejects = unfit.select("image_id", "errors").unionByName(
        counted.where(misfit).select("image_id", F.array(F.lit("masks fit neither one nor all images")).alias("errors"))).unionByName(
        failed.select(c("batch_id").alias("image_id"), "errors"))
    again = lambda df: df.withColumn("pos", F.regexp_extract("image_id", r":(\d+)$", 1).cast("int")).withColumn(
        "image_id", F.regexp_replace("image_id", r":\d+$", "").cast(kind))
    pixels, masks, plan = _carried_out(sound.drop("pos"), presets, raster, mask, host_resampler)
    return again(pixels), again(masks), again(plan.drop("shares")), rejects
