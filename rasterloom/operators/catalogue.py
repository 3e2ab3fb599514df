"""The preset catalogue: projections, choices, lookup with fallbacks, nearest aspect ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dimension_text, resolution_output

# Largest catalogue (in breakpoint rows of some 100 bytes) that is broadcast; beyond it rows are shuffled.
BROADCAST_ROWS = 250_000

# Breakpoint buckets: eighths of a factor two, from 1:16 to 16:1, open at both ends.
_STEPS, _LAST = 8, 32


def label_of_item() -> Column:
    return dimension_text(F.col("ratio"), F.col("label"), F.col("width"), F.col("height"))


def distinct_resolutions(presets: DataFrame) -> DataFrame:
    """Resolution classes of all models with the place where each is first seen."""
    first = F.min(F.struct("model_ord", "res_ord")).alias("first")
    return (
        presets.groupBy("resolution").agg(first)
        .select("resolution", "first.model_ord", "first.res_ord")
        .orderBy("model_ord", "res_ord", "resolution")
    )


def distinct_dimensions(presets: DataFrame) -> DataFrame:
    """Dimension labels of all models with the place where each is first seen."""
    first = F.min(F.struct("model_ord", "res_ord", "item_ord")).alias("first")
    return (
        presets.groupBy(label_of_item().alias("dimensions")).agg(first)
        .select("dimensions", "first.model_ord", "first.res_ord", "first.item_ord")
        .orderBy("model_ord", "res_ord", "item_ord", "dimensions")
    )


def all_choices(presets: DataFrame) -> DataFrame:
    """One distinct list of everything a request may name: models, resolutions and labels."""
    names = F.array(
        F.struct(F.lit("model").alias("kind"), F.col("model").alias("choice")),
        F.struct(F.lit("resolution").alias("kind"), F.col("resolution").alias("choice")),
        F.struct(F.lit("dimensions").alias("kind"), label_of_item().alias("choice")),
    )
    return presets.select(F.inline(names)).distinct()


def choices(presets: DataFrame, model: str | None = None, resolution: str | None = None) -> DataFrame:
    """Menu entries in order: resolutions of a model, or labels once a resolution is given too."""
    chosen = presets if model is None else presets.where(F.col("model") == model)
    if resolution is None:
        return (
            chosen.groupBy("model", "resolution").agg(F.min("res_ord").alias("pos"))
            .select("model", F.col("resolution").alias("choice"), "pos")
        )
    return chosen.where(F.col("resolution") == resolution).select(
        "model", label_of_item().alias("choice"), F.col("item_ord").alias("pos")
    )


def _first_items(presets: DataFrame) -> DataFrame:
    """First item of every (model, resolution)."""
    item = F.struct(
        "item_ord", F.col("ratio"), F.col("width"), F.col("height"), label_of_item().alias("dimensions")
    )
    return presets.groupBy("model", "resolution").agg(
        F.min("model_ord").alias("model_ord"), F.min("res_ord").alias("res_ord"), F.min(item).alias("item")
    )


def first_choices(presets: DataFrame) -> DataFrame:
    """Per model, the resolution and item that stand in for invalid ones."""
    return (
        _first_items(presets)
        .groupBy("model")
        .agg(
            F.min("model_ord").alias("model_ord"),
            F.min(F.struct("res_ord", "resolution", "item")).alias("first"),
        )
        .withColumn("resolution_text", resolution_output(F.col("first.resolution")))
    )


def lookup_preset(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """Resolve (model, resolution_preset, dimensions) level by level, first entries standing in.

    Adds ``chosen_model``, ``chosen_resolution``, ``chosen`` (the item) and ``resolution_text``. The three
    joins keep every request; Spark broadcasts the grouped catalogue while its size allows and otherwise
    shuffles, where adaptive execution splits popular models.
    """
    models = first_choices(presets)
    # The printed resolution is worked out once per catalogue row, not once per request.
    default = F.struct(F.col("first.resolution").alias("resolution"), F.col("first.item").alias("item"), "resolution_text")
    defaults = models.select("model", "model_ord", default.alias("default"))
    first_model = defaults.agg(F.min(F.struct("model_ord", "model", "default")).alias("m")).scalar()
    by_model = defaults.select(F.col("model").alias("_model"), F.col("default").alias("_of_model"))
    by_resolution = _first_items(presets).select(
        F.col("model").alias("_res_model"), F.col("resolution").alias("_resolution"),
        F.struct("resolution", "item", resolution_output(F.col("resolution")).alias("resolution_text")).alias("_of_res"),
    )
    by_label = (
        presets.withColumn("_label", label_of_item())
        .groupBy(
            F.col("model").alias("_lab_model"), F.col("resolution").alias("_lab_resolution"), "_label"
        )
        .agg(F.min(F.struct("item_ord", "ratio", "width", "height", F.col("_label").alias("dimensions"))).alias("_item"))
    )
    with_model = (
        requests.join(by_model, F.col("model") == F.col("_model"), "left")
        .withColumn("chosen_model", F.coalesce("_model", first_model["model"]))
        .withColumn("_of_model", F.coalesce("_of_model", first_model["default"]))
    )
    with_resolution = (
        with_model.join(
            by_resolution,
            (F.col("chosen_model") == F.col("_res_model")) & (F.col("resolution_preset") == F.col("_resolution")),
            "left",
        )
        .withColumn("_of_res", F.coalesce("_of_res", "_of_model"))
        .withColumn("chosen_resolution", F.col("_of_res.resolution"))
    )
    return (
        with_resolution.join(
            by_label,
            (F.col("chosen_model") == F.col("_lab_model"))
            & (F.col("chosen_resolution") == F.col("_lab_resolution"))
            & (F.col("dimensions") == F.col("_label")),
            "left",
        )
        .withColumn("chosen", F.coalesce("_item", "_of_res.item"))
        .withColumn("resolution_text", F.col("_of_res.resolution_text"))
        .drop("_model", "_of_model", "_res_model", "_resolution", "_of_res",
              "_lab_model", "_lab_resolution", "_label", "_item")
    )


def _bucket(ratio: Column) -> Column:
    scaled = F.floor(F.log2(ratio) * _STEPS)
    return F.greatest(F.lit(-_LAST), F.least(F.lit(_LAST), scaled)).cast("int")


def ratio_breakpoints(presets: DataFrame) -> DataFrame:
    """Every distinct ratio of a (model, resolution) with its neighbours, spread over the buckets it can win.

    An image is nearest to an item only if its ratio lies between the item's lower and upper neighbour, so
    a group of n ratios needs at most 2n + 2 * 65 rows however wide the axis is.
    """
    item = F.struct("item_ord", "ratio", "width", "height", label_of_item().alias("dimensions"))
    shapes = (
        presets.withColumn("_shape", F.col("width") / F.col("height"))
        .groupBy("model", "resolution", "_shape")
        .agg(F.min(item).alias("item"))
    )
    near = F.struct("_shape", "item.item_ord", "item.width", "item.height")
    # Distinct width:height quotients only, so a window group cannot grow with copies of a preset.
    order = Window.partitionBy("model", "resolution").orderBy("_shape")
    c = F.col
    big = lambda name: c(name).cast("bigint")

    def margin(rival: str, side: str, absent: int) -> Column:
        return F.coalesce(big(f"item.{side}") * big(f"{rival}.{side}"), F.lit(absent).cast("bigint"))

    def needed(rival: str) -> Column:
        first = c("item.item_ord") < c(f"{rival}.item_ord")
        return F.when(c(rival).isNull() | first, F.lit(0)).otherwise(F.lit(1)).cast("bigint")

    return (
        shapes.withColumn("below", F.lag(near).over(order))
        .withColumn("above", F.lead(near).over(order))
        .withColumn(
            "bucket",
            F.explode(
                F.sequence(
                    F.when(c("below").isNull(), F.lit(-_LAST)).otherwise(_bucket(c("below._shape"))),
                    F.when(c("above").isNull(), F.lit(_LAST)).otherwise(_bucket(c("above._shape"))),
                )
            ),
        )
        .select(
            c("model").alias("_near_model"), c("resolution").alias("_near_resolution"),
            c("bucket").alias("_near_bucket"), c("item").alias("_near"),
            margin("below", "height", 1).alias("_low_h"), margin("below", "width", 0).alias("_low_w"),
            needed("below").alias("_low_need"),
            margin("above", "height", 0).alias("_high_h"), margin("above", "width", 1).alias("_high_w"),
            needed("above").alias("_high_need"),
        )
    )


def _lead(a: Column, b: Column, c: Column, d: Column) -> Column:
    """a * b - c * d, exact in BIGINT; beyond it the sign of the DOUBLE difference."""
    sign = F.when(a.cast("double") * b > c.cast("double") * d, 1).otherwise(-1).cast("bigint")
    return F.coalesce(F.try_subtract(F.try_multiply(a, b), F.try_multiply(c, d)), sign)


def closest_preset(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """Add ``nearest``: the item of the chosen model and resolution nearest in aspect ratio.

    Needs ``chosen_model``, ``chosen_resolution``, ``src_width``, ``src_height``. One equi-join on
    (model, resolution, ratio bucket) with the breakpoint test as its condition: exactly one item passes per
    request, nothing is grouped afterwards.
    """
    breaks = ratio_breakpoints(presets)
    groups = presets.groupBy("model", "resolution").agg(F.count("*").alias("n"))
    rows = groups.agg(F.sum(2 * F.col("n") + 4 * _LAST + 2)).first()[0] or 0
    breaks = F.broadcast(breaks) if rows <= BROADCAST_ROWS else breaks.hint("merge")
    c = F.col
    height = F.greatest(F.lit(1), c("src_height")).cast("bigint")
    width = c("src_width").cast("bigint")
    sized = (
        requests.withColumn("_w2", width * width)
        .withColumn("_h2", height * height)
        .withColumn("_bucket", _bucket(width / height))
    )
    # |ln(s/a)| < |ln(s/b)| for a > b means s*s > a*b; a tie goes to the item that comes first.
    wins = (
        (c("chosen_model") == c("_near_model"))
        & (c("chosen_resolution") == c("_near_resolution"))
        & (c("_bucket") == c("_near_bucket"))
        & (_lead(c("_w2"), c("_low_h"), c("_h2"), c("_low_w")) >= c("_low_need"))
        & (_lead(c("_h2"), c("_high_w"), c("_w2"), c("_high_h")) >= c("_high_need"))
    )
    return (
        sized.join(breaks, wins, "left")
        .withColumnRenamed("_near", "nearest")
        .drop("_w2", "_h2", "_bucket", "_near_model", "_near_resolution", "_near_bucket", "_low_h", "_low_w",
              "_low_need", "_high_h", "_high_w", "_high_need")
    )
