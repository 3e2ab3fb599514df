"""Positions inside ordered groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


# Groups of up to this many rows are sorted whole in a task.
WHOLE = 100_000


def grouped_position(df: DataFrame, group: list[str], order: list[Column], position: str, total: str) -> DataFrame:
    """Add the 0-based position of a row in its group and the group's size; NULL is a group too.

    Groups of up to ``WHOLE`` rows are ranked by a window, so their rows move once and their order is worked out once.
    Larger ones, told by a count and broadcast by their keys, are cut into ranges.
    """
    sizes = df.groupBy(*group).agg(F.count("*").cast("int").alias("_rows"))
    large = materialise(sizes.where(F.col("_rows") > WHOLE).select(*(F.col(g).alias(f"_of_{g}") for g in group)), "large")
    if large.isEmpty():
        return _ranked_whole(df, group, order, position, total)
    same = reduce(Column.__and__, (F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group))
    apart = lambda how: df.join(F.broadcast(large), same, how)
    return _ranked_whole(apart("left_anti"), group, order, position, total).unionByName(
        _ranked_in_ranges(apart("left_semi"), group, order, position, total))


def _ranked_whole(df: DataFrame, group: list[str], order: list[Column], position: str, total: str) -> DataFrame:
    keys = [f"_key_{i}" for i in range(len(order))]
    rows = Window.partitionBy(*group)
    return df.withColumns(dict(zip(keys, order))).select(
        *df.columns, F.count("*").over(rows).cast("int").alias(total),
        (F.row_number().over(rows.orderBy(*keys)) - 1).cast("int").alias(position))


def _ranked_in_ranges(df: DataFrame, group: list[str], order: list[Column], position: str, total: str) -> DataFrame:
    """``grouped_position`` of groups of any size.

    Rows are dealt out in ranges of (group, order) that Spark samples from the rows themselves, so a range holds
    about equally many whatever the names look like, and one huge group is cut into many. They are stored with the
    number of their range, ranked inside it and shifted by the sizes of the group's earlier ranges; only these sizes
    are ever gathered per group.
    """
    ranged = df.repartitionByRange(*group, *order).withColumn("_block", F.spark_partition_id())
    keyed = materialise(ranged, "ranged")
    blocks = Window.partitionBy(*group).orderBy("_block")
    offsets = keyed.groupBy(*group, "_block").agg(F.count("*").alias("_rows")).select(
        *(F.col(g).alias(f"_of_{g}") for g in group),
        F.col("_block").alias("_of_block"),
        (F.sum("_rows").over(blocks) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*group)).cast("int").alias(total),
    )
    within = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*order))
    same = F.col("_block") == F.col("_of_block")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return (
        keyed.withColumn("_within", within)
        .join(offsets, same)
        .withColumn(position, (F.col("_before") + F.col("_within") - 1).cast("int"))
        .drop("_block", "_within", "_before", "_of_block", *(f"_of_{g}" for g in group))
    )


def spread_range(df: DataFrame, key: list[str], first: Column, last: Column, name: str, step: int = 4096) -> DataFrame:
    """One row per integer in first..last; long ranges are cut into steps that are spread over the tasks."""
    blocks = df.withColumn("_first", first.cast("bigint")).withColumn("_last", last.cast("bigint")).where("_first <= _last")
    starts = F.sequence("_first", "_last", F.lit(step).cast("bigint"))
    cut = blocks.withColumn("_start", F.explode(starts))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut.repartition(tasks, *key, "_start")
    numbers = F.sequence(
        F.col("_start").cast("int"), F.least(F.col("_last"), F.col("_start") + step - 1).cast("int")
    )
    return spread.withColumn(name, F.explode(numbers)).drop("_first", "_last", "_start")
