"""Streaming and user-hook queries: the views arrive as files and every run drains what is there."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import frames as V
from ..operators import packed as K
from ..operators.hooks import apply_per_frame, apply_per_packed_frame
from ..session import scratch_path
from ..streaming import passes as P
from .frame_queries import ACTIONS_SQL
from .registry import query


# Rows of a file that arrives.
FILE_ROWS = 500_000


def _arriving(t, df, name):
    """``df`` written as at least four files of at most some ``FILE_ROWS`` rows and read as a stream of half of them per batch."""
    path, files = scratch_path(t.spark, name), max(4, -(-df.count() // FILE_ROWS))
    df.repartition(files).write.parquet(path)
    return P.frame_stream(t.spark, path, df.schema, max_files=-(-files // 2))


def _paths(t, name):
    return scratch_path(t.spark, f"{name}-out"), scratch_path(t.spark, f"{name}-progress")


@query("str1_incremental_frame_pass", """
select video_id, frame_idx, frame_name, payload * 2 + 1 as processed from frames_fx""", "frames_fx")
def _(t):
    stream = _arriving(t, t.frames_fx, "frames")
    sink, progress = _paths(t, "pass")
    step = lambda df: df.select("video_id", "frame_idx", "frame_name", (F.col("payload") * 2 + 1).alias("processed"))
    P.run_frames(stream, step, sink, progress)
    return t.spark.read.parquet(sink)


@query("str2_completion_detection", """
with c as (select video_id, count(distinct frame_name) as n from frames_fx group by video_id)
select m.video_id, frame_count from manifest_fx m join c on c.video_id = m.video_id where n >= frame_count""", "frames_fx manifest_fx")
def _(t):
    stream = _arriving(t, t.frames_fx.select("video_id", "frame_name"), "frames")
    sink, progress = _paths(t, "completed")
    P.completed_videos(stream, t.manifest_fx, sink, progress)
    return P.read_completed(t.spark, sink)


@query("str3_last_write_wins", """
select video_id, frame_name, max((arrived, payload))[2] as payload from frames_fx group by video_id, frame_name""", "frames_fx")
def _(t):
    stream = _arriving(t, t.frames_fx, "frames")
    sink, progress = _paths(t, "last")
    key, order = ["video_id", "frame_name"], ["arrived", "payload"]
    P.keep_last(stream, sink, progress, key, order, buckets=8)
    return P.read_last(t.spark, sink).select(*key, "payload")


@query("str4_changed_source_detection", ACTIONS_SQL, "sources_fx manifest_fx frames_fx")
def _(t):
    stream = _arriving(t, t.sources_fx, "sources")
    sink, progress = _paths(t, "changes")
    P.detect_changes(stream, t.manifest_fx, V.frame_counts(t.frames_fx), F.col("size") % 2 == 0, sink, progress)
    return t.spark.read.parquet(sink).select("video_id", "action")


def _stretch_contrast(pixels: pd.DataFrame) -> pd.DataFrame:
    centred = pixels["v"] - pixels["v"].mean()
    return pixels.assign(v=(0.5 + 1.5 * centred).clip(0.0, 1.0))


@query("udf1_per_frame_transform", """
with m as (select image_id, avg(v) as mean from raster_fx group by image_id)
select (r.image_id // 10)::varchar as video_id, (r.image_id % 10)::int as frame_idx, y, x, round(least(1, greatest(0, 0.5 + 1.5 * (v - mean))), 6) + 0.0 as v
from raster_fx r join m on m.image_id = r.image_id""", "raster_fx")
def _(t):
    frames = t.raster_fx.select(
        F.expr("image_id div 10").cast("string").alias("video_id"), (F.col("image_id") % 10).cast("int").alias("frame_idx"),
        "y", "x", "v",
    )
    done = apply_per_frame(frames, _stretch_contrast, "video_id string, frame_idx int, y int, x int, v double")
    return done.withColumn("v", F.round("v", 6) + F.lit(0.0))


@query("udf1_per_packed_frame", """
with m as (select image_id, avg(v) as mean from raster_fx group by image_id)
select (r.image_id // 10)::varchar as video_id, (r.image_id % 10)::int as frame_idx, y, x, round(least(1, greatest(0, 0.5 + 1.5 * (v - mean))), 6) + 0.0 as v
from raster_fx r join m on m.image_id = r.image_id""", "raster_fx")
def _(t):
    stretch = lambda frame: (0.5 + 1.5 * (frame - frame.mean())).clip(0.0, 1.0)
    done = apply_per_packed_frame(K.pack_frames(K.pack(t.raster_fx), "float64"), stretch, "float64")
    pixels = K.unpack(K.unpack_frames(done, "float64"))
    return pixels.select(
        F.expr("image_id div 10").cast("string").alias("video_id"), (F.col("image_id") % 10).cast("int").alias("frame_idx"),
        "y", "x", (F.round("v", 6) + F.lit(0.0)).alias("v"))


@query("udf1_per_frame_columns", """
select image_id, y, x, c, round(least(1, v * 1.2), 6) + 0.0 as v from raster_fx""", "raster_fx")
def _(t):
    brighter = lambda df: df.withColumn("v", F.round(F.least(F.lit(1.0), F.col("v") * 1.2), 6) + F.lit(0.0))
    return t.raster_fx.transform(brighter)
