"""Frame sequences: listing order, change detection, completeness, timelines, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CRF_RANGE, FRAME_FILES, VIDEO_CODECS, VIDEO_SUFFIXES
from ..functions.text import (
    clean_path, frame_name, natural_key, relative_folder, safe_output_name, suffix, unquote, usable_rate,
)
from .ordering import grouped_position, spread_range


def frame_listing(frames: DataFrame, names: str | None = FRAME_FILES) -> DataFrame:
    """Every (video, name) once, as a folder would list it; copies collapse before the shuffle.

    Other files of the folder, such as a cover or the finished video, are no frames; ``names=None`` takes all.
    """
    listed = frames.select("video_id", "frame_name")
    return (listed if names is None else listed.where(F.col("frame_name").rlike(names))).distinct()


def index_frames(frames: DataFrame, names: str | None = FRAME_FILES) -> DataFrame:
    """Position of each frame in name order and the number of frames of its video."""
    return grouped_position(frame_listing(frames, names), ["video_id"], [F.col("frame_name")], "frame_idx", "frame_count")


def natural_index(frames: DataFrame, names: str | None = FRAME_FILES) -> DataFrame:
    """Position of each frame in natural order (numbers by value), name as tie-break."""
    name = F.col("frame_name")
    return grouped_position(frame_listing(frames, names), ["video_id"], [natural_key(name), name], "frame_idx", "found_count")


def frame_counts(frames: DataFrame) -> DataFrame:
    """Distinct frame names per video."""
    return frame_listing(frames).groupBy("video_id").agg(F.count("*").alias("frame_count"))


def take_expected(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The first ``frame_count`` found frames of each video in natural order."""
    expected = manifest.select("video_id", "frame_count")
    return natural_index(found).join(expected, "video_id").where(F.col("frame_idx") < F.col("frame_count"))


def completeness(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Whether enough frames exist; only counts are compared, so a stale frame can stand in for a missing one."""
    counts = frame_counts(found).withColumnRenamed("frame_count", "found_count")
    usable = F.least(F.coalesce("found_count", F.lit(0)), F.col("frame_count")).cast("int")
    return (
        manifest.select("video_id", "frame_count")
        .join(counts, "video_id", "left")
        .select("video_id", "frame_count", usable.alias("found"), (usable == F.col("frame_count")).alias("complete"))
    )


def expected_frames(manifest: DataFrame, name: Column | None = None) -> DataFrame:
    """One row per frame a video should have, numbered from one."""
    numbered = spread_range(
        manifest.select("video_id", "frame_count"), ["video_id"], F.lit(1), F.col("frame_count"), "number"
    )
    name = frame_name(F.col("number")) if name is None else name
    return numbered.select("video_id", name.alias("frame_name"))


def missing_frames(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected frames that were not found, by name."""
    return expected.join(found.select("video_id", "frame_name"), ["video_id", "frame_name"], "left_anti")


def match_manifest(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``matches``: path, size and modification time equal those of the last extraction."""
    # The same file may have been extracted into several folders: a video's own entry counts, where entries name it.
    key = ["video_id", "path"] if "video_id" in manifest.columns else ["path"]
    seen = manifest.select(*key, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    return (
        sources.join(seen, key, "left")
        .withColumn("matches", F.coalesce(same, F.lit(False)))
        .drop("_size", "_mtime")
    )


def extraction_plan(sources: DataFrame, manifest: DataFrame, counts: DataFrame, replace: Column | bool) -> DataFrame:
    """Add ``action``: reuse, extract, re-extract or conflict."""
    replace = F.lit(replace) if isinstance(replace, bool) else replace
    present = F.coalesce(F.col("frame_count") > 0, F.lit(False))
    action = (
        F.when(present & F.col("matches"), "reuse").when(~present, "extract").when(replace, "re-extract")
        .otherwise("conflict")
    )
    return match_manifest(sources, manifest).join(counts, "video_id", "left").withColumn("action", action)


def updated_manifest(sources: DataFrame, probes: DataFrame, counts: DataFrame) -> DataFrame:
    """The manifest after extraction: fingerprint, probed rate and size, and the frames that exist."""
    return (
        sources.select("video_id", "path", "size", "mtime")
        .join(probes.select("video_id", "fps", "width", "height"), "video_id")
        .join(counts.select("video_id", F.col("frame_count").cast("int").alias("frame_count")), "video_id")
    )


def frame_context(frames: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every frame with the facts about its video; NULL where the video has no manifest."""
    return frames.join(manifest.select("video_id", "path", "fps", "frame_count"), "video_id", "left")


def timeline(frames: DataFrame, manifest: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Ordered listing with start and duration; the last frame is listed once more without a duration.

    Where the manifest's rate is absent, not finite or not positive, that of ``probes(video_id, fps)`` counts, then the
    default. Every frame is listed, also of a video that the manifest lacks or that has a NULL id.
    """
    listed = natural_index(frames)
    rates = manifest.select(F.col("video_id").alias("_video"), "fps")
    rated = listed.join(rates, listed["video_id"].eqNullSafe(rates["_video"]), "left").drop("_video")
    if probes is not None:
        finite = ~F.isnan("fps") & (F.col("fps") > 0) & (F.col("fps") < float("inf"))
        probed = probes.groupBy(F.col("video_id").alias("_video")).agg(F.max("fps").alias("_probed"))
        rated = rated.join(probed, rated["video_id"].eqNullSafe(probed["_video"]), "left").drop("_video").withColumn(
            "fps", F.when(finite, F.col("fps")).otherwise(F.col("_probed"))).drop("_probed")
    rated = rated.withColumn("fps", usable_rate(F.col("fps")))
    shown = F.struct(
        F.col("frame_idx").alias("pos"), (F.col("frame_idx") / F.col("fps")).alias("start"),
        (F.lit(1.0) / F.col("fps")).alias("duration"),
    )
    again = F.struct(
        (F.col("frame_idx") + 1).alias("pos"), ((F.col("frame_idx") + 1) / F.col("fps")).alias("start"),
        F.lit(None).cast("double").alias("duration"),
    )
    last = F.col("frame_idx") == F.col("found_count") - 1
    entries = F.when(last, F.array(shown, again)).otherwise(F.array(shown))
    return rated.select("video_id", "frame_name", F.inline(entries))


def concat_lines(timeline_rows: DataFrame, folder: Column) -> DataFrame:
    """Text lines of the sequence lists, with their place: header, then file and duration lines."""
    quote = F.replace(F.concat(folder, F.lit("/"), F.col("frame_name")), F.lit("'"), F.lit("'\\''"))
    file_line = F.concat(F.lit("file '"), quote, F.lit("'"))
    duration_line = F.format_string("duration %.12f", F.col("duration"))
    lines = F.array_compact(
        F.array(
            F.when(F.col("pos") == 0, F.lit("ffconcat version 1.0")), file_line,
            F.when(F.col("duration").isNotNull(), duration_line),
        )
    )
    return timeline_rows.select("video_id", "pos", F.posexplode(lines).alias("part", "line"))


def check_index(loops: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loop positions below zero count as zero; those past the last frame or of an unknown video are rejected."""
    known = loops.join(manifest.select("video_id", "frame_count"), "video_id", "left").withColumn(
        "loop_index", F.greatest(F.lit(0), F.col("loop_index"))
    )
    inside = F.coalesce(F.col("loop_index") < F.col("frame_count"), F.lit(False))
    return known.where(inside), known.where(~inside)


def one_frame_check(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames delivered exactly once, and the keys delivered more than once with their count.

    A group of one needs no window: the minimum of each column is the row itself.
    """
    key = ["video_id", "frame_idx"]
    others = [c for c in frames.columns if c not in key]
    grouped = frames.groupBy(*key).agg(F.count("*").alias("delivered"), *[F.min(c).alias(c) for c in others])
    single = grouped.where(F.col("delivered") == 1).select(*frames.columns)
    return single, grouped.where(F.col("delivered") != 1).select(*key, "delivered")


def supported(path: Column, suffixes: list[str] = VIDEO_SUFFIXES) -> Column:
    """Extension filter, whatever the case."""
    return suffix(path).isin(suffixes)


def check_jobs(jobs: DataFrame, output_root: str | None = None) -> DataFrame:
    """Add ``errors`` to extraction jobs (video, frames_folder, processed_folder, clear_processed).

    ``output_root`` is the absolute path that relative folders are below; a folder may name it in full.
    """
    blank = lambda name: F.coalesce(unquote(F.col(name)), F.lit("")) == ""
    below = lambda name: relative_folder(clean_path(F.col(name)), output_root)
    frames, processed = below("frames_folder"), below("processed_folder")
    checks = F.array(
        F.when(blank("video"), "no video"),
        F.when(~blank("video") & ~supported(unquote(F.col("video"))), "unsupported extension"),
        F.when(blank("frames_folder"), "no frames folder"),
        F.when(blank("processed_folder"), "no processed folder"),
        F.when(frames == processed, "same folder"),
        F.when(F.col("clear_processed") & (processed == ""), "would clear the output root"),
    )
    return jobs.withColumn("errors", F.array_compact(checks))


def output_clashes(outputs: DataFrame, existing: DataFrame) -> DataFrame:
    """Add the final path and ``errors`` to (folder, output_filename, video_codec, crf, overwrite)."""
    path = F.concat_ws("/", "folder", safe_output_name(F.col("output_filename")))
    there = existing.select(F.col("path").alias("output_path")).distinct().withColumn("_exists", F.lit(True))
    errors = F.array(
        F.when(F.col("_exists") & ~F.col("overwrite"), "output exists"),
        F.when(~F.col("video_codec").isin(VIDEO_CODECS), "unknown codec"),
        F.when(~F.col("crf").between(*CRF_RANGE), "crf out of range"),
    )
    return (
        outputs.withColumn("output_path", path).join(there, "output_path", "left")
        .withColumn("errors", F.array_compact(errors)).drop("_exists")
    )
