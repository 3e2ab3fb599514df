"""Saved fingerprints of extracted videos, and the frame and sequence sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import merge_buckets, publish_table, read_table

MANIFEST_SCHEMA = (
    "video_id string, path string, size bigint, mtime timestamp_ntz, fps double, width int, height int, frame_count int"
)
_FIELDS = [f.split()[0] for f in MANIFEST_SCHEMA.split(", ")]


def encode_manifest(manifest: DataFrame) -> DataFrame:
    """One JSON text per video."""
    return manifest.select(F.to_json(F.struct(*_FIELDS)).alias("value"))


def decode_manifest(texts: DataFrame, column: str = "value") -> DataFrame:
    """Parsed entries; an unreadable text or one without path, size or time is no fingerprint and is left out."""
    schema = MANIFEST_SCHEMA + ", _corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = texts.select(F.from_json(column, schema, options).alias("m")).select("m.*")
    usable = F.col("_corrupt").isNull() & F.col("path").isNotNull() & F.col("size").isNotNull() & F.col("mtime").isNotNull()
    return parsed.where(usable).select(*_FIELDS)


def read_manifest(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    if format == "json":
        return decode_manifest(spark.read.text(path))
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def merge_manifest(saved: DataFrame, touched: DataFrame) -> DataFrame:
    """The saved entries, with those of the videos in ``touched`` replaced and new videos added."""
    kept = saved.join(touched.select("video_id").distinct(), "video_id", "left_anti")
    return kept.select(*_FIELDS).unionByName(touched.select(*_FIELDS))


def write_manifest(manifest: DataFrame, path: str, format: str = "parquet") -> None:
    """Replace the manifest. Spark deletes the old files first, so a merged manifest goes to a new path."""
    if format == "json":
        encode_manifest(manifest).write.mode("overwrite").text(path)
    else:
        manifest.select(*_FIELDS).write.mode("overwrite").parquet(path)


def publish_manifest(manifest: DataFrame, root: str) -> int:
    """Write the manifest as a new version below ``root`` and publish it; readers have the old one until then."""
    return publish_table(manifest.select(*_FIELDS), root)


def update_manifest(touched: DataFrame, root: str) -> int:
    """Publish the latest manifest with the entries of the videos in ``touched`` replaced and new videos added."""
    return publish_manifest(merge_manifest(read_published_manifest(touched.sparkSession, root), touched), root)


def read_published_manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The latest published manifest, or an older one; no entries before the first."""
    return read_table(spark, root, MANIFEST_SCHEMA, version)


def replace_frames(frames: DataFrame, root: str, key: tuple[str, ...] = ("video_id", "frame_idx"), buckets: int = 256) -> int:
    """Replace whole frames, known by ``key``, and add new ones; only the buckets of their videos are written."""
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select(*key).distinct(), list(key), "left_anti").select(*new.columns).unionByName(new)

    order = [*key, *(c for c in ("y", "c") if c in frames.columns and c not in key)]
    return merge_buckets(frames, root, [key[0]], merge, order, buckets)


def write_frames(frames: DataFrame, path: str, buckets: int = 256) -> None:
    """Write frame or pixel rows in a fixed number of folders by video.

    One folder per video would mean millions of folders. Range partitioning gives every task an equal share
    in (bucket, video, frame) order, so a very long video is cut into many files and a bucket has few.
    """
    order = ["bucket", "video_id"] + [c for c in ("frame_idx", "frame_name", "y") if c in frames.columns]
    bucketed = frames.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int"))
    bucketed.repartitionByRange(*order).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_timeline(timeline: DataFrame, path: str) -> None:
    """Sequence lists as a table, range-sorted so that each list can be read off in order."""
    timeline.repartitionByRange("video_id", "pos").sortWithinPartitions("video_id", "pos").write.mode(
        "overwrite"
    ).parquet(path)
