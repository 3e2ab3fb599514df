"""Incremental passes over frames that keep arriving.

Every pass writes what a batch produced under the batch's own number and replaces it when the batch is
repeated, so a restart neither loses nor doubles anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.constants import FRAME_FILES
from ..operators.frames import extraction_plan
from ..session import materialise
from ..sources.versions import merge_buckets, read_buckets


def frame_stream(
    spark: SparkSession, path: str, schema, format: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """New files under ``path`` as a stream."""
    reader = spark.readStream.format(format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def _drain(writer, checkpoint: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_frames(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Pass every frame that is new since the last run through ``fn``, exactly once."""
    writer = stream.transform(fn).writeStream.format("parquet").option("path", sink).outputMode("append")
    return _drain(writer, checkpoint)


def upsert_batch(sink: str, key: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps, per key, the row that is last in ``order``, in the buckets that the batch touches.

    A batch is published under its number; repeating it replaces its own files from the versions before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        settle = lambda old, new: last_rows(old.unionByName(new), key, order)
        merge_buckets(last_rows(batch, key, order), sink, key, settle, buckets=buckets, version=batch_id)

    return write


def last_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key; copies of a key collapse before the shuffle."""
    rest = [c for c in df.columns if c not in key and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, "_last.*").select(*df.columns)


def keep_last(stream: DataFrame, sink: str, checkpoint: str, key: list[str], order: list[str], buckets: int = 64) -> StreamingQuery:
    """Last write wins: ``read_last`` finds one row per key. A sink belongs to one checkpoint and number of buckets."""
    return _drain(stream.writeStream.foreachBatch(upsert_batch(sink, key, order, buckets)), checkpoint)


def read_last(spark: SparkSession, sink: str) -> DataFrame:
    """The last row per key of all published batches; nothing is grouped again."""
    return read_buckets(spark, sink)


def completed_videos(stream: DataFrame, manifest: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Write each video to ``sink``/completed once, in the batch in which its last expected frame arrives.

    Only names of frames count, each once however late it is repeated: the stream's state remembers every name and the
    number of names per video. A batch reads, besides its own counts, only the videos completed before it.
    """
    new = stream.where(F.col("frame_name").rlike(FRAME_FILES)).dropDuplicates(["video_id", "frame_name"])
    found = new.groupBy("video_id").agg(F.count("*").alias("found"))

    def write(batch: DataFrame, batch_id: int) -> None:
        done = batch.join(manifest.select("video_id", "frame_count"), "video_id").where(F.col("found") >= F.col("frame_count"))
        if batch_id:
            before = batch.sparkSession.read.schema("video_id string, batch bigint").parquet(f"{sink}/completed")
            done = done.join(before.where(F.col("batch") < batch_id), "video_id", "left_anti")
        done.select("video_id", "frame_count").write.mode("overwrite").parquet(f"{sink}/completed/batch={batch_id}")

    return _drain(found.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def read_completed(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/completed").drop("batch")


def detect_changes(
    stream: DataFrame, manifest: DataFrame, counts: DataFrame, replace, sink: str, checkpoint: str
) -> StreamingQuery:
    """Decide for each arriving source whether its extracted frames still hold.

    ``counts`` is worked out once and stored; batches read the result, not the frames.
    """
    decided = extraction_plan(stream, manifest, materialise(counts, "counts"), replace)
    return _drain(decided.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)
