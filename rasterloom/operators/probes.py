"""Video facts out of probe output: log lines or JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_FPS
from ..functions.text import frame_rate, usable_rate

# What a probe log looks like.
VIDEO_LINE = r"Stream #.*Video:"
SIZE = r"(?<!\d)(\d{2,6})x(\d{2,6})(?!\d)"
FPS = r"(\d+(?:\.\d+)?)\s*fps\b"
TBR = r"(\d+(?:\.\d+)?)\s*tbr\b"
DURATION = r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"

PROBE_SCHEMA = (
    "streams array<struct<avg_frame_rate:string, r_frame_rate:string, width:string, height:string>>, "
    "format struct<duration:string>"
)


def _first_line(pattern: str):
    return F.min_by("line", F.when(F.col("line").rlike(pattern), F.col("line_no")))


def probe_from_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts per file from (file_id, line_no, line), and the files without a video stream."""
    firsts = lines.groupBy("file_id").agg(
        _first_line(VIDEO_LINE).alias("_video"), _first_line(DURATION).alias("_duration")
    )
    number = lambda column, pattern, group=1: F.regexp_extract(column, pattern, group).try_cast("double")
    seconds = (
        number("_duration", DURATION, 1) * 3600 + number("_duration", DURATION, 2) * 60 + number("_duration", DURATION, 3)
    )
    rate = F.coalesce(number("_video", FPS), number("_video", TBR), F.lit(DEFAULT_FPS))
    size = lambda group: F.coalesce(F.regexp_extract("_video", SIZE, group).try_cast("int"), F.lit(0))
    facts = firsts.where(F.col("_video").isNotNull()).select(
        "file_id", usable_rate(rate).alias("fps"), size(1).alias("width"), size(2).alias("height"),
        F.coalesce(seconds, F.lit(0.0)).alias("duration"),
    )
    return facts, firsts.where(F.col("_video").isNull()).select("file_id")


def probe_from_json(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Facts from a JSON document per row, and the rows without a video stream."""
    parsed = df.withColumn("_probe", F.from_json(column, PROBE_SCHEMA)).withColumn(
        "_stream", F.get("_probe.streams", F.lit(0))
    )
    whole = lambda name: F.coalesce(F.col(f"_stream.{name}").try_cast("int"), F.lit(0))
    has_video = F.coalesce(F.size("_probe.streams") > 0, F.lit(False))
    facts = (
        parsed.where(has_video)
        .withColumn("fps", frame_rate(F.col("_stream.avg_frame_rate"), F.col("_stream.r_frame_rate")))
        .withColumn("width", whole("width"))
        .withColumn("height", whole("height"))
        .withColumn("duration", F.coalesce(F.col("_probe.format.duration").try_cast("double"), F.lit(0.0)))
        .drop("_probe", "_stream", column)
    )
    return facts, parsed.where(~has_video).drop("_probe", "_stream", column)
