"""Media files as a table of facts; file contents are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import IMAGE_SUFFIXES, VIDEO_SUFFIXES
from ..functions.text import natural_key
from ..operators.frames import supported


def list_media(
    spark: SparkSession, root: str, suffixes: list[str] = VIDEO_SUFFIXES, recursive: bool = True, natural: bool = False
) -> DataFrame:
    """(path relative to ``root``, size, mtime) of matching files in name order, or in natural order.

    The content column is pruned, so only file status is touched.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )
    folder = "/" + root.split(":", 1)[-1].strip("/") + "/"
    relative = F.substr(F.col("path"), F.instr("path", F.lit(folder)) + F.lit(len(folder)))
    listed = files.where(supported(F.col("path"), suffixes)).withColumn("path", relative)
    return listed.orderBy(natural_key(F.col("path")), "path") if natural else listed.orderBy("path")


def list_images(spark: SparkSession, root: str, suffixes: list[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Like ``list_media`` for the image files of one folder, in natural order."""
    return list_media(spark, root, suffixes, recursive=False, natural=True)
