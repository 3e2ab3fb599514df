"""Image files as packed rows and pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import IMAGE_SUFFIXES
from ..operators.frames import supported
from ..operators.packed import PACKED, unpack
from ..session import materialise
from .png import decode_png, encode_png

# Image rows are handed on in batches of about this many pixel values.
BATCH_VALUES = 1 << 20

_PIXEL_SCHEMA = "image_id {key}, channels int, y int, x int, c int, v int"


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            record = {name: batch.column(name)[row] for name in batch.schema.names}
            height, width, channels = (record[n].as_py() for n in ("height", "width", "channels"))
            values = np.frombuffer(record["data"].as_buffer(), dtype=np.uint8).reshape(height, width, channels)
            if channels >= 3:
                # Stored blue, green, red: turn to red, green, blue and leave alpha where it is.
                values = values[:, :, [2, 1, 0] + list(range(3, channels))]
            step = max(1, BATCH_VALUES // (width * channels))
            for top in range(0, height, step):
                part = values[top : top + step]
                y, x, c = (a.ravel().astype(np.int32) for a in np.indices(part.shape))
                key = pa.repeat(record["image_id"], part.size)
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(np.full(part.size, channels, np.int32)), pa.array(y + np.int32(top)),
                     pa.array(x), pa.array(c), pa.array(part.ravel().astype(np.int32))],
                    names=["image_id", "channels", "y", "x", "c", "v"],
                )


def unpack_images(images: DataFrame) -> DataFrame:
    """Byte pixels of (image_id, height, width, channels, data) rows, data in blue-green-red(-alpha) order."""
    key = images.schema["image_id"].dataType.simpleString()
    columns = images.select("image_id", "height", "width", "channels", "data")
    return columns.mapInArrow(_pixels, _PIXEL_SCHEMA.format(key=key))


#: Rows of decoded files: colours are channels 0 to 2, the mask is channel ``MASK``.
MASK = 3
_ROW_SCHEMA = "path string, error string, c int, y int, row array<double>"


def _file_rows(path: str, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the bytes (height, width, channels): three colours, and one minus alpha or zero as the mask."""
    height, width, channels = values.shape
    colours = values[..., :3] if channels >= 3 else np.repeat(values[..., :1], 3, axis=2)
    step = max(1, BATCH_VALUES // (4 * width))
    for top in range(0, height, step):
        part = colours[top : top + step] / 255.0
        mask = 1.0 - values[top : top + step, :, -1] / 255.0 if channels in (2, 4) else np.zeros(part.shape[:2])
        flat = np.concatenate((part, mask[..., None]), axis=2).transpose(2, 0, 1)
        n = flat.shape[0] * flat.shape[1]
        offsets = np.arange(n + 1, dtype=np.int32) * width
        c, y = np.repeat(np.arange(4, dtype=np.int32), flat.shape[1]), np.tile(np.arange(top, top + flat.shape[1], dtype=np.int32), 4)
        yield pa.RecordBatch.from_arrays(
            [pa.array([path] * n), pa.nulls(n, pa.string()), pa.array(c), pa.array(y), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))],
            ["path", "error", "c", "y", "row"])


def _reject(path: str, error: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path]), pa.array([error]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.float64()))],
        ["path", "error", "c", "y", "row"])


def _png_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                values = decode_png(content.as_py() or b"")
            except ValueError as error:
                yield _reject(path, str(error))
            else:
                yield from _file_rows(path, values)


def _stored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, height, width, channels, data in zip(*batch.columns, strict=True):
            shape = tuple(n.as_py() for n in (height, width, channels))
            if shape[0] is None or shape[0] <= 0:
                yield _reject(path.as_py(), "unreadable")
                continue
            values = np.frombuffer(data.as_buffer(), np.uint8).reshape(shape)
            # Stored blue, green, red.
            yield from _file_rows(path.as_py(), values[..., [2, 1, 0, *range(3, shape[2])]] if shape[2] >= 3 else values)


def decode_png_files(files: DataFrame) -> DataFrame:
    """``path, error, c, y, row`` of PNG files ``path, content``: the rows of each image, or one row with ``error``.

    All colour types and depths are read, interlaced ones too. Grey images have three equal colours; the mask is one
    minus alpha, zero without an alpha channel.
    """
    return files.select(F.col("path").cast("string"), "content").mapInArrow(_png_rows, _ROW_SCHEMA)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shape = tuple(batch.column(k)[i].as_py() for k in (1, 2, 3))
            content = encode_png(np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).reshape(shape))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([content], pa.binary())], ["path", "content"])


def encode_png_files(frames: DataFrame) -> DataFrame:
    """``path, content``: PNG files of packed frames (path, height, width, channels, data), one to four channels of bytes."""
    return frames.select("path", "height", "width", "channels", "data").mapInArrow(_encoded, "path string, content binary")


def _any_case(suffixes: list[str]) -> str:
    letters = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
    return "*{" + ",".join(letters(s) for s in suffixes) + "}"


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Like ``decode_png_files`` for all files under ``path``, stored once.

    PNG files are decoded here, the other formats by Spark's image source; what is no image file by its name is rejected.
    """
    named = F.col("_metadata.file_path").alias("path")
    source = lambda kind, suffixes: spark.read.format(kind).option("recursiveFileLookup", recursive).option("pathGlobFilter", _any_case(suffixes)).load(path)
    png, others = [".png"], [s for s in IMAGE_SUFFIXES if s != ".png"]
    image = lambda name: F.col(f"image.{name}")
    stored = source("image", others).select(named, image("height"), image("width"), image("nChannels"), image("data"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select(named)
    foreign = listed.where(~supported(F.col("path"), IMAGE_SUFFIXES)).select(
        "path", F.lit("no image file").alias("error"), F.lit(None).cast("int").alias("c"), F.lit(None).cast("int").alias("y"),
        F.lit(None).cast("array<double>").alias("row"))
    found = decode_png_files(source("binaryFile", png).select(named, "content")).unionByName(stored.mapInArrow(_stored_rows, _ROW_SCHEMA)).unionByName(foreign)
    return materialise(found, "decoded")


def split_files(found: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``read_files`` or ``decode_png_files``: packed colour rows, mask pixels (image_id, y, x, m), and rejects (path, error).

    Images are known by their path, or by ``ids`` (path, image_id) where given.
    """
    good = found.where("error is null")
    keyed = good.withColumnRenamed("path", "image_id") if ids is None else good.join(ids, "path")
    rows = keyed.withColumn("x0", F.lit(0)).select(*PACKED)
    mask = unpack(rows.where(F.col("c") == MASK)).select("image_id", "y", "x", F.col("v").alias("m"))
    return rows.where(F.col("c") < MASK), mask, found.where("error is not null").select("path", "error")


def raster_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``path, error``: the files under ``path`` that ``read_rasters`` leaves out, as they can't be decoded."""
    return split_files(read_files(spark, path))[2]


def read_rasters(spark: SparkSession, path: str, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Colour pixels and mask of all usable images under ``path``; ``raster_rejects`` lists the others.

    ``split_files(read_files(…))`` gives all three from one reading, and the colours as packed rows.
    """
    rows, mask, _ = split_files(read_files(spark, path), ids)
    return unpack(rows), mask
