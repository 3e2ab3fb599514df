"""User code between extraction and assembly: one frame in, exactly one frame out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def apply_per_frame(
    frames: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: tuple[str, ...] = ("video_id", "frame_idx")
) -> DataFrame:
    """Run array code on each frame's pixels, gathered as one pandas frame per frame of a video.

    Column logic needs none of this: ``frames.transform(fn)`` keeps it in generated code. All pixel rows of a frame meet
    in one Python group, so this is for small frames; ``apply_per_packed_frame`` takes large ones.
    """
    return frames.groupBy(*key).applyInPandas(fn, schema)


def apply_per_packed_frame(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray], dtype: str = "uint8") -> DataFrame:
    """Run array code on frames that are one row each: (height, width, channels, data) besides other columns.

    ``data`` holds the bytes of an array (height, width, channels) of ``dtype``; ``fn`` gives back one of the same shape.
    Rows stay where they are and one frame at a time is unpacked. ``packed.pack_frames`` makes such frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("data")
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shape = tuple(row.column(row.schema.get_field_index(n))[0].as_py() for n in ("height", "width", "channels"))
                done = np.asarray(fn(np.frombuffer(row.column(at)[0].as_buffer(), dtype).reshape(shape)), dtype)
                if done.shape != shape:
                    raise ValueError(f"a frame of shape {shape} came back as {done.shape}")
                yield row.set_column(at, row.schema.field(at), pa.array([done.tobytes()], row.schema.field(at).type))

    return frames.mapInArrow(run, frames.schema)
