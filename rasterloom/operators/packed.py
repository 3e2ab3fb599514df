"""Images as packed rows (image_id, c, y, x0, row): ``row`` has the values of one channel from column ``x0`` on.

Whatever treats columns and rows alike and apart, resampling, cutting out and blurring, is done along the rows where they
are, then the rows are cut into strips of columns and brought together once, by (image, channel, strip), as arrays. A
strip has so few columns that it fits into ``STRIP_VALUES`` values, whatever the height, so one giant image is spread over
many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taps import blurred, resampled

PACKED = ["image_id", "c", "y", "x0", "row"]
#: Values of a strip at most, before and after it is resampled.
STRIP_VALUES = 1 << 21
#: Finished rows are handed on in batches of about this many values.
BATCH_VALUES = 1 << 19

#: What happens along one axis: resample ``n_in`` to ``n_out`` values, keep ``size`` of them from ``start`` on, blur with ``sigma``.
AXIS = "struct<n_in:int,n_out:int,method:string,start:int,size:int,sigma:double>"


def axis(n_in: Column, n_out: Column | None = None, method: Column | None = None, start: Column | None = None, size: Column | None = None,
         sigma: Column | None = None) -> Column:
    """The facts of an axis; what is left out isn't done."""
    n_out = n_in if n_out is None else n_out
    none = F.lit(None)
    given = (n_in, n_out, none if method is None else method, F.lit(0) if start is None else start, n_out if size is None else size,
             none if sigma is None else sigma)
    names = ("n_in", "n_out", "method", "start", "size", "sigma")
    return F.struct(*[v.alias(n) for v, n in zip(given, names, strict=True)]).cast(AXIS)


def pack(raster: DataFrame, value: str = "v") -> DataFrame:
    """Whole rows of a pixel table. Pixels of a row in one task are put together before they are shuffled.

    A row that lacks a column or has one twice ends the job.
    """
    cells = F.sort_array(F.collect_list(F.struct("x", F.col(value).cast("double").alias("v"))))
    rows = raster.groupBy("image_id", "c", "y").agg(cells.alias("_cells"))
    whole = F.transform("_cells", lambda p: p["x"]) == F.transform(F.sequence(F.lit(0), F.size("_cells") - 1), lambda i: i.cast(raster.schema["x"].dataType))
    row = F.when(whole, F.transform("_cells", lambda p: p["v"])).otherwise(F.raise_error(F.concat(F.lit("pixels missing or repeated in row "), F.col("y"))))
    return rows.select("image_id", "c", "y", F.lit(0).alias("x0"), row.alias("row"))


def packed(raster: DataFrame) -> DataFrame:
    """``raster`` as whole packed rows, which it may be already."""
    return raster if "row" in raster.columns else pack(raster)


def unpack(rows: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, c, v) of packed rows, in place."""
    return rows.select("image_id", "y", "x0", "c", F.posexplode("row").alias("_at", "v")).select(
        "image_id", "y", (F.col("x0") + F.col("_at")).alias("x"), "c", "v")


def whole_rows(strips: DataFrame) -> DataFrame:
    """Rows whose strips lie side by side from column 0 on, as one array each."""
    parts = F.sort_array(F.collect_list(F.struct("x0", "row")))
    return strips.groupBy("image_id", "c", "y").agg(F.flatten(F.transform(parts, lambda p: p["row"])).alias("row")).select(
        "image_id", "c", "y", F.lit(0).alias("x0"), "row")


def _along(lines: np.ndarray, n_in: int, n_out: int, method: str | None, start: int, size: int, sigma: float | None) -> np.ndarray:
    """What an axis asks for, along the first axis of ``lines``."""
    if len(lines) != n_in:
        raise ValueError(f"{len(lines)} values instead of {n_in}")
    if method is not None:
        lines = resampled(lines, method, n_out)
    lines = lines[start : start + size]
    return lines if sigma is None else blurred(lines, sigma)


def _list(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))


def _across(strip_values: int):
    """For mapInArrow over (image_id, c, y, row, ax, ay): the rows after their axis, cut into strips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            axes, heights = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            values = [None] * batch.num_rows
            alike: dict[tuple, list[int]] = {}
            for i, a in enumerate(axes):
                alike.setdefault(tuple(a.values()), []).append(i)
            flat, offsets = batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
            offsets = offsets - offsets[0]
            for a, rows in alike.items():
                step = max(1, 4 * strip_values // max(1, a[0], a[1]))
                for k in range(0, len(rows), step):
                    part = rows[k : k + step]
                    if any(offsets[i + 1] - offsets[i] != a[0] for i in part):
                        raise ValueError(f"a row of other than {a[0]} values")
                    lines = np.stack([flat[offsets[i] : offsets[i + 1]] for i in part], axis=1)
                    for i, line in zip(part, np.ascontiguousarray(_along(lines, *a).T), strict=True):
                        values[i] = line
            at, firsts, sizes = [], [], []
            for i, line in enumerate(values):
                wide = max(1, strip_values // max(1, heights[i]["n_in"], heights[i]["n_out"]))
                for first in range(0, len(line), wide):
                    at.append(i)
                    firsts.append(first)
                    sizes.append(min(wide, len(line) - first))
            rows = batch.select(["image_id", "c", "y", "ay"]).take(pa.array(at, pa.int32()))
            whole = np.concatenate(values) if values else np.empty(0)
            # In slices: a few wide batches in, many values out.
            ends = np.cumsum(sizes)
            cuts = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(BATCH_VALUES, ends[-1] if len(ends) else 0, BATCH_VALUES)) + 1, [len(at)])))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                begin = int(ends[lo - 1]) if lo else 0
                own = rows.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(2), pa.array(firsts[lo:hi], pa.int32()),
                     _list(whole[begin : int(ends[hi - 1])], sizes[lo:hi]), own.column(3)],
                    [*PACKED, "ay"])

    return run


def _stacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one strip after the other, of batches sorted by strip and ``y``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, y = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("_key", "y"))
        before_key, before_y = np.concatenate(([last[0] if last else key[0]], key[:-1])), np.concatenate(([last[1] if last else y[0] - 1], y[:-1]))
        begins = np.flatnonzero((key != before_key) | (y <= before_y)).tolist()
        last = key[-1], y[-1]
        at = 0
        for begin in begins:
            if begin > at:
                held.append(batch.slice(at, begin - at))
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, at = [], begin
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over sorted (image_id, c, y, x0, row, ay, _key): every strip after its axis, as packed rows."""
    done, values = [], 0
    for strip in _stacks(batches):
        lines = strip.column(4).flatten().to_numpy(zero_copy_only=False)
        out = _along(lines.reshape(strip.num_rows, -1), *strip.column(5)[0].as_py().values())
        if not out.size:
            continue
        first = strip.slice(0, 1).take(pa.array(np.zeros(len(out), np.int32)))
        done.append(pa.RecordBatch.from_arrays(
            [first.column(0), first.column(1), pa.array(np.arange(len(out), dtype=np.int32)), first.column(3),
             _list(out.ravel(), np.full(len(out), out.shape[1]))], PACKED))
        values += out.size
        if values >= BATCH_VALUES:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
            done, values = [], 0
    if done:
        yield from pa.Table.from_batches(done).combine_chunks().to_batches()


def along_both(rows: DataFrame) -> DataFrame:
    """Packed strips of whole rows (image_id, c, y, x0, row) that carry ``ax`` and ``ay``, after both axes; one exchange."""
    kind = lambda name: rows.schema[name].dataType.simpleString()
    whole = rows.select(
        "image_id", F.col("c").cast("int").alias("c"), F.col("y").cast("int").alias("y"), "row", "ax", "ay")
    strips = whole.mapInArrow(_across(STRIP_VALUES), f"image_id {kind('image_id')}, c int, y int, x0 int, row array<double>, ay {AXIS}")
    together = strips.withColumn("_key", F.xxhash64("image_id", "c", "x0")).repartition("image_id", "c", "x0").sortWithinPartitions(
        "image_id", "c", "x0", "y")
    return together.mapInArrow(_down, f"image_id {kind('image_id')}, c int, y int, x0 int, row array<double>")


def _row_bytes(dtype: str):
    """For mapInArrow over (image_id, c, y, x0, row): the row as bytes of ``dtype``; of whole numbers by rounding 0..1 to 0..255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = batch.column(4).flatten().to_numpy(zero_copy_only=False), batch.column(4).offsets.to_numpy()
            if dtype == "uint8":
                flat = np.rint(np.clip(flat, 0.0, 1.0) * 255).astype(np.uint8)
            offsets = (offsets - offsets[0]).tolist()
            data = [flat[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(data, pa.binary())], [*PACKED[:4], "data"])

    return run


def _assembled(dtype: str):
    """For mapInArrow over (image_id, parts): frames of parts (y, c, x0, data) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column(1)[i].values
                y, c = (parts.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                shape = int(y.max()) + 1, int(c.max()) + 1
                values = np.frombuffer(b"".join(x.as_buffer() for x in parts.field(3)), dtype)
                if len(values) % (shape[0] * shape[1]):
                    raise ValueError("rows of different lengths in one frame")
                frame = values.reshape(*shape, -1).transpose(0, 2, 1)
                sizes = [pa.array([n], pa.int32()) for n in frame.shape]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), *sizes, pa.array([frame.tobytes()], pa.binary())], ["image_id", *FRAME])

    return run


#: Columns of a frame that is one row: ``data`` has the bytes of an array (height, width, channels).
FRAME = ["height", "width", "channels", "data"]


def pack_frames(rows: DataFrame, dtype: str = "uint8") -> DataFrame:
    """Packed rows or strips as one row per image (image_id, height, width, channels, data).

    ``data`` holds ``dtype``: ``uint8``, for which values 0..1 become 0..255, or ``float64``. What is gathered per image
    are byte strings, one per row or strip, never pixels.
    """
    kind = rows.schema["image_id"].dataType.simpleString()
    parts = rows.select("image_id", F.col("c").cast("int"), F.col("y").cast("int"), F.col("x0").cast("int"), "row").mapInArrow(
        _row_bytes(dtype), f"image_id {kind}, c int, y int, x0 int, data binary")
    together = parts.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "c", "x0", "data"))).alias("parts"))
    return together.mapInArrow(_assembled(dtype), f"image_id {kind}, height int, width int, channels int, data binary")


def _frame_rows(dtype: str):
    """For mapInArrow over (image_id, height, width, channels, data): packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                height, width, channels = (batch.column(k)[i].as_py() for k in (1, 2, 3))
                frame = np.frombuffer(batch.column(4)[i].as_buffer(), dtype).reshape(height, width, channels)
                step = max(1, BATCH_VALUES // (width * channels))
                for top in range(0, height, step):
                    part = frame[top : top + step].transpose(0, 2, 1).astype(np.float64)
                    n = part.shape[0] * channels
                    flat = part.ravel() / 255.0 if dtype == "uint8" else part.ravel()
                    at = pa.array(np.full(n, i, np.int32))
                    c, y = np.tile(np.arange(channels, dtype=np.int32), part.shape[0]), np.repeat(np.arange(top, top + part.shape[0], dtype=np.int32), channels)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), pa.array(c), pa.array(y), pa.array(np.zeros(n, np.int32)), _list(flat, np.full(n, width))], PACKED)

    return run


def unpack_frames(frames: DataFrame, dtype: str = "uint8") -> DataFrame:
    """Packed rows of frames that are one row each; bytes 0..255 become values 0..1."""
    kind = frames.schema["image_id"].dataType.simpleString()
    return frames.select("image_id", *FRAME).mapInArrow(_frame_rows(dtype), f"image_id {kind}, c int, y int, x0 int, row array<double>")
