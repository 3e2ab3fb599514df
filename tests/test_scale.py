"""Wide images, long videos, large catalogues and plan shapes."""

from __future__ import annotations

import math
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.taps import resampled
from rasterloom.operators import canvas as K
from rasterloom.operators import catalogue as C
from rasterloom.operators import frames as V
from rasterloom.operators import ordering
from rasterloom.operators import packed as P
from rasterloom.operators import resample as R
from rasterloom.plans.registry import Tables
from rasterloom.session import materialise
from rasterloom.sources import rasters as S
from rasterloom.sources.png import decode_png, encode_png

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(spark, df) -> int:
    """Bytes that the exchanges of ``df`` write."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = df._jdf.queryExecution()
        execution.toRdd().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    total, nodes = 0, [execution.executedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleBytesWritten").value()
    return total


def gather_weights(n_in: int, n_out: int, method: str) -> np.ndarray:
    """Output-by-input weights, one output at a time."""
    scale = n_in / n_out
    out = np.zeros((n_out, n_in))
    for o in range(n_out):
        if method == "nearest-exact":
            out[o, math.floor((2 * o + 1) * n_in / (2 * n_out))] = 1
        elif method == "area":
            out[o, (o * n_in) // n_out : -((-(o + 1) * n_in) // n_out)] = 1
        else:
            t = np.abs(np.arange(n_in) + 0.5 - scale * (o + 0.5)) / max(scale, 1)
            if method == "bilinear":
                out[o] = np.maximum(0, 1 - t)
            elif method == "bicubic":
                out[o] = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
            else:
                out[o] = np.where(t < 3, np.sinc(t) * np.sinc(t / 3), 0)
    return out / out.sum(axis=1, keepdims=True)


def as_raster(spark, pixels: np.ndarray):
    h, w = pixels.shape
    flat = spark.createDataFrame([(1, pixels.ravel().tolist())], "image_id int, a array<double>")
    cells = flat.select("image_id", F.posexplode("a").alias("i", "v"))
    return cells.select("image_id", F.expr(f"int(i div {w})").alias("y"), F.expr(f"i % {w}").alias("x"), F.lit(0).alias("c"), "v")


def as_array(raster, h: int, w: int, value: str = "v") -> np.ndarray:
    out = np.full((h, w), np.nan)
    rows = raster.select("y", "x", value).collect()
    assert len(rows) == h * w
    for y, x, v in rows:
        out[y, x] = v
    return out


@pytest.mark.parametrize("method", ["nearest-exact", "bilinear", "area", "bicubic", "lanczos"])
@pytest.mark.parametrize("size", [((3, 600), (2, 700)), ((4, 1100), (5, 130)), ((700, 2), (300, 601))])
def test_images_wider_than_a_strip(spark, monkeypatch, method, size):
    monkeypatch.setattr(P, "STRIP_VALUES", 1000)  # strips of one to a few hundred columns
    (h, w), (oh, ow) = size
    pixels = np.random.default_rng(3).random((h, w))
    plan = spark.createDataFrame(
        [(1, w, h, ow, oh, method)], "image_id int, src_width int, src_height int, resized_w int, resized_h int, upscale_method string"
    )
    found = as_array(R.resample(as_raster(spark, pixels), plan), oh, ow)
    wanted = gather_weights(h, oh, method) @ pixels @ gather_weights(w, ow, method).T
    np.testing.assert_allclose(found, wanted, atol=1e-9)


@pytest.mark.parametrize(("h", "w", "sigma"), [(5, 600, 2.3), (40, 300, 5.0), (120, 70, 31.0), (1, 1, 2.0), (30, 40, 90.0)])
def test_blur_wider_than_a_strip(spark, monkeypatch, h, w, sigma):
    """Short and long Gaussians, the latter by Fourier transform, also wider than the image."""
    monkeypatch.setattr(P, "STRIP_VALUES", 700)
    pixels = np.random.default_rng(4).random((h, w))
    sizes = spark.createDataFrame([(1, w, h)], "image_id int, width int, height int")
    radius = int(3 * sigma)
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma**2))
    kernel /= kernel.sum()
    full = lambda line: np.convolve(np.pad(line, radius), kernel, mode="valid")
    wanted = np.apply_along_axis(full, 0, np.apply_along_axis(full, 1, pixels))
    found = as_array(K.gaussian_blur(as_raster(spark, pixels), sizes, F.lit(sigma)), h, w)
    np.testing.assert_allclose(found, wanted, atol=1e-9)


def test_weight_table_agrees_with_resampling(spark):
    sizes = spark.createDataFrame([(m, 9, n) for m in ("bilinear", "lanczos", "area") for n in (4, 9, 17)], "method string, n_in int, n_out int")
    for row in R.weights(sizes).groupBy("method", "n_in", "n_out", "o").agg(F.sum("w").alias("total")).collect():
        assert row.total == pytest.approx(1.0)
    table = {(r.method, r.n_out, r.o, r.i): r.w for r in R.weights(sizes).collect()}
    for (method, n_out, o, i), w in table.items():
        assert w == pytest.approx(gather_weights(9, n_out, method)[o, i], abs=1e-12)


def test_both_passes_share_one_exchange_of_arrays(spark):
    """Packed rows move once; pixels are put together map-side and move once more. No struct is a key."""
    t = Tables(spark, SF)
    raster = materialise(t.raster_fx, "raster")
    plan = materialise(
        t.sizes_fx.withColumn("resized_w", F.col("target_w")).withColumn("resized_h", F.col("target_h")), "sizes"
    )
    text = plan_text(R.resample(P.pack(raster), plan))
    assert text.count("REPARTITION_BY_COL") == 1 and text.count("Exchange hashpartitioning") == 2, text
    assert re.search(r"hashpartitioning\(image_id#\d+L?, c#\d+, y#", text) and "partial_collect_list" in text
    text = plan_text(R.resample(materialise(P.pack(raster), "rows"), plan))
    assert text.count("Exchange hashpartitioning") == 1 and re.search(r"hashpartitioning\(image_id#\d+L?, c#\d+, x0#", text), text


def test_strips_of_many_images(spark, monkeypatch):
    """Images of one row or column, of alike ids, over several Arrow batches; every image as NumPy has it."""
    monkeypatch.setattr(P, "STRIP_VALUES", 24)
    monkeypatch.setattr(P, "BATCH_VALUES", 40)
    rng, rows, plans, wanted = np.random.default_rng(8), [], [], {}
    for i in range(60):
        h, w, oh, ow = (int(n) for n in rng.integers(1, 9, 4))
        method = ["nearest-exact", "nearest", "area", "bilinear", "bicubic", "lanczos"][i % 6]
        pixels = rng.random((2, h, w))
        rows += [(f"i{i}", c, y, 0, pixels[c, y].tolist()) for c in range(2) for y in range(h)]
        plans.append((f"i{i}", w, h, ow, oh, method))
        resize = lambda m, ow=ow, oh=oh, method=method: resampled(resampled(m, method, oh).T, method, ow).T
        for c in range(2):
            wanted[f"i{i}", c] = resize(pixels[c])
    packed = spark.createDataFrame(rows, "image_id string, c int, y int, x0 int, row array<double>").repartition(3)
    plan = spark.createDataFrame(plans, "image_id string, src_width int, src_height int, resized_w int, resized_h int, upscale_method string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        strips = R.resample_packed(packed, plan)
        found = {(r["image_id"], r["c"], r["y"]): r["row"] for r in P.whole_rows(strips).collect()}
        assert strips.where("x0 > 0").count() > 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(found) == sum(len(m) for m in wanted.values())
    for (i, c), m in wanted.items():
        np.testing.assert_allclose(np.array([found[i, c, y] for y in range(len(m))]), m, atol=1e-12)


def test_rows_with_gaps_are_refused(spark):
    for cells in ([0, 2], [0, 1, 1], [1, 2]):
        raster = spark.createDataFrame([(1, 0, x, 0, 0.5) for x in cells], "image_id int, y int, x int, c int, v double")
        with pytest.raises(Exception, match="pixels missing or repeated"):
            P.pack(raster).collect()
    assert P.unpack(P.pack(raster.limit(0))).count() == 0


def test_packed_rows_move_less_than_a_third_of_the_bytes(spark):
    """A 512 x 512 image of random values: what the exchange of arrays writes, against one row per pixel."""
    h = w = 512
    rows = spark.range(h).select(
        F.lit(1).alias("image_id"), F.lit(0).alias("c"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x0"),
        F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda x: F.rand(3) + x * 0).alias("row"))
    rows = materialise(rows, "rows")
    plan = spark.createDataFrame([(1, w, h, 256, 256, "bilinear")], "image_id int, src_width int, src_height int, resized_w int, resized_h int, upscale_method string")
    pixels = P.unpack(rows).join(plan, "image_id").repartition("image_id", "x")
    arrays = R.resample_packed(rows, plan)
    assert 3 * exchanged(spark, arrays) < exchanged(spark, pixels)


def test_large_plans_are_merged(spark, monkeypatch):
    t = Tables(spark, SF)
    plan = t.sizes_fx.withColumn("resized_w", F.col("target_w")).withColumn("resized_h", F.col("target_h"))
    small = R.resample_nearest(t.raster_fx, plan)
    monkeypatch.setattr(R, "BROADCAST_PLANS", 10)
    large = R.resample_nearest(t.raster_fx, plan)
    assert "BroadcastHashJoin" not in plan_text(large)
    assert large.exceptAll(small).count() == 0 and large.count() == small.count()


def test_nearest_and_edge_pixels_need_no_exchange(spark):
    t = Tables(spark, SF)
    raster = materialise(t.raster_fx, "raster")
    plan = materialise(
        t.sizes_fx.withColumn("resized_w", F.col("target_w")).withColumn("resized_h", F.col("target_h")), "sizes"
    )
    assert "Exchange hashpartitioning" not in plan_text(R.resample_nearest(raster, plan))


def test_planning_neither_shuffles_requests_nor_pairs_them_up(spark):
    from rasterloom.operators.planning import plan_resize

    t = Tables(spark, SF)
    requests = materialise(t.requests_fx, "requests")
    text = plan_text(plan_resize(requests, t.presets_fx))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert not [line for line in text.splitlines() if "Exchange hashpartitioning(image_id" in line]


def test_nearest_ratio_without_broadcast(spark, monkeypatch):
    t = Tables(spark, SF)
    found = materialise(C.lookup_preset(t.requests_fx, t.presets_fx), "found")
    small = C.closest_preset(found, t.presets_fx).select("image_id", "nearest.item_ord")
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    large = C.closest_preset(found, t.presets_fx).select("image_id", "nearest.item_ord")
    assert "SortMergeJoin" in plan_text(large)
    assert small.exceptAll(large).count() == 0 and large.count() == found.count()


def test_nearest_ratio_against_logarithms(spark):
    rows = [(f"m{i % 3}", i % 3, "1K", 0, i, "r", "l", 1 + (i * 37) % 97, 1 + (i * 53) % 89) for i in range(240)]
    presets = spark.createDataFrame(rows, "model string, model_ord int, resolution string, res_ord int, item_ord int, ratio string, label string, width int, height int")
    asked = [(i, f"m{i % 3}", "1K", 1 + (i * 7919) % 4001, (i * 104729) % 3001) for i in range(1500)]
    requests = spark.createDataFrame(asked, "image_id int, chosen_model string, chosen_resolution string, src_width int, src_height int")
    found = {r.image_id: r for r in C.closest_preset(requests, presets).select("image_id", "nearest.width", "nearest.height").collect()}
    assert len(found) == 1500
    for image_id, model, _, w, h in asked:
        far = lambda a, b: abs(math.log((w / max(1, h)) / (a / b)))
        best = min(far(r[7], r[8]) for r in rows if r[0] == model)
        assert far(found[image_id].width, found[image_id].height) == pytest.approx(best, abs=1e-9)


def test_positions_in_a_long_video(spark):
    n = 25_000
    names = spark.range(1, n + 1).select(F.lit("hot").alias("video_id"), F.format_string("frame_%08d.png", "id").alias("frame_name"), "id")
    small = spark.range(1, 4).select(F.lit("cold").alias("video_id"), F.format_string("frame_%08d.png", "id").alias("frame_name"), "id")
    frames = names.union(small).union(names.limit(5))
    indexed = V.index_frames(frames).withColumn("id", F.substring("frame_name", 7, 8).cast("int"))
    assert indexed.count() == n + 3 and indexed.where("frame_idx <> id - 1").count() == 0
    unpadded = names.select("video_id", F.concat(F.lit("frame_"), F.col("id").cast("string"), F.lit(".png")).alias("frame_name"), "id")
    natural = V.natural_index(unpadded).withColumn("id", F.regexp_extract("frame_name", r"(\d+)", 1).cast("int"))
    assert natural.where("frame_idx <> id - 1 or found_count <> 25000").count() == 0
    by_name = V.index_frames(unpadded).orderBy("frame_idx").select("frame_name")
    assert [r.frame_name for r in by_name.collect()] == sorted(f"frame_{i}.png" for i in range(1, n + 1))


@pytest.mark.parametrize("pattern", ["frame_extracted_by_a_long_name_%08d.png", "take1_frame_%08d.png", "%032x.png"])
def test_positions_whatever_the_names_look_like(spark, pattern):
    n = 20_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 > 0, "hot").alias("video_id"), F.col("id"),
        F.md5(F.col("id").cast("string")).alias("hash"))
    name = F.concat("hash", F.lit(".png")) if pattern.startswith("%032x") else F.format_string(pattern, "id")
    frames = rows.select("video_id", name.alias("frame_name"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = materialise(V.index_frames(frames, names=None), "found")
        sizes = [r["n"] for r in frames.repartitionByRange("video_id", "frame_name").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(sizes) < n / 2
    listed = found.collect()
    assert len(listed) == n
    for video, total in (("hot", 18_000), (None, 2_000)):
        own = sorted((r for r in listed if r.video_id == video), key=lambda r: r.frame_idx)
        assert [r.frame_idx for r in own] == list(range(total)) and {r.frame_count for r in own} == {total}
        assert [r.frame_name for r in own] == sorted(r.frame_name for r in own)


def test_small_groups_are_ordered_once_and_large_ones_cut(spark, monkeypatch):
    """Groups that fit a task move by a window, without a table of ranges; larger ones beside them get the same positions."""
    written = []
    monkeypatch.setattr(ordering, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    rows = [(v, f"frame_{i}.png") for v, n in (("a", 12), (None, 11), ("b", 3)) for i in range(n)]
    frames = spark.createDataFrame(rows, "video_id string, frame_name string")
    positions = lambda: sorted((str(r.video_id), r.frame_idx, r.found_count, r.frame_name) for r in V.natural_index(frames).collect())
    whole = positions()
    assert written == ["large"]
    assert whole == sorted((str(v), i, n, f"frame_{i}.png") for v, n in (("a", 12), (None, 11), ("b", 3)) for i in range(n))
    monkeypatch.setattr(ordering, "WHOLE", 10)
    assert positions() == whole and "ranged" in written


def png_file(samples: np.ndarray, kind: int, depth: int, rng, palette=None, interlaced=False) -> bytes:
    """A PNG file with a random filter per row, filtered byte by byte as the format describes."""
    unit = max(1, samples.shape[2] * depth // 8)

    def lines(part):
        out, above = b"", None
        for row in part:
            bits = "".join(f"{v:0{depth}b}" for v in row.ravel().tolist())
            bits += "0" * (-len(bits) % 8)
            raw = [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]
            above = above or [0] * len(raw)
            kind = int(rng.integers(0, 5))
            done = []
            for i, v in enumerate(raw):
                a, b, c = raw[i - unit] if i >= unit else 0, above[i], above[i - unit] if i >= unit else 0
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                done.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
            out += bytes([kind, *done])
            above = raw
        return out

    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlaced else [(0, 0, 1, 1)]
    data = b"".join(lines(p) for x, y, w, h in passes if (p := samples[y::h, x::w]).size)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", samples.shape[1], samples.shape[0], depth, kind, 0, 0, int(interlaced))
    packed = zlib.compress(data)
    colours = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    half = len(packed) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + colours + chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("kind", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png_of_every_kind(kind, depth, interlaced):
    rng = np.random.default_rng(100 * kind + depth)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    for height, width in [(1, 1), (2, 3), (9, 5), (13, 17), (3, 40)]:
        samples = rng.integers(0, 1 << depth, (height, width, channels))
        palette = rng.integers(0, 256, (1 << depth, 3), dtype=np.uint8) if kind == 3 else None
        found = decode_png(png_file(samples, kind, depth, rng, palette, interlaced))
        wanted = palette[samples[..., 0]] if kind == 3 else samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
        np.testing.assert_array_equal(found, wanted)


def test_broken_png_files_are_refused():
    whole = encode_png(np.arange(60, dtype=np.uint8).reshape(4, 5, 3))
    assert decode_png(whole).shape == (4, 5, 3)
    cut = whole[: len(whole) // 2]
    for content in (b"", b"no image", whole[:8], whole[:40], cut, whole.replace(b"IDAT", b"IDAX"), whole[:25] + b"\x07" + whole[26:]):
        with pytest.raises(ValueError):
            decode_png(content)


def test_files_of_all_sorts(spark, tmp_path):
    """Upper case names, a bitmap through Spark's own source, and rejects, all from one reading."""
    pixels = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    (tmp_path / "B.PNG").write_bytes(encode_png(pixels))
    bitmap = b"".join(pixels[y, :, [2, 1, 0]].T.tobytes() + b"\0" * 3 for y in (1, 0))
    (tmp_path / "c.bmp").write_bytes(struct.pack("<2sIII", b"BM", 54 + len(bitmap), 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, len(bitmap), 0, 0, 0, 0) + bitmap)
    (tmp_path / "d.jpg").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("x")
    rows, mask, rejects = S.split_files(S.read_files(spark, str(tmp_path)))
    name = lambda path: path.rsplit("/", 1)[1]
    found = {(name(r.image_id), r.c, r.y): r.row for r in rows.collect()}
    for file in ("B.PNG", "c.bmp"):
        for y in range(2):
            for c in range(3):
                np.testing.assert_allclose(found[file, c, y], pixels[y, :, c] / 255)
    assert len(found) == 12
    assert {name(r.image_id) for r in mask.where("m > 0").collect()} == {"B.PNG"}
    assert {(name(r.path), r.error) for r in rejects.collect()} == {("d.jpg", "unreadable"), ("notes.txt", "no image file")}


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_image_files(spark, tmp_path, channels):
    pixels = np.random.default_rng(channels).integers(0, 256, (3, 5, channels), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(encode_png(pixels))
    (tmp_path / "broken.png").write_bytes(b"no image")
    image, mask = S.read_rasters(spark, str(tmp_path))
    colours = np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]
    for c in range(3):
        np.testing.assert_allclose(as_array(image.where(F.col("c") == c), 3, 5), colours[:, :, c] / 255)
    alpha = pixels[:, :, -1] if channels in (2, 4) else np.full((3, 5), 255)
    np.testing.assert_allclose(as_array(mask, 3, 5, "m"), 1 - alpha / 255)


@pytest.mark.parametrize("dtype", ["uint8", "float64"])
def test_frames_as_one_row_each(spark, monkeypatch, dtype):
    """Rows and strips make the same frames, and frames give the rows back; no pixel is a row in between."""
    monkeypatch.setattr(P, "STRIP_VALUES", 24)
    monkeypatch.setattr(P, "BATCH_VALUES", 20)
    rng, rows, images = np.random.default_rng(2), [], {}
    for i, shape in enumerate([(1, 1, 1), (5, 7, 3), (12, 2, 4), (3, 9, 2)]):
        values = rng.integers(0, 256, shape) / 255
        images[f"f{i}"] = values
        rows += [(f"f{i}", c, y, 0, values[y, :, c].tolist()) for c in range(shape[2]) for y in range(shape[0])]
    packed = spark.createDataFrame(rows, "image_id string, c int, y int, x0 int, row array<double>").repartition(3)
    sizes = [(i, v.shape[1], v.shape[0], v.shape[1], v.shape[0], "area") for i, v in images.items()]
    plan = spark.createDataFrame(sizes, "image_id string, src_width int, src_height int, resized_w int, resized_h int, upscale_method string")
    for source in (packed, R.resample_packed(packed, plan)):
        frames = P.pack_frames(source, dtype)
        found = {r.image_id: r for r in frames.collect()}
        for i, values in images.items():
            r = found[i]
            own = np.frombuffer(bytes(r.data), dtype).reshape(r.height, r.width, r.channels)
            np.testing.assert_allclose(own, np.rint(values * 255) if dtype == "uint8" else values, atol=1e-12)
        assert not re.search(r"\bx#", plan_text(frames))
        back = {(r.image_id, r.c, r.y): r.row for r in P.unpack_frames(frames, dtype).collect()}
        assert len(back) == len(rows)
        for i, c, y, _, row in rows:
            np.testing.assert_allclose(back[i, c, y], row, atol=1e-12)
