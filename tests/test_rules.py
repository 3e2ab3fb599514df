"""Rules with results worked out by hand."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.functions import text as X
from rasterloom.functions.numbers import actual_ratio, half_even, parse_float
from rasterloom.operators import canvas as K
from rasterloom.operators import catalogue as C
from rasterloom.operators import frames as V
from rasterloom.operators import graph as GR
from rasterloom.operators import planning as P
from rasterloom.session import materialise, materialise_buckets
from rasterloom.sources import manifests as M
from rasterloom.sources import presets as S
from rasterloom.sources import workflows as W

PRESETS = "model string, model_ord int, resolution string, res_ord int, item_ord int, ratio string, label string, width int, height int"
REQUEST = (
    "image_id bigint, model string, resolution_preset string, selection_mode string, dimensions string, width int, height int, "
    "upscale_method string, keep_proportion string, pad_color string, crop_position string, src_width int, src_height int, "
    "has_image boolean, has_mask boolean, resolution int"
)


@pytest.mark.parametrize(
    "text, expected",
    [("1.5K", "1536"), ("2k", "2048"), ("1024", "1024"), ("K", "K"), ("xK", "xK"), ("0.0004882812K", "0"),
     ("0.00146484375K", "2"), (" 1K", "1024"), ("1_0K", "10240"), ("1dK", "1dK"), ("nanK", "nanK"), ("-1K", "-1024")],
)
def test_resolution_output(value, text, expected):
    assert value(X.resolution_output(F.lit(text))) == expected


@pytest.mark.parametrize(
    "text, channels, expected",
    [("0, 0, 0", 3, [0, 0, 0]), ("255, 128, 0", 3, [1, 128 / 255, 0]), ("0.5", 3, [0.5] * 3), ("red", 3, [0] * 3),
     ("0.5, 200", 2, [0.5 / 255, 200 / 255]), ("1,x", 1, [0]), ("", 4, [0] * 4), (" , ,0.25", 2, [0.25, 0.25]),
     ("-3", 1, [0]), ("0.1,0.2,0.3,0.4", 2, [0.1, 0.2]), ("inf", 1, [1.0]), ("1_0,0", 2, [10 / 255, 0])],
)
def test_parse_color(value, text, channels, expected):
    assert value(X.parse_color(F.lit(text), channels)) == pytest.approx(expected)


def test_parse_color_nan_counts_only_in_front(value):
    late, early = (value(X.parse_color(F.lit(t), 2)) for t in ("0.5, nan", "nan, 200"))
    assert late[0] == 0.5 and math.isnan(late[1])
    assert math.isnan(early[0]) and early[1] == 1.0


@pytest.mark.parametrize("text", ["1d", "0x10", "1__0", "_1", "1e", "", "1 2", "1f"])
def test_not_a_float(value, text):
    assert value(parse_float(F.lit(text))) is None


@pytest.mark.parametrize("number, expected", [(0.5, 0), (1.5, 2), (2.5, 2), (-0.5, 0), (-1.5, -2)])
def test_half_even(value, number, expected):
    assert value(half_even(F.lit(number))) == expected


@pytest.mark.parametrize(
    "average, real, expected",
    [("30000/1001", "25/1", 30000 / 1001), ("0/0", "25/1", 24.0), ("", "25/1", 25.0), (None, None, 24.0), ("-5/1", "", 24.0),
     ("23.976", None, 23.976), ("abc", "25/1", 24.0), (None, "0", 24.0)],
)
def test_frame_rate(value, average, real, expected):
    text = lambda t: F.lit(t).cast("string")
    assert value(X.frame_rate(text(average), text(real))) == pytest.approx(expected)


@pytest.mark.parametrize(
    "path, expected",
    [(' "output/a" ', "a"), ("ComfyUI/Output/a/b", "a/b"), ("OUTPUT", ""), ("a/output", "a/output"), ("/output/a", "/output/a"),
     ("  ", None), ('""', None), ("./output//a/", "a"), ("comfyui/a", "comfyui/a")],
)
def test_clean_path(value, path, expected):
    assert value(X.clean_path(F.lit(path))) == expected


@pytest.mark.parametrize(
    "name, expected",
    [("", "processed_video.mp4"), ("a.mp4", "a.mp4"), ("x/A.MP4", "A.MP4"), ("a.avi", "a.mp4"), ("a.b.mov", "a.b.mp4"),
     ("a", "a.mp4"), (".hidden", ".hidden.mp4"), ("x/y/", "y.mp4"), (" a.mkv ", "a.mp4")],
)
def test_safe_output_name(value, name, expected):
    assert value(X.safe_output_name(F.lit(name))) == expected


def test_relative_to(value):
    assert tuple(value(X.relative_to(F.lit("/o/a/b/c.mp4"), "/o"))) == ("c.mp4", "a/b")
    assert tuple(value(X.relative_to(F.lit("/o/c.mp4"), "/o/"))) == ("c.mp4", "")
    assert value(X.relative_to(F.lit("/other/c.mp4"), "/o")) is None


def test_natural_order(spark):
    names = ["10.png", "9.png", "A2", "a10", "a1b", "a1", "b", "frame_2.png", "Frame_10.png", "frame_1.png"]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "name string")
    ordered = [r.name for r in df.orderBy(X.natural_key(F.col("name")), "name").collect()]
    assert ordered == ["9.png", "10.png", "a1", "a1b", "A2", "a10", "b", "frame_1.png", "frame_2.png", "Frame_10.png"]


@pytest.mark.parametrize("w, h, expected", [(1920, 1080, "16:9"), (1, 1, "1:1"), (16384, 10946, "8192:5473"), (6765, 4181, "6765:4181"), (7, 14, "1:2")])
def test_actual_ratio(value, w, h, expected):
    assert value(actual_ratio(F.lit(w), F.lit(h))) == expected


def test_padding_names_the_anchor(value):
    pads = lambda where: tuple(value(G.padding(F.lit(10), F.lit(9), F.lit(5), F.lit(6), F.lit(where))))
    assert pads("left") == (0, 5, 1, 2) and pads("right") == (5, 0, 1, 2)
    assert pads("top") == (2, 3, 0, 3) and pads("bottom") == (2, 3, 3, 0) and pads("center") == (2, 3, 1, 2)


def test_crop_box(value):
    box = lambda w, h, ratio, where: tuple(value(G.crop_box(F.lit(w), F.lit(h), F.lit(ratio), F.lit(where))))
    assert box(100, 50, 1.0, "left") == (0, 0, 50, 50) and box(100, 50, 1.0, "right") == (50, 0, 50, 50)
    assert box(100, 51, 1.0, "top") == (24, 0, 51, 51) and box(50, 100, 1.0, "bottom") == (0, 50, 50, 50)
    assert box(50, 100, 1.0, "left") == (0, 25, 50, 50)


def test_longer_side_prefers_width(value):
    size = lambda w, h, side: tuple(value(G.longer_side(F.lit(w), F.lit(h), F.lit(side))))
    assert size(16, 9, 1000) == (1000, 562) and size(9, 16, 1000) == (562, 1000) and size(5, 5, 7) == (7, 7)
    assert size(1000, 1, 10) == (10, 1)


@pytest.fixture(scope="module")
def presets(spark):
    rows = [
        ("First", 0, "2K", 0, 0, "2:1", "Wide", 2000, 1000), ("First", 0, "2K", 0, 1, "1:2", "Tall", 1000, 2000),
        ("First", 0, "1024", 1, 0, "1:1", "Square", 1000, 1000),
        ("FLUX.2 Klein", 1, "1024", 0, 0, "1:1", "Square", 1024, 1024), ("FLUX.2 Klein", 1, "1024", 0, 1, "3:2", "Photo", 1216, 832),
    ]
    return spark.createDataFrame(rows, PRESETS)


def request(**changes):
    row = dict(
        image_id=1, model="First", resolution_preset="2K", selection_mode="automatic", dimensions="", width=300, height=200,
        upscale_method="lanczos", keep_proportion="pad_edge_pixel", pad_color="0, 0, 0", crop_position="center", src_width=100,
        src_height=100, has_image=True, has_mask=False, resolution=None,
    )
    row.update(changes)
    return tuple(row.values())


def plan_of(spark, presets, **changes):
    return P.plan_resize(spark.createDataFrame([request(**changes)], REQUEST), presets).first()


def test_golden_lookup(spark, presets):
    row = C.lookup_preset(
        spark.createDataFrame([request(model="FLUX.2 Klein", resolution_preset="1024", dimensions="1:1 (Square) - 1024 x 1024")], REQUEST),
        presets,
    ).first()
    assert (row.chosen.width, row.chosen.height, row.chosen.ratio, row.resolution_text) == (1024, 1024, "1:1", "1024")


def test_unknown_model_falls_to_the_first_and_keeps_a_known_resolution(spark, presets):
    row = C.lookup_preset(spark.createDataFrame([request(model="?", resolution_preset="1024")], REQUEST), presets).first()
    assert (row.chosen_model, row.chosen_resolution, row.chosen.width) == ("First", "1024", 1000)
    row = C.lookup_preset(spark.createDataFrame([request(model="?", resolution_preset="8K")], REQUEST), presets).first()
    assert (row.chosen_resolution, row.resolution_text, row.chosen.ratio) == ("2K", "2048", "2:1")


def test_nearest_tie_goes_to_the_first_item(spark, presets):
    assert plan_of(spark, presets).target_w == 2000
    assert plan_of(spark, presets, src_width=99).target_w == 1000
    assert plan_of(spark, presets, src_width=101).target_w == 2000
    assert plan_of(spark, presets, src_width=1, src_height=100000).target_w == 1000
    assert plan_of(spark, presets, src_width=3_000_000, src_height=2_999_999).target_w == 2000


def test_override_keeps_the_preset_shape_and_beats_manual_size(spark, presets):
    row = plan_of(spark, presets, selection_mode="manual", dimensions="1:2 (Tall) - 1000 x 2000", resolution=500)
    assert (row.target_w, row.target_h, row.resolution_text) == (250, 500, "500")
    row = plan_of(spark, presets, selection_mode="manual", resolution=0)
    assert (row.target_w, row.target_h, row.resolution_text) == (300, 200, "2048")


def test_unknown_mode_pads(spark, presets):
    row = plan_of(spark, presets, selection_mode="manual", keep_proportion="tile")
    assert (row.resized_w, row.resized_h, row.out_w, row.out_h, row.pad.left, row.aspect_ratio) == (200, 200, 300, 200, 50, "3:2")


def test_plan_invariants(spark):
    from rasterloom.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = P.plan_resize(t.requests_fx, t.presets_fx)
    padded = P.is_padded(F.col("keep_proportion"))
    broken = plan.where(
        (padded & ((F.col("out_w") != F.col("target_w")) | (F.col("pad.left") + F.col("pad.right") + F.col("resized_w") != F.col("target_w"))))
        | (F.col("crop.x") < 0) | (F.col("crop.x") + F.col("crop.w") > F.col("src_width"))
        | (F.col("crop.y") < 0) | (F.col("crop.y") + F.col("crop.h") > F.col("src_height"))
    )
    assert plan.count() == t.requests_fx.count() and broken.count() == 0


def test_requests_without_input_are_rejected(spark):
    rows = [request(), request(image_id=2, has_image=False), request(image_id=3, has_image=False, has_mask=True)]
    ok, rejects = P.validate_requests(spark.createDataFrame(rows, REQUEST))
    assert sorted(r.image_id for r in ok.collect()) == [1, 3] and [r.image_id for r in rejects.collect()] == [2]


def test_catalogue_file_keeps_its_order(spark, tmp_path):
    text = '{"Z": {"2K": [{"ratio": "1:1", "label": "b", "width": 2, "height": 2}, {"ratio": "2:1", "label": "a", "width": 4, "height": 2}], "1K": []},\n "A": {"9": [{"ratio": "1:1", "label": "c", "width": 1, "height": 1}]}}'
    (tmp_path / "catalogue.json").write_text(text)
    rows = S.read_presets(spark, str(tmp_path / "catalogue.json")).orderBy("model_ord", "res_ord", "item_ord").collect()
    assert [(r.model, r.resolution, r.label, r.item_ord) for r in rows] == [("Z", "2K", "b", 0), ("Z", "2K", "a", 1), ("A", "9", "c", 0)]


def test_graph_between_start_and_end(spark):
    document = """{"nodes": [{"id": 1, "type": "a", "inputs": []}, {"id": 2, "type": "b", "inputs": [{"name": "image", "link": 2}]},
      {"id": 3, "type": "c", "inputs": [{"name": "flow", "link": 1}, {"name": "x", "link": 3}, {"name": "y", "link": 4}]}],
      "links": [[1, 1, 0, 3, 0, "F"], [2, 1, 1, 2, 0, "I"], [3, 2, 0, 3, 1, "I"], [4, 1, 4, 3, 2, "C"]]}"""
    nodes, edges = W.parse_workflows(spark.createDataFrame([(7, document)], "graph_id int, d string"), "d")
    assert nodes.count() == 3 and {r.dst_input for r in edges.collect()} == {"flow", "image", "x", "y"}
    at = lambda node: spark.createDataFrame([(7, node)], "graph_id int, node_id string")
    members = GR.between(edges, at("1"), at("3"))
    assert sorted(r.node_id for r in members.collect()) == ["1", "2", "3"]
    kinds = GR.classify_edges(edges, members, at("3"))
    assert {(r.copy_dst, r.kind) for r in kinds.collect()} == {("Recurse", "internal"), ("2", "internal")}


def test_reach_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "a", "d")], "graph_id int, src string, dst string")
    seed = spark.createDataFrame([(1, "a")], "graph_id int, node_id string")
    assert sorted(r.node_id for r in GR.upstream(edges, seed)[0].collect()) == ["a", "b", "c"]


def plain_reach(edges, seeds):
    reached, todo = set(), list(seeds)
    while todo:
        g, node = todo.pop()
        new = {(g, b) for h, a, b in edges if h == g and a == node} - reached
        reached |= new
        todo += new
    return reached


def test_reach_of_random_graphs(spark, monkeypatch):
    """Chains, circles, branches, repeated links, NULLs and several seeds, with chains condensed from the first round on."""
    monkeypatch.setattr(GR, "HOPS", 0)
    rng = random.Random(11)
    edges, seeds = [], []
    for g in range(14):
        n = rng.choice([1, 2, 9, 30])
        # Mostly one successor per node, so that long chains and circles come about.
        for a in range(n):
            for b in rng.sample(range(n), min(n, rng.choice([0, 1, 1, 1, 1, 2]))):
                edges += [(g, str(a), str(b))] * rng.choice([1, 1, 2])
        seeds += [(g, str(rng.randrange(n))) for _ in range(rng.choice([0, 1, 2]))]
    df = spark.createDataFrame([*edges, (3, "0", None), (3, None, "1"), (None, "0", "1")], "graph_id int, src string, dst string")
    start = spark.createDataFrame([*seeds, (None, "0"), (3, None), (99, "0")], "graph_id int, node_id string")
    found = {(r.graph_id, r.node_id) for r in GR.downstream(df, start)[0].where("node_id is not null").collect()}
    assert found == plain_reach(edges, seeds)
    up = {(r.graph_id, r.node_id) for r in GR.upstream(df, start)[0].where("node_id is not null").collect()}
    assert up == plain_reach([(g, b, a) for g, a, b in edges], seeds)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(GR, "materialise", lambda df, name: rounds.append(name) or materialise(df, name))
    chain = spark.range(2000).selectExpr("1 as graph_id", "concat('n', id) as src", "concat('n', id + 1) as dst")
    circle = spark.range(700).selectExpr("2 as graph_id", "concat('c', id) as src", "concat('c', (id + 1) % 700) as dst")
    seeds = spark.createDataFrame([(1, "n0"), (2, "c5")], "graph_id int, node_id string")
    reached = GR.downstream(chain.union(circle), seeds)[0].groupBy("graph_id").count().collect()
    assert dict(map(tuple, reached)) == {1: 2000, 2: 700}
    assert len(rounds) - rounds.count("seeds") <= 30


def test_links_of_a_traversal_move_once(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "graph_id int, src string, dst string")
    links = materialise_buckets(edges.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("_next")), "links", *GR.NODE)
    nodes = spark.createDataFrame([(1, "a")], "graph_id int, node_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = nodes.join(links, GR.NODE)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("links")]


def test_extraction_actions(spark):
    sources = spark.createDataFrame([(v, f"{v}.mp4", 1, "t") for v in "abcd"], "video_id string, path string, size int, mtime string")
    manifest = spark.createDataFrame([("a.mp4", 1, "t"), ("b.mp4", 2, "t"), ("d.mp4", 1, "t")], "path string, size int, mtime string")
    counts = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "video_id string, frame_count int")
    action = lambda replace: {r.video_id: r.action for r in V.extraction_plan(sources, manifest, counts, replace).collect()}
    assert action(False) == {"a": "reuse", "b": "conflict", "c": "conflict", "d": "extract"}
    assert action(True) == {"a": "reuse", "b": "re-extract", "c": "re-extract", "d": "extract"}


def test_stale_frame_hides_a_missing_one_from_the_count(spark):
    manifest = spark.createDataFrame([("v", 3)], "video_id string, frame_count int")
    found = spark.createDataFrame([("v", n) for n in ("frame_00000001.png", "frame_00000002.png", "frame_00000009.png")], "video_id string, frame_name string")
    assert V.completeness(found, manifest).first().complete
    assert [r.frame_name for r in V.missing_frames(V.expected_frames(manifest), found).collect()] == ["frame_00000003.png"]


def test_unreadable_manifests_are_no_fingerprint(spark):
    texts = spark.createDataFrame([("{",), ("[]",), ('{"path": "a"}',), ('{"path": "a", "size": 1, "mtime": "2020-01-01T00:00:00.123"}',)], "value string")
    assert [r.path for r in M.decode_manifest(texts).collect()] == ["a"]


def test_quotes_in_sequence_lists(spark):
    timeline = spark.createDataFrame([("v", 0, "a'b.png", 0.5)], "video_id string, pos int, frame_name string, duration double")
    lines = [r.line for r in V.concat_lines(timeline, F.lit("/f")).orderBy("part").collect()]
    assert lines == ["ffconcat version 1.0", "file '/f/a'\\''b.png'", "duration 0.500000000000"]


def test_mask_border_counts_the_added_area(spark):
    plan = spark.createDataFrame([(1, 4, 3, 7, 5)], "image_id int, resized_w int, resized_h int, out_w int, out_h int")
    plan = plan.withColumn("pad", G.padding(F.col("out_w"), F.col("out_h"), F.col("resized_w"), F.col("resized_h"), F.lit("center")))
    mask = spark.range(12).select(F.lit(1).alias("image_id"), F.expr("cast(id div 4 as int)").alias("y"), (F.col("id") % 4).cast("int").alias("x"), F.lit(0.0).alias("m"))
    padded = K.pad_mask(mask, plan)
    assert padded.count() == 35 and padded.agg(F.sum("m")).first()[0] == 35 - 12


def test_no_request_disappears(spark):
    from rasterloom.operators.planning import is_padded, validate_requests

    requests = spark.createDataFrame(
        [(1, True, False, "bilinear"), (2, None, None, "bilinear"), (3, True, False, None), (4, False, True, "typo")],
        "image_id int, has_image boolean, has_mask boolean, upscale_method string")
    good, bad = validate_requests(requests)
    assert [r.image_id for r in good.collect()] == [1]
    assert {r.image_id: r.errors for r in bad.collect()} == {
        2: ["no image and no mask"], 3: ["unknown method"], 4: ["unknown method"]}
    assert spark.range(1).select(is_padded(F.lit(None).cast("string"))).first()[0]


def test_unknown_method_ends_the_job(spark):
    from rasterloom.operators.resample import method_or_fallback

    with pytest.raises(Exception, match="unknown method typo"):
        spark.createDataFrame([("typo",)], "m string").select(method_or_fallback(F.col("m"), True)).collect()


def test_other_files_are_no_frames(spark):
    frames = spark.createDataFrame([("v", n) for n in ("frame_1.png", "cover.png", "processed_video.mp4", "frame_2.jpg")], "video_id string, frame_name string")
    manifest = spark.createDataFrame([("v", 3)], "video_id string, frame_count int")
    row = V.completeness(frames, manifest).first()
    assert (row.found, row.complete) == (1, False)
    assert V.natural_index(frames, names=None).count() == 4


def test_videos_without_manifest_stay(spark):
    manifest = spark.createDataFrame([("v", "p", 24.0, 2)], "video_id string, path string, fps double, frame_count int")
    loops = spark.createDataFrame([("v", -1), ("v", 2), ("zz", 0)], "video_id string, loop_index int")
    ok, rejects = V.check_index(loops, manifest)
    assert [(r.video_id, r.loop_index) for r in ok.collect()] == [("v", 0)]
    assert sorted((r.video_id, r.loop_index) for r in rejects.collect()) == [("v", 2), ("zz", 0)]
    frames = spark.createDataFrame([("v", 0), ("zz", 0)], "video_id string, frame_idx int")
    assert {r.video_id: r.fps for r in V.frame_context(frames, manifest).collect()} == {"v": 24.0, "zz": None}


def test_unusable_rate_falls_back(spark):
    frames = spark.createDataFrame([(v, "frame_1.png") for v in "abcd"], "video_id string, frame_name string")
    manifest = spark.createDataFrame([("a", 0.0), ("b", float("nan")), ("c", 50.0), ("d", None)], "video_id string, fps double")
    probes = spark.createDataFrame([("a", 10.0), ("c", 10.0), ("d", 20.0)], "video_id string, fps double")
    shown = {r.video_id: r.duration for r in V.timeline(frames, manifest, probes).where("pos = 0").collect()}
    assert shown == {"a": 0.1, "b": 1 / 24, "c": 0.02, "d": 0.05}


def test_timeline_of_videos_without_a_manifest(spark):
    schema = "video_id string, fps double"
    frames = spark.createDataFrame([(v, f"frame_{i:08d}.png") for v in ("a", "b", "c", None) for i in (1, 2)], "video_id string, frame_name string")
    manifest, probes = spark.createDataFrame([("a", 10.0)], schema), spark.createDataFrame([("b", 50.0), (None, 20.0)], schema)

    def shown(*rates):
        rows = V.timeline(frames, *rates).collect()
        assert len(rows) == 12
        return {r.video_id: r.duration for r in rows if r.pos == 0}

    assert shown(manifest, probes) == {"a": 0.1, "b": 0.02, "c": 1 / 24, None: 0.05}
    assert shown(manifest) == {"a": 0.1, "b": 1 / 24, "c": 1 / 24, None: 1 / 24}


def test_same_file_in_two_folders(spark):
    sources = spark.createDataFrame([("one", "p", 5, 7)], "video_id string, path string, size long, mtime long")
    manifest = spark.createDataFrame([("one", "p", 5, 7), ("two", "p", 6, 7)], "video_id string, path string, size long, mtime long")
    assert [r.matches for r in V.match_manifest(sources, manifest).collect()] == [True]


def test_graph_with_two_ends(spark):
    from rasterloom.operators.graph import classify_edges

    edges = spark.createDataFrame([("g", "s", "a"), ("g", "a", "e"), ("g", "a", "f")], "graph_id string, src string, dst string")
    node = lambda *names: spark.createDataFrame([("g", n) for n in names], "graph_id string, node_id string")
    found = sorted((r.src, r.dst, r.copy_dst) for r in classify_edges(edges, node("s", "a", "e", "f"), node("e", "f")).collect())
    assert found == [("a", "e", "Recurse"), ("a", "f", "Recurse"), ("s", "a", "a")]


def test_texts_with_any_white_space_and_long_numbers(value):
    from rasterloom.functions import text as X

    assert value(X.unquote(F.lit('\t"out/a"\n'))) == "out/a"
    assert value(X.clean_path(F.lit("frames/x/../a"))) == "frames/a"
    assert value(X.clean_path(F.lit("output/.."))) == value(X.clean_path(F.lit(".")))
    assert value(X.relative_folder(F.lit("/srv/out"), "/srv/out/")) == ""
    assert value(X.parse_color(F.lit("0.1,\t,0.3"), 2)) == [0.1, 0.3]
    assert value(X.resolution_output(F.lit("1e15K"))) == "1024000000000000000"
    assert value(X.resolution_output(F.lit("nanK"))) == "nanK"
    low, high = "a" + "0" * 3 + "9" * 40, "a" + "1" + "0" * 40
    assert value(X.natural_key(F.lit(low)) < X.natural_key(F.lit(high)))
    assert value(X.natural_key(F.lit("a10")) > X.natural_key(F.lit("a9")))


def test_images_that_cannot_be_read_whole_are_rejected(spark, tmp_path):
    import struct
    import zlib

    from rasterloom.sources.media import list_images
    from rasterloom.sources.rasters import raster_rejects, read_rasters

    def png(kind, pixel):
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        rows = b"".join(b"\0" + bytes(pixel) * 2 for _ in range(2))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    files = {"grey 10.png": png(0, [9]), "alpha 2.png": png(4, [9, 200]), "rgba.PNG": png(6, [1, 2, 3, 51]), "broken.jpg": b"no image", "note.txt": b"text"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    last = lambda path: path.replace("%20", " ").rsplit("/", 1)[-1]
    assert {last(r.path): r.error for r in raster_rejects(spark, str(tmp_path)).collect()} == {
        "broken.jpg": "unreadable", "note.txt": "no image file"}
    image, mask = read_rasters(spark, str(tmp_path))
    assert image.count() == 3 * 4 * 3
    assert {(last(r.image_id), round(r.m, 6)) for r in mask.collect()} == {("grey 10.png", 0.0), ("alpha 2.png", round(55 / 255, 6)), ("rgba.PNG", 0.8)}
    assert [r.path for r in list_images(spark, str(tmp_path)).collect()] == ["alpha 2.png", "broken.jpg", "grey 10.png", "rgba.PNG"]


def test_hook_on_packed_frames(spark):
    from rasterloom.operators.hooks import apply_per_packed_frame

    frames = spark.createDataFrame(
        [("a", 0, 2, 3, 1, bytearray(range(6))), ("a", 1, 1, 2, 3, bytearray(range(6)))],
        "video_id string, frame_idx int, height int, width int, channels int, data binary")
    done = {r.frame_idx: bytes(r.data) for r in apply_per_packed_frame(frames, lambda a: a[:, ::-1]).collect()}
    assert done == {0: bytes([2, 1, 0, 5, 4, 3]), 1: bytes([3, 4, 5, 0, 1, 2])}


def test_batches_share_masks_and_fail_as_a_whole(spark):
    from rasterloom.plans.resize import smart_resize_batches

    presets = spark.createDataFrame([("m", 0, "1K", 0, 0, "1:1", "a", 4, 4)], PRESETS)
    row = lambda batch, image=True, mask=True: (
        batch, "m", "1K", "manual", "1:1 (a) - 4 x 4", 4, 4, "nearest-exact", "resize", "0", "center", 2, 2, image, mask, None)
    requests = spark.createDataFrame([row(1), row(2), row(3), row(4, mask=False), row(5, image=False)], REQUEST)
    pixel = lambda batch, pos, skip=(): [(batch, pos, y, x, 0, batch / 10 + pos / 100) for y in range(2) for x in range(2) if (y, x) not in skip]
    raster = spark.createDataFrame(
        pixel(1, 0) + pixel(1, 1) + pixel(1, 2) + pixel(2, 0) + pixel(2, 1) + pixel(2, 2) + pixel(3, 0) + pixel(3, 2) + pixel(4, 0) + pixel(4, 1),
        "image_id bigint, pos int, y int, x int, c int, v double")
    mask = raster.sparkSession.createDataFrame(
        [(b, p, y, x, float(x)) for b, p in ((1, 0), (2, 0), (2, 1), (3, 0), (5, 0), (5, 1)) for y in range(2) for x in range(2)],
        "image_id bigint, pos int, y int, x int, m double")
    pixels, masks, plan, rejects = smart_resize_batches(requests, presets, raster, mask)
    images = lambda df: {(r.image_id, r.pos) for r in df.select("image_id", "pos").distinct().collect()}
    wanted = {(1, 0), (1, 1), (1, 2), (4, 0), (4, 1), (5, 0), (5, 1)}
    assert images(pixels) == images(masks) == images(plan) == wanted
    assert {r.image_id: r.errors for r in rejects.collect()} == {
        2: ["masks fit neither one nor all images"], 3: ["image pixels missing"]}
    found = {(r.image_id, r.pos, r.y, r.x): r.m for r in masks.collect()}
    assert all(found[1, p, y, x] == (x > 1) for p in range(3) for y in range(4) for x in range(4))
    assert all(found[4, p, y, x] == 0 for p in range(2) for y in range(4) for x in range(4))
    assert pixels.schema["image_id"].dataType == requests.schema["image_id"].dataType


@pytest.mark.parametrize("small", [25, 4000])
def test_small_and_large_graphs_have_the_same_loop_bodies(spark, monkeypatch, small):
    """Walks of whole graphs, rounds, and both in one table give what a plain walk gives."""
    monkeypatch.setattr(GR, "SMALL", small)
    rng = random.Random(5)
    edges, starts, ends = [], [], []
    for g in range(12):
        n = rng.choice([2, 5, 30])
        edges += [(g, str(a), str(b)) for a in range(n) for b in rng.sample(range(n), rng.choice([0, 1, 1, 2]))]
        starts += [(g, str(rng.randrange(n))) for _ in range(rng.choice([1, 1, 2]))]
        ends += [(g, str(rng.randrange(n))) for _ in range(rng.choice([0, 1, 2]))]
    df = spark.createDataFrame([*edges, (3, "0", None), (3, None, "1"), (None, "0", "1")], "graph_id int, src string, dst string")
    nodes = lambda rows: spark.createDataFrame(rows, "graph_id int, node_id string")
    first, last = nodes([*starts, (None, "0"), (3, None), (99, "0")]), nodes(ends)
    rows = lambda found: sorted(((r.graph_id, r.node_id) for r in found.where("graph_id is not null and node_id is not null").collect()))
    up, down = plain_reach([(g, b, a) for g, a, b in edges], ends), plain_reach(edges, starts)
    towards = [(g, a, b) for g, a, b in edges if (g, b) in up | set(ends)]
    inner = plain_reach(towards, starts)
    members = inner | set(starts) | set(ends) | {(99, "0")}
    assert rows(GR.upstream(df, last)[0]) == sorted(up) and rows(GR.downstream(df, first)[0]) == sorted(down)
    used = GR.upstream(df, last)[1].where("src is not null")
    assert used.columns == df.columns and sorted((r.graph_id, r.src, r.dst) for r in used.collect()) == sorted(towards)
    assert rows(GR.inner(df, first, last)) == sorted(inner) and rows(GR.between(df, first, last)) == sorted(members)
    assert rows(GR.reach_intersection(*GR.both_ways(df, first, last), first, last)) == sorted(up & down | members - inner)
    wanted = sorted((g, a, b, (g, a) in members, (g, b) in set(ends)) for g, a, b in edges if (g, b) in members)
    for found in (GR.classify_between(df, first, last), GR.classify_edges(df, GR.between(df, first, last), last)):
        kinds = [(r.graph_id, r.src, r.dst, r.kind == "internal", r.copy_dst == GR.LOOP_END_ID) for r in found.where("src is not null").collect()]
        assert sorted(kinds) == wanted


def test_small_graphs_move_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(GR, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    edges = spark.createDataFrame([(g, a, b) for g in range(50) for a, b in ("sa", "ab", "be")], "graph_id int, src string, dst string")
    at = lambda node: spark.range(50).selectExpr("cast(id as int) as graph_id", f"'{node}' as node_id")
    found = GR.classify_between(edges, at("s"), at("e"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 150 and plan.count("Exchange") == 1 and not written


@pytest.mark.parametrize(("small", "links", "exact", "large"), [(400, 3, False, False), (8, 6, True, False), (8, 9, True, True)])
def test_sizes_of_graphs_are_counted_only_where_one_may_be_large(spark, monkeypatch, small, links, exact, large):
    """Counts by remainders of a hash tell that all graphs are small; crowded remainders are no large graphs yet."""
    monkeypatch.setattr(GR, "SMALL", small)
    edges = spark.createDataFrame([(g, str(i), str(i + 1)) for g in range(600) for i in range(links if g % 7 == 0 else 3)], "graph_id int, src string, dst string")
    ends = spark.range(600).selectExpr("cast(id as int) as graph_id", "'3' as node_id")
    looked, frame = [], type(edges)
    monkeypatch.setattr(frame, "agg", lambda df, *by, agg=frame.agg: looked.append(df.columns[0]) or agg(df, *by))
    split = GR._Split(edges, {GR.END: ends})
    assert looked == ["_shared", "graph_id"][: 1 + exact] and (split.large is not None) == large
    up = GR.upstream(edges, ends)
    assert up[0].count() == up[1].count() == 600 * 3


@pytest.mark.parametrize("small", [3, 4000])
def test_reach_both_ways_needs_no_table(spark, monkeypatch, small):
    """Small graphs move once for both directions and their intersection; a null id, and one that no link names, stay."""
    monkeypatch.setattr(GR, "SMALL", small)
    written = []
    monkeypatch.setattr(GR, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    edges = spark.createDataFrame([(g, a, b) for g in range(20) for a, b in ("sa", "ab", "be", "xb", "ay")], "graph_id int, src string, dst string")
    edges = edges.union(spark.createDataFrame([(0, None, "a"), (0, "a", None), (None, "s", "e")], edges.schema))
    at = lambda node: spark.createDataFrame([(g, node) for g in [*range(20), 77, None]], "graph_id int, node_id string")
    found = GR.reached_both_ways(edges, at("s"), at("e"))
    if small > 3:
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(graph_id") == 1 and not written
    rows = lambda df: sorted(((r.graph_id, r.node_id) for r in df.collect()), key=str)
    assert rows(found) == rows(GR.reach_intersection(*GR.both_ways(edges, at("s"), at("e")), at("s"), at("e")))
    assert len(rows(found)) == 20 * 4 + 1 + 2 + 2


def test_literals_are_parsed_once_and_stay_where_they_are(spark):
    """Listed and named controls come from one parse, and the few names of controls are broadcast."""
    listed = '{"nodes": [{"id": 1, "type": "t", "inputs": [{"name": "b", "link": 4}], "widgets_values": [7, "x", null]}]}'
    named = '{"nodes": [{"id": 2, "type": "t", "widgets_values": {"c": [1], "d": null}}, {"id": 3, "type": "t"}]}'
    docs = spark.createDataFrame([(1, listed), (2, named)], "graph_id int, d string")
    controls = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b")], "type string, position int, input string")
    found = W.literal_inputs(docs, "d", controls)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 2 and "hashpartitioning" not in plan
    rows = sorted((r.graph_id, r.node_id, r.input, r.value) for r in found.collect())
    assert rows == [(1, "1", "a", "7"), (1, "1", "control_2", "null"), (2, "2", "c", "[1]"), (2, "2", "d", "null")]
