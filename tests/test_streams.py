"""Restarts and repeated batches."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from rasterloom.session import scratch_path
from rasterloom.sources import manifests as M
from rasterloom.sources import versions as V
from rasterloom.streaming import passes as P

FRAME = "video_id string, frame_name string, arrived int, payload int"


def add(spark, path, rows):
    spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(path)


def names(video, *numbers, arrived=0):
    return [(video, f"frame_{n:08d}.png", arrived, n) for n in numbers]


def test_each_frame_passes_once_across_restarts(spark):
    source, sink, progress = (scratch_path(spark, n) for n in ("s", "o", "c"))
    step = lambda df: df.withColumn("payload", F.col("payload") + 100)
    seen = []
    for rows in (names("a", 1, 2), names("a", 3) + names("b", 1), []):
        if rows:
            add(spark, source, rows)
        P.run_frames(P.frame_stream(spark, source, FRAME), step, sink, progress)
        seen.append(spark.read.parquet(sink).count())
    assert seen == [2, 4, 4]
    assert spark.read.parquet(sink).agg(F.min("payload")).first()[0] == 101


def test_completion_is_reported_once(spark):
    source, sink, progress = (scratch_path(spark, n) for n in ("s", "o", "c"))
    manifest = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "video_id string, frame_count int")
    done = []
    for rows in (names("a", 1, 2) + names("b", 1), names("a", 2, 2), names("a", 3) + names("c", 1), names("a", 3, 4)):
        add(spark, source, rows)
        P.completed_videos(P.frame_stream(spark, source, FRAME), manifest, sink, progress)
        done.append(sorted(r.video_id for r in P.read_completed(spark, sink).collect()))
    assert done == [["b"], ["b"], ["a", "b"], ["a", "b"]]


def test_other_files_and_late_repeats_complete_nothing(spark):
    source, sink, progress = (scratch_path(spark, n) for n in ("s", "o", "c"))
    manifest = spark.createDataFrame([("a", 3), ("late", 2)], "video_id string, frame_count int")
    done = []
    others = [("a", n, 0, 0) for n in ("cover.png", "processed_video.mp4")]
    for rows in (names("a", 1, 2) + others, names("a", 1, 2, arrived=10**6) + names("late", 1), names("a", 3), names("late", 1, 2)):
        add(spark, source, rows)
        P.completed_videos(P.frame_stream(spark, source, FRAME), manifest, sink, progress)
        done.append(sorted((r.video_id, r.frame_count) for r in P.read_completed(spark, sink).collect()))
    assert done == [[], [], [("a", 3)], [("a", 3), ("late", 2)]]
    assert not (Path(sink.split(":", 1)[-1]) / "counts").exists()


def test_last_write_wins_and_a_repeated_batch_changes_nothing(spark):
    source, sink, progress = (scratch_path(spark, n) for n in ("s", "o", "c"))
    key, order = ["video_id", "frame_name"], ["arrived", "payload"]
    add(spark, source, names("a", 1, 2, arrived=1) + names("a", 1, arrived=5))
    P.keep_last(P.frame_stream(spark, source, FRAME), sink, progress, key, order)
    add(spark, source, names("a", 2, arrived=3) + names("a", 1, arrived=2))
    P.keep_last(P.frame_stream(spark, source, FRAME), sink, progress, key, order)
    last = lambda: sorted((r.frame_name[-5], r.arrived) for r in P.read_last(spark, sink).collect())
    assert last() == [("1", 5), ("2", 3)]
    repeated = spark.createDataFrame(names("a", 2, arrived=3) + names("a", 1, arrived=2), FRAME)
    P.upsert_batch(sink, key, order)(repeated, 1)
    assert last() == [("1", 5), ("2", 3)]


def files(root):
    """Data files below ``root`` by bucket and version."""
    found = {}
    for path in Path(root.split(":", 1)[-1]).glob("data/bucket=*/version=*/*.parquet"):
        found.setdefault(path.parent.parent.name, {}).setdefault(path.parent.name, set()).add((path.name, path.stat().st_mtime_ns))
    return found


def test_a_batch_rewrites_the_buckets_it_touches_only(spark):
    source, sink, progress = (scratch_path(spark, n) for n in ("s", "o", "c"))
    key, order = ["video_id", "frame_name"], ["arrived", "payload"]
    add(spark, source, [r for v in "abcdefghij" for r in names(v, *range(20), arrived=1)])
    P.keep_last(P.frame_stream(spark, source, FRAME), sink, progress, key, order, buckets=8)
    before = files(sink)
    assert len(before) == 8
    add(spark, source, names("a", 3, arrived=2))
    P.keep_last(P.frame_stream(spark, source, FRAME), sink, progress, key, order, buckets=8)
    after = files(sink)
    assert [b for b in before if after[b] != before[b]] and sum(after[b] != before[b] for b in before) == 1
    rows = P.read_last(spark, sink).collect()
    assert len(rows) == 200 and [r.arrived for r in rows if (r.video_id, r.payload) == ("a", 3)] == [2]
    # A batch that dies before it is published changes nothing for readers; repeated, it is whole.
    late = spark.createDataFrame(names("b", 5, arrived=9), FRAME)
    crash, published = V._publish, []
    V._publish = lambda *a: published.append(a) or (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        P.upsert_batch(sink, key, order, 8)(late, 2)
    except RuntimeError:
        pass
    finally:
        V._publish = crash
    assert published and {tuple(r) for r in P.read_last(spark, sink).collect()} == {tuple(r) for r in rows}
    for _ in range(2):
        P.upsert_batch(sink, key, order, 8)(late, 2)
        found = P.read_last(spark, sink).collect()
        assert len(found) == 200 and max(r.arrived for r in found) == 9
    assert V.drop_superseded(spark, sink) == 2
    assert {tuple(r) for r in P.read_last(spark, sink).collect()} == {tuple(r) for r in found}
    assert all(len(v) == 1 for v in files(sink).values())


def test_one_frame_is_replaced(spark):
    root = scratch_path(spark, "frames")
    schema = "video_id string, frame_idx int, y int, v double"
    rows = [(v, i, y, 0.0) for v in "abcdefgh" for i in range(3) for y in range(4)]
    assert M.replace_frames(spark.createDataFrame(rows, schema), root, buckets=4) == 1
    before = files(root)
    assert M.replace_frames(spark.createDataFrame([("c", 1, 0, 1.0), ("new", 0, 0, 2.0)], schema), root, buckets=4) == 2
    found = {(r.video_id, r.frame_idx, r.y): r.v for r in V.read_buckets(spark, root, schema).collect()}
    assert found == {(v, i, y): x for v, i, y, x in rows if (v, i) != ("c", 1)} | {("c", 1, 0): 1.0, ("new", 0, 0): 2.0}
    untouched = [b for b, versions in files(root).items() if set(versions) == {"version=1"}]
    assert untouched and all(files(root)[b] == before[b] for b in untouched)


def test_readers_see_whole_manifests(spark):
    root = scratch_path(spark, "manifests")
    entry = lambda v, n: (v, f"{v}.mp4", 10 * n, None, 25.0, 4, 3, n)
    manifest = lambda *entries: spark.createDataFrame(list(entries), M.MANIFEST_SCHEMA)
    counts = lambda df: {r.video_id: r.frame_count for r in df.collect()}
    assert M.read_published_manifest(spark, root).collect() == []
    assert M.publish_manifest(manifest(entry("a", 1), entry("b", 2)), root) == 1
    old = M.read_published_manifest(spark, root)
    assert M.update_manifest(manifest(entry("b", 5), entry("c", 7)), root) == 2
    assert counts(old) == {"a": 1, "b": 2} == counts(M.read_published_manifest(spark, root, 1))
    assert counts(M.read_published_manifest(spark, root)) == {"a": 1, "b": 5, "c": 7}
    # A write that dies before it is published stays unseen, and the next one takes its number.
    publish = V._publish
    V._publish = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        M.update_manifest(manifest(entry("a", 9)), root)
    except RuntimeError:
        pass
    finally:
        V._publish = publish
    assert counts(M.read_published_manifest(spark, root))["a"] == 1
    assert M.update_manifest(manifest(entry("a", 4)), root) == 3
    assert counts(M.read_published_manifest(spark, root)) == {"a": 4, "b": 5, "c": 7}


def test_arriving_files_stay_small(spark, monkeypatch, tmp_path):
    """More rows make more files, so that no task reads a fixed share of them all."""
    from rasterloom.plans import stream_queries as Q
    from rasterloom.plans.registry import Tables

    monkeypatch.setattr(Q, "FILE_ROWS", 100)
    monkeypatch.setattr(Q, "scratch_path", lambda session, name: str(tmp_path / name))
    Q._arriving(Tables(spark, "/root/testdata/sf0.001"), spark.range(1000), "many")
    Q._arriving(Tables(spark, "/root/testdata/sf0.001"), spark.range(40), "few")
    files = lambda name: len(list((tmp_path / name).glob("*.parquet")))
    assert files("many") == 10 and 1 <= files("few") <= 4
