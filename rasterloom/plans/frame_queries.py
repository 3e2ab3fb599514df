"""Frame sequence, path and probe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import frames as V
from ..operators import ordering as O
from ..operators import probes as B
from ..operators.canvas import quantise
from ..session import scratch_path
from ..sources import manifests as M
from ..sources import media as L
from ..sources.versions import read_buckets
from .registry import query

# Python-style suffix of the last path component, lower case.
SUFFIX_SQL = "lower(regexp_extract({0}, '[^/](\\.[^./]+)$', 1))"
NATURAL_SQL = (
    "list_transform(regexp_extract_all(lower({0}), '[0-9]+|[^0-9]+'), lambda p: "
    "{{'number': coalesce(try_cast(p as bigint), -1), 'text': case when try_cast(p as bigint) is null then p else '' end}})"
)


def _ts(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


TS_SQL = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query("src2_video_listing", """
select 'clip=' || (page_id % 7) as folder, sum(octet_length(encode(url)) + 1)::bigint as bytes from pages group by page_id % 7""")
def _(t):
    path = scratch_path(t.spark, "listing")
    t.pages.select(F.concat(F.lit("clip="), (F.col("page_id") % 7).cast("string")).alias("folder"), "url").repartition(
        "folder"
    ).write.partitionBy("folder").text(path)
    listed = L.list_media(t.spark, path, [".txt"], recursive=True)
    folder = F.url_decode(F.regexp_extract("path", "^folder=([^/]*)/[^/]+$", 1))
    return listed.groupBy(folder.alias("folder")).agg(F.sum("size").cast("bigint").alias("bytes"))


@query("src3_frame_listing", """
select 1 as with_suffix, sum(octet_length(encode(url)) + 1)::bigint as bytes from pages""")
def _(t):
    path = scratch_path(t.spark, "flat")
    t.pages.select("url").repartition(12).write.text(path)
    listed = L.list_media(t.spark, path, [".txt"], recursive=False, natural=True)
    return listed.groupBy(F.col("path").rlike(r"^part-\d+[^/]*\.txt$").cast("int").alias("with_suffix")).agg(
        F.sum("size").cast("bigint").alias("bytes")
    )


# A dozen files by remainder of the page, their names, and their places in the listings (none: not listed).
VIDEO_FILES = [
    ("b/Take_10.MP4", 2), ("b/take_9.mkv", 3), ("a.txt", None), ("a/notes.MOV.txt", None), ("a/clip.webm", 1), ("Z.avi", 0), ("c/d/e.M2ts", 6),
    ("c/d.png", None), ("c.mp4", 5), ("c-1.mp4", 4), ("noext", None), ("c/mp4", None),
]
IMAGE_FILES = [
    ("frame_10.png", 4), ("frame_9.PNG", 3), ("Frame_1.jpg", 0), ("frame_2.webp", 1), ("frame_2b.tiff", 2), ("take 3.bmp", 6), ("take 03a.bmp", 7),
    ("frame_11.mp4", None), ("sub/frame_1.png", None), ("frame.png.txt", None), ("frame_100.jpeg", 5), ("zebra", None),
]


def _files_sql(files):
    names = ", ".join(f"({i}, '{path}', {pos})" for i, (path, pos) in enumerate(files) if pos is not None)
    return f"""
select path, pos::int as pos, sum(octet_length(encode(url)) + 1)::bigint as size from pages join (values {names}) as f(k, path, pos) on page_id % {len(files)} = k group by path, pos"""


def _written_files(t, files):
    """The pages' addresses in files of these names; as Spark names its own files, each is moved to its place afterwards."""
    root, parts = scratch_path(t.spark, "files"), scratch_path(t.spark, "parts")
    t.pages.select((F.col("page_id") % len(files)).alias("k"), "url").repartition("k").write.partitionBy("k").text(parts)
    jvm = t.spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(t.spark._jsc.hadoopConfiguration())
    for k, (name, _) in enumerate(files):
        found = store.globStatus(path(f"{parts}/k={k}/part-*"))
        if found:
            store.mkdirs(path(f"{root}/{name}").getParent())
            store.rename(found[0].getPath(), path(f"{root}/{name}"))
    return root


def _places(listed):
    """A listing in order as rows with their place; listings of a folder are short."""
    return listed.coalesce(1).withColumn("pos", F.monotonically_increasing_id().cast("int")).select("path", "pos", "size")


@query("src2_video_names", _files_sql(VIDEO_FILES))
def _(t):
    """Videos by suffix in any case, in all folders, in name order."""
    return _places(L.list_media(t.spark, _written_files(t, VIDEO_FILES)))


@query("src3_image_names", _files_sql(IMAGE_FILES))
def _(t):
    """Images of one folder in natural order."""
    return _places(L.list_images(t.spark, _written_files(t, IMAGE_FILES)))


@query("src5_manifest_scan", f"""
select video_id, path, size, {TS_SQL.format('mtime')} as mtime, fps, width, height, frame_count from manifest_fx where frame_count % 5 <> 2""",
       "manifest_fx")
def _(t):
    texts = M.encode_manifest(t.manifest_fx).withColumn("n", F.get_json_object("value", "$.frame_count").cast("int"))
    path = scratch_path(t.spark, "manifest-json")
    damaged = F.expr("substring(value, 1, length(value) - 9)")
    texts.select(F.when(F.col("n") % 5 == 2, damaged).otherwise(F.col("value")).alias("value")).write.text(path)
    return M.read_manifest(t.spark, path).withColumn("mtime", _ts("mtime"))


@query("snk1_manifest_sink", f"""
select video_id, path, size, {TS_SQL.format('mtime')} as mtime, fps, width, height, frame_count from manifest_fx""", "manifest_fx")
def _(t):
    path = scratch_path(t.spark, "manifest")
    M.write_manifest(t.manifest_fx, path)
    return M.read_manifest(t.spark, path, "parquet").withColumn("mtime", _ts("mtime"))


@query("snk1_manifest_merge", f"""
select video_id, path, case when size % 3 = 1 then size + 1 else size end as size, {TS_SQL.format('mtime')} as mtime, fps, width, height, frame_count
from manifest_fx""", "manifest_fx")
def _(t):
    saved, merged = scratch_path(t.spark, "manifest"), scratch_path(t.spark, "manifest")
    M.write_manifest(t.manifest_fx.where("size % 3 <> 0").withColumn("size", F.col("size") + 1), saved)
    touched = t.manifest_fx.where("size % 3 <> 1")
    M.write_manifest(M.merge_manifest(M.read_manifest(t.spark, saved, "parquet"), touched), merged)
    return M.read_manifest(t.spark, merged, "parquet").withColumn("mtime", _ts("mtime"))


@query("snk1_published_manifest", f"""
select video_id, path, case when size % 3 = 1 then size + 1 else size end as size, {TS_SQL.format('mtime')} as mtime, fps, width, height, frame_count
from manifest_fx""", "manifest_fx")
def _(t):
    """Two versions, the second an update of the first; what is read is the second as published."""
    root = scratch_path(t.spark, "manifest")
    M.publish_manifest(t.manifest_fx.where("size % 3 <> 0").withColumn("size", F.col("size") + 1), root)
    M.update_manifest(t.manifest_fx.where("size % 3 <> 1"), root)
    return M.read_published_manifest(t.spark, root).withColumn("mtime", _ts("mtime"))


@query("snk2_replaced_frames", """
select image_id::varchar as video_id, image_id % 4 as frame_idx, y, x, case when image_id % 7 = 2 then 255 - round_even(v * 255, 0)::int else round_even(v * 255, 0)::int end as v
from raster_fx""", "raster_fx")
def _(t):
    """All frames, then a seventh of them again with other pixels, which replace the first."""
    root = scratch_path(t.spark, "frames")
    frames = quantise(t.raster_fx).select(F.col("image_id").cast("string").alias("video_id"), (F.col("image_id") % 4).alias("frame_idx"), "y", "x", "v")
    M.replace_frames(frames, root, buckets=8)
    M.replace_frames(frames.where("video_id % 7 = 2").withColumn("v", 255 - F.col("v")), root, buckets=8)
    return read_buckets(t.spark, root, frames.schema)


@query("jsn2_manifest_encode_decode", f"""
select video_id, path, size, {TS_SQL.format('mtime')} as mtime, fps, width, height, frame_count from manifest_fx""", "manifest_fx")
def _(t):
    return M.decode_manifest(M.encode_manifest(t.manifest_fx)).withColumn("mtime", _ts("mtime"))


RATE_TEXTS = (
    "case {0} % 8 when 0 then '0/0' when 1 then '30000/1001' when 2 then '' when 3 then '25' when 4 then null "
    "when 5 then 'abc' when 6 then '-5/1' else '1e1' end"
)
RATES = (
    "case {0} % 8 when 1 then 30000::double / 1001 when 3 then 25.0 when 7 then 10.0 when 2 then {1} when 4 then {1} else 24.0 end::double"
)
REAL_RATES = "case {0} % 3 when 0 then 24.0 when 1 then 60000::double / 1001 else 50.0 end::double"
REAL_TEXTS = "case {0} % 3 when 0 then '' when 1 then '60000/1001' else '50/1' end"


@query("prj13_frame_rate", "select o_orderkey, "
       + RATES.format("o_orderkey", REAL_RATES.format("o_custkey")) + " as fps from orders")
def _(t):
    rows = t.orders.select(
        "o_orderkey", F.expr(RATE_TEXTS.format("o_orderkey")).alias("a"), F.expr(REAL_TEXTS.format("o_custkey")).alias("r")
    )
    return rows.select("o_orderkey", X.frame_rate(F.col("a"), F.col("r")).alias("fps"))


@query("prj14_frame_names", """
select l_orderkey, l_linenumber, printf('frame_%08d.png', l_partkey::int) as frame_name, printf('frame_%08d', l_partkey::int) as frame_stem,
  l_partkey as frame_number from lineitem""")
def _(t):
    named = t.lineitem.select("l_orderkey", "l_linenumber", X.frame_name(F.col("l_partkey")).alias("frame_name"))
    return named.withColumn("frame_stem", X.stem(F.col("frame_name"))).withColumn(
        "frame_number", X.frame_number(F.col("frame_name"))
    )


@query("prj15_path_cleanup", """
with q as (select page_id, path, case page_id % 5 when 0 then '  "' || path || '" ' when 1 then path || '/' when 2 then '' when 3 then '/abs//' || path else './' || path end as raw from paths_fx)
select page_id, raw, case page_id % 5 when 2 then null when 3 then '/abs/' || path
  else regexp_replace(path, '^(ComfyUI/Output|output)/', '') end as cleaned from q""", "paths_fx")
def _(t):
    key = F.col("page_id") % 5
    raw = (
        F.when(key == 0, F.concat(F.lit('  "'), "path", F.lit('" '))).when(key == 1, F.concat("path", F.lit("/")))
        .when(key == 2, "").when(key == 3, F.concat(F.lit("/abs//"), "path")).otherwise(F.concat(F.lit("./"), "path"))
    )
    return t.paths_fx.select("page_id", raw.alias("raw")).withColumn("cleaned", X.clean_path(F.col("raw")))


@query("prj16_output_name", """
with n as (select page_id, case page_id % 9 when 8 then '  ' else path end as raw from paths_fx),
b as (select *, case when trim(raw) = '' then 'processed_video.mp4' else regexp_extract(trim(raw), '[^/]*$') end as base from n)
select page_id, case when lower(base) like '%.mp4' then base else regexp_replace(base, '\\.[^.]+$', '') || '.mp4' end as output_name from b""",
       "paths_fx")
def _(t):
    raw = F.when(F.col("page_id") % 9 == 8, "  ").otherwise(F.col("path"))
    return t.paths_fx.select("page_id", X.safe_output_name(raw).alias("output_name"))


@query("prj17_root_relative", """
select page_id, case when starts_with(path, 'output/') then regexp_extract(path, '[^/]*$') end as filename,
  case when starts_with(path, 'output/') then regexp_extract(path, '^output/(.*)/[^/]*$', 1) end as subfolder from paths_fx""", "paths_fx")
def _(t):
    return t.paths_fx.select("page_id", X.relative_to(F.col("path"), "output").alias("r")).select(
        "page_id", "r.filename", "r.subfolder"
    )


@query("flt1_extension_filter", f"""
select page_id, path from paths_fx where {SUFFIX_SQL.format('path')} in ('.avi', '.m2ts', '.m4v', '.mkv', '.mov', '.mp4', '.mpeg', '.mpg', '.mts', '.webm', '.wmv')""",
       "paths_fx")
def _(t):
    return t.paths_fx.where(V.supported(F.col("path")))


@query("flt2_job_validation", """
with j as (select page_id, case when page_id % 9 = 1 then ' ' else path end as video, page_id % 4 as f, page_id % 3 as p, page_id % 2 = 0 as clr from paths_fx),
e as (select page_id, case when trim(video) = '' then ['no video'] when """ + SUFFIX_SQL.format("video") + """ not in ('.avi', '.m2ts', '.m4v', '.mkv', '.mov', '.mp4', '.mpeg', '.mpg', '.mts', '.webm', '.wmv') then ['unsupported extension'] else [] end
  || case when f = 3 then ['no frames folder'] else [] end || case when f in (0, 1) and p = 0 then ['same folder'] else [] end
  || case when p = 1 and clr then ['would clear the output root'] else [] end as errors from j)
select page_id, array_to_string(errors, '; ') as errors from e""", "paths_fx")
def _(t):
    key = F.col("page_id")
    jobs = t.paths_fx.select(
        "page_id", F.when(key % 9 == 1, " ").otherwise(F.col("path")).alias("video"),
        F.when(key % 4 == 0, "frames/a").when(key % 4 == 1, "output/frames/a").when(key % 4 == 2, "frames/b").otherwise('""').alias("frames_folder"),
        F.when(key % 3 == 0, "Output/frames/a").when(key % 3 == 1, "output").otherwise("done").alias("processed_folder"),
        (key % 2 == 0).alias("clear_processed"),
    )
    return V.check_jobs(jobs).select("page_id", F.array_join("errors", "; ").alias("errors"))


LOOPS_SQL = """
with l as (select video_id, frame_idx - 1 as i from frames_fx),
k as (select l.video_id, greatest(0, i) as loop_index, frame_count from l left join manifest_fx m on m.video_id = l.video_id)
select video_id, loop_index, case when loop_index < frame_count then 'ok' else 'outside' end as verdict from k"""


@query("flt3_frame_bound_check", LOOPS_SQL.replace("i) as loop_index", "i + case when payload % 50 = 0 then 9 else 0 end) as loop_index").replace("frame_idx - 1 as i", "frame_idx - 1 as i, payload"),
       "frames_fx manifest_fx")
def _(t):
    late = F.when(F.col("payload") % 50 == 0, 9).otherwise(0)
    loops = t.frames_fx.select("video_id", (F.col("frame_idx") - 1 + late).cast("int").alias("loop_index"))
    ok, rejects = V.check_index(loops, t.manifest_fx)
    return ok.withColumn("verdict", F.lit("ok")).unionByName(rejects.withColumn("verdict", F.lit("outside"))).drop("frame_count")


@query("flt4_one_frame_check", """
with g as (select video_id, frame_idx, count(*) as n, min(payload) as payload from frames_fx group by video_id, frame_idx)
select video_id, frame_idx, n as delivered, case when n = 1 then payload end as payload from g""", "frames_fx")
def _(t):
    single, rejects = V.one_frame_check(t.frames_fx)
    return (
        single.select("video_id", "frame_idx", F.lit(1).cast("bigint").alias("delivered"), "payload")
        .unionByName(rejects, allowMissingColumns=True)
    )


@query("flt5_output_clash", """
with o as (select image_id, 'out/' || (image_id % 40) as folder, 'clip' || (width % 9) || '.mp4' as f, case image_id % 6 when 0 then 'vp9' when 1 then 'libx265' else 'libx264' end as codec,
  height % 60 as crf, image_id % 2 = 0 as ow from requests_fx),
x as (select distinct 'out/' || (page_id % 40) || '/clip' || (page_id % 7) || '.mp4' as path from pages)
select image_id, folder || '/' || f as output_path, array_to_string(case when path is not null and not ow then ['output exists'] else [] end
  || case when codec = 'vp9' then ['unknown codec'] else [] end || case when crf > 51 then ['crf out of range'] else [] end, '; ') as errors
from o left join x on path = folder || '/' || f""", "requests_fx")
def _(t):
    c = F.col
    number = lambda column: column.cast("string")
    outputs = t.requests_fx.select(
        "image_id", F.concat(F.lit("out/"), number(c("image_id") % 40)).alias("folder"),
        F.concat(F.lit("clip"), number(c("width") % 9), F.lit(".avi")).alias("output_filename"),
        F.when(c("image_id") % 6 == 0, "vp9").when(c("image_id") % 6 == 1, "libx265").otherwise("libx264").alias("video_codec"),
        (c("height") % 60).alias("crf"), (c("image_id") % 2 == 0).alias("overwrite"),
    )
    existing = t.pages.select(
        F.concat(F.lit("out/"), number(c("page_id") % 40), F.lit("/clip"), number(c("page_id") % 7), F.lit(".mp4")).alias("path")
    )
    return V.output_clashes(outputs, existing).select("image_id", "output_path", F.array_join("errors", "; ").alias("errors"))


LISTING = "listing as (select distinct video_id, frame_name from frames_fx)"


@query("sort1_natural_order", f"""
with f as (select distinct (page_id % 7)::varchar as video_id, regexp_extract(path, '[^/]*$') as frame_name from paths_fx)
select video_id, frame_name, (row_number() over (partition by video_id order by {NATURAL_SQL.format('frame_name')}, frame_name) - 1)::int as frame_idx from f""",
       "paths_fx")
def _(t):
    names = t.paths_fx.select(
        (F.col("page_id") % 7).cast("string").alias("video_id"), X.base_name(F.col("path")).alias("frame_name")
    )
    return V.natural_index(names, names=None).select("video_id", "frame_name", "frame_idx")


@query("sort2_listing_order", f"select page_id, path from paths_fx where {SUFFIX_SQL.format('path')} = '.png' order by path, page_id", "paths_fx")
def _(t):
    return t.paths_fx.where(V.supported(F.col("path"), [".png"])).orderBy("path", "page_id")


@query("win1_frame_index", f"""
with {LISTING}
select video_id, frame_name, (row_number() over (partition by video_id order by frame_name) - 1)::int as frame_idx,
  count(*) over (partition by video_id)::int as frame_count from listing""", "frames_fx")
def _(t):
    return V.index_frames(t.frames_fx)


TIMELINE_SQL = """
with f as (select distinct video_id, frame_name, frame_idx from frames_complete_fx),
m as (select video_id, 10 + max(frame_idx) % 3 as fps from f group by video_id),
last as (select video_id, max(frame_idx) as li from f group by video_id),
t as (select video_id, frame_name, frame_idx::int as pos, frame_idx / fps::double as start, 1.0::double / fps as duration from f join m using (video_id)
union all select video_id, frame_name, (frame_idx + 1)::int, (frame_idx + 1) / fps::double, null from f join m using (video_id) join last using (video_id) where frame_idx = li)
"""


def _timeline(t):
    frames = t.frames_complete_fx
    manifest = frames.groupBy("video_id").agg((10 + F.max("frame_idx") % 3).cast("double").alias("fps"))
    return V.timeline(frames, manifest)


@query("win2_timeline", TIMELINE_SQL + "select video_id, frame_name, pos, round(start, 9) as start, round(duration, 9) as duration from t",
       "frames_complete_fx")
def _(t):
    return _timeline(t).withColumn("start", F.round("start", 9)).withColumn("duration", F.round("duration", 9))


@query("snk3_sequence_sink", TIMELINE_SQL + """
select video_id, pos, 0 as part, 'ffconcat version 1.0' as line from t where pos = 0
union all select video_id, pos, case when pos = 0 then 1 else 0 end, 'file ''out/' || video_id || '/' || frame_name || '''' from t
union all select video_id, pos, case when pos = 0 then 2 else 1 end, printf('duration %.12f', duration) from t where duration is not null""", "frames_complete_fx")
def _(t):
    path = scratch_path(t.spark, "timeline")
    M.write_timeline(_timeline(t), path)
    written = t.spark.read.parquet(path)
    return V.concat_lines(written, F.concat(F.lit("out/"), "video_id"))


@query("lim1_first_expected", f"""
with {LISTING}, r as (select *, (row_number() over (partition by video_id order by {NATURAL_SQL.format('frame_name')}, frame_name) - 1)::int as frame_idx from listing)
select r.video_id, frame_name, frame_idx from r join manifest_fx m on m.video_id = r.video_id where frame_idx < frame_count - 1""",
       "frames_fx manifest_fx")
def _(t):
    fewer = t.manifest_fx.withColumn("frame_count", F.col("frame_count") - 1)
    return V.take_expected(t.frames_fx, fewer).select("video_id", "frame_name", "frame_idx")


@query("agg5_frame_count", "select video_id, count(distinct frame_name) as frame_count from frames_fx group by video_id", "frames_fx")
def _(t):
    return V.frame_counts(t.frames_fx)


@query("agg6_completeness", """
with c as (select video_id, count(distinct frame_name) as n from frames_fx group by video_id)
select m.video_id, frame_count, least(coalesce(n, 0), frame_count)::int as found, coalesce(n, 0) >= frame_count as complete
from manifest_fx m left join c on c.video_id = m.video_id""", "frames_fx manifest_fx")
def _(t):
    return V.completeness(t.frames_fx, t.manifest_fx)


@query("join7_missing_frames", """
with e as (select video_id, 'frame_' || i || '.png' as frame_name from manifest_fx, unnest(generate_series(1, frame_count)) as u(i))
select * from e where not exists (select 1 from frames_fx f where f.video_id = e.video_id and f.frame_name = e.frame_name)""",
       "frames_fx manifest_fx")
def _(t):
    unpadded = F.concat(F.lit("frame_"), F.col("number").cast("string"), F.lit(".png"))
    return V.missing_frames(V.expected_frames(t.manifest_fx, unpadded), t.frames_fx)


@query("join3_source_manifest", """
select s.video_id, s.path, coalesce(s.size = m.size and s.mtime = m.mtime, false) as matches from sources_fx s left join manifest_fx m on m.path = s.path""",
       "sources_fx manifest_fx")
def _(t):
    return V.match_manifest(t.sources_fx, t.manifest_fx).select("video_id", "path", "matches")


ACTIONS_SQL = """
with c as (select video_id, count(distinct frame_name) as n from frames_fx group by video_id),
j as (select s.video_id, s.path, s.size, coalesce(s.size = m.size and s.mtime = m.mtime, false) as matches, coalesce(n, 0) as n from sources_fx s
  left join manifest_fx m on m.path = s.path left join c on c.video_id = s.video_id)
select video_id, case when n > 0 and matches then 'reuse' when n = 0 then 'extract' when size % 2 = 0 then 're-extract' else 'conflict' end as action from j"""


@query("join4_extraction_decision", ACTIONS_SQL, "sources_fx manifest_fx frames_fx")
def _(t):
    counts = V.frame_counts(t.frames_fx)
    return V.extraction_plan(t.sources_fx, t.manifest_fx, counts, F.col("size") % 2 == 0).select("video_id", "action")


@query("join6_frame_context", """
select f.video_id, f.frame_idx, f.frame_name, f.payload, m.path, fps, frame_count from frames_fx f left join manifest_fx m on m.video_id = f.video_id""",
       "frames_fx manifest_fx")
def _(t):
    return V.frame_context(t.frames_fx, t.manifest_fx).drop("arrived")


@query("txt1_probe_log", """
with v as (select file_id, arg_min(line, line_no) as l from probe_fx where regexp_matches(line, 'Stream #.*Video:') group by file_id),
d as (select file_id, arg_min(line, line_no) as l from probe_fx where regexp_matches(line, 'Duration:') group by file_id)
select v.file_id, coalesce(try_cast(regexp_extract(v.l, '([0-9]+([.][0-9]+)?)\\s*fps', 1) as double), try_cast(regexp_extract(v.l, '([0-9]+([.][0-9]+)?)\\s*tbr', 1) as double), 24.0)::double as fps,
  regexp_extract(v.l, '(^|[^0-9])([0-9]{2,6})x([0-9]{2,6})([^0-9]|$)', 2)::int as width, regexp_extract(v.l, '(^|[^0-9])([0-9]{2,6})x([0-9]{2,6})([^0-9]|$)', 3)::int as height,
  regexp_extract(d.l, 'Duration: ([0-9]+):', 1)::double * 3600 + regexp_extract(d.l, 'Duration: [0-9]+:([0-9]+):', 1)::double * 60 + regexp_extract(d.l, 'Duration: [0-9]+:[0-9]+:([0-9.]+)', 1)::double as duration
from v left join d on d.file_id = v.file_id""", "probe_fx")
def _(t):
    return B.probe_from_log(t.probe_fx)[0]


@query("txt1_probe_log_rejects", "select p_partkey as file_id from part where p_size % 10 = 9")
def _(t):
    return B.probe_from_log(t.probe_fx)[1]


@query("txt2_probe_json", "select p_partkey, " + RATES.format("p_partkey", REAL_RATES.format("p_size")) + """ as fps,
  case when p_size % 4 = 0 then 0 else 64 * (1 + p_size) end::int as width, (64 * (1 + p_partkey % 16))::int as height,
  case when p_size % 6 = 0 then 0.0 else p_size + 0.5 end::double as duration from part where p_size % 10 <> 9""")
def _(t):
    stream = F.struct(
        F.expr(RATE_TEXTS.format("p_partkey")).alias("avg_frame_rate"), F.expr(REAL_TEXTS.format("p_size")).alias("r_frame_rate"),
        F.when(F.col("p_size") % 4 != 0, 64 * (1 + F.col("p_size"))).alias("width"),
        (64 * (1 + F.col("p_partkey") % 16)).alias("height"),
    )
    streams = F.when(F.col("p_size") % 10 != 9, F.array(stream)).otherwise(F.filter(F.array(stream), lambda s: F.lit(False)))
    form = F.struct(F.when(F.col("p_size") % 6 != 0, (F.col("p_size") + 0.5).cast("string")).alias("duration"))
    docs = t.part.select("p_partkey", F.to_json(F.struct(streams.alias("streams"), form.alias("format"))).alias("doc"))
    return B.probe_from_json(docs, "doc")[0]
