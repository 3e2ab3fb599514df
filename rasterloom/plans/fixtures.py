"""Input views derived from the test tables. One SQL text serves Spark and the SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

VIEWS: dict[str, str] = {
    "presets_fx": """
select p_brand as model, cast(substring(p_brand, 7) as int) as model_ord,
  case p_size % 4 when 0 then '1024' when 1 then '1K' when 2 then '1.5K' else '2K' end as resolution,
  cast(p_size % 4 as int) as res_ord, p_partkey as item_ord,
  concat(cast(1 + p_size as string), ':', cast(1 + p_partkey % 16 as string)) as ratio, p_type as label,
  cast(64 * (1 + p_size) as int) as width, cast(64 * (1 + p_partkey % 16) as int) as height
from part""",
    "requests_fx": """
select o_orderkey as image_id,
  case when o_orderkey % 13 = 0 then 'unknown' else p_brand end as model,
  case when o_orderkey % 11 = 0 then '8K' when p_size % 4 = 0 then '1024' when p_size % 4 = 1 then '1K'
       when p_size % 4 = 2 then '1.5K' else '2K' end as resolution_preset,
  case when o_orderkey % 2 = 0 then 'automatic' else 'manual' end as selection_mode,
  case when o_orderkey % 17 = 0 then 'none' else concat(cast(1 + p_size as string), ':', cast(1 + p_partkey % 16 as string),
       ' (', p_type, ') - ', cast(64 * (1 + p_size) as string), ' x ', cast(64 * (1 + p_partkey % 16) as string)) end as dimensions,
  cast(o_custkey % 2048 + 1 as int) as width, cast(o_orderkey % 1536 + 1 as int) as height,
  case o_orderkey % 5 when 0 then 'nearest-exact' when 1 then 'bilinear' when 2 then 'area' when 3 then 'bicubic' else 'lanczos' end as upscale_method,
  case o_orderkey % 8 when 0 then 'stretch' when 1 then 'resize' when 2 then 'pad' when 3 then 'pad_edge' when 4 then 'pad_edge_pixel'
       when 5 then 'crop' when 6 then 'pillarbox_blur' else 'total_pixels' end as keep_proportion,
  case o_custkey % 4 when 0 then '0, 0, 0' when 1 then '255, 128, 0' when 2 then '0.5' else 'red' end as pad_color,
  case o_custkey % 5 when 0 then 'center' when 1 then 'top' when 2 then 'bottom' when 3 then 'left' else 'right' end as crop_position,
  cast(o_orderkey % 1920 + 1 as int) as src_width, cast(o_custkey % 1080 + 1 as int) as src_height,
  o_orderkey % 19 <> 0 as has_image, o_orderkey % 3 = 0 as has_mask,
  cast(case when o_orderkey % 7 = 0 then o_custkey % 1024 else null end as int) as resolution
from (select *, o_orderkey % (select count(*) from part) as _part from orders) o join part on p_partkey = _part""",
    "sources_fx": """
select cast(o_orderkey as string) as video_id, concat('in/', cast(o_orderkey as string), '.mp4') as path,
  o_custkey * 1000 + o_orderkey % 997 as size, o_orderdate as mtime
from orders""",
    "manifest_fx": """
select cast(o_orderkey as string) as video_id, concat('in/', cast(o_orderkey as string), '.mp4') as path,
  o_custkey * 1000 + o_orderkey % 997 + case when o_orderkey % 7 = 0 then 1 else 0 end as size, o_orderdate as mtime,
  cast(case o_orderkey % 3 when 0 then 24.0 when 1 then 25.0 else 30.0 end as double) as fps,
  cast(1920 as int) as width, cast(1080 as int) as height, n as frame_count
from orders join (select l_orderkey, cast(max(l_linenumber) as int) as n from lineitem group by l_orderkey) c on l_orderkey = o_orderkey
where o_orderkey % 11 <> 0""",
    "frames_fx": """
select cast(l_orderkey as string) as video_id, l_linenumber - 1 as frame_idx,
  concat('frame_', cast(l_linenumber as string), '.png') as frame_name, l_shipdate as arrived, l_partkey as payload
from lineitem""",
    "frames_complete_fx": """
select cast(conv_id as string) as video_id, turn as frame_idx,
  concat('frame_', cast(turn + 1 as string), '.png') as frame_name, length(text) as payload
from conversations""",
    "paths_fx": """
select page_id, concat(case when page_id % 4 = 0 then 'ComfyUI/Output/' when page_id % 4 = 1 then 'output/' else '' end,
  'clip', cast(page_id % 7 as string), '/Take_', cast(page_id % 120 as string), case page_id % 6 when 0 then '.mp4' when 1 then '.MOV'
  when 2 then '.txt' when 3 then '.png' when 4 then '.webm' else '' end) as path
from pages""",
    "probe_fx": """
select p_partkey as file_id, 1 as line_no, concat('  Duration: 00:0', cast(p_size % 6 as string), ':1', cast(p_size % 9 as string), '.50, start: 0.0') as line from part
union all select p_partkey, 2, concat('  Stream #0:0: Video: h264 (0x31637661), yuv420p, ', cast(64 * (1 + p_size) as string), 'x', cast(64 * (1 + p_partkey % 16) as string),
  ' [SAR 1:1], ', case when p_size % 5 = 0 then '' when p_size % 5 = 1 then '29.97 tbr' else '25 fps, 30 tbr' end) from part where p_size % 10 <> 9
union all select p_partkey, 3, '  Stream #0:1: Audio: aac' from part""",
    "edges_fx": """
select concat('r', cast(n_regionkey as string)) as src, concat('n', cast(n_nationkey as string)) as dst from nation
union all select concat('n', cast(c_nationkey as string)), concat('c', cast(c_custkey as string)) from customer
union all select concat('c', cast(o_custkey as string)), concat('o', cast(o_orderkey as string)) from orders""",
    # One workflow per order: loop start -> a step per line -> loop end, with suppliers feeding steps from
    # outside the loop and a preview hanging off each step that never reaches the end.
    "graphs_fx": """
select l_orderkey as graph_id, 'start' as src, 1 as src_slot, concat('step', cast(l_linenumber as string), '_', cast(l_partkey as string)) as dst, 'image' as dst_input, 'IMAGE' as link_type from lineitem
union all select l_orderkey, concat('step', cast(l_linenumber as string), '_', cast(l_partkey as string)), 0, concat('part', cast(l_partkey % 3 as string)), 'image', 'IMAGE' from lineitem
union all select l_orderkey, concat('part', cast(l_partkey % 3 as string)), 0, 'end', 'processed_image', 'IMAGE' from lineitem
union all select l_orderkey, concat('supplier', cast(l_suppkey as string)), 0, concat('step', cast(l_linenumber as string), '_', cast(l_partkey as string)), 'model', 'MODEL' from lineitem
union all select l_orderkey, concat('step', cast(l_linenumber as string), '_', cast(l_partkey as string)), 1, concat('preview', cast(l_linenumber as string)), 'image', 'IMAGE' from lineitem
union all select o_orderkey, 'start', 0, 'end', 'flow', 'FLOW_CONTROL' from orders""",
}

# Views that need engine-specific array syntax.
ARRAY_VIEWS: dict[str, tuple[str, str]] = {
    "raster_fx": (
        """select vec_id as image_id, cast(p div 8 as int) as y, cast(p % 8 as int) as x, 0 as c,
  least(1D, greatest(0D, cast(v as double) + 0.5D)) as v
from (select vec_id, posexplode(embedding) as (p, v) from embeddings)""",
        """select vec_id as image_id, cast((p - 1) // 8 as int) as y, cast((p - 1) % 8 as int) as x, 0 as c,
  least(1::double, greatest(0::double, v::double + 0.5::double)) as v
from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as p from embeddings)""",
    ),
    "rgba_fx": (
        """select vec_id as image_id, cast(p div 16 as int) as y, cast((p div 4) % 4 as int) as x, cast(p % 4 as int) as c,
  cast(floor(least(1D, greatest(0D, cast(v as double) + 0.5D)) * 255) as int) as v
from (select vec_id, posexplode(embedding) as (p, v) from embeddings)""",
        """select vec_id as image_id, cast((p - 1) // 16 as int) as y, cast(((p - 1) // 4) % 4 as int) as x, cast((p - 1) % 4 as int) as c,
  cast(floor(least(1::double, greatest(0::double, v::double + 0.5::double)) * 255) as int) as v
from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as p from embeddings)""",
    ),
}

# Views over views, same text in both engines.
LAYERED: dict[str, tuple[str, tuple[str, ...]]] = {
    "mask_fx": ("select image_id, y, x, v as m from raster_fx where image_id % 3 = 0", ("raster_fx",)),
    # Small pictures with every method, mode and anchor, both growing and shrinking.
    "sizes_fx": (
        """
select vec_id as image_id, 8 as src_width, 8 as src_height,
  cast(3 + vec_id % 11 as int) as target_w, cast(3 + (vec_id * 7) % 10 as int) as target_h,
  case vec_id % 5 when 0 then 'nearest-exact' when 1 then 'bilinear' when 2 then 'area' when 3 then 'bicubic' else 'lanczos' end as upscale_method,
  case vec_id % 8 when 0 then 'stretch' when 1 then 'resize' when 2 then 'pad' when 3 then 'pad_edge' when 4 then 'pad_edge_pixel'
       when 5 then 'crop' when 6 then 'pillarbox_blur' else 'total_pixels' end as keep_proportion,
  case vec_id % 3 when 0 then '0, 0, 0' when 1 then '255, 128, 0' else '0.5' end as pad_color,
  case vec_id % 7 when 0 then 'top' when 1 then 'bottom' when 2 then 'left' when 3 then 'right' else 'center' end as crop_position
from embeddings""",
        (),
    ),
    # A catalogue and requests of thumbnail size, for runs that really resample pixels.
    "thumb_presets_fx": (
        """
select model, model_ord, resolution, res_ord, item_ord, ratio, label,
  cast(1 + width / 64 % 13 as int) as width, cast(1 + height / 64 % 11 as int) as height
from presets_fx""",
        ("presets_fx",),
    ),
    "thumb_requests_fx": (
        """
select vec_id as image_id, r.model, r.resolution_preset, r.selection_mode, r.dimensions,
  cast(1 + r.width % 14 as int) as width, cast(1 + r.height % 12 as int) as height,
  s.upscale_method, s.keep_proportion, s.pad_color, s.crop_position,
  cast(8 as int) as src_width, cast(8 as int) as src_height, true as has_image, vec_id % 3 = 0 as has_mask,
  cast(case when vec_id % 6 = 0 then 1 + vec_id % 15 else null end as int) as resolution
from embeddings join requests_fx r on r.image_id = vec_id join sizes_fx s on s.image_id = vec_id""",
        ("requests_fx", "sizes_fx"),
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a derived view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ARRAY_VIEWS:
        text = ARRAY_VIEWS[name][0]
    else:
        text = LAYERED[name][0] if name in LAYERED else VIEWS[name]
    for needed in _needed(name):
        view(spark, sf_dir, needed).createOrReplaceTempView(needed)
    return spark.sql(text)


def _needed(name: str) -> list[str]:
    text = ARRAY_VIEWS[name][0] if name in ARRAY_VIEWS else LAYERED[name][0] if name in LAYERED else VIEWS[name]
    words = set(text.replace("(", " ").replace(")", " ").replace("\n", " ").split())
    known = set(TABLES) | set(VIEWS) | set(ARRAY_VIEWS) | set(LAYERED)
    return sorted(words & known)


def with_views(query: str, *names: str) -> str:
    """Put the named views in front of a check query as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for needed in _needed(name):
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return query.strip()
    bodies = []
    for name in ordered:
        text = ARRAY_VIEWS[name][1] if name in ARRAY_VIEWS else LAYERED[name][0] if name in LAYERED else VIEWS[name]
        bodies.append(f"{name} as ({text})")
    head = "with recursive " + ",\n".join(bodies)
    query = query.strip()
    if query.lower().startswith("with "):
        return f"{head},\n{query[5:]}"
    return f"{head}\n{query}"
