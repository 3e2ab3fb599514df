"""Catalogue and planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numbers import actual_ratio
from ..functions.text import dimension_text, parse_color, resolution_output
from ..operators import catalogue as C
from ..operators import planning as P
from ..session import scratch_path
from ..sources import presets as S
from .registry import Tables, query

LABEL = "ratio || ' (' || label || ') - ' || width || ' x ' || height"
K_TEXT = (
    "case when upper({0}) like '%K' and try_cast({0}[:-2] as double) is not null "
    "then cast(cast(round_even(try_cast({0}[:-2] as double) * 1024, 0) as bigint) as varchar) else {0} end"
)

# Request resolution step by step: model, resolution, label, nearest item, target size.
RESOLVE = f"""
with items as (select *, {LABEL} as dim from {{presets}}),
models as (select model, min(model_ord) as mo from items group by model),
resolutions as (select model, resolution, min(res_ord) as ro, min(item_ord) as io from items group by model, resolution),
labels_by as (select model, resolution, dim, min(item_ord) as io from items group by model, resolution, dim),
first_res as (select model, arg_min(resolution, ro) as fr from resolutions group by model),
r1 as (select r.*, coalesce(m.model, (select arg_min(model, mo) from models)) as cm from {{requests}} r left join models m on m.model = r.model),
r2 as (select r1.*, coalesce(s.resolution, f.fr) as cr from r1 left join resolutions s on s.model = cm and s.resolution = r1.resolution_preset
       join first_res f on f.model = cm),
r3 as (select r2.*, coalesce(l.io, s.io) as chosen_io from r2 join resolutions s on s.model = cm and s.resolution = cr
       left join labels_by l on l.model = cm and l.resolution = cr and l.dim = r2.dimensions),
ranked as (select r3.image_id, i.item_ord, row_number() over (partition by r3.image_id order by
       greatest(src_width::bigint * i.height, greatest(1, src_height)::bigint * i.width)::double
       / least(src_width::bigint * i.height, greatest(1, src_height)::bigint * i.width)::double, i.item_ord) as rn
       from r3 join items i on i.model = cm and i.resolution = cr),
near as (select image_id, item_ord as near_io from ranked where rn = 1),
sel as (select r3.*, near_io, case when selection_mode = 'automatic' then near_io else chosen_io end as sel_io from r3 join near using (image_id)),
targets as (select sel.*, i.width as iw, i.height as ih,
  case when sel.resolution > 0 then case when i.width >= i.height then sel.resolution else greatest(1, round_even(sel.resolution::bigint * i.width / i.height, 0)) end
       when selection_mode = 'automatic' then i.width else greatest(1, sel.width) end::int as target_w,
  case when sel.resolution > 0 then case when i.width >= i.height then greatest(1, round_even(sel.resolution::bigint * i.height / i.width, 0)) else sel.resolution end
       when selection_mode = 'automatic' then i.height else greatest(1, sel.height) end::int as target_h,
  case when sel.resolution > 0 then sel.resolution::varchar else {K_TEXT.format('cr')} end as resolution_text
  from sel join items i on i.item_ord = sel_io)
"""

# Geometry of requests that know their target: crop box, resampled size, borders, output.
GEOMETRY = """
g1 as (select t.*, src_width::double / src_height::double as sr, target_w::double / target_h::double as tr,
  least(target_w::double / src_width::double, target_h::double / src_height::double) as fit,
  target_w::bigint * target_h::bigint as px,
  keep_proportion not in ('stretch', 'resize', 'crop', 'total_pixels') as padded from {targets} t),
g2 as (select *,
  case when keep_proportion in ('stretch', 'crop') then target_w when keep_proportion = 'total_pixels' then greatest(1, round_even(sqrt(px * sr), 0))
       else greatest(1, round_even(src_width * fit, 0)) end::int as resized_w,
  case when keep_proportion in ('stretch', 'crop') then target_h when keep_proportion = 'total_pixels' then greatest(1, round_even(sqrt(px / sr), 0))
       else greatest(1, round_even(src_height * fit, 0)) end::int as resized_h,
  case when keep_proportion = 'crop' and sr > tr then greatest(1, round_even(src_height * tr, 0)) else src_width end::int as crop_w,
  case when keep_proportion = 'crop' and not sr > tr then greatest(1, round_even(src_width / tr, 0)) else src_height end::int as crop_h from g1),
g3 as (select *, case when padded then greatest(0, target_w - resized_w) else 0 end as ew, case when padded then greatest(0, target_h - resized_h) else 0 end as eh,
  case crop_position when 'left' then 0 when 'right' then src_width - crop_w else (src_width - crop_w) // 2 end as crop_x,
  case crop_position when 'top' then 0 when 'bottom' then src_height - crop_h else (src_height - crop_h) // 2 end as crop_y from g2),
geo as (select *, case crop_position when 'left' then 0 when 'right' then ew else ew // 2 end as pad_left,
  case crop_position when 'top' then 0 when 'bottom' then eh else eh // 2 end as pad_top,
  case when padded then target_w else resized_w end as out_w, case when padded then target_h else resized_h end as out_h from g3)
"""

RESOLVE_FX = RESOLVE.format(presets="presets_fx", requests="requests_fx")
GEOMETRY_FX = GEOMETRY.format(targets="targets")
FX = "presets_fx requests_fx"


def _documents(t: Tables):
    """One catalogue document per part: two models, resolutions out of alphabetical order."""
    item = lambda w, h: F.struct(
        F.concat_ws(":", w.cast("string"), h.cast("string")).alias("ratio"), F.col("p_type").alias("label"),
        (w * 64).cast("int").alias("width"), (h * 64).cast("int").alias("height"),
    )
    a, b = F.col("p_size") % 16 + 1, (F.col("p_partkey") % 16 + 1).cast("int")
    first = F.create_map(F.lit("2K"), F.array(item(a, b), item(b, a)), F.lit("1024"), F.array(item(a, a)))
    second = F.create_map(F.lit("1.5K"), F.array(item(b, b)))
    document = F.to_json(F.create_map(F.col("p_brand"), first, F.col("p_name"), second))
    return t.part.select("p_partkey", document.alias("document"))


DOCUMENT_ROWS = """
with p as (select p_partkey, p_brand, p_name, p_type, (p_size % 16 + 1)::int as a, (p_partkey % 16 + 1)::int as b from part),
rows as (
  select p_partkey, p_brand as model, 0 as model_ord, '2K' as resolution, 0 as res_ord, 0 as item_ord, a as w, b as h, p_type from p
  union all select p_partkey, p_brand, 0, '2K', 0, 1, b, a, p_type from p
  union all select p_partkey, p_brand, 0, '1024', 1, 0, a, a, p_type from p
  union all select p_partkey, p_name, 1, '1.5K', 0, 0, b, b, p_type from p)
select {columns} model, model_ord, resolution, res_ord, item_ord, w || ':' || h as ratio, p_type as label,
  (w * 64)::int as width, (h * 64)::int as height from rows
"""


@query("src1_preset_catalogue_scan", DOCUMENT_ROWS.format(columns=""))
def _(t):
    path = scratch_path(t.spark, "catalogue")
    _documents(t).select("document").write.text(path)
    return S.read_presets(t.spark, path, one_document_per_line=True)


@query("jsn1_nested_map_flattening", DOCUMENT_ROWS.format(columns="p_partkey,"))
def _(t):
    return S.flatten_presets(_documents(t), "document", keep=["p_partkey"])


@query("agg1_distinct_resolutions", """
select resolution, min((model_ord, res_ord))[1] as model_ord, min((model_ord, res_ord))[2] as res_ord from presets_fx group by resolution""",
       "presets_fx")
def _(t):
    return C.distinct_resolutions(t.presets_fx)


@query("agg2_distinct_dimensions", f"""
select dimensions, model_ord, res_ord, item_ord from (select {LABEL} as dimensions, *, row_number() over (partition by {LABEL}
  order by model_ord, res_ord, item_ord) as rn from presets_fx) where rn = 1""", "presets_fx")
def _(t):
    return C.distinct_dimensions(t.presets_fx)


@query("set1_distinct_union", f"""
select 'model' as kind, model as choice from presets_fx union select 'resolution', resolution from presets_fx
union select 'dimensions', {LABEL} from presets_fx""", "presets_fx")
def _(t):
    return C.all_choices(t.presets_fx)


@query("lim2_first_or_default", """
with r as (select model, resolution, min(res_ord) as ro, min(item_ord) as io from presets_fx group by model, resolution),
f as (select *, row_number() over (partition by model order by ro, resolution) as rn from r)
select f.model, f.resolution as first_resolution, p.width as first_width, p.height as first_height, p.ratio as first_ratio
from f join presets_fx p on p.item_ord = f.io where rn = 1""", "presets_fx")
def _(t):
    return C.first_choices(t.presets_fx).select(
        "model", F.col("first.resolution").alias("first_resolution"), F.col("first.item.width").alias("first_width"),
        F.col("first.item.height").alias("first_height"), F.col("first.item.ratio").alias("first_ratio"),
    )


@query("flt6_dependent_choices", f"""
select model, resolution, {LABEL} as choice, item_ord as pos from presets_fx where resolution = '1.5K'
union all select model, 'any', resolution, min(res_ord) from presets_fx group by model, resolution""", "presets_fx")
def _(t):
    labels = C.choices(t.presets_fx, resolution="1.5K").withColumn("resolution", F.lit("1.5K"))
    resolutions = C.choices(t.presets_fx).withColumn("resolution", F.lit("any"))
    return labels.unionByName(resolutions).select("model", "resolution", "choice", F.col("pos").cast("bigint").alias("pos"))


@query("flt6_kept_choices", RESOLVE_FX + """
select r3.image_id, r3.model = cm as model_kept, r3.resolution_preset = cr as resolution_kept, i.dim = r3.dimensions as dimensions_kept,
  i.dim as dimensions_shown from r3 join items i on i.item_ord = chosen_io""", FX)
def _(t):
    found = C.lookup_preset(t.requests_fx, t.presets_fx)
    return found.select(
        "image_id", (F.col("model") == F.col("chosen_model")).alias("model_kept"),
        (F.col("resolution_preset") == F.col("chosen_resolution")).alias("resolution_kept"),
        (F.col("dimensions") == F.col("chosen.dimensions")).alias("dimensions_kept"),
        F.col("chosen.dimensions").alias("dimensions_shown"),
    )


@query("prj1_dimension_label", f"select item_ord, {LABEL} as dimensions from presets_fx", "presets_fx")
def _(t):
    c = F.col
    return t.presets_fx.select("item_ord", dimension_text(c("ratio"), c("label"), c("width"), c("height")).alias("dimensions"))


@query("prj2_numeric_resolution", f"""
with r as (select o_orderkey, case o_orderkey % 6 when 0 then resolution_preset when 1 then (o_custkey / 8.0)::double || 'k'
  when 2 then o_custkey || 'K' when 3 then 'x' || o_custkey || 'K' when 4 then o_custkey || '' else 'K' end as resolution
  from orders join requests_fx on image_id = o_orderkey)
select o_orderkey, resolution, case when resolution = 'K' then 'K' else {K_TEXT.format('resolution')} end as resolution_text from r""",
       "requests_fx")
def _(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = (
        F.when(key % 6 == 0, F.col("resolution_preset")).when(key % 6 == 1, F.concat((cust / 8.0).cast("string"), F.lit("k")))
        .when(key % 6 == 2, F.concat(cust.cast("string"), F.lit("K")))
        .when(key % 6 == 3, F.concat(F.lit("x"), cust.cast("string"), F.lit("K")))
        .when(key % 6 == 4, cust.cast("string")).otherwise("K")
    )
    rows = t.orders.join(t.requests_fx.select("image_id", "resolution_preset"), key == F.col("image_id"))
    return rows.select("o_orderkey", text.alias("resolution")).withColumn(
        "resolution_text", resolution_output(F.col("resolution"))
    )


@query("prj3_reduced_ratio", """
select image_id, (width // gcd(width, height)) || ':' || (height // gcd(width, height)) as aspect_ratio from requests_fx""",
       "requests_fx")
def _(t):
    return t.requests_fx.select("image_id", actual_ratio(F.col("width"), F.col("height")).alias("aspect_ratio"))


@query("prj4_longer_side", """
with r as (select image_id, width, height, greatest(1, (src_width - 5)::int) as l from requests_fx)
select image_id, case when width >= height then l else greatest(1, round_even(l::bigint * width / height, 0)) end::int as w,
  case when width >= height then greatest(1, round_even(l::bigint * height / width, 0)) else l end::int as h from r""", "requests_fx")
def _(t):
    size = G.longer_side(F.col("width"), F.col("height"), F.col("src_width") - 5)
    return t.requests_fx.select("image_id", size.alias("s")).select("image_id", "s.w", "s.h")


@query("prj5_target_selection", RESOLVE_FX + "select image_id, target_w, target_h, resolution_text from targets", FX)
def _(t):
    return P.select_targets(t.requests_fx, t.presets_fx).select("image_id", "target_w", "target_h", "resolution_text")


@query("prj6_crop_box", "with t as (select *, width as target_w, height as target_h from (select * replace ('crop' as keep_proportion) from requests_fx)),"
       + GEOMETRY.format(targets="t") + "select image_id, crop_x as x, crop_y as y, crop_w as w, crop_h as h from geo", "requests_fx")
def _(t):
    c = F.col
    box = G.crop_box(c("src_width"), c("src_height"), c("width").cast("double") / c("height"), c("crop_position"))
    return t.requests_fx.select("image_id", box.alias("b")).select("image_id", "b.x", "b.y", "b.w", "b.h")


@query("prj7_padding", """
with e as (select image_id, crop_position as p, greatest(0, width - src_width) as ew, greatest(0, height - src_height) as eh from requests_fx),
l as (select *, case p when 'left' then 0 when 'right' then ew else ew // 2 end as l, case p when 'top' then 0 when 'bottom' then eh else eh // 2 end as t from e)
select image_id, l::int as "left", (ew - l)::int as "right", t::int as top, (eh - t)::int as bottom from l""", "requests_fx")
def _(t):
    c = F.col
    pads = G.padding(c("width"), c("height"), c("src_width"), c("src_height"), c("crop_position"))
    return t.requests_fx.select("image_id", pads.alias("p")).select("image_id", "p.left", "p.right", "p.top", "p.bottom")


@query("prj8_fit_size", """
select image_id, greatest(1, round_even(src_width * least(width / src_width, height / src_height), 0))::int as w,
  greatest(1, round_even(src_height * least(width / src_width, height / src_height), 0))::int as h from requests_fx""", "requests_fx")
def _(t):
    c = F.col
    size = G.fit_size(c("width"), c("height"), c("src_width"), c("src_height"))
    return t.requests_fx.select("image_id", size.alias("s")).select("image_id", "s.w", "s.h")


@query("prj9_equal_area_size", """
select image_id, greatest(1, round_even(sqrt(width::bigint * height * (src_width / src_height)), 0))::int as w,
  greatest(1, round_even(sqrt(width::bigint * height / (src_width / src_height)), 0))::int as h from requests_fx""", "requests_fx")
def _(t):
    c = F.col
    size = G.equal_area_size(c("width"), c("height"), c("src_width"), c("src_height"))
    return t.requests_fx.select("image_id", size.alias("s")).select("image_id", "s.w", "s.h")


@query("prj10_cover_size", """
with s as (select image_id, width, height, greatest(1, round_even(src_width * greatest(width / src_width, height / src_height), 0))::int as w,
  greatest(1, round_even(src_height * greatest(width / src_width, height / src_height), 0))::int as h from requests_fx)
select image_id, w, h, (greatest(0, w - width) // 2)::int as x, (greatest(0, h - height) // 2)::int as y from s""", "requests_fx")
def _(t):
    c = F.col
    size = G.cover_size(c("width"), c("height"), c("src_width"), c("src_height"))
    return t.requests_fx.select("image_id", size.alias("s")).select("image_id", "s.w", "s.h", "s.x", "s.y")


def flat_plan(plan):
    return plan.select(
        "image_id", "target_w", "target_h", "resized_w", "resized_h", F.col("crop.x").alias("crop_x"),
        F.col("crop.y").alias("crop_y"), F.col("crop.w").alias("crop_w"), F.col("crop.h").alias("crop_h"),
        F.col("pad.left").alias("pad_left"), F.col("pad.right").alias("pad_right"), F.col("pad.top").alias("pad_top"),
        F.col("pad.bottom").alias("pad_bottom"), "out_w", "out_h", "aspect_ratio", "resolution_text",
    )


@query("prj11_resize_plan", RESOLVE_FX + "," + GEOMETRY_FX + """
select image_id, target_w, target_h, resized_w, resized_h,
  case when keep_proportion = 'crop' then crop_x else 0 end as crop_x, case when keep_proportion = 'crop' then crop_y else 0 end as crop_y,
  crop_w, crop_h, pad_left, ew - pad_left as pad_right, pad_top, eh - pad_top as pad_bottom, out_w, out_h,
  (out_w // gcd(out_w, out_h)) || ':' || (out_h // gcd(out_w, out_h)) as aspect_ratio, resolution_text from geo""", FX)
def resize_plan(t):
    return flat_plan(P.plan_resize(t.requests_fx, t.presets_fx))


@query("prj12_colour_list", """
with r as (select image_id, (1 + image_id % 4)::int as n, case image_id % 6 when 0 then pad_color when 1 then '0.25, , 0.75' when 2 then width || ',' || height
  when 3 then '' when 4 then '0.5, 200' else '1, x' end as pad_color from requests_fx),
p as (select *, list_transform(list_filter(string_split(pad_color, ','), lambda v: trim(v) <> ''), lambda v: try_cast(trim(v) as double)) as parsed from r),
v as (select *, case when len(parsed) = 0 or list_contains(list_transform(parsed, lambda v: v is null), true) then [0.0::double, 0.0::double, 0.0::double] else parsed end as vals from p),
s as (select *, list_transform(vals, lambda v: v / case when list_max(vals) > 1.0 then 255.0::double else 1.0::double end) as scaled from v)
select image_id, n as channels, i::int as c, round(least(1.0::double, greatest(0.0::double, scaled[least(i + 1, len(scaled))])), 9) as value
from s, unnest(generate_series(0, n - 1)) as u(i)""", "requests_fx")
def _(t):
    key = F.col("image_id")
    text = (
        F.when(key % 6 == 0, F.col("pad_color")).when(key % 6 == 1, "0.25, , 0.75")
        .when(key % 6 == 2, F.concat_ws(",", "width", "height")).when(key % 6 == 3, "").when(key % 6 == 4, "0.5, 200")
        .otherwise("1, x")
    )
    rows = t.requests_fx.select("image_id", (1 + key % 4).cast("int").alias("channels"), text.alias("pad_color"))
    color = F.posexplode(parse_color(F.col("pad_color"), F.col("channels"))).alias("c", "value")
    return rows.select("image_id", "channels", color).withColumn("value", F.round("value", 9))


@query("join1_preset_lookup", RESOLVE_FX + f"""
select image_id, cm as chosen_model, cr as chosen_resolution, i.width as preset_width, i.height as preset_height, i.ratio as preset_ratio,
  {K_TEXT.format('cr')} as resolution_text from r3 join items i on i.item_ord = chosen_io""", FX)
def _(t):
    return C.lookup_preset(t.requests_fx, t.presets_fx).select(
        "image_id", "chosen_model", "chosen_resolution", F.col("chosen.width").alias("preset_width"),
        F.col("chosen.height").alias("preset_height"), F.col("chosen.ratio").alias("preset_ratio"), "resolution_text",
    )


@query("join2_nearest_ratio", RESOLVE_FX + """
select image_id, near_io as item_ord, i.width as preset_width, i.height as preset_height from sel join items i on i.item_ord = near_io""", FX)
def _(t):
    found = C.closest_preset(C.lookup_preset(t.requests_fx, t.presets_fx), t.presets_fx)
    return found.select(
        "image_id", "nearest.item_ord", F.col("nearest.width").alias("preset_width"), F.col("nearest.height").alias("preset_height")
    )


@query("agg8_argmin_stable_tie", """
with d as (select p_brand, p_partkey, p_size, row_number() over (partition by p_brand order by abs(ln((p_size + 1) / 25.0::double)), p_partkey) as rn from part)
select p_brand, p_partkey as first_part, p_size as first_size from d where rn = 1""")
def _(t):
    distance = F.abs(F.log((F.col("p_size") + 1) / F.lit(25.0)))
    best = F.min(F.struct(distance.alias("d"), "p_partkey", "p_size")).alias("best")
    return t.part.groupBy("p_brand").agg(best).select(
        "p_brand", F.col("best.p_partkey").alias("first_part"), F.col("best.p_size").alias("first_size")
    )


@query("flt2_request_validation", """
select image_id, case when not has_image and not has_mask then 'no image and no mask' else '' end as errors from requests_fx""",
       "requests_fx")
def _(t):
    return P.check_requests(t.requests_fx).select("image_id", F.array_join("errors", "; ").alias("errors"))


@query("udf2_request_options", """
select image_id, upscale_method in ('nearest-exact', 'bilinear', 'area', 'bicubic', 'lanczos') as known_method,
  m in ('stretch', 'resize', 'pad', 'pad_edge', 'pad_edge_pixel', 'crop', 'pillarbox_blur', 'total_pixels') as known_mode,
  crop_position in ('center', 'top', 'bottom', 'left', 'right') as known_position, width between 1 and 16384 and height between 1 and 16384 as size_in_range,
  case when m = 'tile' then 'pad' else m end as acts_as_mode, crop_position as acts_as_position
from (select *, case when image_id % 10 = 0 then 'tile' else keep_proportion end as m from requests_fx)""", "requests_fx")
def _(t):
    mode = F.when(F.col("image_id") % 10 == 0, "tile").otherwise(F.col("keep_proportion"))
    return P.option_report(t.requests_fx.withColumn("keep_proportion", mode))
