"""Labels, colours, names and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DEFAULT_FPS, DEFAULT_VIDEO_NAME, FRAME_NAME_FORMAT, OUTPUT_ROOTS
from .numbers import half_even, let, parse_float


def dimension_text(ratio: Column, label: Column, width: Column, height: Column) -> Column:
    """``16:9 (Wide) - 1920 x 1080``"""
    return F.concat(
        ratio, F.lit(" ("), label, F.lit(") - "), width.cast("string"), F.lit(" x "), height.cast("string")
    )


def resolution_output(resolution: Column) -> Column:
    """``1.5K`` as ``1536``; text without a numeric K size stays as it is."""
    number = parse_float(F.regexp_extract(resolution, r"(?s)^(.*)[kK]$", 1))
    # Beyond 2 ** 53 every double is whole; its digits come from the decimal form.
    whole = F.when(F.abs(number) < 1e15, half_even(number * 1024).cast("string")).otherwise(
        F.coalesce((number * 1024).try_cast("decimal(38,0)").cast("string"), F.format_string("%.0f", number * 1024)))
    pixels = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), whole)
    return F.coalesce(F.when(F.upper(resolution).endswith("K"), pixels), resolution)


def parse_color(text: Column, channels: Column | int) -> Column:
    """Comma list to ``channels`` values in 0..1; unreadable lists are black, 0..255 lists are scaled."""
    channels = F.lit(channels) if isinstance(channels, int) else channels
    parts = F.filter(F.split(text, ",", -1), lambda p: strip(p) != "")
    black = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def readable(parsed: Column) -> Column:
        return F.when((F.size(parsed) > 0) & ~F.exists(parsed, lambda v: v.isNull()), parsed).otherwise(black)

    def divisor(values: Column) -> Column:
        # A NaN never wins or loses a comparison, so it only stays on top when it came first.
        top = F.aggregate(
            values, values[0], lambda m, v: F.when(~F.isnan(m) & ~F.isnan(v) & (v > m), v).otherwise(m),
            lambda m: F.when(~F.isnan(m) & (m > 1.0), F.lit(255.0)).otherwise(F.lit(1.0)),
        )
        return F.struct(values.alias("values"), top.alias("divisor"))

    def channel(color: Column, i: Column) -> Column:
        # The last value stands in for channels that have none.
        value = F.get(color["values"], F.least(i, F.size(color["values"]) - 1)) / color["divisor"]
        return F.when(F.isnan(value), value).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))

    color = let(let(F.transform(parts, parse_float), readable), divisor)
    return let(color, lambda known: F.transform(F.sequence(F.lit(0), channels - 1), lambda i: channel(known, i)))


def _rate(text: Column) -> Column:
    fraction = r"^\s*([+-]?\d+)/(\d+)\s*$"
    quotient = F.try_divide(
        F.regexp_extract(text, fraction, 1).try_cast("double"),
        F.regexp_extract(text, fraction, 2).try_cast("double"),
    )
    return F.when(text.rlike(fraction), quotient).otherwise(parse_float(text))


def usable_rate(rate: Column) -> Column:
    """The rate itself if finite and positive, else the default."""
    finite = ~F.isnan(rate) & (rate > 0) & (rate < float("inf"))
    return F.when(finite, rate).otherwise(F.lit(DEFAULT_FPS))


def frame_rate(average: Column, real: Column) -> Column:
    """Frames per second from the first non-empty text; the second is not a retry of an unreadable first."""
    empty = F.lit("")
    return usable_rate(_rate(F.coalesce(F.nullif(average, empty), F.nullif(real, empty), F.lit("24/1"))))


def frame_name(number: Column) -> Column:
    return F.format_string(FRAME_NAME_FORMAT, number.cast("int"))


def suffix(name: Column) -> Column:
    """Last extension with its dot, lower case; a leading dot starts a name, not an extension."""
    return F.lower(F.regexp_extract(base_name(name), r"^.+(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    base = base_name(name)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(base)


def base_name(path: Column) -> Column:
    """Last path component; trailing slashes and ``.`` components do not count."""
    return F.regexp_extract(path, r"([^/]*?)(?:/+\.?(?=/|$))*$", 1)


def frame_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)\.[^.]*$", 1).try_cast("bigint")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def unquote(path: Column) -> Column:
    return F.regexp_replace(strip(path), r'^"+|"+$', "")


def fold_parents(parts: Column) -> Column:
    """Path components with ``..`` taken up; what climbs above the beginning keeps its ``..``."""
    def step(done, part):
        last = F.try_element_at(done, F.lit(-1))
        climbs = (part == "..") & last.isNotNull() & (last != "..")
        return F.when(climbs, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def relative_folder(path: Column, root: str | None) -> Column:
    """An absolute path at or below ``root`` as the relative one it stands for; others as they are."""
    if root is None:
        return path
    root = root.rstrip("/")
    return F.when(path == root, F.lit("")).when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


def clean_path(path: Column, roots: list[str] = OUTPUT_ROOTS) -> Column:
    """Trimmed path without quotes, empty components and a leading output-root name; null when blank."""
    text = unquote(path)
    parts = fold_parents(F.filter(F.split(text, "/"), lambda p: (p != "") & (p != ".")))
    absolute = text.startswith("/")
    cut = F.lit(0)
    for root in sorted(roots, key=len):
        names = root.split("/")
        head = F.lower(F.array_join(F.slice(parts, 1, len(names)), "/"))
        cut = F.when(head == root, F.lit(len(names))).otherwise(cut)
    kept = F.array_join(F.slice(parts, cut + 1, F.greatest(F.lit(0), F.size(parts) - cut)), "/")
    return F.when(text == "", F.lit(None)).when(
        absolute, F.concat(F.lit("/"), F.array_join(parts, "/"))
    ).otherwise(kept)


def safe_output_name(name: Column) -> Column:
    """Base name with an ``.mp4`` suffix; blank names get the default."""
    base = base_name(strip(name))
    base = F.when(base.isin("", "."), F.lit(DEFAULT_VIDEO_NAME)).otherwise(base)
    return F.when(suffix(base) == ".mp4", base).otherwise(F.concat(stem(base), F.lit(".mp4")))


def relative_to(path: Column, root: Column | str) -> Column:
    """File name and folder below ``root``; null outside it."""
    root = F.lit(root) if isinstance(root, str) else root
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    rest = F.substring(path, F.length(prefix) + 1, F.length(path))
    folder = F.regexp_extract(rest, r"^(.*)/[^/]+$", 1)
    return F.when(
        path.startswith(prefix),
        F.struct(F.substring_index(rest, "/", -1).alias("filename"), folder.alias("subfolder")),
    )


def _digits(run: Column) -> Column:
    """Without leading zeros; numbers then compare by length, then as text, however long they are."""
    return F.regexp_replace(run, "^0+(?=.)", "")


def natural_key(name: Column) -> Column:
    """Sort key: digit runs as numbers, other runs in lower case, always starting with a text piece."""
    runs = F.split(F.lower(name), r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    runs = F.when(name.rlike(r"^\d"), F.concat(F.array(F.lit("")), runs)).otherwise(runs)
    return F.transform(
        runs,
        lambda r: F.struct(
            F.when(r.rlike(r"^[0-9]+$"), F.length(_digits(r))).alias("digits"),
            F.when(r.rlike(r"^[0-9]+$"), _digits(r)).otherwise(r).alias("text"),
        ),
    )
