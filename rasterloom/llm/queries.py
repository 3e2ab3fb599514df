"""The operators over their whole tables, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, decontaminate, exact_dedup, hard_negatives, language, line_dedup, quality, secrets, sentencepieces, simhash, substring_dedup,
    toxicity, url_filter)
from .common import table

#: The rules of the URL query, as (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.printed(F.col("base")), 256).alias("base_sha256"), secrets.printed(F.col("spans")).alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark windows that stand in a document exactly or nearly, with the items that own them."""
    found = decontaminate.proximity(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_near", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.mark_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are the sources; a source's texts in one language are its sections, as under ``/en/``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").where(~quality.held_out()).select("doc_id", "quality")
    judged = quality.judge(docs, quality.train(docs.where(~quality.held_out()), labels), path=F.col("lang"))
    return judged.select(
        "doc_id", quality.held_out().alias("held_out"), "host", "path", "host_mean", "path_mean", "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out()).select("doc_id", "toxic")
    model = toxicity.train(docs.where(~toxicity.held_out()), labels)
    found = toxicity.score_texts(docs, model, ["doc_id"])
    return found.select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(
        table(spark, sf_dir, "documents").select("doc_id", "text"), result=lambda kept: F.sha2(kept, 256)
    ).withColumnRenamed("kept", "kept_sha256")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``round_trip``: the ids give back the text (with U+2581 read as a space)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "decoded_sha256", "round_trip")


def encoded(docs: DataFrame) -> DataFrame:
    """``doc_id, ids, decoded_sha256, round_trip`` of each document."""
    docs = docs.withColumn("_plain", F.xxhash64(F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepieces.SPACE), F.lit(" "))))
    found = sentencepieces.encode_texts(docs, sentencepieces.read_vocabulary(), ["doc_id", "_plain"])
    return found.select(
        "doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.xxhash64("decoded") == F.col("_plain")).alias("round_trip"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; a seventh of the rows gets the next label first, as label noise."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("label"),
        F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(
            F.floor(F.lit(256.0) * x.cast("double")).cast("double"))).alias("v"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, groups=lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256)))
    return found.rows.withColumnRenamed("groups", "groups_sha256")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs, result=lambda kept: F.sha2(kept, 256)).withColumnRenamed("kept", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_secret_scan, op3_decontamination, op3_proximity, op4_simhash, op5_exact_dedup, op6_quality,
        op7_language_id, op8_toxicity, op9_substring_dedup, op10_sentencepiece, op11_hard_negatives, op12_token_alignment, op13_line_dedup)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_url_filter": r"""
with rest as (
  select page_id, case when position('://' in url) > 0 then substring(url, position('://' in url) + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
ruled as (
  select *, case
    when (host = 'www.example.com' or suffix(host, '.www.example.com')) and prefix(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/en/') then 'example.com/en/'
    when (host = 'net' or suffix(host, '.net')) and prefix(path, '/es/') then 'net/es/'
    when (host = 'net' or suffix(host, '.net')) and prefix(path, '/fr/') then 'net/fr/'
    when (host = 'com' or suffix(host, '.com')) and prefix(path, '/') then 'com/' end as rule from parts)
select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict
from ruled
""",
    "op3_decontamination": rf"""
with items as (select item_id, {_WORDS} as w from benchmark),
starts as (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from items where len(w) > 0),
windows as (select item_id, array_to_string(w[i:i + 12], ' ') as g, least(13, len(w)) as size from starts),
docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
sizes as (select distinct size from windows),
grams as (
  select r, i, size, array_to_string(w[i:i + size - 1], ' ') as g
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, sizes where len(w) >= size)),
found as (select distinct r, i, g.size, g.g from grams g semi join windows w on g.g = w.g and g.size = w.size),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + size)) as p from found) group by r),
owned as (select r, list_sort(list(distinct cast(item_id as varchar))) as items from found join windows using (g) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(len(items), 0) as bigint) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit using (r) left join owned using (r)
""",
    "op5_exact_dedup": r"""
with hashed as (
  select doc_id, length(coalesce(text, '')) as chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents),
best as (
  select text_sha256, count(*) as group_size, first(doc_id order by chars desc, doc_id) as keep_id from hashed group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from hashed join best using (text_sha256)
""",
    "op9_substring_dedup": r"""
with docs as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
windows as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as g
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from docs where len(w) >= 50)),
first as (select g, min(doc_id) as lo from windows group by g having min(doc_id) < max(doc_id)),
gone as (
  select doc_id, list(distinct p) as ps
  from (select doc_id, unnest(range(i, i + 50)) as p from windows join first using (g) where lo < doc_id) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(case when ps is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end, ' '), '')) as kept_sha256
from docs left join gone using (doc_id)
""",
    "op11_hard_negatives": """
with sound as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as int) as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label as own, r.vec_id, r.label, cast(list_inner_product(a.v, r.v) as bigint) as score
  from sound a join sound r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where label = own
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from scored join positives using (anchor_id)
where label <> own and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10
""",
    "op13_line_dedup": r"""
with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
keyed as (
  select r, doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos,
    translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from docs),
often as (select k from keyed where k <> '' group by k having count(distinct r) >= 10),
marked as (select r, doc_id, line, pos, k in (select k from often) as gone from keyed)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by r, doc_id
""",
}
