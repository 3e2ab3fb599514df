"""URL rules by a sorted sweep over reversed-host keys.

A rule (host, path) fits its host and all subdomains when the URL's path starts with the rule's. The canonical key of
a host and path is the host's labels in reverse, ``#``, and the path, so everything a rule covers at one host is the
interval of keys that start with the rule's key. A URL is looked up once per parent domain of its host. Keys and rules
of a domain are sorted together; the sweep carries the stack of nested rules that were open at the latest rule start,
and the rules that have ended by a URL's key are popped from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER

#: Keys of one domain that are swept in one group; domains with more are split, each part with its own copy of the rules.
SWEEP_ROWS = 20_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _domain(labels: Column, depth: Column) -> Column:
    return F.array_join(F.slice(labels, 1, depth), ".")


def _reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``domain, key, stack``: each rule's key with all rules it is nested in at its host, itself last.

    Repeated rules with different verdicts count as one; the greater verdict ('block' over 'allow') holds. Rules
    without a host or path are left out, as no URL fits a NULL.
    """
    keyed = (
        rules.where((F.col("host") != "") & F.col("path").isNotNull())
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("domain", F.array_join(_reversed_labels(F.col("host")), "."))
        .select(
            "domain", F.concat("domain", F.lit("#"), "path").alias("key"), "verdict",
            F.concat("host", "path").alias("rule"), F.length(F.concat("host", "path")).alias("size"),
        )
    )
    prefixes = keyed.select("domain", "key", F.explode(F.transform(
        F.sequence(F.length("domain") + 1, F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("prefix"))
    outer = keyed.select(
        F.col("key").alias("prefix"),
        F.struct(F.length("key").alias("depth"), F.col("key"), "size", "rule", "verdict").alias("entry"))
    return prefixes.join(outer, "prefix").groupBy("domain", "key").agg(
        F.sort_array(F.collect_list("entry")).alias("stack"))


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``host, path, rule, verdict`` once per distinct host and path of ``urls(host, path)``.

    The longest fitting rule wins (then the deeper host); without one the rule is NULL and the verdict ``default``.
    An empty host or path fits no rule but such with an empty path. Empty inputs give empty outputs.
    """
    stacks = rule_stacks(rules)
    targets = urls.select("host", "path").distinct()
    deepest = stacks.agg(F.max(F.size(F.split("domain", r"\."))).alias("n")).first()["n"] or 0
    labels = _reversed_labels(F.col("host"))
    keys = targets.where(F.col("host") != "").select(
        "host", "path",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1)))),
            lambda n: _domain(labels, n))).alias("domain"))
    counts = keys.groupBy("domain").agg(F.ceil(F.count("*") / SWEEP_ROWS).cast("int").alias("parts"))
    domains = stacks.select("domain").distinct().join(counts, "domain")
    probes = keys.join(domains, "domain").select(
        "domain", F.pmod(F.xxhash64("host", "path"), F.col("parts")).cast("int").alias("part"),
        F.concat("domain", F.lit("#"), "path").alias("key"), F.lit(1).alias("kind"), "host", "path",
        F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    openings = stacks.join(domains, "domain").select(
        "domain", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    sweep = Window.partitionBy("domain", "part").orderBy("key", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    still_open = F.filter("open", lambda r: F.startswith(F.col("key"), r["key"]))
    best = (
        probes.unionByName(openings)
        .withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .where((F.col("kind") == 1) & F.col("open").isNotNull())
        .select("host", "path", F.try_element_at(still_open, F.lit(-1)).alias("r"))
        .where("r is not null")
        .groupBy("host", "path")
        .agg(F.max(F.struct("r.size", "r.depth", "r.rule", "r.verdict")).alias("best"))
    )
    return targets.join(best, ["host", "path"], "left").select(
        "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``pages`` plus ``host, path, rule, verdict``, in place of columns of those names.

    A NULL URL or one without ``://`` has an empty host and path and gets the default verdict. Repeated rows stay.
    """
    parts = pages.withColumns({"_h": url_host(F.col(url)), "_p": url_path(F.col(url))}).drop("host", "path", "rule", "verdict")
    judged = judge_urls(parts.select(F.col("_h").alias("host"), F.col("_p").alias("path")), rules, default)
    judged = judged.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "rule", "verdict")
    return parts.join(judged, ["_h", "_p"], "left").withColumnsRenamed({"_h": "host", "_p": "path"})
