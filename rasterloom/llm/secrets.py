"""Secrets in texts: fixed patterns, and strings that look random to a pair of character Markov models.

Positions are code points; a span is (kind, start, end) with the end exclusive. Everything is column expressions over
one row's text, so no row of the table moves; only distinct matched values, hashes of texts and the bounded training
samples are grouped.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sum

KINDS = ("assign", "access", "hex", "random")
#: The patterns, and which matches count. Shorter matches of access and hex fail as a whole, so their
#: least length stands in the pattern; those of assign are dropped after matching, as a match uses up its text.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: What the models judge: runs of these characters, with base64 padding.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ORDINARY = r"[A-Za-z0-9+/_-]{6,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: What trains the models: ordinary strings come from the distinct texts with the lowest hashes among those of at most
#: TRAIN_CHARS code points, random strings from the distinct matched values with the lowest hashes in the whole corpus.
TRAIN_TEXTS = 4_000
TRAIN_CHARS = 20_000
TRAIN_VALUES = 4_000
#: A token is a secret if random strings explain it better by this log-likelihood in all and per character.
LEAST_GAIN = 16.0
LEAST_GAIN_PER_CHAR = 0.7

SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def _spans(text: Column, pattern: str, rank: int, keep=None, group: int = 0) -> Column:
    """Spans of all matches; ``keep`` filters by the text of ``group``. The rest is only worked out after a match."""
    none = F.array().cast(SPANS)

    def located(matches):
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m))
        ends = running_sum(F.slice(steps, F.lit(1), F.size(matches)))
        spans = F.zip_with(ends, matches, lambda e, m: F.struct(
            (e - F.length(m)).cast("bigint").alias("start"), F.lit(rank).alias("rank"), e.cast("bigint").alias("end")))
        if keep is None:
            return spans
        chosen = F.zip_with(spans, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda s, v: F.when(keep(v), s))
        return F.filter(chosen, lambda s: s.isNotNull())

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, located(m)).otherwise(none))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then by kind as listed."""
    return F.sort_array(F.concat(
        _spans(text, ASSIGN, 0, lambda v: F.length(v) >= ASSIGN_VALUE, group=2), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def printed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _symbols(token: Column) -> Column:
    """Positions of a token's characters in the alphabet, from 1, after a 0 for its beginning."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)))


def train_markov(docs: DataFrame, text: str = "text") -> list[float]:
    """Log-likelihood ratio (random against ordinary) of each pair of neighbouring characters, as one flat table.

    Labelled samples: values that the fixed patterns find anywhere in the corpus are random strings, each distinct value
    once; the other runs of word characters in a sample of distinct texts are ordinary. The two are drawn apart, so rare
    secrets are found however large the corpus is, and copies of a text or value take one place. Values beyond
    TRAIN_CHARS train with their beginning. Pairs are counted by grouping; what reaches the driver is bounded by the
    square of the alphabet. Without any random or any ordinary string no token gains anything, and a warning says so.
    """
    content = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    values = F.concat(
        F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_VALUE),
        F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))
    random = (
        content.select(F.explode(values).alias("v")).select(F.substring("v", 1, TRAIN_CHARS).alias("token")).distinct()
        .orderBy(F.xxhash64("token"), "token").limit(TRAIN_VALUES).select(F.lit(1).alias("random"), "token")
    )
    hashed = content.where(F.length("t") <= TRAIN_CHARS).withColumn("h", F.xxhash64("t"))
    last = hashed.select("h").distinct().orderBy("h").limit(TRAIN_TEXTS).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= F.lit(last)).select("t").distinct()
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = sample.select(
        F.lit(0).alias("random"), F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("token"))
    labelled = random.unionByName(ordinary)
    symbols = labelled.groupBy("random", "token").count().select("random", "count", _symbols(F.col("token")).alias("s"))
    pairs = symbols.select("random", "count", F.explode(F.zip_with(
        F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    counts = pairs.groupBy("random", "p.a", "p.b").agg(F.sum("count").alias("n")).collect()
    for label, kind in ((1, "random"), (0, "ordinary")):
        if not any(r["random"] == label for r in counts):
            warnings.warn(f"no {kind} string to train on: only the fixed patterns find secrets", stacklevel=2)
    return _log_ratios({(r["random"], r["a"], r["b"]): r["n"] for r in counts})


def _log_ratios(counts: dict[tuple[int, int, int], int]) -> list[float]:
    """Each model mixes pair, single-character and even probabilities, so that unseen pairs stay moderate."""
    size = len(ALPHABET)
    if not any(k[0] == 1 for k in counts) or not any(k[0] == 0 for k in counts):
        return [0.0] * (size + 1) ** 2

    def model(label):
        single = [sum(counts.get((label, a, b), 0) for a in range(size + 1)) for b in range(size + 1)]
        whole = sum(single[1:])
        base = [(single[b] + 0.5) / (whole + 0.5 * size) for b in range(size + 1)]
        table = []
        for a in range(size + 1):
            row = sum(counts.get((label, a, b), 0) for b in range(1, size + 1))
            table.append([(counts.get((label, a, b), 0) + 20 * base[b]) / (row + 20) for b in range(size + 1)])
        return table

    random, ordinary = model(1), model(0)
    even = 1 / size
    return [
        0.0 if b == 0 else math.log((0.7 * random[a][b] + 0.3 * even) / (0.98 * ordinary[a][b] + 0.02 * even))
        for a in range(size + 1) for b in range(size + 1)
    ]


def _gain(token: Column, ratios: Column) -> Column:
    """Summed log-likelihood ratio of a token."""
    step = lambda acc, b: F.struct(
        (acc["gain"] + F.get(ratios, acc["last"] * (len(ALPHABET) + 1) + b)).alias("gain"), b.alias("last"))
    start = F.struct(F.lit(0.0).alias("gain"), F.lit(0).alias("last"))
    return F.aggregate(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)), start, step, lambda acc: acc["gain"])


def random_spans(text: Column, ratios: list[float]) -> Column:
    """Spans of tokens that the Markov models take for random strings."""
    if not any(ratios):
        return F.array().cast(SPANS)
    known = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    keep = lambda v: let(_gain(v, known), lambda g: (g >= LEAST_GAIN) & (g >= LEAST_GAIN_PER_CHAR * F.length(v)))
    return _spans(text, TOKEN, 3, keep)


def find_secrets(docs: DataFrame, text: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` plus ``base`` and ``spans``, arrays of (start, rank in KINDS, end).

    ``base`` holds the fixed patterns' spans; ``spans`` also those the models add, without such that overlap a base
    span. NULL text counts as empty and has no spans; repeated rows stay. ``ratios`` is a trained table; by default one
    is trained on ``docs``. Columns that are already called ``base`` or ``spans`` are replaced.
    """
    ratios = train_markov(docs, text) if ratios is None else ratios
    content = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("_found", let(content, lambda t: F.struct(
        base_spans(t).alias("base"), random_spans(t, ratios).alias("more"))))
    free = F.when(F.size("_found.more") == 0, F.col("_found.base")).otherwise(F.sort_array(F.concat("_found.base", F.filter(
        "_found.more", lambda r: ~F.exists("_found.base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))))))
    return found.drop("base", "spans").withColumns({"base": F.col("_found.base"), "spans": free}).drop("_found")
