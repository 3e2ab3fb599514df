"""Document quality by hierarchical empirical Bayes: what the text says, shrunk together with what its site says.

A logistic classifier turns surface features of a text into evidence, the log-odds of good quality beyond the labelled
sample's own odds. The mean quality of a site (host) and of each section (path) below it is estimated from the evidence
of all its documents. Sites are Beta-distributed around the global mean and sections around their site's; how far one
is pulled towards its parent follows from how much sites, or sections, differ in the whole corpus. A document's odds are
its own evidence times the odds of its section, worked out without the document itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import remainder

#: The fit takes at most this many labelled documents of each class.
TRAIN_ROWS = 10_000
FEATURES = ("upper", "marks", "digits", "distinct", "log_words", "word_length", "line_length")
UPPER, MARKS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!#$%&*+<=>?@^_`{|}~", "0123456789"
#: Bounds of the strength with which a level is pulled to its parent, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1_000.0
#: Sites that hold more than one in HEAVY of all rows number less than HEAVY, so they can be broadcast.
HEAVY = 500


def features(text: Column) -> Column:
    """The FEATURES of a text as a struct of doubles; NULL counts as empty."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))) / size

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = 1 + F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.struct(
        share(UPPER).alias("upper"), share(MARKS).alias("marks"), share(DIGITS).alias("digits"),
        (F.size(F.array_distinct(words)) / n_words).alias("distinct"), F.log1p(F.size(words).cast("double")).alias("log_words"),
        F.log1p(size / n_words).alias("word_length"), F.log1p(size / lines).alias("line_length"))


@dataclass
class Classifier:
    """Weights of the standardised features, with bias; ``prior`` is the labelled sample's log-odds."""

    means: list[float]
    widths: list[float]
    weights: list[float]
    bias: float
    prior: float

    def evidence(self, found: Column) -> Column:
        """Log-odds that the features of ``found`` add to the prior ones."""
        total = F.lit(self.bias - self.prior)
        for name, mean, width, weight in zip(FEATURES, self.means, self.widths, self.weights, strict=True):
            total = total + (found[name] - mean) * (weight / width)
        return total


def fit(rows: list[tuple[tuple[float, ...], int]], steps: int = 30) -> Classifier:
    """A logistic classifier by penalised Newton steps; without rows of both labels it finds no evidence."""
    y = np.array([label for _, label in rows], float)
    size = len(FEATURES)
    if not len(y) or y.min() == y.max():
        return Classifier([0.0] * size, [1.0] * size, [0.0] * size, 0.0, 0.0)
    x = np.array([values for values, _ in rows], float)
    means, widths = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = np.concatenate([(x - means) / widths, np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(size + 1), np.full(size + 1, 1.0)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 4 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    rate = y.mean()
    return Classifier(means.tolist(), widths.tolist(), w[:-1].tolist(), float(w[-1]), float(np.log(rate / (1 - rate))))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Classifier:
    """A classifier fitted to at most TRAIN_ROWS labelled documents of each class, evenly by a hash of the id.

    Where an id has several labels, the smallest counts. Rows without text, id or label aren't learned from.
    """
    marked = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(
        F.min(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    samples = []
    for y, n in sorted(counts.items()):
        share = min(1.0, 1.5 * TRAIN_ROWS / n)
        picked = marked.where(F.col("y") == y).where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share * (1 << 20))
        picked = picked.orderBy(F.xxhash64(F.lit(1), F.col("_id"))).limit(TRAIN_ROWS)
        taken = rows.join(F.broadcast(picked), "_id").select("_id", features(F.col("_text")).alias("f"))
        taken = taken.orderBy(F.xxhash64("_id"), "f").limit(TRAIN_ROWS).collect()
        samples += [(tuple(r["f"]), int(y)) for r in taken]
    return fit(samples)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(spread: float | None, within: float | None, size: float | None) -> float:
    """How many documents the parent's mean is worth: noise within groups over the true spread between them."""
    if not spread or not within or not size:
        return MOST_STRENGTH
    real = spread - within / size
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, within / real))) if real > 0 else MOST_STRENGTH


def _level_strength(groups: DataFrame, parent_mean: Column) -> float:
    """By moments over ``groups(n, s, q)``: count, sum and sum of squares of the documents' probabilities."""
    mean = F.col("s") / F.col("n")
    found = groups.where("n > 1").agg(
        F.avg((mean - parent_mean) ** 2).alias("spread"),
        (F.sum(F.col("q") - F.col("s") * mean) / F.sum(F.col("n") - 1)).alias("within"),
        (F.count("*") / F.sum(1 / F.col("n"))).alias("size")).first()
    return _strength(found["spread"], found["within"], found["size"])


def judge(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text", host: Column | None = None,
          path: Column | None = None) -> DataFrame:
    """``doc_id, host, path, evidence, host_mean, path_mean, score`` for every row of ``docs``.

    ``score`` is the probability of good quality; ``host_mean`` and ``path_mean`` are the shrunk means of the document's
    site and section without the document itself. NULL or empty text has the features of the empty text. A NULL host or
    path counts as the empty one, so such documents form a group of their own. Repeated rows count as often as they
    occur, and all are returned.
    """
    host = F.col("source") if host is None else host
    path = F.lit("") if path is None else path
    # The group's own odds come in once, from the groups; a document counts in them with its classifier's probability.
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"), classifier.evidence(features(F.col(text))).alias("evidence"))
    rows = materialise(rows.withColumn("p", 1 / (1 + F.exp(-F.least(F.greatest(
        F.col("evidence") + classifier.prior, F.lit(-30.0)), F.lit(30.0))))), "evidence")
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    sections = materialise(rows.groupBy("host", "path").agg(*sums), "sections")
    sites = materialise(sections.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]), "sites")
    whole = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not whole["n"]:
        mean = 0.5
    else:
        mean = whole["s"] / whole["n"]
    by_site = _level_strength(sites, F.lit(mean))
    nested = sections.join(sites.select("host", F.col("n").alias("site_n"), F.col("s").alias("site_s")), "host")
    nested = materialise(nested, "sections")
    by_section = _level_strength(nested, F.col("site_s") / F.col("site_n"))
    parents = nested.select("host", "path", "n", "s", "site_n", "site_s")
    heavy = F.col("n") * HEAVY > F.lit(whole["n"] or 0)
    many = F.broadcast(parents.where(heavy).withColumn("_heavy", F.lit(True)))
    marked = rows.join(many, ["host", "path"], "left")
    few = marked.where("_heavy is null").select(*rows.columns).join(parents.where(~heavy), ["host", "path"])
    joined = marked.where("_heavy").drop("_heavy").unionByName(few)
    host_mean = (F.col("site_s") - F.col("p") + by_site * mean) / (F.col("site_n") - 1 + by_site)
    path_mean = (F.col("s") - F.col("p") + by_section * F.col("host_mean")) / (F.col("n") - 1 + by_section)
    judged = joined.withColumn("host_mean", host_mean).withColumn("path_mean", path_mean)
    odds = F.least(F.greatest(F.col("evidence") + _logit(F.col("path_mean")), F.lit(-30.0)), F.lit(30.0))
    return judged.select("doc_id", "host", "path", "evidence", "host_mean", "path_mean", (1 / (1 + F.exp(-odds))).alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that the fit never sees."""
    return remainder(F.col(doc_id), 5) == 0
