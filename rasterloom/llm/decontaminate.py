"""Benchmark passages in training texts, found in a positional inverted index.

The index holds a posting (document, term, position) for every training token whose term occurs in the benchmark,
written where the document was read, so building it shuffles nothing. A document is known by its id and a hash of its
text, which also serves repeated ids. Phrases are searched from their rarest term on: its postings, shifted by the
term's place in the phrase, give the possible starts; the lists of the further terms, shifted likewise, are intersected
with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import ascii_lower, small, text_key, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No word contains this character; its posting gives a document's number of words.
END = "\u0000"
WINDOW = 13
#: Windows, keys of documents and terms beyond these numbers are joined by a shuffle instead of a broadcast.
BROADCAST_WINDOWS = 100_000


def words(text: Column) -> Column:
    """Words of a text in order, A-Z lower-cased; NULL has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``window_id, item_id, terms``: all runs of ``size`` words, or a shorter item whole; one row per item and window."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    return items.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1)), lambda i: F.slice("w", i, size))).alias("terms")
    ).distinct().withColumn("window_id", F.md5(F.array_join("terms", " ")))


class PositionIndex:
    """Postings of the training texts for the terms of a vocabulary, kept as tables in the shared folder."""

    def __init__(self, docs: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        """``vocabulary(term)``: the terms that will be searched."""
        spark = docs.sparkSession
        terms = vocabulary.select("term").where(F.col("term").isNotNull() & (F.col("term") != END)).distinct()
        self.terms = materialise(terms.select("term", F.monotonically_increasing_id().alias("term_id")), "terms")
        known = self.terms.unionByName(spark.range(1).select(F.lit(END).alias("term"), F.lit(-1).cast("bigint").alias("term_id")))
        tokens = docs.select(
            F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("t"),
            F.posexplode(F.concat(words(F.col(text)), F.array(F.lit(END)))).alias("pos", "term"))
        self.path = scratch_path(spark, "postings")
        tokens.join(small(known), "term").select("doc_id", "t", "term_id", "pos").write.parquet(self.path)
        postings = spark.read.parquet(self.path)
        #: One row per row of the input.
        self.documents = postings.where("term_id = -1").select("doc_id", "t", F.col("pos").cast("bigint").alias("n_words"))
        #: ``doc_id, t, term_id, pos``; repeated rows of the input repeat theirs.
        self.postings = postings.where("term_id >= 0")
        self._texts = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("t"), words(F.col(text)).alias("w"))

    def surroundings(self, terms: DataFrame, reach: int) -> DataFrame:
        """``doc_id, t, term, pos, first, around``: each occurrence of ``terms(term)`` with the words up to ``reach`` places
        off, of which the first stands at ``first``."""
        held = small(terms)
        tokens = self._texts.select("doc_id", "t", "w", F.posexplode("w").alias("pos", "term"))
        first = F.greatest(F.lit(0), F.col("pos") - reach)
        cut = ["doc_id", "t", "term", "pos", first.alias("first"), F.slice("w", first + 1, F.col("pos") + reach + 1 - first).alias("around")]
        # Whole texts must not be shuffled once per word: beyond a broadcast the words are cut out before the join.
        return tokens.select(*cut).join(held, "term") if held is terms else tokens.join(held, "term").select(*cut)

    def term_counts(self) -> DataFrame:
        return self.postings.groupBy("term_id").agg(F.count("*").alias("n"))


def _ranked(index: PositionIndex, windows: DataFrame) -> DataFrame:
    """``window_id, size, ranked``: the places of each distinct window whose terms all occur, rarest term first."""
    counts = index.terms.join(index.term_counts(), "term_id")
    places = windows.select("window_id", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "term"))
    return (
        places.distinct().join(counts, "term")
        .groupBy("window_id", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "place", "term_id"))).alias("ranked"))
        .where(F.size("ranked") == F.col("size"))
    )


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t"] == b["t"])


def phrase_matches(index: PositionIndex, windows: DataFrame) -> DataFrame:
    """``doc_id, t, start, size, window_id``: every exact occurrence of a window (``window_id, terms``) in a document."""
    ranked = materialise(_ranked(index, windows.select("window_id", "terms").distinct()).select(
        F.monotonically_increasing_id().alias("w"), "window_id", "size", "ranked"), "ranked")
    first = F.col("ranked")[0]
    anchors = ranked.select("w", "size", first["term_id"].alias("term_id"), first["place"].alias("place"))
    held = index.postings.join(small(anchors.select("term_id").distinct()), "term_id", "left_semi")
    starts = held.join(small(anchors, BROADCAST_WINDOWS), "term_id").select(
        "doc_id", "t", (F.col("pos") - F.col("place")).alias("start"), "w", "size").where("start >= 0").distinct()
    starts = materialise(starts, "starts")
    # The second rarest term alone first: it removes most false starts at the price of short lists.
    second = F.try_element_at("ranked", F.lit(2))
    seconds = ranked.where("size > 1").select("w", second["term_id"].alias("term_id"), second["place"].alias("place"))
    wanted = starts.where("size > 1").join(small(seconds, BROADCAST_WINDOWS), "w").select(
        "doc_id", "t", "start", "w", "size", "term_id", (F.col("start") + F.col("place")).alias("pos"))
    lists = index.postings.join(small(seconds.select("term_id").distinct()), "term_id", "left_semi")
    both = _intersect(wanted, lists).unionByName(starts.where("size = 1").select("doc_id", "t", "start", "w", "size"))
    both = materialise(both, "starts")
    rest = ranked.where("size > 2").select("w", F.explode(F.slice("ranked", F.lit(3), F.size("ranked"))).alias("r")).select(
        "w", "r.term_id", "r.place")
    wanted = both.where("size > 2").join(rest, "w").select(
        "doc_id", "t", "start", "w", "size", "term_id", (F.col("start") + F.col("place")).alias("pos"))
    holders = small(both.where("size > 2").select("doc_id", "t").distinct())
    lists = index.postings.join(holders, _same_document(index.postings, holders), "left_semi")
    whole = _intersect(wanted, lists).groupBy("doc_id", "t", "start", "w", "size").count().where("count = size - 2").drop("count")
    found = both.where("size <= 2").unionByName(whole)
    return found.join(small(ranked.select("w", "window_id"), BROADCAST_WINDOWS), "w").drop("w")


def _intersect(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """The wanted (start, place) rows that have a posting; repeated postings count once."""
    return wanted.join(postings, _same_document(wanted, postings) & (wanted["term_id"] == postings["term_id"])
                       & (wanted["pos"] == postings["pos"]), "left_semi").select("doc_id", "t", "start", "w", "size")


#: Of so many of a window's rarest terms it is looked first whether they stand anywhere around an occurrence.
LOOKED_FIRST = 6


def proximity_matches(index: PositionIndex, windows: DataFrame, slack: int = 5, share: float = 0.8) -> DataFrame:
    """``doc_id, t, window_id, near``: windows of which ``share`` of the terms stand near an occurrence of a rare one.

    Near means at most ``slack`` words from where the term would stand in an exact occurrence. A window may lack
    ``size - ceil(share * size)`` of its terms; occurrences of one more than that many of its rarest terms are looked at,
    so one of them is there whichever terms are changed or missing. Every passage in which the share of the terms is
    displaced by at most ``slack`` words against one another is found, exact occurrences included. ``near`` is the largest
    number of places found so at one occurrence of the rarest term that reaches the share. Terms that the corpus lacks
    count as missing.
    """
    longest = windows.agg(F.max(F.size("terms"))).first()[0] or 1
    counts = index.terms.join(index.term_counts(), "term_id")
    places = windows.select("window_id", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "term")).distinct()
    ranked = places.join(counts, "term").groupBy("window_id", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "place", "term"))).alias("ranked"))
    need = F.ceil(F.lit(share) * F.col("size")).cast("int")
    spare = F.greatest(F.lit(-1), F.size("ranked") - need)
    ranked = ranked.select("window_id", "ranked", need.alias("need"), spare.alias("spare")).where("spare >= 0")
    anchors = materialise(ranked.select(
        "window_id", "need", "spare", F.transform("ranked", lambda r: F.struct(r["term"].alias("term"), r["place"].alias("place"))).alias("ranked"),
        F.posexplode(F.slice("ranked", F.lit(1), F.col("spare") + 1)).alias("rank", "r"),
    ).select("window_id", "need", "spare", "ranked", "rank", F.col("r.term").alias("term"), F.col("r.place").alias("place")), "anchors")
    held = index.surroundings(anchors.select("term").distinct(), longest - 1 + slack)
    absent = [F.when(~F.array_contains("around", F.get("ranked", F.lit(k))["term"]), 1).otherwise(0) for k in range(LOOKED_FIRST)]
    spots = held.join(small(anchors, BROADCAST_WINDOWS), "term").where(sum(absent, F.lit(0)) <= F.col("spare"))
    start = F.col("pos") - F.col("place") - F.col("first")

    def there(r):
        lo, hi = start + r["place"] - slack, start + r["place"] + slack
        lo = F.greatest(F.lit(0), lo)
        return F.array_contains(F.slice("around", lo + 1, F.greatest(F.lit(0), hi + 1 - lo)), r["term"])

    near = spots.withColumn("near", F.size(F.filter("ranked", there))).where("near >= need")
    best = near.groupBy("doc_id", "t", "window_id").agg(F.min(F.struct("rank", (-F.col("near")).alias("less"))).alias("best"))
    return best.select("doc_id", "t", "window_id", (-F.col("best.less")).cast("bigint").alias("near"))


def proximity(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
              item_text: str = "text", slack: int = 5, share: float = 0.8) -> DataFrame:
    """``doc_id, t, n_words, n_near, items`` for every row of ``docs``: the benchmark windows that stand in it exactly or
    nearly, counted, and the items that own them. NULLs, empty texts and repeated rows are treated as by ``contamination``."""
    windows = materialise(benchmark_windows(benchmark, item_id, item_text), "windows")
    index = PositionIndex(docs, windows.select(F.explode("terms").alias("term")), doc_id, text)
    found = materialise(proximity_matches(index, windows, slack, share), "near")
    counted = found.groupBy("doc_id", "t").agg(F.count("*").alias("n_near"))
    owned = found.join(windows.select("window_id", "item_id"), "window_id").groupBy("doc_id", "t").agg(
        F.collect_set(F.col("item_id").cast("string")).alias("items"))
    rows = index.documents
    rows = rows.join(counted, _same_document(rows, counted), "left").select(rows["*"], "n_near")
    rows = rows.join(owned, _same_document(rows, owned), "left").select(rows["*"], "items")
    return rows.select(
        "doc_id", "t", "n_words", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.sort_array(F.coalesce("items", F.array().cast("array<string>"))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, t, n_words, n_hit, items, contaminated`` for every row of ``docs``.

    A word is hit inside any occurrence of a benchmark window; ``items`` lists the items with occurring windows (NULL
    ids are passed over, though their windows hit). A document is contaminated if a twentieth of its words is hit. NULL
    and empty texts have no words, and items without words no windows; an empty benchmark contaminates nothing.
    Repeated rows are all returned.
    """
    windows = materialise(benchmark_windows(benchmark, item_id, item_text), "windows")
    index = PositionIndex(docs, windows.select(F.explode("terms").alias("term")), doc_id, text)
    found = materialise(phrase_matches(index, windows), "matches")
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    cover = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["end"]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["upto"], s["start"]))).alias("n")),
        lambda acc: acc["n"])
    hits = found.groupBy("doc_id", "t").agg(spans.alias("spans")).select("doc_id", "t", cover.cast("bigint").alias("n_hit"))
    owners = found.select("doc_id", "t", "window_id").distinct().join(windows.select("window_id", "item_id"), "window_id")
    owned = owners.select("doc_id", "t", "item_id").distinct().groupBy("doc_id", "t").agg(
        F.collect_set(F.col("item_id").cast("string")).alias("items"))
    rows = index.documents
    rows = rows.join(hits, _same_document(rows, hits), "left").select(rows["*"], "n_hit")
    rows = rows.join(owned, _same_document(rows, owned), "left").select(rows["*"], "items")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.select(
        "doc_id", "t", "n_words", n_hit.alias("n_hit"),
        F.sort_array(F.coalesce("items", F.array().cast("array<string>"))).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns."""
    bad = contamination(docs, benchmark, doc_id, text).where("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct()
    bad = materialise(bad, "contaminated")
    return without(docs, bad, F.col(doc_id), text)
