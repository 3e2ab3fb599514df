"""Hard negatives by segment summaries.

Every vector is stored with the mean and the deviation of its segments, at a few levels of ever shorter segments. Over a
segment of ``s`` components the inner product of two vectors is ``s`` times the product of their means, plus or minus at
most the product of their deviations (root sums of squared distances from the mean), so the summaries of a level bound a
score from both sides. Pairs of an anchor and a row that can still matter at one level are bounded more closely at the
next, and only what survives the last level is scored exactly.

Anchors and rows are dealt out to tiles of bounded size; every pair meets in one tile. A tile keeps the best rows of each
anchor as it goes through its rows, and these few are ranked among tiles at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

POSITIVES = 5
NEGATIVES = 10
#: Per cent of the positive's score that a negative's score may have, from and to.
SHARES = (30, 90)
#: Numbers of segments, level by level, as long as a segment has two components or more.
LEVELS = (4, 16, 32)
#: Anchors and rows of a tile at most, and how many of them are bounded at a time.
TILE = (8192, 32768)
#: Rows are cut into at least so many parts for each shuffle partition, so that small tables occupy all tasks too.
PARTS = 3
STEP = (256, 2048)
#: Above this share of surviving pairs a level is worked out for all pairs at once, as a product of matrices.
DENSE = 0.1
#: Sums of products of whole numbers below this are exact in doubles.
EXACT = 1 << 53


def segment_edges(size: int, segments: int) -> np.ndarray:
    return np.linspace(0, size, segments + 1).astype(int)


def levels_of(size: int, levels: tuple[int, ...] = LEVELS) -> list[int]:
    return [n for n in levels if 2 * n <= size]


def summaries(vectors: np.ndarray, levels: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level: the means of the segments times the root of their length, and their deviations."""
    found = []
    for n in levels:
        edges = segment_edges(vectors.shape[1], n)
        sizes = np.diff(edges)
        means = np.add.reduceat(vectors, edges[:-1], axis=1) / sizes
        spread = vectors - np.repeat(means, sizes, axis=1)
        found.append((means * np.sqrt(sizes), np.sqrt(np.add.reduceat(spread * spread, edges[:-1], axis=1))))
    return found


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), len(values) // max(1, len(flat)))


def _prepared(size: int, levels: list[int]):
    """For mapInArrow over (vec_id, label, v): whole vectors of one length with their summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.zeros((batch.num_rows, size))
            for i, x in enumerate(batch.column(2)):
                values = x.values.to_numpy(zero_copy_only=False)
                v[i, : len(values)] = values
            parts = [a for pair in summaries(v, levels) for a in pair]
            s = np.concatenate(parts, axis=1) if parts else np.empty((len(v), 0))
            lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64())) if m.shape[1] else pa.array([[]] * len(m), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(v), lists(s)], ["vec_id", "label", "v", "s"])

    return run


def prepare(rows: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``vec_id, label, v, s`` of ``rows(vec_id bigint, label, v array<double>)``: vectors and the summaries of all levels.

    Shorter vectors are filled up with zeros to the length of the longest.
    """
    rows = materialise(rows, "vectors")
    size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    kind = rows.schema["label"].dataType.simpleString()
    found = rows.select("vec_id", "label", "v").mapInArrow(_prepared(size, levels_of(size, levels)), f"vec_id bigint, label {kind}, v array<double>, s array<double>")
    return materialise(found, "summaries")


class _Block:
    """Rows of a tile: ids, labels, vectors and their summaries by level."""

    def __init__(self, table: pa.Table, levels: list[int]):
        self.ids = table["vec_id"].to_numpy()
        self.labels = np.asarray(table["label"].to_pylist())
        self.v, s = _matrix(table["v"]), _matrix(table["s"])
        edges = np.cumsum([0] + [n for n in levels for _ in range(2)])
        self.levels = [(s[:, edges[2 * i] : edges[2 * i + 1]], s[:, edges[2 * i + 1] : edges[2 * i + 2]]) for i in range(len(levels))]
        self.most = float(np.abs(self.v).max(initial=0.0))

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, at: slice) -> _Block:
        new = object.__new__(_Block)
        new.ids, new.labels, new.v, new.most = self.ids[at], self.labels[at], self.v[at], self.most
        new.levels = [(m[at], d[at]) for m, d in self.levels]
        return new


def scores(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (i, j)."""
    if a.most * b.most * max(1, a.v.shape[1]) < EXACT:
        if len(i) > DENSE * len(a) * len(b):
            return (a.v @ b.v.T)[i, j].astype(np.int64)
        return np.einsum("ij,ij->i", a.v[i], b.v[j]).astype(np.int64)
    whole = lambda m: [[int(x) for x in row] for row in m]  # noqa: E731  beyond doubles: Python's whole numbers
    return np.array([sum(x * y for x, y in zip(p, q, strict=True)) for p, q in zip(whole(a.v[i]), whole(b.v[j]), strict=True)], np.int64)


def survivors(a: _Block, b: _Block, may: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the mask ``may`` whose score can lie in some of the ranges ``low[i, r] .. high[i, r]``."""

    def within(centre, reach, i):
        slack = 1e-6 * (1.0 + np.abs(centre) + reach)  # rounding of the bounds
        least, most = centre - reach - slack, centre + reach + slack
        shape = (slice(None), None) if i is None else (i,)
        ok = np.zeros(centre.shape, bool)
        for r in range(low.shape[1]):
            ok |= (most >= low[:, r][shape]) & (least <= high[:, r][shape])
        return ok

    pairs = None
    for (ma, da), (mb, db) in zip(a.levels, b.levels, strict=True):
        if pairs is None:
            may = may & within(ma @ mb.T, da @ db.T, None)
            if may.mean() <= DENSE:
                pairs = np.nonzero(may)
        else:
            i, j = pairs
            ok = within(np.einsum("ij,ij->i", ma[i], mb[j]), np.einsum("ij,ij->i", da[i], db[j]), i)
            pairs = i[ok], j[ok]
    return np.nonzero(may) if pairs is None else pairs


class _Best:
    """The best ``k`` rows of each of ``n`` lists, by score and then smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.list, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, lists: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        lists, ids, values = (np.concatenate(x) for x in ((self.list, lists), (self.id, ids), (self.score, values)))
        order = np.lexsort((ids, -values, lists))
        lists, ids, values = lists[order], ids[order], values[order]
        first = np.searchsorted(lists, lists)
        kept = np.arange(len(lists)) - first < self.k
        self.list, self.id, self.score = lists[kept], ids[kept], values[kept]

    def least(self) -> np.ndarray:
        """The score that a row needs to get into each list."""
        found = np.full(self.n, -np.inf)
        last = np.flatnonzero(np.bincount(self.list, minlength=self.n) >= self.k)
        found[last] = self.score[np.searchsorted(self.list, last, side="right") - 1]
        return found


def best_rows(a: _Block, b: _Block, k: int, same: bool, low: np.ndarray, high: np.ndarray) -> _Best:
    """For each anchor of ``a`` and each of its ranges ``r``, as list ``i * ranges + r``: the best ``k`` rows of ``b`` whose
    score lies in the range. Only rows with the anchor's label (``same``) or another one count, never one with its id."""
    ranges = low.shape[1]
    best = _Best(len(a) * ranges, k)
    for top in range(0, len(a), STEP[0]):
        own = a.part(slice(top, top + STEP[0]))
        lo, hi, part = low[top : top + STEP[0]], high[top : top + STEP[0]], _Best(len(own) * ranges, k)
        for left in range(0, len(b), STEP[1]):
            rows = b.part(slice(left, left + STEP[1]))
            may = (own.labels[:, None] == rows.labels[None, :]) == same
            may &= own.ids[:, None] != rows.ids[None, :]
            i, j = survivors(own, rows, may, np.maximum(lo, part.least().reshape(lo.shape)), hi)
            s = scores(own, rows, i, j)
            for r in range(ranges):
                ok = (s >= lo[i, r]) & (s <= hi[i, r])
                part.add(i[ok] * ranges + r, rows.ids[j[ok]], s[ok])
        best.add(part.list + top * ranges, part.id, part.score)
    return best


def _tile_positives(levels: list[int], k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, b = _Block(anchors, levels), _Block(rows, levels)
        found = best_rows(a, b, k, True, np.full((len(a), 1), -np.inf), np.full((len(a), 1), np.inf))
        return pa.table({"anchor_id": a.ids[found.list], "row_id": found.id, "score": found.score})

    return run


def _tile_negatives(levels: list[int], k: int, shares: tuple[int, int]):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, b = _Block(anchors, levels), _Block(rows, levels)
        given = [(i, p["row_id"], p["score"]) for i, own in enumerate(anchors["positives"].to_pylist()) for p in own]
        width = max((len(own) for own in anchors["positives"].to_pylist()), default=0)
        low, high = np.full((len(a), width), np.inf), np.full((len(a), width), -np.inf)
        ids, reached = np.zeros((len(a), width), np.int64), np.zeros((len(a), width), np.int64)
        filled = np.zeros(len(a), int)
        for i, row, score in given:
            r = filled[i]
            # Of whole numbers: the least and the greatest score within the shares.
            low[i, r], high[i, r] = -(-shares[0] * score // 100), shares[1] * score // 100
            ids[i, r], reached[i, r] = row, score
            filled[i] += 1
        low[low > high], high[low > high] = np.inf, -np.inf
        found = best_rows(a, b, k, False, low, high) if width else _Best(0, k)
        i, r = (found.list // width, found.list % width) if width else (found.list, found.list)
        return pa.table({
            "anchor_id": a.ids[i], "positive_id": ids[i, r], "positive_score": reached[i, r], "negative_id": found.id,
            "negative_score": found.score})

    return run


def _tiles(anchors: DataFrame, rows: DataFrame, run, schema: str, sizes: tuple[int, int]) -> DataFrame:
    """``run`` over every tile of at most about ``sizes`` anchors and rows: all pairs, each in one tile."""
    parts = [max(1, -(-df.count() // n)) for df, n in zip((anchors, rows), sizes, strict=True)]
    parts[1] = max(parts[1], PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts[0])
    place = lambda df, n: df.withColumn("_own", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = place(anchors, parts[0]).withColumnRenamed("_own", "_a").withColumn("_b", everywhere(parts[1]))
    right = place(rows, parts[1]).withColumnRenamed("_own", "_b").withColumn("_a", everywhere(parts[0]))
    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], score: str, row: str, k: int) -> DataFrame:
    """The first ``k`` rows per key, with their ``rank``; a key has at most ``k`` rows from each tile."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), row)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, shares: tuple[int, int] = SHARES,
    levels: tuple[int, ...] = LEVELS, tile: tuple[int, int] = TILE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among ``rows``.

    ``rows`` has ``vec_id, label`` and ``v``, an array of whole numbers as doubles. Rows with a NULL id, label or vector, or
    with a NULL, infinite or NaN component take no part. An anchor's positives are the first ``positives`` other rows of
    its label, by greater inner product and then smaller id; a positive's negatives the first ``negatives`` rows of other
    labels whose score is within ``shares`` per cent of the positive's. Rows that share an id count one by one, but not
    for an anchor with that id. Vectors of different lengths are compared as if filled up with zeros. A score
    beyond the range of a bigint ends the job.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", finite), F.lit(False))
    whole = prepare(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("v").cast("array<double>").alias("v")).where(sound), levels)
    size = whole.select(F.size("v").alias("n")).first()
    used = levels_of(size["n"] if size else 0, levels)
    anchors = whole.where(is_anchor).dropDuplicates(["vec_id"])
    found = _tiles(anchors, whole, _tile_positives(used, positives), "anchor_id bigint, row_id bigint, score bigint", tile)
    best = _first(found, ["anchor_id"], "score", "row_id", positives)
    lists = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "row_id", "score"))).alias("positives"))
    asked = materialise(anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "anchors")
    hard = _tiles(
        asked, whole, _tile_negatives(used, negatives, shares),
        "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint", tile)
    ranked = _first(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
