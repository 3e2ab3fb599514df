"""Repeated passages of running text, found by level-wise doubling.

A passage of ``size`` words is looked for at lengths that double up to ``size``. At each length a passage stands for
itself through the least hash among its runs of that length: equal passages choose equal runs, and neighbouring ones
mostly the same, so few runs are counted at the short lengths. Only passages whose run occurs in two documents are
extended to the next length; at the last length the run is the passage itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import text_key

SIZE = 50
#: The first length is at least this.
SHORTEST = 13
#: Distinct words whose hashes a worker remembers at most.
REMEMBERED = 400_000
#: Odd factors of the two rolling hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Stands for an absent id: greater than any other.
NO_ID = (1 << 63) - 1


def lengths(size: int = SIZE, shortest: int = SHORTEST) -> list[int]:
    """Lengths in rising order, each at most twice the one before; the last is ``size``."""
    found = [size]
    while (found[0] + 1) // 2 >= shortest:
        found.insert(0, (found[0] + 1) // 2)
    return found


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def run_hashes(words: np.ndarray, size: int, factor: int = FACTORS[0]) -> np.ndarray:
    """Hash of each run of ``size`` words, put together from runs of doubling lengths."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    found, got, part, length = None, 0, words, 1
    while True:
        if size & length:
            n = len(words) - got - length + 1
            found = part[:n] if found is None else found[:n] * np.uint64(pow(factor, length, 1 << 64)) + part[got : got + n]
            got += length
        if got == size:
            return found
        n = len(part) - length
        part = part[:n] * np.uint64(pow(factor, length, 1 << 64)) + part[length : length + n]
        length *= 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values."""
    part, length = values, 1
    while 2 * length <= width:
        part, length = np.minimum(part[:-length], part[length:]), 2 * length
    rest = width - length
    return np.minimum(part[: len(part) - rest], part[rest:]) if rest else part


def _runs(words: np.ndarray, size: int, length: int) -> np.ndarray:
    """The run of ``length`` words that stands for each passage of ``size``."""
    return _least(run_hashes(words, length), size - length + 1)


def _alive(words: np.ndarray, size: int, length: int, repeated: np.ndarray) -> np.ndarray:
    return np.isin(_runs(words, size, length), repeated)


def _level(size: int, before: int | None, length: int):
    """For mapInArrow over (k, id, text[, repeated]): the runs of passages that survive, as (k, id, run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            keys, ids, runs = [], [], []
            for row in range(batch.num_rows):
                words = (batch.column(2)[row].as_py() or "").encode().split()
                if len(words) < size:
                    continue
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                own = _runs(hashes, size, length)
                if before is not None:
                    own = own[_alive(hashes, size, before, _numbers(batch.column(3)[row]))]
                own = np.unique(own)
                runs.append(own)
                keys.append(np.full(len(own), batch.column(0)[row].as_py(), np.int64))
                ids.append(np.full(len(own), batch.column(1)[row].as_py(), np.int64))
            yield _batch(("k", "id", "run"), keys, ids, runs)

    return run


def _passages(size: int, before: int | None):
    """For mapInArrow over (k, id, text[, repeated]): the passages that survive, as (k, id, pos, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            keys, ids, places, first, second = [], [], [], [], []
            for row in range(batch.num_rows):
                words = (batch.column(2)[row].as_py() or "").encode().split()
                if len(words) < size:
                    continue
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                at = np.arange(len(words) - size + 1)
                if before is not None:
                    at = at[_alive(hashes, size, before, _numbers(batch.column(3)[row]))]
                if len(at):
                    first.append(run_hashes(hashes, size)[at])
                    second.append(run_hashes(hashes, size, FACTORS[1])[at])
                    places.append(at)
                    keys.append(np.full(len(at), batch.column(0)[row].as_py(), np.int64))
                    ids.append(np.full(len(at), batch.column(1)[row].as_py(), np.int64))
            yield _batch(("k", "id", "pos", "a", "b"), keys, ids, places, first, second)

    return run


def _numbers(scalar: pa.ListScalar) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False).view(np.uint64)


def _batch(names: tuple[str, ...], *columns: list[np.ndarray]) -> pa.RecordBatch:
    whole = [np.concatenate(c).view(np.int64) if c else np.empty(0, np.int64) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in whole], list(names))


def _cleaned(size: int):
    """For mapInArrow over (digest, id, text, starts): (digest, id, n_words, n_removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for text, starts in zip(batch.column(2), batch.column(3), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = 0
                if starts.is_valid and len(starts.values):
                    at = starts.values.to_numpy(zero_copy_only=False)
                    edges = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + size, minlength=len(words) + 1)
                    stays = np.cumsum(edges)[: len(words)] == 0
                    gone = len(words) - int(stays.sum())
                    kept.append(b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s).decode())
                else:
                    kept.append(b" ".join(words).decode())
                totals.append(len(words))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["digest", "id", "n_words", "n_removed", "kept"])

    return run


class _Texts:
    """Each distinct text once with its least id, in buckets of a text hash, so that later joins leave texts in place."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, buckets: int):
        self.spark = docs.sparkSession
        content = F.coalesce(F.col(text), F.lit(""))
        self.rows = docs.select(
            F.sha2(content, 256).alias("digest"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("id"), content.alias("text"))
        once = self.rows.groupBy("digest").agg(F.min("id").alias("id"), F.any_value("text").alias("text"))
        self.name = f"distinct_texts_{uuid.uuid4().hex}"
        (once.withColumn("k", text_key(F.col("text"))).repartition(buckets, "k").write
         .bucketBy(buckets, "k").option("path", scratch_path(self.spark, "texts")).saveAsTable(self.name))

    def joined(self, more: DataFrame, how: str = "inner") -> DataFrame:
        return self.spark.table(self.name).join(more.hint("merge"), ["k", "id"], how)


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, shortest: int = SHORTEST,
                     result: Callable[[Column], Column] = lambda kept: kept, buckets: int | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs``.

    Words are split at ASCII white space. A word is removed if it lies in a passage of ``size`` words that also starts
    in a document with a smaller id; passages are judged on the texts as they came. ``kept`` is ``result`` of the
    remaining words joined by single spaces, worked out once per distinct text. NULL and empty texts have no words;
    texts shorter than ``size`` lose none. Rows that share an id don't remove from each other; a NULL id counts as
    greater than all others, and such rows don't remove from each other.
    """
    spark = docs.sparkSession
    buckets = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts, before, repeated = _Texts(docs, doc_id, text, buckets), None, None
    for length in lengths(size, shortest)[:-1]:
        rows = texts.joined(repeated).select("k", "id", "text", "repeated") if before else spark.table(texts.name).select("k", "id", "text")
        runs = materialise(rows.mapInArrow(_level(size, before, length), "k bigint, id bigint, run bigint"), "runs")
        # Stored, so that a join with it can split the runs that very many texts have.
        twice = materialise(runs.groupBy("run").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("run"), "twice")
        repeated = materialise(
            runs.join(twice, "run").groupBy("k", "id").agg(F.collect_list("run").alias("repeated")), "repeated")
        before = length
    rows = texts.joined(repeated).select("k", "id", "text", "repeated") if before else spark.table(texts.name).select("k", "id", "text")
    found = materialise(rows.mapInArrow(_passages(size, before), "k bigint, id bigint, pos bigint, a bigint, b bigint"), "passages")
    first = materialise(found.groupBy("a", "b").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("a", "b", "lo"), "first")
    starts = found.join(first, ["a", "b"]).where("lo < id").groupBy("k", "id").agg(F.collect_list("pos").alias("starts"))
    cleaned = texts.joined(materialise(starts, "starts"), "left").select("digest", "id", "text", "starts").mapInArrow(
        _cleaned(size), "digest string, id bigint, n_words bigint, n_removed bigint, kept string")
    cleaned = materialise(cleaned.withColumn("kept", result(F.col("kept"))), "cleaned").withColumnsRenamed({"id": "first_id"})
    nothing = result(F.lit(""))
    # A copy under a greater id loses all its passages to the first one.
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_words") >= size)
    return texts.rows.select("digest", "id").join(cleaned, "digest").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.col("kept")).alias("kept"))
