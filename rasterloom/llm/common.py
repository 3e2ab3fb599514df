"""Small column and table helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rows than this are never broadcast by the operators here.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(numbers: Column) -> Column:
    """Prefix sums of an array of numbers, in blocks of about the root of its size.

    Appending to an array copies it; blocks keep the copying near ``n ** 1.5`` for very long arrays.
    """

    def append(acc, x):
        total = acc["total"] + x
        return F.struct(F.concat(acc["sums"], F.array(total)).alias("sums"), total.alias("total"))

    def sums(part, start):
        first = F.struct(F.array().cast("array<bigint>").alias("sums"), start.cast("bigint").alias("total"))
        return F.aggregate(part, first, append, lambda acc: acc["sums"])

    def total(part):
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def blocks(values):
        width = F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int")
        starts = F.sequence(F.lit(1), F.size(values), width)
        parts = F.transform(starts, lambda i: F.slice(values, i, width))
        return let(parts, lambda p: let(
            F.concat(F.array(F.lit(0).cast("bigint")), sums(F.transform(p, total), F.lit(0))),
            lambda offsets: F.flatten(F.transform(p, lambda part, i: sums(part, F.get(offsets, i))))))

    return let(F.transform(numbers, lambda x: x.cast("bigint")), lambda values: F.when(
        F.size(values) > 0, blocks(values)).otherwise(F.array().cast("array<bigint>")))


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone; other letters stay. Plain ASCII text takes the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER))


def text_key(text: Column) -> Column:
    """A hash that, with a document's id, tells repeated ids with different texts apart; NULL counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def without(docs: DataFrame, dropped: DataFrame, doc_id: Column, text: str) -> DataFrame:
    """The rows of ``docs`` whose id and text key aren't in ``dropped(_id, _t)``, with their columns, whatever their names."""
    rows = docs.select(F.struct("*").alias("_row"), doc_id.alias("_own_id"), text_key(F.col(text)).alias("_own_t"))
    return rows.join(dropped, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_t") == F.col("_t")), "left_anti").select("_row.*")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small, else unmarked for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_slices(texts: pa.Array, rows: int = 500, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """First rows and numbers of rows of slices of a batch: at most ``rows`` rows and, but for a longer text, ``size`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for row, own in enumerate(sizes.tolist()):
        if row > start and (row - start >= rows or total + own > size):
            yield start, row - start
            start, total = row, 0
        total += own
    if start < len(sizes):
        yield start, len(sizes) - start


_held: list = []


def held(owner: object, make: Callable[[], object]) -> object:
    """What ``make`` makes for ``owner``, kept by this worker for later tasks of the same job.

    A worker keeps one thing at a time: what it held for another operator's model is let go first, as workers outlive
    stages and their memory would add up.
    """
    if not _held or _held[0] is not owner:
        _held.clear()
        _held[:] = [owner, make()]
    return _held[1]
