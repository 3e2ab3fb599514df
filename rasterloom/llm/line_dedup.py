"""Repeated lines, counted in levelled sorted runs of line hashes.

Documents come in batches. A batch is reduced to its line hashes with the number of documents that hold each; hashes that
a run already knows to be repeated are taken out by merge anti-joins with the runs, and the others are written as the
batch's own run. When a level holds ``fanout`` runs they are merged into one run of the next level, whose counts add up, so
a hash is rewritten as often as there are levels: the logarithm of the number of batches. All runs are cut and sorted by
hash alike, so neither the anti-joins nor the merging move them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import ascii_lower, small, text_key

#: A line that stands in at least this many documents is dropped, if its key has at least so many code points.
DOCUMENTS = 10
CHARS = 1
#: The corpus is counted in this many batches; a level is merged when it has this many runs.
BATCHES = 4
FANOUT = 2
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def line_hashes(text: Column, chars: int = CHARS) -> Column:
    """The 128-bit hash of each line's key, in order; NULL for keys of fewer than ``chars`` code points."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    keys = F.transform(lines, line_key)
    return F.transform(keys, lambda key: F.when(F.length(key) >= chars, F.md5(key)))


class LineRuns:
    """Runs ``(hash, n)`` by level: ``n`` documents of some batches hold a line of that hash.

    A hash that one run holds with ``documents`` or more is settled: later batches don't count it on. Every run is a
    written table, so lost executors repeat one batch or one merging at most.
    """

    def __init__(self, spark: SparkSession, documents: int = DOCUMENTS, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.documents, self.fanout = spark, documents, fanout
        self.buckets = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, hashes: DataFrame) -> None:
        """Take in a batch: rows ``hashes``, an array per document. A document belongs to one batch."""
        counted = hashes.select(F.explode(F.array_distinct("hashes")).alias("hash")).where("hash is not null").groupBy("hash").agg(F.count("*").alias("n"))
        for run in self.runs():
            settled = run.where(F.col("n") >= self.documents).select("hash")
            counted = counted.join(settled.hint("merge"), "hash", "left_anti")
        self._place(self._written(counted), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self._written(self._merged(self.levels[level])), []
            self._place(merged, level + 1)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.withColumnRenamed("n", "_a").join(b.withColumnRenamed("n", "_b").hint("merge"), "hash", "full_outer")
            return both.select("hash", (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("n"))

        return reduce(merge, runs)

    def _written(self, counted: DataFrame) -> DataFrame:
        """``counted`` as a table in sorted buckets; its name is given back at once, the files stay."""
        name = f"line_run_{uuid.uuid4().hex}"
        (counted.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash")
         .option("path", scratch_path(self.spark, "line-run")).saveAsTable(name))
        run = self.spark.table(name)
        self.spark.sql(f"drop table {name}")
        return run

    def repeated(self) -> DataFrame:
        """``hash`` of every line that stands in at least ``documents`` documents of all batches."""
        runs = self.runs()
        if not runs:
            return self.spark.range(0).select(F.lit("").alias("hash"))
        return self._merged(runs).where(F.col("n") >= self.documents).select("hash")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (id, text, gone): (id, n_lines, n_dropped, kept)."""
    for batch in batches:
        totals, dropped, kept = [], [], []
        for text, gone in zip(batch.column(1), batch.column(2), strict=True):
            lines = (text.as_py() or "").split("\n")
            places = set(gone.as_py() or ())
            totals.append(len(lines))
            dropped.append(len(places))
            kept.append("\n".join(line for i, line in enumerate(lines) if i not in places) if places else text.as_py() or "")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
            [batch.schema.names[0], "n_lines", "n_dropped", "kept"])


def drop_repeated_lines(
    docs: DataFrame, runs: LineRuns | None = None, doc_id: str = "doc_id", text: str = "text", chars: int = CHARS,
    batches: int = BATCHES, result: Callable[[Column], Column] = lambda kept: kept,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` for every row of ``docs``.

    Texts are split at line feeds; a NULL or empty text is one empty line. A line goes from every document if its key
    (``line_key``) has ``chars`` code points or more and stands in at least ``runs.documents`` documents. ``kept`` is
    ``result`` of the other lines joined by line feeds. Every row is a document: repeated rows, and rows that share an id
    or have none, count one by one and are answered one by one. ``runs`` may hold batches of earlier documents, whose lines
    count too; the batches of ``docs`` are added to it. Columns besides id and text don't matter.
    """
    spark = docs.sparkSession
    runs = runs or LineRuns(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("k"))
    hashed = rows.select(
        "doc_id", "k", line_hashes(F.col("text"), chars).alias("hashes"), F.pmod(F.xxhash64("doc_id", "k"), F.lit(batches)).alias("batch"))
    path = scratch_path(spark, "line-hashes")
    hashed.write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema(hashed.schema).parquet(path)
    for batch in range(batches):
        runs.add(hashed.where(F.col("batch") == batch))
    repeated = small(materialise(runs.repeated(), "repeated-lines"))
    lines = hashed.select("doc_id", "k", F.posexplode("hashes").alias("pos", "hash")).where("hash is not null")
    gone = lines.join(repeated, "hash", "left_semi").groupBy("doc_id", "k").agg(F.collect_set("pos").alias("gone"))
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.k") == F.col("g.k"))
    found = rows.alias("d").join(materialise(gone, "gone-lines").alias("g").hint("merge"), same, "left").select("d.doc_id", "d.text", "g.gone")
    kind = rows.schema["doc_id"].dataType.simpleString()
    answered = found.mapInArrow(_kept, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept string")
    return answered.withColumn("kept", result(F.col("kept")))
