"""Exact duplicates through a persistent index of text digests, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch_path


def normal_text(text: Column) -> Column:
    """The text without ASCII white space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


class DigestIndex:
    """Digests of every text seen so far with the row that stays, as a table in ``buckets`` sorted buckets.

    The files below ``path`` are the index; any later session opens them again with the same number of buckets. New
    data is reduced to one row per digest, merged against the buckets by an anti-join without moving them, and appended.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = path or scratch_path(spark, "digest-index")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {self.name} (digest binary, keep_id bigint, keep_chars bigint) using parquet "
            f"clustered by (digest) sorted by (digest) into {buckets} buckets location '{self.path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> DataFrame:
        """Take in ``rows(doc_id, digest, chars)``; returns ``digest, keep_id, keep_chars, group_size`` per digest.

        Of equal new texts the one with most characters, then the smallest id stays (a NULL id comes last); a digest
        that the index already holds keeps the row stored first. Adding the same rows again appends nothing.
        """
        order = F.struct("chars", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus_id"))
        best = rows.groupBy("digest").agg(F.max(order).alias("best"), F.count("*").alias("group_size"))
        best = materialise(best.select(
            "digest", (-F.col("best.minus_id")).alias("keep_id"), F.col("best.chars").alias("keep_chars"), "group_size"),
            "digests")
        fresh = best.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        (fresh.select("digest", "keep_id", "keep_chars").repartition(self.buckets, "digest")
         .sortWithinPartitions("digest").write.insertInto(self.name))
        self.spark.catalog.refreshTable(self.name)
        return best.select("digest", "group_size").join(self.table().hint("merge"), "digest")

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"drop table {self.name}")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, chars`` of every row: SHA-256 of the normal text, code points of the original."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.unhex(F.sha2(normal_text(content), 256)).alias("digest"),
        F.length(content).cast("bigint").alias("chars"))


def mark_duplicates(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` for every row, dropped ones too.

    Repeated rows under one id share their answer. Rows without an id are kept only where no equal text has one.
    """
    rows = materialise(digests(docs, doc_id, text), "hashed")
    groups = materialise((index or DigestIndex(docs.sparkSession)).add(rows), "groups")
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("kept"), "digest")


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: exactly one per text that the index didn't hold before.

    Which of several wholly equal best rows stays doesn't matter, and only one does.
    """
    index = index or DigestIndex(docs.sparkSession)
    known = materialise(index.table().select("digest"), "known")
    rows = materialise(digests(docs, doc_id, text), "hashed")
    keep = materialise(index.add(rows).join(known, "digest", "left_anti"), "keepers").select("digest", "keep_id", "keep_chars")
    content = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select(
        F.struct("*").alias("_row"), F.unhex(F.sha2(normal_text(content), 256)).alias("digest"),
        F.col(doc_id).cast("bigint").alias("_id"), F.length(content).cast("bigint").alias("_chars"))
    best = marked.join(keep, [
        marked["digest"] == keep["digest"], marked["_chars"] == keep["keep_chars"],
        marked["_id"].eqNullSafe(keep["keep_id"])], "left_semi")
    first = Window.partitionBy("digest").orderBy("_id", "_chars")
    return best.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_row.*")
