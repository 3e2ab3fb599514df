"""Tables whose versions readers can trust.

Data of a version is written first, under a path of its own. A small pointer file, written last, publishes it. Readers ask the
pointers, so they see the whole version before or the whole one after, never a part; a write that dies leaves files that
no pointer names. Older versions stay readable until they are given up.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialise

POINTER = "version bigint, path string"
PART_POINTER = "version bigint, bucket int"


def _pointers(spark: SparkSession, root: str, schema: str) -> list:
    """All published pointers: one small file per version."""
    try:
        return spark.read.schema(schema).json(f"{root}/published").collect()
    except AnalysisException:
        return []


def _publish(spark: SparkSession, root: str, version: int, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(f"{root}/published/at={version}")


# --- whole tables -------------------------------------------------------------------------------------------------


def table_versions(spark: SparkSession, root: str) -> dict[int, str]:
    """Numbers and paths of the published versions."""
    return {r["version"]: r["path"] for r in _pointers(spark, root, POINTER)}


def publish_table(df: DataFrame, root: str, version: int | None = None) -> int:
    """Write ``df`` as the next version, or as ``version``, and publish it. One writer at a time."""
    spark = df.sparkSession
    version = max(table_versions(spark, root), default=0) + 1 if version is None else version
    path = f"{root}/data/{version}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _publish(spark, root, version, [(version, path)], POINTER)
    return version


def read_table(spark: SparkSession, root: str, schema: str | StructType, version: int | None = None) -> DataFrame:
    """The latest published version, or the one asked for; no rows before the first."""
    known = table_versions(spark, root)
    if version is None and not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(known[max(known) if version is None else version])


# --- tables in buckets, of which a version replaces some ----------------------------------------------------------


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _current(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """The version that counts for each bucket, at most as many entries as buckets."""
    current: dict[int, int] = {}
    for r in _pointers(spark, root, PART_POINTER):
        if before is None or r["version"] < before:
            current[r["bucket"]] = max(current.get(r["bucket"], r["version"]), r["version"])
    return current


def _read(spark: SparkSession, root: str, chosen: dict[int, int], schema: str | StructType | None) -> DataFrame:
    if not chosen:
        if schema is None:
            raise ValueError(f"nothing is published below {root}")
        return spark.createDataFrame([], schema)
    paths = [f"{root}/data/bucket={b}/version={v}" for b, v in sorted(chosen.items())]
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def read_buckets(spark: SparkSession, root: str, schema: str | StructType | None = None) -> DataFrame:
    """All rows, of each bucket in its latest published version. Without a schema the files tell it."""
    return _read(spark, root, _current(spark, root), schema)


def merge_buckets(
    rows: DataFrame, root: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], order: list[str] | None = None,
    buckets: int = 256, version: int | None = None,
) -> int:
    """Merge ``rows`` into the buckets by ``keys`` that they touch; files of the others stay as they are.

    ``merge(old, new)`` gives the new rows of the touched buckets. A bucket is written in ranges of ``order``, so a large one
    is many files of even size. Repeating a version starts from the versions before it and replaces its own files, so it
    changes nothing. One writer at a time; ``keys`` and ``buckets`` belong to the table.
    """
    spark = rows.sparkSession
    new = materialise(rows, "arrived")
    spread = new.select(bucket_of(keys, buckets).alias("bucket")).distinct().collect()
    touched = {r["bucket"] for r in spread}
    if version is None:
        version = max(_current(spark, root).values(), default=0) + 1
    old = _read(spark, root, {b: v for b, v in _current(spark, root, version).items() if b in touched}, rows.schema)
    merged = merge(old, new).select(*rows.columns).withColumn("bucket", bucket_of(keys, buckets)).withColumn("version", F.lit(version))
    if touched:
        merged.repartitionByRange("bucket", *(order or keys)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket", "version").parquet(f"{root}/data")
    _publish(spark, root, version, [(version, b) for b in sorted(touched)], PART_POINTER)
    return version


def drop_superseded(spark: SparkSession, root: str) -> int:
    """Delete the files of buckets' versions that a later published one replaces; how many folders went.

    Call it when no reader works on an older version.
    """
    current = _current(spark, root)
    gone = {(r["bucket"], r["version"]) for r in _pointers(spark, root, PART_POINTER) if r["version"] < current[r["bucket"]]}
    for bucket, version in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/bucket={bucket}/version={version}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)
