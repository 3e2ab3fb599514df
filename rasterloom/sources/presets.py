"""The preset catalogue as a table: nested JSON documents to ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A map schema keeps the key order of the text; inferred structs would sort keys by name.
CATALOGUE_SCHEMA = "map<string, map<string, array<struct<ratio:string, label:string, width:int, height:int>>>>"


def flatten_presets(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """One row per preset item, with the position of model, resolution and item in their document."""
    keep = keep or []
    models = df.select(*keep, F.posexplode(F.from_json(column, CATALOGUE_SCHEMA)).alias("model_ord", "model", "_r"))
    resolutions = models.select(*keep, "model", "model_ord", F.posexplode("_r").alias("res_ord", "resolution", "_i"))
    items = resolutions.select(
        *keep, "model", "model_ord", "resolution", "res_ord", F.posexplode("_i").alias("item_ord", "_item")
    )
    return items.select(
        *keep, "model", "model_ord", "resolution", "res_ord", "item_ord",
        "_item.ratio", "_item.label", "_item.width", "_item.height",
    )


def read_presets(spark: SparkSession, path: str, one_document_per_line: bool = False) -> DataFrame:
    """Scan catalogue files; a document is a whole file or, for large collections, one line."""
    text = spark.read.text(path, wholetext=not one_document_per_line)
    return flatten_presets(text, "value")
