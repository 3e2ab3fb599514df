"""Saved workflow documents as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import let

# A link is a mixed array: id, source node, source slot, target node, target slot, type.
WORKFLOW_SCHEMA = (
    "nodes array<struct<id:string, type:string, inputs:array<struct<name:string, link:string>>>>, "
    "links array<array<string>>"
)


# Nodes alone need neither inputs nor links, and the parser skips what a schema leaves out.
NODE_SCHEMA = "nodes array<struct<id:string, type:string>>"


def parse_workflows(df: DataFrame, column: str, graph_id: str = "graph_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the documents in ``column``, one document per row."""
    key = F.col(graph_id).alias("graph_id")
    named = df.select(key, F.from_json(column, NODE_SCHEMA).alias("w"))
    nodes = named.select("graph_id", F.inline("w.nodes").alias("node_id", "type"))
    parsed = df.select(key, F.from_json(column, WORKFLOW_SCHEMA).alias("w"))
    no_inputs = F.array().cast("array<struct<name:string, link:string>>")
    inputs = F.flatten(F.transform("w.nodes", lambda n: F.coalesce(n["inputs"], no_inputs)))

    def edge(link, known):
        return F.struct(
            link[1].alias("src"), link[2].try_cast("int").alias("src_slot"), link[3].alias("dst"),
            F.get(known["names"], (F.array_position(known["links"], link[0]) - 1).cast("int")).alias("dst_input"),
            link[5].alias("link_type"),
        )

    def apart(inputs):
        """Link ids and names as two arrays, so that finding an id compares plain strings and builds nothing."""
        return F.struct(F.transform(inputs, lambda i: i["link"]).alias("links"), F.transform(inputs, lambda i: i["name"]).alias("names"))

    links = let(let(inputs, apart), lambda known: F.transform("w.links", lambda link: edge(link, known)))
    return nodes, parsed.select("graph_id", F.inline(links))


# The values of a node's own controls are a mixed array in a fixed order, or an object by name.
CONTROL_SCHEMA = "nodes array<struct<id:string, type:string, inputs:array<struct<name:string, link:string>>, widgets_values:variant>>"


def literal_inputs(df: DataFrame, column: str, controls: DataFrame, graph_id: str = "graph_id") -> DataFrame:
    """``graph_id, node_id, input, value``: the inputs that hold a literal, ``value`` as JSON text of whatever type.

    ``controls(type, position, input)`` names the controls of each node type by their position from 0; one without a
    name there is called ``control_<position>``. A control that a link feeds holds no literal.
    """
    nodes = df.select(F.col(graph_id).alias("graph_id"), F.inline(F.from_json(column, CONTROL_SCHEMA)["nodes"])).select(
        "graph_id", F.col("id").alias("node_id"), "type",
        F.transform(F.filter(F.coalesce("inputs", F.array().cast("array<struct<name:string, link:string>>")), lambda i: i["link"].isNotNull()), lambda i: i["name"]).alias("linked"),
        F.try_variant_get("widgets_values", "$", "array<variant>").alias("listed"),
        F.try_variant_get("widgets_values", "$", "map<string, variant>").alias("named"))
    # Both forms in one array, so that a document is parsed once.
    value = "array<struct<position:int, input:string, v:variant>>"
    by_place = F.transform("listed", lambda v, i: F.struct(i.alias("position"), F.lit(None).cast("string").alias("input"), v.alias("v")))
    by_name = F.transform(F.map_entries("named"), lambda e: F.struct(F.lit(None).cast("int").alias("position"), e["key"].alias("input"), e["value"].alias("v")))
    held = F.concat(*(F.coalesce(values, F.array().cast(value)) for values in (by_place, by_name)))
    rows = nodes.select("graph_id", "node_id", "type", "linked", F.inline(held))
    # Node types are code, so their controls are few whatever the number of documents.
    names = F.broadcast(controls.select("type", "position", F.col("input").alias("_name")))
    found = rows.join(names, ["type", "position"], "left").withColumn(
        "input", F.coalesce("input", "_name", F.concat(F.lit("control_"), "position")))
    free = found.where(~F.array_contains("linked", F.col("input")))
    return free.select("graph_id", "node_id", "input", F.coalesce(F.to_json("v"), F.lit("null")).alias("value"))


def read_workflows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all workflow files under ``path``; a graph is known by its file."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("graph_id"), "value")
    return parse_workflows(texts, "value")
