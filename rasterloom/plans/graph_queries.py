"""Workflow graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import materialise
from ..sources import workflows as W
from .registry import query


def _ends(t, node):
    return t.orders.select(F.col("o_orderkey").alias("graph_id"), F.lit(node).alias("node_id"))


UP = """
with up as (select graph_id, src as node_id from graphs_fx where dst = 'end'
  union select e.graph_id, e.src from graphs_fx e join up on up.graph_id = e.graph_id and up.node_id = e.dst),
down as (select graph_id, dst as node_id from graphs_fx where src = 'start'
  union select e.graph_id, e.dst from graphs_fx e join down on down.graph_id = e.graph_id and down.node_id = e.src),
members as (select * from (select * from up intersect select * from down)
  union select o_orderkey, 'start' from orders union select o_orderkey, 'end' from orders)
"""


@query("grf1_upstream_reach", UP + "select graph_id, node_id from up", "graphs_fx")
def _(t):
    return G.upstream(t.graphs_fx, _ends(t, "end"))[0]


@query("grf1_upstream_edges", UP + """
select graph_id, src, src_slot, dst, dst_input, link_type from graphs_fx e where dst = 'end' or exists (select 1 from up where up.graph_id = e.graph_id and up.node_id = e.dst)""",
       "graphs_fx")
def _(t):
    return G.upstream(t.graphs_fx, _ends(t, "end"))[1]


@query("grf1_customer_ancestors", """
with up as (select src as node_id from edges_fx where starts_with(dst, 'o') union select e.src from edges_fx e join up on up.node_id = e.dst)
select 0 as graph_id, node_id from up""", "edges_fx")
def _(t):
    edges = t.edges_fx.withColumn("graph_id", F.lit(0))
    orders = t.orders.select(F.lit(0).alias("graph_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"))
    return G.upstream(edges, orders)[0]


@query("grf2_downstream_reach", UP + """
, used as (select graph_id, src, dst from graphs_fx e where dst = 'end' or exists (select 1 from up where up.graph_id = e.graph_id and up.node_id = e.dst)),
inner_nodes as (select graph_id, dst as node_id from used where src = 'start' union select e.graph_id, e.dst from used e join inner_nodes i on i.graph_id = e.graph_id and i.node_id = e.src)
select graph_id, node_id from inner_nodes""", "graphs_fx")
def _(t):
    return G.inner(t.graphs_fx, _ends(t, "start"), _ends(t, "end"))


@query("grf3_subgraph_between", UP + "select graph_id, node_id from members", "graphs_fx")
def _(t):
    return G.between(t.graphs_fx, _ends(t, "start"), _ends(t, "end"))


@query("set2_reach_intersection", UP + "select graph_id, node_id from members", "graphs_fx")
def _(t):
    return G.reached_both_ways(t.graphs_fx, _ends(t, "start"), _ends(t, "end"))


@query("grf4_edge_classification", UP + """
select e.graph_id, src, src_slot, dst, dst_input, link_type, case when s.node_id is not null then 'internal' else 'boundary' end as kind,
  case when dst = 'end' then 'Recurse' else dst end as copy_dst, case when s.node_id is not null and src = 'end' then 'Recurse' else src end as copy_src
from graphs_fx e join members d on d.graph_id = e.graph_id and d.node_id = e.dst left join members s on s.graph_id = e.graph_id and s.node_id = e.src""", "graphs_fx")
def _(t):
    return G.classify_between(t.graphs_fx, _ends(t, "start"), _ends(t, "end"))


def _workflow_documents(t):
    """One saved workflow per order line: loop start, a step, loop end, and an unconnected input."""
    links = F.concat(
        F.lit('[[1, 1, 0, 3, 0, "FLOW_CONTROL"], [2, 1, 1, 2, 0, "IMAGE"], [3, 2, '), F.col("l_linenumber").cast("string"),
        F.lit(', 3, 1, "IMAGE"]]'),
    )
    nodes = F.concat(
        F.lit('[{"id": 1, "type": "start", "inputs": []}, {"id": 2, "type": "step_'), F.col("l_partkey").cast("string"),
        F.lit('", "inputs": [{"name": "image", "type": "IMAGE", "link": 2}, {"name": "mask", "link": null}]}, '
              '{"id": 3, "type": "end", "inputs": [{"name": "flow", "link": 1}, {"name": "processed_image", "link": 3}], "mode": 0}]'),
    )
    document = F.concat(F.lit('{"id": "x", "nodes": '), nodes, F.lit(', "links": '), links, F.lit(', "version": 0.4}'))
    return t.lineitem.select(F.col("l_orderkey").alias("graph_id"), document.alias("document"))


@query("src6_workflow_edges", """
select l_orderkey as graph_id, '1' as src, 0 as src_slot, '3' as dst, 'flow' as dst_input, 'FLOW_CONTROL' as link_type from lineitem
union all select l_orderkey, '1', 1, '2', 'image', 'IMAGE' from lineitem
union all select l_orderkey, '2', l_linenumber, '3', 'processed_image', 'IMAGE' from lineitem""")
def _(t):
    return W.parse_workflows(_workflow_documents(t), "document")[1]


@query("src6_workflow_nodes", """
select l_orderkey as graph_id, '1' as node_id, 'start' as type from lineitem union all select l_orderkey, '2', 'step_' || l_partkey from lineitem
union all select l_orderkey, '3', 'end' from lineitem""")
def _(t):
    return W.parse_workflows(_workflow_documents(t), "document")[0]


def _loops(t):
    """One saved loop per order, with controls of all types, one of them fed by a link in every other order."""
    key, even = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 2 == 0
    fed = F.when(even, ', {"name": "crf", "link": 4}').otherwise("")
    document = F.concat(
        F.lit('{"nodes": [{"id": 1, "type": "start", "inputs": [], "widgets_values": ["in/'), key, F.lit('.mp4", "src", false, 0]}, '
              '{"id": 2, "type": "step", "inputs": [{"name": "image", "link": 2}], "widgets_values": ['), F.col("o_custkey").cast("string"),
        F.lit(', 0.5, true, null, "p\\"q", [1, "a"]]}, {"id": 3, "type": "end", "inputs": [{"name": "flow", "link": 1}, {"name": "image", "link": 3}'), fed,
        F.lit('], "widgets_values": {"output": "out.mp4", "crf": 19}}, {"id": 4, "type": "step", "inputs": [], "widgets_values": [1]}], '
              '"links": [[1, 1, 0, 3, 0, "FLOW"], [2, 1, 1, 2, 0, "IMAGE"], [3, 2, 0, 3, 1, "IMAGE"], [4, 4, 0, 3, 2, "INT"]]}'),
    )
    return t.orders.select(F.col("o_orderkey").alias("graph_id"), document.alias("document"))


CONTROLS = [("start", 0, "video"), ("start", 1, "folder"), ("start", 2, "clear"), ("start", 3, "loop_index"), ("step", 0, "strength"), ("step", 1, "gain"),
            ("step", 2, "on"), ("step", 4, "label"), ("step", 5, "list")]


@query("grf4_literal_inputs", """
select o_orderkey as graph_id, null::varchar as src, dst, dst_input, 'boundary' as kind, copy_dst, value from orders,
  lateral (values ('1', 'video', '1', '"in/' || o_orderkey || '.mp4"'), ('1', 'folder', '1', '"src"'), ('1', 'clear', '1', 'false'), ('1', 'loop_index', '1', '7'),
    ('2', 'strength', '2', o_custkey::varchar), ('2', 'gain', '2', '0.5'), ('2', 'on', '2', 'true'), ('2', 'control_3', '2', 'null'),
    ('2', 'label', '2', '"p\\"q"'), ('2', 'list', '2', '[1,"a"]'), ('3', 'output', 'Recurse', '"out.mp4"'),
    ('3', 'crf', 'Recurse', case when o_orderkey % 2 = 1 then '19' end)) as l(dst, dst_input, copy_dst, value) where value is not null
union all select o_orderkey, src, dst, dst_input, kind, copy_dst, null from orders,
  (values ('1', '3', 'flow', 'internal', 'Recurse'), ('1', '2', 'image', 'internal', '2'), ('2', '3', 'image', 'internal', 'Recurse'), ('4', '3', 'crf', 'boundary', 'Recurse')) as e(src, dst, dst_input, kind, copy_dst)
  where dst_input <> 'crf' or o_orderkey % 2 = 0""")
def _(t):
    """Whole loop bodies: links inside, links from outside, and literals with the next loop position."""
    docs = _loops(t)
    edges = materialise(W.parse_workflows(docs, "document")[1].where("dst_input is not null"), "edges")
    at = lambda node: docs.select("graph_id", F.lit(node).alias("node_id"))
    controls = t.spark.createDataFrame(CONTROLS, "type string, position int, input string")
    literals = W.literal_inputs(docs, "document", controls)
    members = materialise(G.between(edges, at("1"), at("3")), "members")
    found = G.classify_inputs(edges, literals, members, at("1"), at("3"), next_index=7)
    return found.select("graph_id", "src", "dst", "dst_input", "kind", "copy_dst", "value")
