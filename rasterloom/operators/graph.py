"""Reachability and loop bodies over tables of workflow edges (graph_id, src, …, dst, …).

Graphs of up to ``SMALL`` rows, which workflows are, move once: the rows of a graph meet in a task, which walks many graphs
at a time. Larger ones advance together in rounds; a round writes its new nodes to the shared folder, so lineage stays
short and a lost executor repeats one round only. Their links are stored once in buckets of their near node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..session import materialise, materialise_buckets

# Fixed value: the id the loop end carries in its own copy.
LOOP_END_ID = "Recurse"

NODE = ["graph_id", "node_id"]
# Graphs of more rows (links, and the nodes named with them) are walked in rounds.
SMALL = 4000
# Rows of small graphs that a task takes.
TASK_ROWS = 400_000
# Rounds of single hops before chains are condensed.
HOPS = 4


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _step(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes one link on; copies collapse before the shuffle, so a hub that everything points to is one row per task."""
    return nodes.join(links, NODE).select("graph_id", F.col("_next").alias("node_id")).distinct()


def _visited(edges: DataFrame, seeds: DataFrame, near: str, far: str) -> DataFrame:
    """Seeds and everything reached from ``near`` to ``far``.

    The first rounds go one hop each, which is all that shallow graphs need. If nodes remain, ``_beyond`` takes over.
    """
    links = edges.select("graph_id", F.col(near).alias("node_id"), F.col(far).alias("_next")).where("_next is not null")
    links = materialise_buckets(links, "links", *NODE)
    frontier = materialise(seeds.select(*NODE).where("graph_id is not null and node_id is not null").distinct(), "seeds")
    visited = [frontier]
    for _ in range(HOPS):
        if frontier.isEmpty():
            return _union(visited)
        frontier = materialise(_step(frontier, links).join(_union(visited), NODE, "left_anti"), "reached")
        visited.append(frontier)
    if not frontier.isEmpty():
        visited.append(_beyond(links, frontier).join(_union(visited), NODE, "left_anti"))
    return _union(visited)


def _chains(links: DataFrame) -> list[DataFrame]:
    """Pointers (graph_id, node_id, to, on) of the nodes with one successor, level by level.

    A pointer of level ``k`` is ``2 ** k`` links long, or ends earlier at a node with another number of successors, where
    ``on`` is false; nodes whose pointer ended have none on later levels. What is still ``on`` at the last level runs
    in a circle of such nodes.
    """
    single = links.groupBy(*NODE).agg(F.min("_next").alias("to"), F.max("_next").alias("_last")).where("to = _last").select(*NODE, "to")
    single = materialise_buckets(single, "single", *NODE)
    known = single.select("graph_id", F.col("node_id").alias("to"), F.lit(True).alias("on"))
    levels = [materialise(single.join(known, ["graph_id", "to"], "left").select(*NODE, "to", F.coalesce("on", F.lit(False)).alias("on")), "pointers")]
    longest = single.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    ended = []
    while 2 ** (len(levels) - 1) < longest and not (on := levels[-1].where("on")).isEmpty():
        ended.append(levels[-1].where("not on"))
        further = _union([*ended, on]).select("graph_id", F.col("node_id").alias("to"), F.col("to").alias("_to"), F.col("on").alias("_on"))
        doubled = on.select(*NODE, "to").join(further, ["graph_id", "to"])
        levels.append(materialise(doubled.select(*NODE, F.col("_to").alias("to"), F.col("_on").alias("on")), "pointers"))
    return levels


def _beyond(links: DataFrame, frontier: DataFrame) -> DataFrame:
    """Everything reached from ``frontier``, in rounds that grow with the logarithm of the length of chains.

    Chains of nodes with one successor are passed in one hop, from where they are entered to where they end. The nodes
    between are marked afterwards: pointers of all lengths, applied one after the other to all that is marked, reach every
    node of a chain, as every distance is a sum of different powers of two.
    """
    levels = _chains(links)
    last = levels[-1].select(*NODE, F.when(~F.col("on"), F.col("to")).alias("to"))
    ends = materialise_buckets(_union([*(p.where("not on").select(*NODE, "to") for p in levels[:-1]), last]).withColumn("_single", F.lit(True)), "ends", *NODE)

    def heads(nodes: DataFrame) -> DataFrame:
        """Where the chains that begin at ``nodes`` end; nodes on none stand for themselves, circles have no end."""
        found = nodes.join(ends, NODE, "left").select("graph_id", F.when(F.col("_single"), F.col("to")).otherwise(F.col("node_id")).alias("node_id"))
        return found.where("node_id is not null").distinct()

    entered, new = [frontier], materialise(heads(frontier), "heads")
    passed = [new]
    while not new.isEmpty():
        entered.append(materialise(_step(new, links).join(_union(entered), NODE, "left_anti"), "entered"))
        new = materialise(heads(entered[-1]).join(_union(passed), NODE, "left_anti"), "heads")
        passed.append(new)
    # Ends are passed already, and no chain or circle is longer than the last pointers.
    marked = [_union([*entered, *passed]).distinct()]
    for pointers in levels[:-1]:
        more = _union(marked).join(pointers, NODE).select("graph_id", F.col("to").alias("node_id")).distinct()
        marked.append(materialise(more.join(_union(marked), NODE, "left_anti"), "marked"))
    return _union(marked).distinct()


def _used(edges: DataFrame, visited: DataFrame, near: str) -> DataFrame:
    known = visited.select("graph_id", F.col("node_id").alias(near))
    return edges.join(known, ["graph_id", near], "left_semi").select(*edges.columns)


# --- small graphs, each whole in a task ---------------------------------------------------------------------------

LINK, START, END, MEMBER = range(4)


def _closure(near: np.ndarray, far: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which nodes are seeds or reached from one; links leave the search once they are passed."""
    visited = seeds.copy()
    while True:
        hit = visited[near]
        new = far[hit]
        new = new[~visited[new]]
        if not new.size:
            return visited
        visited[new] = True
        near, far = near[~hit], far[~hit]


class _Graphs:
    """The graphs of one task: links as pairs of node numbers, and masks over the nodes.

    A node's number stands for its graph and id; an absent id is a node of its own, at which no way begins or goes on.
    """

    def __init__(self, rows: pa.Table):
        self.rows = rows
        numbered = lambda column: pa.chunked_array(column, type=column[0].type).combine_chunks().dictionary_encode()
        graphs = numbered(rows["graph_id"].chunks)
        names = numbered([*rows["src"].chunks, *rows["dst"].cast(rows["src"].type).chunks])
        self.graphs, self.names = graphs.dictionary, names.dictionary
        code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.width = len(self.names) + 1
        graph = graphs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.nodes, place = np.unique(np.concatenate([graph, graph]) * self.width + code, return_inverse=True)
        self.role = rows["_role"].to_numpy()
        self.near, self.far = place[: len(graph)], place[len(graph):]
        self.link = self.role == LINK
        self.src, self.dst = self.near[self.link], self.far[self.link]
        self.named = self.nodes % self.width > 0

    def marked(self, places: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(self.nodes), dtype=bool)
        mask[places] = True
        return mask

    def of(self, role: int) -> np.ndarray:
        return self.marked(self.near[self.role == role]) & self.named

    def passed(self, near: np.ndarray, far: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Which links have a near end that is a seed or reached from one."""
        whole = self.named[near] & self.named[far]
        return _closure(near[whole], far[whole], seeds)[near]

    def up(self) -> np.ndarray:
        return self.passed(self.dst, self.src, self.of(END))

    def down(self) -> np.ndarray:
        return self.passed(self.src, self.dst, self.of(START))

    def masks(self, wanted: tuple[str, ...]) -> dict[str, np.ndarray]:
        """Masks over the nodes: ancestors of an end, descendants of a start, those of them by links towards an end, and starts and ends."""
        found = {}
        up = self.up() if {"up", "inner"} & set(wanted) else None
        if "up" in wanted:
            found["up"] = self.marked(self.src[up])
        if "down" in wanted:
            found["down"] = self.marked(self.dst[self.down()])
        if "inner" in wanted:
            src, dst = self.src[up], self.dst[up]
            found["inner"] = self.marked(dst[self.passed(src, dst, self.of(START))])
        if "given" in wanted:
            found["given"] = self.marked(self.near[(self.role == START) | (self.role == END)])
        return found


def _node_rows(wanted: tuple[str, ...]):
    """For mapInArrow: one row per node that is in a mask, with all masks asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (rows := [b for b in batches if b.num_rows]):
            return
        g = _Graphs(pa.Table.from_batches(rows))
        masks = g.masks(wanted)
        kept = np.flatnonzero(np.logical_or.reduce(list(masks.values())))
        code = g.nodes[kept] % g.width
        columns = [g.graphs.take(pa.array(g.nodes[kept] // g.width)), g.names.take(pa.array(code - 1, mask=code == 0))]
        found = pa.table([*columns, *(pa.array(m[kept]) for m in masks.values())], names=[*NODE, *(f"_{w}" for w in masks)])
        yield from found.to_batches(max_chunksize=10_000)

    return run


def _link_rows(wanted: str):
    """For mapInArrow: links on a way (``up``, ``down``), or those into ``members`` or nodes ``between``, and what is known about both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (rows := [b for b in batches if b.num_rows]):
            return
        g = _Graphs(pa.Table.from_batches(rows))
        links = g.rows.filter(pa.array(g.link)).drop_columns(["_role"])
        if wanted in ("up", "down"):
            found = links.filter(pa.array(g.up() if wanted == "up" else g.down()))
        else:
            starts, ends = g.of(START), g.of(END)
            members = g.of(MEMBER) if wanted == "members" else g.named & np.logical_or.reduce(list(g.masks(("inner", "given")).values()))
            kept = members[g.dst]
            found = links.filter(pa.array(kept))
            for name, mask in (("_inside", members[g.src]), ("_dst_starts", starts[g.dst]), ("_dst_ends", ends[g.dst]), ("_src_ends", ends[g.src])):
                found = found.append_column(name, pa.array(mask[kept]))
        yield from found.to_batches(max_chunksize=10_000)

    return run


class _Split:
    """Edges and nodes named with them (by role), apart by the size of their graph.

    ``large`` is None or the edges and nodes of large graphs. Their ids alone are broadcast, one for ``SMALL`` rows at most.
    """

    def __init__(self, edges: DataFrame, named: dict[int, DataFrame]):
        parts = [edges, *(df.select(*NODE) for df in named.values())]
        ids = _union([df.select("graph_id") for df in parts])
        total = ids.count()
        ids = ids.where("graph_id is not null")
        # Rows by remainders of a hash, about a third of SMALL in each: where none has more than SMALL rows, no graph has.
        shared = ids.groupBy(F.pmod(F.xxhash64("graph_id"), F.lit(3 * total // SMALL + 1)).alias("_shared")).count()
        largest = total if total <= SMALL else shared.agg(F.max("count")).first()[0]
        sizes = ids.groupBy("graph_id").count()
        if (largest or 0) > SMALL:
            largest = sizes.agg(F.max("count")).first()[0]
        self.large = None
        if (largest or 0) > SMALL:
            big = F.broadcast(materialise(sizes.where(F.col("count") > SMALL).select("graph_id"), "large"))
            above = [df.join(big, "graph_id", "left_semi").select(*df.columns) for df in parts]
            self.large = above[0], dict(zip(named, above[1:]))
            parts = [df.join(big, "graph_id", "left_anti").select(*df.columns) for df in parts]
        self.edges, self.named, self.tasks = parts[0], dict(zip(named, parts[1:])), total // TASK_ROWS + 1

    def _rows(self, edges: DataFrame) -> DataFrame:
        """Small graphs, dealt out by graph: links and named nodes with their role."""
        rows = edges.withColumn("_role", F.lit(LINK))
        for role, nodes in self.named.items():
            nodes = nodes.select("graph_id", F.col("node_id").alias("src"), F.lit(role).alias("_role"))
            rows = rows.unionByName(nodes, allowMissingColumns=True)
        return rows.where("graph_id is not null").repartition(self.tasks, "graph_id")

    def nodes(self, *wanted: str) -> DataFrame:
        """Nodes of small graphs that are in one of the ``wanted`` sets, with a column ``_up``, ``_down``, … for each."""
        rows = self._rows(self.edges.select("graph_id", "src", "dst"))
        kind = lambda name: rows.schema[name].dataType.simpleString()
        return rows.mapInArrow(_node_rows(wanted), ", ".join([f"graph_id {kind('graph_id')}, node_id {kind('src')}", *(f"_{w} boolean" for w in wanted)]))

    def links(self, wanted: str, *flags: str) -> DataFrame:
        """Edges of small graphs: those passed ``up`` or ``down``, or those into members with ``flags`` about both ends."""
        rows = self._rows(self.edges)
        fields = [f for f in rows.schema if f.name != "_role"] + [StructField(f, BooleanType()) for f in flags]
        found = rows.mapInArrow(_link_rows(wanted), StructType(fields))
        return found.select(*(F.col(f.name).cast(f.dataType) for f in self.edges.schema), *flags)


# --- graphs of any size -------------------------------------------------------------------------------------------


def _walked(edges: DataFrame, seeds: DataFrame, near: str, far: str) -> tuple[DataFrame, DataFrame]:
    """The nodes reached from the seeds in rounds, and the edges passed."""
    used = _used(edges, _visited(edges, seeds, near, far), near)
    return used.select("graph_id", F.col(far).alias("node_id")).distinct(), used


def _walk(edges: DataFrame, seeds: DataFrame, role: int, wanted: str, near: str, far: str) -> tuple[DataFrame, DataFrame]:
    split = _Split(edges, {role: seeds})
    reached, used = split.nodes(wanted).select(F.col("graph_id").cast(edges.schema["graph_id"].dataType), "node_id"), split.links(wanted)
    if split.large is not None:
        more, passed = _walked(split.large[0], split.large[1][role], near, far)
        reached, used = reached.unionByName(more), used.unionByName(passed)
    return reached, used


def upstream(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ancestors of the seeds (graph_id, node_id), and the edges on the way to a seed."""
    return _walk(edges, seeds, END, "up", "dst", "src")


def downstream(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Descendants of the seeds, and the edges leading on from a seed."""
    return _walk(edges, seeds, START, "down", "src", "dst")


def _inner(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    _, towards_end = _walked(edges, ends, "dst", "src")
    # Stored, because every round back from the start reads these edges again.
    return _walked(materialise(towards_end, "used"), starts, "src", "dst")[0]


def inner(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Descendants of the starts by edges that lead on to an end."""
    split = _Split(edges, {START: starts, END: ends})
    found = split.nodes("inner").select(*NODE)
    return found if split.large is None else found.unionByName(_inner(split.large[0], split.large[1][START], split.large[1][END]))


def _of_no_graph(*named: DataFrame) -> DataFrame:
    return _union([df.select(*NODE) for df in named]).where("graph_id is null").distinct()


def between(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes on a way from a graph's start to its end, both included."""
    split = _Split(edges, {START: starts, END: ends})
    found = split.nodes("inner", "given").select(*NODE).unionByName(_of_no_graph(starts, ends))
    if split.large is None:
        return found
    links, named = split.large
    return found.unionByName(_union([_inner(links, named[START], named[END]), *named.values()]).distinct())


def both_ways(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Descendants of the starts, and ancestors of the ends, by one walk: a table of all these nodes is stored once."""
    split = _Split(edges, {START: starts, END: ends})
    found = split.nodes("down", "up")
    if split.large is not None:
        links, named = split.large
        down, up = _walked(links, named[START], "src", "dst")[0], _walked(links, named[END], "dst", "src")[0]
        flagged = lambda df, down: df.select(*NODE, F.lit(down).alias("_down"), F.lit(not down).alias("_up"))
        found = found.unionByName(flagged(down, True).unionByName(flagged(up, False)))
    found = materialise(found, "reached")
    return found.where("_down").select(*NODE), found.where("_up").select(*NODE)


def reach_intersection(down: DataFrame, up: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """The same node set from two given reach tables, whose rows move once."""
    marked = lambda df, name: df.select(*NODE, *(F.lit(n == name).alias(n) for n in ("_down", "_up", "_given")))
    rows = _union([marked(down, "_down"), marked(up, "_up"), marked(starts, "_given"), marked(ends, "_given")])
    sets = rows.groupBy(*NODE).agg(*(F.max(n).alias(n) for n in ("_down", "_up", "_given")))
    return sets.where("(_down and _up) or _given").select(*NODE)


def reached_both_ways(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """``reach_intersection`` of what ``both_ways`` finds; of small graphs neither is stored or moved, as the walk knows both."""
    split = _Split(edges, {START: starts, END: ends})
    found = split.nodes("down", "up", "given").where("(_down and _up) or _given").select(*NODE).unionByName(_of_no_graph(starts, ends))
    if split.large is None:
        return found
    links, named = split.large
    down, up = _walked(links, named[START], "src", "dst")[0], _walked(links, named[END], "dst", "src")[0]
    return found.unionByName(reach_intersection(down, up, named[START], named[END]))


def _facts(starts: DataFrame | None, ends: DataFrame, members: DataFrame) -> dict[int, DataFrame]:
    return {MEMBER: members, END: ends} | ({} if starts is None else {START: starts})


def _inputs(edges: DataFrame, members: DataFrame, ends: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Edges into members, with ``_inside`` (from a member), ``_dst_starts``, ``_dst_ends`` and ``_src_ends``."""
    flags = ["_inside", "_dst_starts", "_dst_ends", "_src_ends"]
    split = _Split(edges, _facts(starts, ends, members))
    found = split.links("members", *flags)
    if split.large is None:
        return found
    links, named = split.large
    known = lambda role, node, flag: named[role].select("graph_id", F.col("node_id").alias(node), F.lit(True).alias(flag)).distinct()
    more = _used(links, named[MEMBER], "dst").join(known(MEMBER, "src", "_inside"), ["graph_id", "src"], "left")
    more = more.join(known(END, "dst", "_dst_ends"), ["graph_id", "dst"], "left").join(known(END, "src", "_src_ends"), ["graph_id", "src"], "left")
    more = more.withColumn("_dst_starts", F.lit(False)) if starts is None else more.join(known(START, "dst", "_dst_starts"), ["graph_id", "dst"], "left")
    return found.unionByName(more.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags}))


def _classified(inputs: DataFrame) -> DataFrame:
    copy = lambda node: F.when(F.col(f"_{node}_ends"), LOOP_END_ID).otherwise(F.col(node))
    internal = F.col("_inside")
    return inputs.withColumns({
        "kind": F.when(internal, "internal").otherwise("boundary"), "copy_dst": copy("dst"),
        "copy_src": F.when(internal, copy("src")).otherwise(F.col("src")),
    }).drop("_inside", "_dst_starts", "_dst_ends", "_src_ends")


def classify_edges(edges: DataFrame, members: DataFrame, ends: DataFrame) -> DataFrame:
    """Inputs of the member nodes: links inside the set, or boundary values taken over as they are.

    Adds ``kind`` and the ids of the copies, in which a loop end has its own name.
    """
    return _classified(_inputs(edges, members, ends))


def classify_between(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """``classify_edges`` of the nodes ``between`` starts and ends; small graphs move once for both."""
    split = _Split(edges, {START: starts, END: ends})
    found = _classified(split.links("between", "_inside", "_dst_starts", "_dst_ends", "_src_ends"))
    if split.large is None:
        return found
    links, named = split.large
    members = materialise(between(links, named[START], named[END]), "members")
    return found.unionByName(classify_edges(links, members, named[END]))


def classify_inputs(
    edges: DataFrame, literals: DataFrame, members: DataFrame, starts: DataFrame, ends: DataFrame, next_index: int | None = None
) -> DataFrame:
    """All inputs of the member nodes: ``classify_edges``, and literals as boundary rows with their ``value``.

    ``literals`` has graph_id, node_id, input, value. With ``next_index`` the copy of each start gets that ``loop_index``,
    whatever fed it before. Literals move once, to what is known about their node.
    """
    columns = ["graph_id", "src", "src_slot", "dst", "dst_input", "link_type", "kind", "copy_dst", "copy_src", "value"]
    nothing = lambda *names: {n: F.lit(None).cast("string") for n in names}
    marked = lambda df, name: df.select(*NODE, *(F.lit(n == name).alias(n) for n in ("_inside", "_starts", "_ends")))
    facts = _union([marked(members, "_inside"), marked(starts, "_starts"), marked(ends, "_ends")]).groupBy(*NODE).agg(
        *(F.max(n).alias(n) for n in ("_inside", "_starts", "_ends")))
    linked = _inputs(edges, members, ends, starts)
    own = literals.select(*NODE, F.col("input").alias("dst_input"), "value").join(facts.where("_inside"), NODE)
    if next_index is not None:
        linked = linked.where(~(F.col("_dst_starts") & F.col("dst_input").eqNullSafe("loop_index")))
        given = facts.where("_starts").withColumns({"dst_input": F.lit("loop_index"), "value": F.lit(str(next_index))})
        own = own.where(~(F.col("_starts") & F.col("dst_input").eqNullSafe("loop_index"))).unionByName(given)
    literal = own.withColumns(nothing("src", "link_type", "copy_src")).withColumns({
        "src_slot": F.lit(None).cast("int"), "dst": F.col("node_id"), "kind": F.lit("boundary"),
        "copy_dst": F.when(F.col("_ends"), LOOP_END_ID).otherwise(F.col("node_id"))})
    return _classified(linked).withColumns(nothing("value")).select(*columns).unionByName(literal.select(*columns))
