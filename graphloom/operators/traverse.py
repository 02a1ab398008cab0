"""Bounded traversal: reverse reach (impact), forward reach (context), neighbours.

A hop starts from its frontier: the frontier's edges are looked up, what was visited is taken away, and node rows are joined to what is
new alone. So a point query costs what it reaches, cycles are walked once, and an empty frontier ends it. Each hop's rows are
a written table, so no plan holds the hops before it. A frontier of at most `MOST_SENT` ids is sent to all executors, and one of at most
`MOST_LISTED` is a list that the scan of a sorted edge table prunes by; beyond, edges are joined by a shuffle that Spark splits where skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import is_test_path, root_folder, scope_prefix
from graphloom.operators import display
from graphloom.shared import written

DISPLAY_HIDDEN = ("imports", "defines", "contains")
MOST_LISTED, MOST_SENT = 64, 1 << 18


class UnknownNode(KeyError):
    """The entry of a traversal is not a node."""


def get_node(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.where(F.col("id") == node)


def require_node(nodes: DataFrame, node: str) -> None:
    if get_node(nodes, node).isEmpty():
        raise UnknownNode(f"Node not found: {node}")


def successors(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("source_id") == node)


def predecessors(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("target_id") == node)


def all_successors(edges: DataFrame) -> DataFrame:
    """source_id, out: its edges in order."""
    return edges.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "edge_type"))).alias("out"))


def edge_listing(nodes: DataFrame, edges: DataFrame, node: str, edges_in: DataFrame | None = None) -> DataFrame:
    """Edges in and out of a node beside its neighbours, without structural ones; missing neighbours are left out. edges_in: the edges
    laid out by target, if there are such."""
    shown = lambda df: df.where(~F.col("edge_type").isin(*DISPLAY_HIDDEN))
    out = successors(shown(edges), node).select(F.lit("out").alias("direction"), "edge_type", F.col("target_id").alias("id"))
    into = predecessors(shown(edges if edges_in is None else edges_in), node).select(F.lit("in").alias("direction"), "edge_type", F.col("source_id").alias("id"))
    return out.unionByName(into).join(nodes.select("id", "node_type", "name", "title", "file_path"), "id")


def beside(edges: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """The edges whose `column` is among n ids."""
    if n <= MOST_LISTED:
        return edges.where(F.col(column).isin([r["id"] for r in ids.collect()]))
    return edges.join(F.broadcast(ids) if n <= MOST_SENT else ids, F.col(column) == ids["id"], "left_semi")


def _rows_of(nodes: DataFrame, ids: DataFrame, n: int, *columns) -> DataFrame:
    """ids with columns of their nodes, null where there is none. The few ids are sent to the nodes, never the other way round."""
    known = nodes.select("id", *columns)
    if n <= MOST_SENT:
        known = known.join(F.broadcast(ids.select("id")), "id", "left_semi")
    return ids.join(known, "id", "left")


def _reach(nodes: DataFrame, edges: DataFrame, node: str, max_depth: int, reverse: bool, follow: Column | None = None) -> DataFrame:
    """id, depth, parent, edge_type, present, goes_on: each node at its least depth, the entry (depth 0, no parent) among them. Only
    present nodes that `follow` allows go on."""
    spark = nodes.sparkSession
    near, far = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    flag = (F.lit(True) if follow is None else F.coalesce(follow, F.lit(False))).alias("goes_on")
    visited = written(spark, get_node(nodes, node).select("id", F.lit(0).alias("depth"), F.lit(None).cast(dict(nodes.dtypes)["id"]).alias("parent"), F.lit(None).cast("string").alias("edge_type"), F.lit(True).alias("present"), F.lit(True).alias("goes_on")).limit(1), "reach")
    frontier = visited
    for d in range(1, max_depth + 1):
        ids = frontier.where("goes_on").select("id")
        n = ids.count()
        if not n:
            break
        step = beside(edges, near, ids, n).groupBy(F.col(far).alias("id")).agg(F.min(F.struct(F.col(near).alias("parent"), "edge_type")).alias("by"))
        new = written(spark, step.join(visited.select("id"), "id", "left_anti"), "reach-step")
        hop = _rows_of(nodes, new, new.count(), F.lit(True).alias("present"), flag)
        frontier = written(spark, hop.select("id", F.lit(d).alias("depth"), "by.parent", "by.edge_type", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("goes_on", F.lit(False)).alias("goes_on")), "reach")
        visited = visited.unionByName(frontier)
    return visited


def impact(nodes: DataFrame, edges: DataFrame, node: str, max_depth: int = 5) -> DataFrame:
    """Reverse reach over all edge types: id, depth, parent, edge_type, present. Missing sources are reached but lead no further."""
    return _reach(nodes, edges, node, max_depth, reverse=True).where("depth > 0").drop("goes_on")


def blast_radius(nodes: DataFrame, edges: DataFrame, node: str, max_depth: int = 5) -> DataFrame:
    """Nodes that a change may affect, each with its depth and the edge that leads to it (into the smallest parent)."""
    reached = impact(nodes, edges, node, max_depth).where("present")
    return reached.join(nodes, "id").select("id", "node_type", "name", "title", "file_path", "depth", F.col("parent").alias("via_id"), "edge_type")


def blast_score(nodes: DataFrame, edges: DataFrame, node: str, max_depth: int = 5) -> DataFrame:
    """One row: affected_count, confidence from 1.0 down, risk_reasons."""
    me = get_node(nodes, node).select("file_path", root_folder(F.col("file_path")).alias("root")).head()
    if me is None:
        raise UnknownNode(f"Node not found: {node}")
    reached = impact(nodes, edges, node, max_depth)
    joined = _rows_of(nodes, reached, reached.count(), "title", "file_path")
    cross = F.col("present") & (root_folder(F.col("file_path")) != F.lit(me["root"]))
    # the first three titles: each task keeps as many, so nothing grows with what is reached
    top = joined.where(cross).select(F.struct("depth", "title").alias("t")).orderBy("t").limit(3).agg(F.array_sort(F.collect_list("t")).alias("first")).select(F.transform("first", lambda x: x["title"]).alias("first"))
    row = joined.agg(F.count_if(F.col("present")).alias("affected_count"), F.count_if(F.col("depth") >= 3).alias("far"), F.count_if(cross).alias("crossing"))
    row = row.join(top, F.lit(True)).withColumn("own_path", F.lit(me["file_path"]))  # one row each
    many, other, deep, untested = F.col("affected_count") > 5, F.col("crossing") > 0, F.col("far") > 0, ~is_test_path(F.col("own_path"))
    loss = sum((F.when(c, F.lit(x)).otherwise(0.0) for c, x in ((many, 0.20), (other, 0.10), (deep, 0.05), (untested, 0.15))), F.lit(0.0))
    more = F.when(F.col("crossing") > 3, F.concat(F.lit(" (+"), (F.col("crossing") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    reasons = F.array_compact(F.array(
        F.when(many, F.concat(F.lit("High fan-in: "), F.col("affected_count").cast("string"), F.lit(" callers/dependents will be affected."))),
        F.when(other, F.concat(F.lit("Cross-module impact: "), F.array_join("first", ", "), more, F.lit("."))),
        F.when(deep, F.concat(F.col("far").cast("string"), F.lit(" node(s) are indirect dependencies (3+ hops)."))),
        F.when(untested, F.concat(F.lit("No test file found for '"), F.col("own_path"), F.lit("' — change is unverified."))),
    ))
    return row.select("affected_count", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - loss)), 3).alias("confidence"), reasons.alias("risk_reasons"))


class Context:
    """Forward reach from a node: nodes, edges, external, depth_reached, each a DataFrame."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, node: str, max_depth: int = 3, scope: str | None = None):
        inside = F.lit(True) if scope is None else scope_prefix(F.col("file_path"), scope)
        visited = _reach(nodes, edges, node, max_depth, False, inside).where("goes_on").select("id", "depth")
        n = visited.count()
        self.nodes = _rows_of(nodes, visited.where("depth > 0"), n, *[c for c in nodes.columns if c != "id"])
        self.edges = beside(edges, "source_id", visited.select("id"), n).select("source_id", "target_id", "edge_type")
        targets = self.edges.select(F.col("target_id").alias("id")).distinct()
        self.external = nodes.where(~inside).join(targets, "id", "left_semi")
        self.depth_reached = visited.agg(F.max("depth").alias("depth_reached"))

    def result(self) -> DataFrame:
        """One row, shaped as tools show it: nodes, edges (ids cut to what people read), external_deps, depth_reached, note."""
        shown = display.node_rows(self.nodes)
        nodes = shown.agg(F.array_sort(F.collect_list(F.struct("id", "type", "name", "title", "file", "lines", "signature"))).alias("nodes"))
        links = display.edge_rows(self.edges).agg(F.array_sort(F.collect_list(F.struct("source", "target", F.col("edge_type").alias("type")))).alias("edges"))
        outer = self.external.agg(F.array_sort(F.collect_list(F.struct("title", "id", F.col("file_path").alias("file")))).alias("external_deps"))
        row = nodes.join(links, F.lit(True)).join(outer, F.lit(True)).join(self.depth_reached, F.lit(True))  # one row each
        note = F.when(F.size("external_deps") > 0, F.concat(F.size("external_deps").cast("string"), F.lit(" dependencies lie outside the scope and were not followed.")))
        return row.withColumn("note", note)


def context_depth_first(nodes: DataFrame, edges: DataFrame, node: str, max_depth: int = 3, scope: str | None = None, most_edges: int = 200_000) -> dict:
    """Depth-first order with one visited set, in which a node first met on a long way is not expanded again. It is replayed at
    the driver over the sub-graph in reach, whose size is checked first; edges go by (target_id, edge_type)."""
    reach = Context(nodes, edges, node, max_depth, None)
    rows = reach.edges.limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise ValueError(f"more than {most_edges} edges in reach; use Context")
    out: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(rows, key=lambda r: (r["target_id"], r["edge_type"])):
        out.setdefault(r["source_id"], []).append((r["target_id"], r["edge_type"]))
    inside = F.lit(True) if scope is None else scope_prefix(F.col("file_path"), scope)
    ids = reach.edges.select(F.col("target_id").alias("id")).distinct()
    known = {r["id"]: r["inside"] for r in nodes.join(ids, "id", "left_semi").select("id", inside.alias("inside")).collect()}
    visited: list[str] = []
    seen: set[str] = set()
    walked: list[tuple[str, str, str]] = []
    external: list[str] = []
    deepest, stack = 0, [(node, 0)]
    while stack:
        at, depth = stack.pop()
        if at in seen or depth > max_depth:
            continue
        seen.add(at)
        deepest = max(deepest, depth)
        if at != node:
            visited.append(at)
        follow = []
        for target, kind in out.get(at, []):
            walked.append((at, target, kind))
            if target in known:
                if known[target]:
                    follow.append((target, depth + 1))
                elif target not in external:
                    external.append(target)
        stack += reversed(follow)
    return {"nodes": visited, "edges": walked, "external": external, "depth_reached": deepest}
