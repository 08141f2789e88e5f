"""Traversal of the property graph: one join a level, whatever the number of starts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from .lineage import cut, small
from .model import Graph

DIRECTIONS = ("outgoing", "incoming", "both")


def related(edges: DataFrame, relationship: str | Iterable[str] | None) -> DataFrame:
    """The edges of a relationship, of any of several, or all."""
    if relationship is None:
        return edges
    names = [relationship] if isinstance(relationship, str) else list(relationship)
    return edges.where(F.col("relationship").isin(names))


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b, rank): the steps that a direction allows; rank 0 along an edge, 1 against it."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("rank"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("rank"))
    return out if direction == "outgoing" else back if direction == "incoming" else out.unionAll(back)


def neighbours(graph: Graph, node: str, direction: str = "both", relationship: str | None = None) -> DataFrame:
    """The nodes one step from node; ids without a node are left out, a self loop gives the node."""
    edges = related(graph.edges, relationship)
    ids = steps(edges, direction).where(F.col("a") == node).select(F.col("b").alias("id")).distinct()
    return graph.nodes.join(ids, "id", "left_semi")


#: Ids of a front up to which edges are looked up by them, and nothing is cached.
LOOKUP = 1024


class _Stepper:
    """The steps of edges from a front: looked up where it is narrow, from a cached copy once it is wide.

    A narrow front's ids are a filter that reaches the scans below unions and aggregates; a wide
    one meets all steps, which are cached then, as edges may be an aggregate and levels are many.  What of the cache
    is lost is computed again.
    """

    def __init__(self, step: DataFrame):
        self.step, self.cached = step, None

    def near(self, front: DataFrame, rows: int) -> DataFrame:
        if rows <= LOOKUP:
            return self.step.where(F.col("a").isin([r[0] for r in front.select("id").distinct().collect()]))
        if self.cached is None:
            self.cached = self.step.persist()
        ids = front.select(F.col("id").alias("a")).distinct()
        n = ids.count()
        if n * 8 > rows:
            return self.cached
        # Many rows stand on few ids: the steps of these may be few enough to meet the front where it is.
        few = self.cached.join(small(ids, n), "a", "left_semi")
        return small(few, few.count())

    def close(self) -> None:
        if self.cached is not None:
            self.cached.unpersist()


def distances(edges: DataFrame, starts: DataFrame, direction: str = "outgoing", max_depth: int | None = None) -> DataFrame:
    """(root, id, depth): the least number of steps from every root of starts (root) to every id within max_depth.

    All roots advance together, one join and one reliable checkpoint a level; only new
    pairs go on, and they are broadcast only while their counted size fits.
    """
    step = _Stepper(steps(edges, direction).select("a", "b"))
    front = cut(starts.select("root").distinct().select("root", F.col("root").alias("id"), F.lit(0).alias("depth")))
    levels, rows, depth = [front], front.count(), 0
    while rows and (max_depth is None or depth < max_depth):
        depth += 1
        reached = step.near(front, rows).join(small(front.select("root", F.col("id").alias("a")), rows), "a").select("root", F.col("b").alias("id")).distinct()
        reached = reached.join(_union(levels).select("root", "id"), ["root", "id"], "left_anti")
        front = cut(reached.withColumn("depth", F.lit(depth)))
        rows = front.count()
        if rows:
            levels.append(front)
            if len(levels) > 8:  # a long chain would anti-join as many tables as it has levels
                levels = [cut(_union(levels))]
    step.close()
    return _union(levels)


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole



def traverse(graph: Graph, start: str, direction: str = "outgoing", relationship: str | None = None, max_depth: int = 10) -> tuple[DataFrame, DataFrame, int]:
    """(nodes with depth, edges, depth) of a breadth-first walk.

    Ids without a node are walked through and not returned.  An edge is returned if it was
    looked at: from an end that is nearer than max_depth.  depth is that of the farthest id.
    """
    spark = graph.edges.sparkSession
    edges = related(graph.edges, relationship)
    ball = cut(distances(edges, spark.createDataFrame([(start,)], "root string"), direction, max_depth).select("id", "depth"))
    inner = ball.where(F.col("depth") < max_depth)
    n = inner.count()
    found = []
    for end in ("src",) * (direction != "incoming") + ("dst",) * (direction != "outgoing"):
        found.append(edges.where(F.col(end).isin([r[0] for r in inner.select("id").collect()])) if n <= LOOKUP else edges.join(small(inner.select(F.col("id").alias(end)), n), end, "left_semi"))
    touched = _union([f.select(*edges.columns) for f in found])
    if len(found) == 2:
        touched = touched.dropDuplicates(["src", "dst", "relationship"])
    nodes = graph.nodes.join(small(ball, ball.count()), "id")
    return nodes, touched, ball.agg(F.max("depth")).first()[0] or 0


def near(graph: Graph, node: str, max_depth: int = 3, direction: str = "both") -> DataFrame:
    """(id, depth) within max_depth steps of node, itself included, ids without a node too."""
    spark = graph.edges.sparkSession
    return distances(graph.edges, spark.createDataFrame([(node,)], "root string"), direction, max_depth).select("id", "depth")


def _deep(start: str, max_depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: dict[str, list[str]] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ahead.setdefault(a, []).append(b)
        stack, seen, out = [(start, 0)], {start}, []
        while stack:
            node, depth = stack.pop()
            out.append((node, depth))
            if depth < max_depth:
                for other in ahead.get(node, ()):
                    if other not in seen:
                        seen.add(other)
                        stack.append((other, depth + 1))
        ids, depths = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(range(len(ids)), pa.int32()), pa.array(depths, pa.int32())], names=["id", "visit", "depth"])

    return run


def traverse_depth_first(graph: Graph, start: str, direction: str = "outgoing", relationship: str | None = None, max_depth: int = 10) -> DataFrame:
    """(id, visit, depth) of a depth-first walk with a stack, in which an id is marked when it is pushed.

    Its order depends on every step before, so it runs in one task over the edges within max_depth of
    start, which are found breadth-first; edges are tried in the order of seq, along before against.
    """
    ship()
    edges = related(graph.edges, relationship)
    ball = distances(edges, graph.edges.sparkSession.createDataFrame([(start,)], "root string"), direction, max_depth).where(F.col("depth") < max_depth)
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("rank"), "seq")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("rank"), "seq")
    step = out if direction == "outgoing" else back if direction == "incoming" else out.unionAll(back)
    ball = cut(ball.select(F.col("id").alias("a")))
    n = ball.count()
    step = step.where(F.col("a").isin([r[0] for r in ball.collect()])) if n <= LOOKUP else step.join(small(ball, n), "a", "left_semi")
    return step.repartition(1).sortWithinPartitions("a", "rank", "seq").select("a", "b").mapInArrow(_deep(start, max_depth), "id string, visit int, depth int")


def shortest_path(graph: Graph, start: str, end: str, direction: str = "both", relationship: str | None = None) -> DataFrame:
    """(step, id) of a shortest path, in order; no rows if there is none.  Of equal paths the least ids win.

    The front carries its path; ids seen before are left out of it.
    """
    spark = graph.edges.sparkSession
    step = _Stepper(steps(related(graph.edges, relationship), direction).select("a", "b"))
    front = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    seen = front.select("id")
    path = [start] if start == end else None
    while path is None:
        n = front.count()
        if n == 0:
            break
        reached = step.near(front, n).join(small(front.select(F.col("id").alias("a"), "path"), n, 256), "a").groupBy(F.col("b").alias("id")).agg(F.min("path").alias("path"))
        front = cut(reached.join(seen, "id", "left_anti").select("id", F.concat("path", F.array("id")).alias("path")))
        seen = cut(seen.union(front.select("id")))
        hit = front.where(F.col("id") == end).select("path").first()
        path = hit and hit[0]
    step.close()
    return spark.createDataFrame(list(enumerate(path or [])), "step int, id string")


def max_dependency_depth(graph: Graph, root_type: str = "file", relationship: str | Iterable[str] = "imports") -> int:
    """The greatest distance along relationship from any node of root_type; ids without a node count."""
    roots = graph.nodes.where(F.col("type") == root_type).select(F.col("id").alias("root"))
    return distances(related(graph.edges, relationship), roots, "outgoing").agg(F.max("depth")).first()[0] or 0


def _ends(edges: DataFrame) -> DataFrame:
    """(id, end, seq, relationship): both ends of every edge, of one pass over edges, which may be an aggregate."""
    at = F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("end")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("end"))))
    return edges.select("seq", "relationship", at)


def ends_by_relationship(edges: DataFrame) -> DataFrame:
    """(id, relationship, degree, edges, first0, first1): ends of an id, those that are src, and the least seq of either."""
    at = lambda n: F.when(F.col("end") == n, F.col("seq"))
    return _ends(edges).groupBy("id", "relationship").agg(F.count("*").alias("degree"), F.count_if(F.col("end") == 0).alias("edges"), F.min(at(0)).alias("first0"), F.min(at(1)).alias("first1"))


def degrees(edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(id, degree, first_seq, first_end) of every end of an edge; a self loop counts twice.  ends are those by relationship, if there are any.

    The least seq of either end is a number, which hashes; a struct of both would be sorted.
    """
    if ends is None:
        at = lambda n: F.when(F.col("end") == n, F.col("seq"))
        made = _ends(edges).groupBy("id").agg(F.count("*").alias("degree"), F.min(at(0)).alias("first0"), F.min(at(1)).alias("first1"))
    else:
        made = ends.groupBy("id").agg(F.sum("degree").alias("degree"), F.min("first0").alias("first0"), F.min("first1").alias("first1"))
    along = F.col("first1").isNull() | (F.col("first0") <= F.col("first1"))
    return made.select("id", "degree", F.least("first0", "first1").alias("first_seq"), F.when(along, 0).otherwise(1).alias("first_end"))


def collect_related(graph: Graph, start: str, direction: str, relationships: Iterable[str], max_depth: int = 1) -> DataFrame:
    """(id, depth) reached along any of relationships, without start."""
    starts = graph.edges.sparkSession.createDataFrame([(start,)], "root string")
    return distances(related(graph.edges, relationships), starts, direction, max_depth).where(F.col("depth") > 0).select("id", "depth")


def topological_order(depends: dict[str, list[str]]) -> list[str]:
    """Names with those they depend on first; an unknown name or a cycle is an error."""
    order: list[str] = []
    state: dict[str, int] = {}
    for root in depends:
        stack = [(root, iter(depends[root]))] if root not in state else []
        if stack:
            state[root] = 1
        while stack:
            name, rest = stack[-1]
            for other in rest:
                if other not in depends:
                    raise ValueError(f"{name} depends on {other}, which there isn't")
                if state.get(other) == 1:
                    raise ValueError(f"{other} depends on itself")
                if other not in state:
                    state[other] = 1
                    stack.append((other, iter(depends[other])))
                    break
            else:
                state[name] = 2
                order.append(name)
                stack.pop()
    return order


def edge_list(graph: Graph, node: str) -> DataFrame:
    """Edges from node, then those to it; a self loop is in both."""
    return graph.edges.where(F.col("src") == node).withColumn("rank", F.lit(0)).unionAll(graph.edges.where(F.col("dst") == node).withColumn("rank", F.lit(1))).orderBy("rank", "seq").drop("rank")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end in ids (id): two semi-joins and a union, which hash, in place of a join on an OR, which can't."""
    at = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns)
    to = edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)
    return at.unionByName(to).dropDuplicates(["src", "dst", "relationship"])


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def lookup(graph: Graph, node: str | None = None, type: str | None = None, relationship: str | None = None) -> DataFrame:
    """What the first of node, type and relationship that is given asks for; all nodes if none is.

    node: one row (node, edges, notes), all as JSON, even if there is no such node; edges are those from it and then
    those to it, notes in the order of time.  type: its nodes.  relationship: its edges.
    """
    if node is None:
        return graph.nodes.where(F.col("type") == type) if type is not None else graph.edges.where(F.col("relationship") == relationship) if relationship is not None else graph.nodes
    spark = graph.nodes.sparkSession
    listed = lambda df, order, *fields: df.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("x")))), lambda r: r["x"])).alias("json")).first()[0]
    one = graph.nodes.where(F.col("id") == node).select(F.to_json(F.struct("id", "type", "name", "metadata"))).first()
    touching = edge_list(graph, node).withColumn("rank", F.when(F.col("src") == node, 0).otherwise(1))
    loops = touching.where("src = dst").withColumn("rank", F.lit(1))
    edges = listed(touching.where("src <> dst").unionByName(loops.dropDuplicates(["seq"])).unionByName(loops.dropDuplicates(["seq"]).withColumn("rank", F.lit(0))), ("rank", "seq"), F.col("src").alias("from"), F.col("dst").alias("to"), "relationship", "metadata")
    notes = "[]" if graph.notes is None else listed(graph.notes.where(F.col("entity") == node), ("ts", "seq"), "text", "ts")
    return spark.createDataFrame([(one and one[0], edges, notes)], "node string, edges string, notes string")
