"""Parts of a graph, and their renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import near as ball
from .graph import touching
from .model import Graph

SHAPES = {"file": "folder", "function": "ellipse", "class": "component", "interface": "diamond", "type": "note", "variable": "box"}
HEAD = ["digraph G {", "  rankdir=LR;", '  node [shape=box, fontname="Helvetica", fontsize=10];', '  edge [fontname="Helvetica", fontsize=8];', ""]


def gather(graph: Graph, near: dict | None = None, type: str | None = None, relationship: str | None = None) -> Graph:
    """The nodes within a ball or of a type and the edges with either end among them; or the edges of a relationship and the nodes at their ends."""
    nodes, edges = graph.nodes, graph.edges
    if near:
        ids = ball(graph, near["node"], near.get("maxDepth", 3), near.get("direction", "both")).select("id")
        nodes, edges = nodes.join(ids, "id", "left_semi").select(*nodes.columns), touching(edges, ids)
    if type:
        nodes = nodes.where(F.col("type") == type)
        edges = touching(edges, nodes.select("id"))
    if relationship:
        edges = edges.where(F.col("relationship") == relationship)
        ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
        nodes = nodes.join(ends, "id", "left_semi").select(*nodes.columns)
    return Graph(nodes, edges)


def dot_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def shape(node_id: Column, type: Column) -> Column:
    found = F.when(node_id.startswith("effect:"), "octagon")
    for name, drawn in SHAPES.items():
        found = found.when(type == name, drawn)
    return found.otherwise("box")


def metadata_label(metadata: Column) -> Column:
    """Keys with their scalars, or with the lengths of their arrays, after a (literal) backslash and n; empty if there are none."""
    entries = F.map_entries(F.from_json(metadata, "map<string,string>"))

    def part(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        length = F.when(value.startswith("["), F.json_array_length(value))
        return F.when(length.isNotNull(), F.concat(key, F.lit("=["), length.cast("string"), F.lit("]"))).when(value.isNotNull() & ~value.startswith("{"), F.concat(key, F.lit("="), value))

    parts = F.array_compact(F.transform(entries, part))
    return F.when(F.size(parts) > 0, F.concat(F.lit("\\n"), F.array_join(parts, ", "))).otherwise("")


def dot_lines(graph: Graph, include_metadata: bool = False) -> DataFrame:
    """(part, seq, line) of a DOT text, to be written in this order; nodes are part 1, edges part 3."""
    label = dot_escape(F.col("name"))
    if include_metadata:
        label = F.concat(label, dot_escape(metadata_label(F.col("metadata"))))
    nodes = graph.nodes.select(F.lit(1).alias("part"), "seq", F.concat(F.lit('  "'), dot_escape(F.col("id")), F.lit('" [shape='), shape(F.col("id"), F.col("type")), F.lit(', label="'), label, F.lit('"];')).alias("line"))
    edges = graph.edges.select(F.lit(3).alias("part"), "seq", F.concat(F.lit('  "'), dot_escape(F.col("src")), F.lit('" -> "'), dot_escape(F.col("dst")), F.lit('" [label="'), dot_escape(F.col("relationship")), F.lit('"];')).alias("line"))
    fixed = graph.nodes.sparkSession.createDataFrame([(0, i, x) for i, x in enumerate(HEAD)] + [(2, 0, ""), (4, 0, "}")], "part int, seq bigint, line string")
    return fixed.unionByName(nodes).unionByName(edges)


def to_dot(graph: Graph, include_metadata: bool = False) -> str:
    """The DOT text on the driver, for graphs that one would draw; else write dot_lines."""
    return "\n".join(r["line"] for r in dot_lines(graph, include_metadata).orderBy("part", "seq").toLocalIterator())


def json_rows(graph: Graph, include_metadata: bool = True) -> DataFrame:
    """(part, seq, json): nodes (part nodes) and edges (part edges) as JSON objects; metadata is the object that its text holds, and left out if there is none."""

    def row(*fields: Column | str) -> Column:
        made = F.to_json(F.struct(*fields))
        if not include_metadata:
            return made
        there = F.coalesce(F.col("metadata"), F.lit("")) != ""
        return F.when(there, F.concat(F.substring(made, F.lit(1), F.length(made) - 1), F.lit(',"metadata":'), F.col("metadata"), F.lit("}"))).otherwise(made)

    nodes = graph.nodes.select(F.lit("nodes").alias("part"), "seq", row("id", "type", "name").alias("json"))
    edges = graph.edges.select(F.lit("edges").alias("part"), "seq", row(F.col("src").alias("from"), F.col("dst").alias("to"), "relationship").alias("json"))
    return nodes.unionByName(edges)
