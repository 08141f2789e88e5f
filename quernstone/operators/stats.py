"""Statistics of a graph."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import degrees, ends_by_relationship, max_dependency_depth

from .model import Graph, json_number


def count_by_type(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("type").agg(F.count("*").alias("n"))


def count_by_relationship(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("relationship").agg(F.count("*").alias("n"))


def complexity(graph: Graph, key: str = "complexity") -> DataFrame:
    """One row: mean (0 without any), and the id and value of the greatest (the first of equals)."""
    rated = graph.nodes.select("id", "seq", json_number(F.col("metadata"), key).alias("c")).where("c IS NOT NULL")
    return rated.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("mean"), F.max_by("id", F.struct("c", -F.col("seq"))).alias("most"), F.max("c").alias("greatest"))


def most_connected(graph: Graph, limit: int = 10, ends: DataFrame | None = None) -> DataFrame:
    """(id, degree) of the ids of most edges, ids without a node too; ties by the first edge they are in."""
    return degrees(graph.edges, ends).orderBy(F.desc("degree"), "first_seq", "first_end").limit(limit).select("id", "degree")


def hotspots(graph: Graph, key: str = "complexity", limit: int = 10, ends: DataFrame | None = None) -> DataFrame:
    """(id, complexity, degree, score) where complexity * (1 + degree) is greatest and above 0."""
    rated = graph.nodes.select("id", "seq", json_number(F.col("metadata"), key).alias("complexity")).where("complexity IS NOT NULL")
    joined = rated.join(degrees(graph.edges, ends).select("id", "degree"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    scored = joined.withColumn("score", F.col("complexity") * (1 + F.col("degree"))).where("score > 0")
    return scored.orderBy(F.desc("score"), "seq").limit(limit).select("id", "complexity", "degree", "score")


def compute(graph: Graph, key: str = "complexity", root_type: str = "file", relationship: Any = "imports") -> dict[str, Any]:
    """All statistics in one dict.  Edges are read once for all of their counts."""
    ends = ends_by_relationship(graph.edges).persist()
    types = count_by_type(graph).collect()
    relationships = ends.groupBy("relationship").agg(F.sum("edges").alias("n")).collect()
    of = complexity(graph, key).first()
    made = {
        "nodes": {r["type"]: r["n"] for r in types},
        "edges": {r["relationship"]: r["n"] for r in relationships},
        "totalNodes": sum(r["n"] for r in types),
        "totalEdges": sum(r["n"] for r in relationships),
        "avgComplexity": of["mean"],
        "maxComplexity": of["most"] and {"id": of["most"], "complexity": of["greatest"]},
        "mostConnected": [r.asDict() for r in most_connected(graph, ends=ends).collect()],
        "hotspots": [r.asDict() for r in hotspots(graph, key, ends=ends).collect()],
        "maxDependencyDepth": max_dependency_depth(graph, root_type, relationship),
    }
    ends.unpersist()
    return made


