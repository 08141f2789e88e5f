"""Nodes by type, metadata, proximity, relationship and text in one plan."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import near as ball
from .lineage import small
from .model import Graph, json_number, where_all
from .search import documents, index, search
from .stored_index import StoredIndex


def participating(nodes: DataFrame, edges: DataFrame, relationship: str) -> DataFrame:
    """Nodes at either end of an edge of relationship."""
    of = edges.where(F.col("relationship") == relationship)
    ends = of.select(F.col("src").alias("id")).union(of.select(F.col("dst").alias("id")))
    return nodes.join(ends, "id", "left_semi")


def find(graph: Graph, type: str | None = None, where: dict[str, Any] | None = None, near: dict[str, Any] | None = None, relationship: str | None = None, text: str | None = None, sort: str | None = None, limit: int = 20, indexed: DataFrame | StoredIndex | None = None) -> DataFrame:
    """(id, type, name, metadata, score), at most limit rows.

    where is a dict of predicates (model.predicate); near has node, and maxDepth (3) and direction
    ("both"); text is a search, of indexed if there is one (stored, or that of search.index).  All must hold.  Sorted by sort, a number in the metadata,
    downwards with others last, by score if there is a text, else by seq.
    """
    nodes = graph.nodes.select("seq", "id", "type", "name", "metadata")
    if text:
        wanted = (text, graph.nodes, [type] if type else None, limit * 5)
        hits = indexed.search(*wanted) if isinstance(indexed, StoredIndex) else search(indexed if indexed is not None else index(documents(graph)), *wanted)
        hit = F.broadcast(hits.select(F.col("key").alias("id"), "score", F.col("type").alias("hit_type"), "title"))
        of_nodes = nodes.join(hit.drop("hit_type", "title"), "id")
        others = hits.where(F.col("type").isin("recall", "note")).select(F.lit(None).cast("bigint").alias("seq"), F.col("key").alias("id"), "type", F.col("title").alias("name"), F.lit(None).cast("string").alias("metadata"), "score")
        if graph.kv is not None:
            kv = graph.kv.join(F.broadcast(others.select(F.col("id").alias("key"))), "key", "left_semi").where(F.trim("value").startswith("{")).select(F.col("key").alias("id"), F.col("value").alias("object"))
            others = others.join(kv, "id", "left").withColumn("metadata", F.col("object")).drop("object")
        others = others.withColumn("name", F.when(F.col("type") == "note", F.expr("substring(id, 6)")).otherwise(F.col("id")))
        nodes = of_nodes.unionByName(others)
    else:
        nodes = nodes.withColumn("score", F.lit(None).cast("double"))
    if near:
        ids = ball(graph, near["node"], near.get("maxDepth", 3), near.get("direction", "both")).select("id")
        nodes = nodes.join(small(ids, ids.count()), "id", "left_semi")
    if type:
        nodes = nodes.where(F.col("type") == type)
    nodes = nodes.where(where_all(F.col("metadata"), where))
    if relationship:
        nodes = participating(nodes, graph.edges, relationship)
    if sort and sort != "score":
        order = [F.desc_nulls_last(json_number(F.col("metadata"), sort)), F.asc_nulls_last("seq"), F.asc("id")]
    elif sort == "score" or text:
        order = [F.desc(F.coalesce("score", F.lit(0.0))), F.asc_nulls_last("seq"), F.asc("id")]
    else:
        order = [F.asc_nulls_last("seq"), F.asc("id")]
    return nodes.orderBy(*order).limit(limit).select("id", "type", "name", "metadata", "score")
