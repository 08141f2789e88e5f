"""Definitions and references of a symbol, and what a rename would touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_of
from .model import Graph, json_number

REFERENCE = "kind string, node_id string, type string, name string, relationship string, file string, line double"


def resolve(graph: Graph, symbol: str) -> tuple[str, str, str] | None:
    """(id, name, type) of the node of that id, else of the first node of that name."""
    rows = graph.nodes.where((F.col("id") == symbol) | (F.col("name") == symbol))
    found = rows.orderBy(F.when(F.col("id") == symbol, 0).otherwise(1), "seq").select("id", "name", "type").first()
    return tuple(found) if found else None


def find_refs(graph: Graph, symbol: str) -> DataFrame:
    """(kind, node_id, type, name, relationship, file, line): the definition, if any, and all references.

    The last "defines" edge to the symbol is its definition.  Other edges to it are
    references, as are those from it but "defines" and "exports"; then files whose imports
    name it, unless an import of theirs is listed already.  Ends without a node are left out.
    """
    spark = graph.nodes.sparkSession
    known = resolve(graph, symbol)
    if known is None:
        return spark.createDataFrame([], REFERENCE)
    node, name, _ = known
    coming = graph.edges.where(F.col("dst") == node).select(F.when(F.col("relationship") == "defines", "definition").otherwise("reference").alias("kind"), F.col("src").alias("node_id"), "relationship", "seq")
    going = graph.edges.where((F.col("src") == node) & ~F.col("relationship").isin("defines", "exports")).select(F.lit("reference").alias("kind"), F.col("dst").alias("node_id"), "relationship", "seq")
    face = graph.nodes.select(F.col("id").alias("node_id"), "type", "name", json_number(F.col("metadata"), "line").alias("line"))
    direct = coming.unionByName(going).join(face, "node_id")
    last = direct.where("kind = 'definition'").orderBy(F.desc("seq")).limit(1)
    mine = graph.nodes.where(F.col("id") == node).select(json_number(F.col("metadata"), "line")).first()[0]
    last = last.withColumn("line", F.lit(mine).cast("double"))
    refs = direct.where("kind = 'reference'")
    specifiers = F.from_json(F.get_json_object("metadata", "$.specifiers"), "array<string>")
    importing = graph.edges.where(F.col("relationship") == "imports").where(F.array_contains(specifiers, name)).groupBy(F.col("src").alias("node_id")).agg(F.min("seq").alias("seq"))
    listed = refs.where("relationship = 'imports'").select("node_id")
    by_name = importing.join(listed, "node_id", "left_anti").join(face, "node_id").select(F.lit("reference").alias("kind"), "node_id", F.lit("imports").alias("relationship"), "seq", "type", "name", F.lit(None).cast("double").alias("line"))
    whole = last.unionByName(refs).unionByName(by_name)
    file = F.when(F.col("type") == "file", F.col("name")).otherwise(file_of(F.col("node_id")))
    return whole.select("kind", "node_id", "type", "name", "relationship", file.alias("file"), "line")


def rename_impact(graph: Graph, symbol: str) -> DataFrame:
    """(file, node_id, relationship) of every place that a rename of symbol touches."""
    return find_refs(graph, symbol).select(F.coalesce("file", F.lit("unknown")).alias("file"), "node_id", F.when(F.col("kind") == "definition", "definition").otherwise(F.col("relationship")).alias("relationship"))


def first_existing(wanted: DataFrame, listing: DataFrame, *keys: str) -> DataFrame:
    """(keys, file): of the candidates of each key, as rows (keys, rank, file), the one of the least rank that the listing (file) has."""
    there = listing.select("file").distinct()
    return wanted.join(there, "file", "left_semi").groupBy(*keys).agg(F.min_by("file", "rank").alias("file"))
