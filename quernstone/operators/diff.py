"""What changed between two states of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Graph


def edge_text() -> Column:
    return F.concat("src", F.lit(" -["), "relationship", F.lit("]-> "), "dst")


def compare_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): added, removed or changed.  Type, name and the text of the metadata tell; boost doesn't."""
    face = lambda df, name: df.select("id", F.struct("type", "name", F.coalesce("metadata", F.lit("{}")).alias("metadata")).alias(name))
    both = face(old, "was").join(face(new, "now"), "id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("id", change.alias("change")).where("change IS NOT NULL")


def compare_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(edge, change): added or removed, by ends and relationship alone; as many rows as there are of the edge.

    Both states are counted in one aggregate, so each is shuffled once.  A null in a key equals nothing.
    """
    key = ["src", "dst", "relationship"]
    both = old.select(*key, F.lit(True).alias("was")).unionByName(new.select(*key, F.lit(False).alias("was")))
    counted = both.groupBy(*key).agg(F.count_if("was").cast("int").alias("o"), F.count_if(~F.col("was")).cast("int").alias("n"))
    unlike = F.col("src").isNull() | F.col("dst").isNull() | F.col("relationship").isNull()
    left = counted.where(unlike | (F.col("o") == 0) | (F.col("n") == 0))
    rows = F.explode(F.concat(F.array_repeat(F.lit("removed"), F.col("o")), F.array_repeat(F.lit("added"), F.col("n"))))
    return left.select(edge_text().alias("edge"), rows.alias("change"))


def compare(old: Graph | None, new: Graph) -> dict[str, DataFrame]:
    """nodes and edges that changed; with no old state all are added."""
    was = old or Graph(new.nodes.limit(0), new.edges.limit(0))
    return {"nodes": compare_nodes(was.nodes, new.nodes), "edges": compare_edges(was.edges, new.edges)}


def write_snapshot(graph: Graph, folder: str, name: str = "latest") -> None:
    """Store a state under a name, over one of the same name."""
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/name={name}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{folder}/name={name}/edges")


def read_snapshot(spark: SparkSession, folder: str, name: str = "latest") -> Graph:
    return Graph(spark.read.parquet(f"{folder}/name={name}/nodes"), spark.read.parquet(f"{folder}/name={name}/edges"))


def list_snapshots(spark: SparkSession, folder: str) -> list[str]:
    """Names, the newest first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    found = [(-s.getModificationTime(), s.getPath().getName()) for s in system.listStatus(path)]
    return [name.removeprefix("name=") for _, name in sorted(found) if name.startswith("name=")]
