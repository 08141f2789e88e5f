"""The driver's tables seen as a property graph, documents and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import EDGES, Graph
from ..operators.store import upsert_edges

#: Kinds of nodes: table, key, name, place in the order of seq, columns of the metadata.
KINDS = {
    "region": ("region", "r_regionkey", "r_name", 0, {}),
    "nation": ("nation", "n_nationkey", "n_name", 1, {}),
    "supplier": ("supplier", "s_suppkey", "s_name", 2, {"acctbal": "s_acctbal"}),
    "customer": ("customer", "c_custkey", "c_name", 3, {"acctbal": "c_acctbal", "segment": "c_mktsegment"}),
    "part": ("part", "p_partkey", "p_name", 4, {"brand": "p_brand", "ptype": "p_type", "size": "p_size", "price": "p_retailprice"}),
    "order": ("orders", "o_orderkey", "o_orderkey", 5, {"status": "o_orderstatus", "priority": "o_orderpriority", "total": "o_totalprice"}),
}
SPAN = 10**12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The nodes of kinds, or all."""
    whole = None
    for kind in kinds or KINDS:
        name, key, title, place, metadata = KINDS[kind]
        fields = [F.col(c).alias(k) for k, c in metadata.items()]
        part = table(spark, sf_dir, name).select(
            (F.lit(place * SPAN) + F.col(key)).cast("bigint").alias("seq"),
            F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id"),
            F.lit(kind).alias("type"),
            F.col(title).cast("string").alias("name"),
            F.lit(0.0).alias("boost"),
            (F.to_json(F.struct(*fields)) if fields else F.lit("{}")).alias("metadata"),
        )
        whole = part if whole is None else whole.unionByName(part)
    return whole


def _ref(kind: str, key: str):
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def edges(spark: SparkSession, sf_dir: str, *relationships: str) -> DataFrame:
    """The edges of relationships, or all; lines of an order or a supplier that repeat are upserted into one."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string").alias("metadata")
    plain = {
        "in_region": (0, "nation", "nation", "n_nationkey", "region", "n_regionkey"),
        "in_nation": (1, None, None, None, None, None),
        "placed_by": (2, "orders", "order", "o_orderkey", "customer", "o_custkey"),
    }
    made = {}
    for name, (place, source, a, a_key, b, b_key) in plain.items():
        if source:
            made[name] = lambda name=name, place=place, source=source, a=a, a_key=a_key, b=b, b_key=b_key: t(source).select((F.lit(place * SPAN) + F.col(a_key)).cast("bigint").alias("seq"), _ref(a, a_key).alias("src"), _ref(b, b_key).alias("dst"), F.lit(name).alias("relationship"), none)
    made["in_nation"] = lambda: t("customer").select((F.lit(SPAN) + F.col("c_custkey")).alias("seq"), _ref("customer", "c_custkey").alias("src"), _ref("nation", "c_nationkey").alias("dst"), F.lit("in_nation").alias("relationship"), none).unionByName(t("supplier").select((F.lit(SPAN + SPAN // 2) + F.col("s_suppkey")).alias("seq"), _ref("supplier", "s_suppkey").alias("src"), _ref("nation", "s_nationkey").alias("dst"), F.lit("in_nation").alias("relationship"), none))
    last = F.to_json(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("quantity")))

    def lines(name: str, place: int, a: str, a_key: str, b: str, b_key: str, metadata: Column) -> DataFrame:
        """Lines upserted by their numeric keys, which name the ends; ids are made of what is left."""
        seq = (F.lit(place * SPAN) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("seq")
        kept = upsert_edges(t("lineitem").select(seq, F.col(a_key).alias("src"), F.col(b_key).alias("dst"), F.lit(name).alias("relationship"), metadata.alias("metadata")))
        return kept.select("seq", _ref(a, "src").alias("src"), _ref(b, "dst").alias("dst"), F.lit(name).alias("relationship"), "metadata")

    made["contains"] = lambda: lines("contains", 3, "order", "l_orderkey", "part", "l_partkey", last)
    made["supplied_by"] = lambda: lines("supplied_by", 4, "part", "l_partkey", "supplier", "l_suppkey", F.lit(None).cast("string"))
    whole = None
    for name in relationships or made:
        part = made[name]().select("seq", "src", "dst", "relationship", "metadata")
        whole = part if whole is None else whole.unionByName(part)
    return whole


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, type, title, description): documents by their ids, with languages as types and sources as titles."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"), F.col("lang").alias("type"), F.col("source").alias("title"), F.col("text").alias("description"))


def document_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Documents as nodes without edges, with their length as metadata; good labels have a boost of a half."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(0.5).alias("boost")).distinct()
    docs = table(spark, sf_dir, "documents").join(good, "doc_id", "left")
    made = docs.select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("type"), F.col("source").alias("name"), F.coalesce("boost", F.lit(0.0)).alias("boost"), F.to_json(F.struct("n_chars")).alias("metadata"))
    return Graph(made, spark.createDataFrame([], EDGES))


def conversation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as notes of their conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("entity"), "text", F.col("turn").cast("bigint").alias("ts"))


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of puts: a key for each user and kind of event."""
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("put").alias("op"), key.alias("key"), F.col("props").alias("value"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))


#: The same in SQL, as common table expressions.
SQL_NODES = "\nUNION ALL ".join(f"SELECT ({place * SPAN} + {key})::BIGINT AS seq, '{kind}:' || {key} AS id, '{kind}' AS type, {title}::VARCHAR AS name FROM {name}" for kind, (name, key, title, place, _) in KINDS.items())
SQL_EDGES = f"""SELECT n_nationkey::BIGINT AS seq, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'in_region' AS relationship FROM nation
UNION ALL SELECT {SPAN} + c_custkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation' FROM customer
UNION ALL SELECT {SPAN + SPAN // 2} + s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation' FROM supplier
UNION ALL SELECT {2 * SPAN} + o_orderkey, 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by' FROM orders
UNION ALL SELECT min({3 * SPAN} + l_orderkey * 8 + l_linenumber), 'order:' || l_orderkey, 'part:' || l_partkey, 'contains' FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT min({4 * SPAN} + l_orderkey * 8 + l_linenumber), 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by' FROM lineitem GROUP BY l_partkey, l_suppkey"""
WITH = f"WITH RECURSIVE nodes AS ({SQL_NODES}),\nedges AS ({SQL_EDGES})"
