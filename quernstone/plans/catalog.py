"""Queries of the engine's operators over the driver's tables, with the SQL that they are held against.

"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, diff, export, graph as G, refs, search, stats, store
from ..operators.find import find, participating
from ..operators.lineage import shared
from ..operators.model import json_number, predicate, where_all
from ..operators.stored_index import StoredIndex
from ..streaming import changes
from .projection import SPAN, WITH, conversation_notes, document_graph, edges, graph, kv_log, nodes, search_documents, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def stored(spark: SparkSession, sf_dir: str, name: str = "search") -> StoredIndex:
    """The index of all documents, built in the shared folder when a session first asks for it; other names than "search" are built each time."""
    index = StoredIndex(spark, shared(spark, f"index-{name}-{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}"))
    if name != "search" or not index.exists():
        index.rebuild(search_documents(spark, sf_dir))
    return index


# -- find and its predicates


@query(f"""{WITH},
near AS (SELECT 'nation:11' AS id UNION SELECT src FROM edges WHERE dst = 'nation:11' UNION SELECT dst FROM edges WHERE src = 'nation:11')
SELECT n.id, n.type, n.name, c.c_acctbal AS acctbal FROM nodes n JOIN near USING (id) JOIN customer c ON n.id = 'customer:' || c.c_custkey
WHERE c.c_acctbal > 5000 ORDER BY c.c_acctbal DESC, n.seq LIMIT 20""")
def q1_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(graph(spark, sf_dir), type="customer", where={"acctbal": {"gt": 5000}}, near={"node": "nation:11", "maxDepth": 1}, sort="acctbal", limit=20)
    return found.select("id", "type", "name", json_number(F.col("metadata"), "acctbal").alias("acctbal"))


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size >= 10 AND p_size < 40")
def p7_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = nodes(spark, sf_dir, "part")
    brand = table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    return parts.where(where_all(F.col("metadata"), {"brand": brand, "size": {"gte": 10, "lt": 40}})).select("id")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def p6_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(spark, sf_dir, "order").where(predicate(F.col("metadata"), "status", {"in": ["F", "O", 7, None]}))
    return found.groupBy(F.get_json_object("metadata", "$.status").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE contains(c_mktsegment, 'BUILD')")
def p5_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir, "customer").where(predicate(F.col("metadata"), "segment", {"contains": "BUILD"})).select("id")


@query(f"{WITH} SELECT type, count(*) AS n FROM nodes WHERE type NOT IN ('supplier', 'customer') GROUP BY type")
def p4_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(spark, sf_dir).where(predicate(F.col("metadata"), "acctbal", {"exists": False, "gt": 3}))
    return found.groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_size = 7")
def p2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir, "part").where(predicate(F.col("metadata"), "size", 7) & ~predicate(F.col("metadata"), "size", "7")).select("id")


@query("SELECT 'supplier:' || s_suppkey AS id, s_acctbal AS acctbal FROM supplier WHERE s_acctbal <= 1000 AND s_acctbal >= -500 UNION ALL SELECT 'customer:' || c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 1000 AND c_acctbal >= -500")
def p3_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(spark, sf_dir).where(predicate(F.col("metadata"), "acctbal", {"lte": 1000, "gte": -500}))
    return found.select("id", json_number(F.col("metadata"), "acctbal").alias("acctbal"))


@query(f"{WITH} SELECT type, count(*) AS n FROM nodes WHERE id IN (SELECT src FROM edges WHERE relationship = 'placed_by' UNION SELECT dst FROM edges WHERE relationship = 'placed_by') GROUP BY type")
def p8_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return participating(nodes(spark, sf_dir), edges(spark, sf_dir, "placed_by"), "placed_by").groupBy("type").agg(F.count("*").alias("n"))


# -- scans and logs


@query(f"{WITH} SELECT seq, id, type, name FROM nodes WHERE type = 'nation'")
def s4_scan_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where(F.col("type") == "nation").select("seq", "id", "type", "name")


@query(f"{WITH} SELECT src, dst, relationship FROM edges WHERE relationship = 'in_region' OR (relationship = 'placed_by' AND dst = 'customer:1')")
def s5_scan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir, "in_region", "placed_by")
    return e.where((F.col("relationship") == "in_region") | ((F.col("relationship") == "placed_by") & (F.col("dst") == "customer:1"))).select("src", "dst", "relationship")


@query(f"{WITH} SELECT src, dst, relationship FROM edges WHERE src = 'supplier:1' UNION ALL SELECT src, dst, relationship FROM edges WHERE dst = 'supplier:1'")
def s7_edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_list(graph(spark, sf_dir), "supplier:1").select("src", "dst", "relationship")


@query("SELECT 'conv:' || conv_id AS entity, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS place, text FROM conversations")
def s8_notes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.notes_of(conversation_notes(spark, sf_dir)).select("entity", "place", "text")


@query(f"""{WITH} SELECT 'nation:3' AS id, (SELECT name FROM nodes WHERE id = 'nation:3') AS name, (SELECT count(*) FROM edges WHERE src = 'nation:3' OR dst = 'nation:3') AS edges,
(SELECT min_by(src, seq) FROM edges WHERE src = 'nation:3' AND relationship = 'in_region') AS first""")
def p10_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = G.lookup(graph(spark, sf_dir), node="nation:3", type="part", relationship="contains")
    return one.select(F.get_json_object("node", "$.id").alias("id"), F.get_json_object("node", "$.name").alias("name"), F.json_array_length("edges").cast("bigint").alias("edges"), F.get_json_object("edges", "$[0].from").alias("first"))


_KV = "kv AS (SELECT 'user:' || user_id || ':' || event_type AS key, arg_max(props, event_id) AS value, epoch_us(min(ts)) // 1000 AS created_at, epoch_us(arg_max(ts, event_id)) // 1000 AS updated_at FROM events GROUP BY 1)"


@query(f"WITH {_KV} SELECT key, value, created_at, updated_at FROM kv")
def m7_kv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.current_kv(kv_log(spark, sf_dir))


@query(f"WITH {_KV} SELECT key, updated_at FROM kv WHERE key LIKE 'user:1_:%'")
def s10_kv_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.kv_like(store.current_kv(kv_log(spark, sf_dir)), "USER:1_:%").select("key", "updated_at")


@query(f"WITH {_KV} SELECT substr(key, 8) AS key, updated_at FROM kv WHERE starts_with(key, 'user:7:')")
def m9_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.Namespace("user").namespace("7").query(store.current_kv(kv_log(spark, sf_dir))).select("key", "updated_at")


@query("""WITH puts AS (SELECT user_id, event_type, event_id, props FROM events WHERE event_type <> 'purchase'), gone AS (SELECT user_id, max(event_id) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT 'user:' || p.user_id AS key, arg_max(props, event_id) AS value, count(*) AS n FROM puts p LEFT JOIN gone g USING (user_id) WHERE g.at IS NULL OR event_id > g.at GROUP BY 1""")
def m8_kv_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "delete").otherwise("put").alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    kept = store.current_kv(log)
    n = log.where("op = 'put'").join(log.where("op = 'delete'").groupBy("key").agg(F.max("seq").alias("at")), "key", "left").where("at IS NULL OR seq > at").groupBy("key").agg(F.count("*").alias("n"))
    return kept.select("key", "value").join(n, "key")


@query("""WITH e AS (SELECT 'user:' || user_id AS id, * FROM events), gone AS (SELECT id, max(event_id) AS at FROM e WHERE event_type = 'purchase' AND event_id % 5 = 0 GROUP BY id),
puts AS (SELECT e.* FROM e LEFT JOIN gone g USING (id) WHERE event_type IN ('view', 'signup', 'click') AND (g.at IS NULL OR event_id > g.at)),
n AS (SELECT id, min(event_id) AS seq, arg_max(event_type, event_id) AS type, arg_max(CASE WHEN event_type <> 'click' THEN props END, event_id) AS unused, arg_max(coalesce(CASE WHEN event_type <> 'click' THEN props END, '-'), event_id) AS m FROM puts GROUP BY id),
b AS (SELECT id, max(event_id) AS at, arg_max(value, event_id) AS boost FROM e WHERE event_type = 'error' GROUP BY id)
SELECT n.id, n.type, n.seq, CASE WHEN m = '-' THEN NULL ELSE m END AS metadata, CASE WHEN b.at > n.seq THEN b.boost ELSE 0 END::DOUBLE AS boost FROM n LEFT JOIN b USING (id)""")
def m1_node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts, of which clicks clear the metadata, deletes and boosts, in the order of events."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("type"), "value", "props")
    op = F.when(F.col("type").isin("view", "signup", "click"), "put").when((F.col("type") == "purchase") & (F.col("seq") % 5 == 0), "delete")
    log = e.select("seq", op.alias("op"), "id", "type", F.lit("u").alias("name"), F.when(F.col("type") != "click", F.col("props")).alias("metadata")).where("op IS NOT NULL")
    boosts = e.where("type = 'error'").select("seq", "id", F.col("value").cast("double").alias("boost"))
    return store.current_nodes(log, boosts).select("id", "type", "seq", "metadata", "boost")


@query("""WITH e AS (SELECT *, 'user:' || user_id AS src, 'item:' || (event_id % 50) AS dst FROM events), cut AS (SELECT src, max(event_id) AS at FROM e WHERE event_type = 'purchase' AND event_id % 10 = 0 GROUP BY src),
log AS (SELECT e.* FROM e LEFT JOIN cut c USING (src) WHERE event_type IN ('view', 'click', 'error') AND (c.at IS NULL OR c.at < event_id)),
gone AS (SELECT src, dst, max(event_id) AS at FROM log WHERE event_type = 'error' GROUP BY ALL)
SELECT l.src, l.dst, min(event_id) AS seq, arg_max(props, event_id) AS metadata FROM log l LEFT JOIN gone g ON l.src = g.src AND l.dst = g.dst WHERE event_type <> 'error' AND (g.at IS NULL OR event_id > g.at) GROUP BY l.src, l.dst""")
def m2_edge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("item:"), (F.col("event_id") % 50).cast("string")).alias("dst"), "event_type", "props")
    log = e.where("event_type IN ('view', 'click', 'error')").select("seq", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "src", "dst", F.lit("did").alias("relationship"), F.col("props").alias("metadata"))
    deleted = e.where("event_type = 'purchase' AND seq % 10 = 0").select("seq", F.col("src").alias("id"))
    return store.current_edges(log, deleted).select("src", "dst", "seq", "metadata")


@query(f"""WITH l AS (SELECT l_orderkey, l_partkey, min({3 * SPAN} + l_orderkey * 8 + l_linenumber) AS seq, max(l_linenumber) AS line FROM lineitem GROUP BY 1, 2)
SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, seq, line FROM l""")
def m2_edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir, "contains").select("src", "dst", "seq", F.get_json_object("metadata", "$.line").cast("int").alias("line"))


@query(f"{WITH} SELECT relationship, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE type = 'nation' AND seq % 2 = 0) AND dst NOT IN (SELECT id FROM nodes WHERE type = 'nation' AND seq % 2 = 0) GROUP BY 1")
def m3_node_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    _, kept = store.delete_nodes(g.nodes, g.edges, g.nodes.where((F.col("type") == "nation") & (F.col("seq") % 2 == 0)).select("id"))
    return kept.groupBy("relationship").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT relationship, count(*) AS n FROM edges WHERE NOT (relationship = 'in_region' AND dst = 'region:1') GROUP BY 1")
def m4_edge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph(spark, sf_dir).edges
    keys = e.where("relationship = 'in_region' AND dst = 'region:1'").select("src", "dst", "relationship")
    return store.delete_edges(e, keys).groupBy("relationship").agg(F.count("*").alias("n"))


@query("SELECT 'doc:' || doc_id AS path, strlen(text) AS size, CASE WHEN strlen(text) > 500000 THEN 'too_large' WHEN doc_id % 3 = 0 THEN 'unchanged' ELSE 'parse' END AS state FROM documents")
def s3_hash_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("bigint").alias("size"), F.col("text").alias("content"))
    known = docs.select("path", F.when(F.col("doc_id") % 3 == 0, F.xxhash64("content")).otherwise(F.lit(0)).alias("hash"))
    return store.to_scan(docs, known).select("path", "size", "state")


@query("""WITH old AS (SELECT c_nationkey AS path, c_custkey AS key FROM customer WHERE c_custkey % 10 <> 0), new AS (SELECT c_nationkey AS path, c_custkey AS key FROM customer WHERE c_custkey % 7 <> 0 AND c_nationkey < 20)
SELECT path::VARCHAR AS path, key::VARCHAR AS key, 'put' AS op FROM new UNION ALL
SELECT path::VARCHAR, key::VARCHAR, 'delete' FROM old WHERE path IN (SELECT path FROM new) AND key NOT IN (SELECT key FROM new)""")
def m12_slice_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("path"), F.lit("node").alias("kind"), F.col("c_custkey").cast("string").alias("key"))
    old, new = c.where("c_custkey % 10 <> 0").drop("c_custkey"), c.where("c_custkey % 7 <> 0 AND cast(path AS int) < 20").drop("c_custkey")
    return store.slice_changes(old, new).select("path", "key", "op")


@query("SELECT 'doc:' || doc_id AS path FROM documents WHERE doc_id % 5 = 0")
def m14_gone_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("path"))
    return store.gone_files(paths, paths.where("doc_id % 5 <> 0"))


# -- graph


@query(f"{WITH} SELECT id, name FROM nodes WHERE id IN (SELECT dst FROM edges WHERE src = 'nation:3' UNION SELECT src FROM edges WHERE dst = 'nation:3')")
def g1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(graph(spark, sf_dir), "nation:3").select("id", "name")


_REACH = f"""{WITH},
walk AS (SELECT 'part:1' AS id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE w.depth < 3),
ball AS (SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id)"""


@query(f"{_REACH} SELECT n.id, n.type, b.depth FROM ball b JOIN nodes n USING (id)")
def g2_traverse_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.traverse(graph(spark, sf_dir), "part:1", max_depth=3)[0].select("id", "type", "depth")


@query(f"{_REACH} SELECT DISTINCT e.src, e.dst, e.relationship FROM edges e JOIN ball b ON e.src = b.id WHERE b.depth < 3")
def g2_traverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.traverse(graph(spark, sf_dir), "part:1", max_depth=3)[1].select("src", "dst", "relationship")


@query(f"{_REACH} SELECT id FROM ball")
def g3_depth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth can't bind here, so the ids are those of a breadth-first walk."""
    return G.traverse_depth_first(graph(spark, sf_dir), "part:1", max_depth=10).select("id")


@query(f"""{WITH},
step AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk AS (SELECT 'customer:1' AS id, 0 AS depth UNION SELECT s.b, w.depth + 1 FROM walk w JOIN step s ON s.a = w.id WHERE w.depth < 7)
SELECT min(depth)::BIGINT AS length FROM walk WHERE id = 'region:2'""")
def g4_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = G.shortest_path(graph(spark, sf_dir), "customer:1", "region:2")
    return path.agg(F.max("step").cast("bigint").alias("length"))


@query(f"""{WITH},
walk AS (SELECT id AS root, id, 0 AS depth FROM nodes WHERE type = 'part' UNION SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE w.depth < 6),
best AS (SELECT root, id, min(depth) AS depth FROM walk GROUP BY 1, 2)
SELECT root, max(depth)::INTEGER AS depth, count(*) AS reached FROM best GROUP BY root""")
def g7_dependency_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = nodes(spark, sf_dir, "part").select(F.col("id").alias("root"))
    far = G.distances(edges(spark, sf_dir, "supplied_by", "in_nation", "in_region"), roots, "outgoing")
    return far.groupBy("root").agg(F.max("depth").alias("depth"), F.count("*").alias("reached"))


@query(f"""{WITH}, walk AS (SELECT 'part:2' AS id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id AND e.relationship IN ('supplied_by', 'in_nation') WHERE w.depth < 2)
SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id HAVING min(depth) > 0""")
def g6_collect_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.collect_related(graph(spark, sf_dir), "part:2", "outgoing", ["supplied_by", "in_nation"], 2)


@query()
def g3_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A depth that binds: which ids are reached depends on the order, which SQL has no form for."""
    return G.traverse_depth_first(graph(spark, sf_dir), "supplier:1", direction="both", max_depth=3)


@query(f"{WITH}, ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) SELECT id, count(*) AS degree FROM ends GROUP BY id")
def g8_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(edges(spark, sf_dir)).select("id", "degree")


# -- statistics


@query(f"{WITH} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def a1_count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_by_type(graph(spark, sf_dir))


@query(f"{WITH} SELECT relationship, count(*) AS n FROM edges GROUP BY relationship")
def a2_count_by_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_by_relationship(graph(spark, sf_dir))


@query(f"{WITH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def a3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.nodes.agg(F.count("*").alias("nodes")).crossJoin(g.edges.agg(F.count("*").alias("edges")))


@query("SELECT round(avg(p_size), 6) AS mean, max(p_size)::DOUBLE AS greatest, 'part:' || arg_min(p_partkey, struct_pack(a := -p_size, b := p_partkey)) AS most FROM part")
def a5_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.complexity(graph(spark, sf_dir), "size").select(F.round("mean", 6).alias("mean"), "greatest", "most")


_ENDS = "ends AS (SELECT src AS id, seq, 0 AS e FROM edges UNION ALL SELECT dst, seq, 1 FROM edges), deg AS (SELECT id, count(*) AS degree, min(seq * 2 + e) AS first FROM ends GROUP BY id)"


@query(f"{WITH}, {_ENDS} SELECT id, degree FROM deg ORDER BY degree DESC, first LIMIT 10")
def a6_most_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.most_connected(graph(spark, sf_dir))


@query(f"""{WITH}, {_ENDS}
SELECT 'part:' || p_partkey AS id, p_size::DOUBLE AS complexity, coalesce(degree, 0) AS degree, (p_size * (1 + coalesce(degree, 0)))::DOUBLE AS score
FROM part LEFT JOIN deg ON id = 'part:' || p_partkey WHERE p_size > 0 ORDER BY score DESC, p_partkey LIMIT 10""")
def a7_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hotspots(graph(spark, sf_dir), "size")


@query("""WITH m AS (SELECT l_orderkey, max(l_linenumber) AS most FROM lineitem GROUP BY 1), o AS (SELECT l_orderkey, coalesce(sum(most) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM m)
SELECT l_orderkey AS part, (l_linenumber + off)::BIGINT AS id, (CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber - 1 + off END)::BIGINT AS parent FROM lineitem JOIN o USING (l_orderkey)""")
def a19_running_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as the records of many parts, each of which refers to the line before."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("part"), F.col("l_linenumber").cast("bigint").alias("id"), (F.col("l_linenumber") - 1).cast("bigint").alias("parent"))
    return store.merged_ids(lines, "part", "id", "parent").select("part", "id", "parent")


_TOP = "(SELECT string_agg(id, ',' ORDER BY degree DESC, first) FROM (SELECT * FROM deg ORDER BY degree DESC, first LIMIT 10))"


@query(f"""{WITH}, {_ENDS}, far AS (SELECT id AS root, id, 0 AS depth FROM nodes WHERE type = 'nation' UNION SELECT f.root, e.dst, f.depth + 1 FROM far f JOIN edges e ON e.src = f.id AND e.relationship IN ('in_region', 'in_nation')),
hot AS (SELECT 'part:' || p_partkey AS id, p_size * (1 + coalesce(degree, 0)) AS score, p_partkey FROM part LEFT JOIN deg ON id = 'part:' || p_partkey WHERE p_size > 0 ORDER BY score DESC, p_partkey LIMIT 10)
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM nodes GROUP BY type)) AS types,
round((SELECT avg(p_size) FROM part), 6) AS mean, (SELECT 'part:' || arg_min(p_partkey, struct_pack(a := -p_size, b := p_partkey)) FROM part) AS most, {_TOP} AS connected, (SELECT string_agg(id, ',' ORDER BY score DESC, p_partkey) FROM hot) AS hotspots, (SELECT max(depth)::BIGINT FROM far) AS depth""")
def c1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics as one object."""
    s = stats.compute(graph(spark, sf_dir), "size", "nation", ["in_region", "in_nation"])
    listed = lambda rows: ",".join(r["id"] for r in rows)
    row = (s["totalNodes"], s["totalEdges"], ",".join(f"{k}={n}" for k, n in sorted(s["nodes"].items())), round(s["avgComplexity"], 6), s["maxComplexity"]["id"], listed(s["mostConnected"]), listed(s["hotspots"]), s["maxDependencyDepth"])
    return spark.createDataFrame([row], "nodes bigint, edges bigint, types string, mean double, most string, connected string, hotspots string, depth bigint")


# -- search


_TOKENS = r"SELECT 'doc:' || doc_id AS key, lang AS type, source AS title, text, regexp_extract_all(strip_accents(lower(source)), '[\p{L}\p{N}]+') AS tt, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS dt FROM documents"


def _bm25(terms: list[str]) -> str:
    counts = ", ".join(f"len(list_filter(tt, lambda x: x = '{t}')) + len(list_filter(dt, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    totals = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i, _ in enumerate(terms))
    idf = lambda i: f"ln((n - n{i} + 0.5) / (n{i} + 0.5))"
    score = " + ".join(f"CASE WHEN {idf(i)} > 0 THEN {idf(i)} ELSE 1e-6 END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i, _ in enumerate(terms))
    every = " AND ".join(f"f{i} > 0" for i, _ in enumerate(terms))
    return f"""d AS ({_TOKENS}), c AS (SELECT key, type, len(tt) + len(dt) AS size, {counts} FROM d),
s AS (SELECT count(*) AS n, avg(size) AS mean, {totals} FROM c), hits AS (SELECT key, type, {score} AS raw FROM c, s WHERE {every})"""


@query(f"WITH {_bm25(['blend', 'the'])} SELECT key, type, round(raw, 6) AS raw FROM hits")
def b5_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = stored(spark, sf_dir).word_hits(search.query_terms('"Blend" AND the'))
    return hits.select("key", "type", F.round("raw", 6).alias("raw"))


@query(f"WITH {_bm25(['esan'])} SELECT key, type, round(least(100, greatest(0, raw * 10)), 6) AS score FROM (SELECT * FROM hits ORDER BY raw DESC, key LIMIT 100) ORDER BY score DESC, key LIMIT 20")
def b11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(spark, sf_dir).search("esan")
    return found.select("key", "type", F.round("score", 6).alias("score"))


_CHANGED = _bm25(["esan"]).replace(_TOKENS, "SELECT * FROM (" + _TOKENS.replace("lang AS type, source AS title", "CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE lang END AS type, source AS title").replace("lower(source)", "lower(CASE WHEN doc_id % 7 = 0 THEN source || ' Ésan x' ELSE source END)") + " WHERE doc_id % 11 <> 0)")


def _change(spark: SparkSession, sf_dir: str, name: str) -> StoredIndex:
    """An index of all documents, then a generation in which every 11th goes and every 7th has another type and title."""
    index = stored(spark, sf_dir, name)
    docs = search_documents(spark, sf_dir).withColumn("n", F.substring("key", 5, 20).cast("bigint"))
    gone = docs.where("n % 11 = 0").withColumns({"op": F.lit("delete"), "seq": F.lit(2)})
    new = docs.where("n % 7 = 0").withColumns({"op": F.lit("put"), "seq": F.lit(1), "type": F.lit("new"), "title": F.concat("title", F.lit(" Ésan x"))})
    return index.apply(gone.unionByName(new).drop("n"))


@query(f"WITH {_CHANGED} SELECT key, type, round(raw, 6) AS raw FROM hits")
def b12_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _change(spark, sf_dir, "b12").word_hits(["esan"])
    return hits.select("key", "type", F.round("raw", 6).alias("raw"))


@query(f"WITH {_CHANGED} SELECT key, type, round(raw, 6) AS raw FROM hits")
def b13_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _change(spark, sf_dir, "b13").rebuild().word_hits(["esan"])
    return hits.select("key", "type", F.round("raw", 6).alias("raw"))


@query("""WITH d AS (SELECT 'doc:' || doc_id AS key, lower(text) AS t, greatest(length(source) - 2, 0) + greatest(length(text) - 2, 0) AS size FROM documents),
c AS (SELECT key, size, CASE WHEN contains(t, 'hshtionhe') THEN len(list_filter(range(1, greatest(length(t) - 7, 1)), lambda i: substr(t, i, 9) = 'hshtionhe')) ELSE 0 END AS f FROM d),
s AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (WHERE f > 0) AS h FROM c)
SELECT key, round(CASE WHEN ln((n - h + 0.5) / (h + 0.5)) > 0 THEN ln((n - h + 0.5) / (h + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS raw FROM c, s WHERE f > 0""")
def b6_trigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.trigram_hits(search.index(search_documents(spark, sf_dir)), "hshtionhe")
    return hits.select("key", F.round("raw", 6).alias("raw"))


_BOOSTED = f"""{_bm25(['esan'])}, top AS (SELECT * FROM hits ORDER BY raw DESC, key LIMIT 100), good AS (SELECT DISTINCT 'doc:' || doc_id AS key FROM labels WHERE quality = 1),
scored AS (SELECT key, type, round(least(100, greatest(0, (raw + CASE WHEN g.key IS NULL THEN 0 ELSE 0.5 END) * 10)), 6) AS score FROM top t LEFT JOIN good g USING (key))"""


@query(f"WITH {_BOOSTED} SELECT key, score FROM scored WHERE type IN ('en', 'fr') ORDER BY score DESC, key LIMIT 15")
def b7_boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(spark, sf_dir).search("esan", document_graph(spark, sf_dir).nodes, ["en", "fr"], 15)
    return found.select("key", F.round("score", 6).alias("score"))


@query(f"""WITH {_bm25(['src3'])}, f AS (SELECT key, list_contains(tt, 'src3') AS t, list_contains(dt, 'src3') AS d FROM ({_TOKENS}))
SELECT key, CASE WHEN t AND d THEN 'title,description' WHEN t THEN 'title' ELSE 'description' END AS fields FROM (SELECT * FROM hits ORDER BY raw DESC, key LIMIT 100) JOIN f USING (key) ORDER BY least(100, raw * 10) DESC, key LIMIT 20""")
def b9_matched_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).search("src3").select("key", F.array_join("matched_fields", ",").alias("fields"))


@query(f"""WITH {_bm25(['esan'])}, best AS (SELECT key FROM (SELECT * FROM hits ORDER BY raw DESC, key LIMIT 100) ORDER BY least(100, raw * 10) DESC, key LIMIT 20)
SELECT key, '{{"id":"' || key || '","type":"' || lang || '","name":"' || source || '","metadata":"{{\\"n_chars\\":' || n_chars || '}}"}}' AS value FROM best JOIN documents ON key = 'doc:' || doc_id""")
def b10_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hydrate(stored(spark, sf_dir).search("esan"), document_graph(spark, sf_dir)).select("key", "value")


@query(f"WITH {_BOOSTED}, most AS (SELECT * FROM scored WHERE type = 'en' ORDER BY score DESC, key LIMIT 100) SELECT key AS id, score, n_chars::DOUBLE AS n_chars FROM most JOIN documents ON key = 'doc:' || doc_id WHERE n_chars >= 500 ORDER BY score DESC, doc_id LIMIT 20")
def q1_find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(document_graph(spark, sf_dir), type="en", where={"n_chars": {"gte": 500}}, text="esan", indexed=stored(spark, sf_dir))
    return found.select("id", F.round("score", 6).alias("score"), json_number(F.col("metadata"), "n_chars").alias("n_chars"))


@query("""WITH d AS (SELECT 'doc:' || doc_id AS key, lower(text) AS t, greatest(length(source) - 2, 0) + greatest(length(text) - 2, 0) AS size FROM documents),
c AS (SELECT key, size, CASE WHEN contains(t, 'hshtionhe') THEN len(list_filter(range(1, greatest(length(t) - 7, 1)), lambda i: substr(t, i, 9) = 'hshtionhe')) ELSE 0 END AS f FROM d),
s AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (WHERE f > 0) AS h FROM c)
SELECT key, round(least(100, 7 * ln((n - h + 0.5) / (h + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM c, s WHERE f > 0""")
def b6_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No word is as the query, so the hits are those by trigrams, at 0.7 of their score; all of them, as SQL has them."""
    return stored(spark, sf_dir).search("hshtionhe", limit=None, candidates=None).select("key", F.round("score", 6).alias("score"))


@query(r"SELECT doc_id, len(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'))::BIGINT AS words, array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')[1:5], ' ') AS head FROM documents")
def b2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("bigint").alias("words"), F.array_join(F.slice(words, 1, 5), " ").alias("head"))


# -- difference, export, references, context


_VERSIONS = """old AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 10 <> 0),
new AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) || '!' ELSE c_name END AS name FROM customer WHERE c_custkey % 11 <> 0)"""


@query(f"""WITH {_VERSIONS} SELECT 'customer:' || coalesce(o.k, n.k) AS id, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old o FULL JOIN new n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.name <> n.name""")
def d1_compare_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = nodes(spark, sf_dir, "customer")
    key = F.col("seq") - 3 * SPAN
    new = c.where(key % 11 != 0).withColumn("name", F.when(key % 7 == 0, F.concat(F.upper("name"), F.lit("!"))).otherwise(F.col("name")))
    return diff.compare_nodes(c.where(key % 10 != 0), new)


@query(f"""{WITH} SELECT src || ' -[' || relationship || ']-> ' || dst AS edge, 'removed' AS change FROM edges WHERE seq % 5 = 0 AND seq % 3 <> 0
UNION ALL SELECT src || ' -[' || relationship || ']-> ' || dst, 'added' FROM edges WHERE seq % 3 = 0 AND seq % 5 <> 0""")
def d1_compare_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return diff.compare_edges(e.where("seq % 3 <> 0"), e.where("seq % 5 <> 0"))


@query(f"""{WITH}, mine AS (SELECT * FROM edges WHERE src LIKE 'nation:%' OR dst LIKE 'nation:%')
SELECT relationship, count(*) AS n FROM mine GROUP BY 1""")
def x1_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.gather(graph(spark, sf_dir), type="nation").edges.groupBy("relationship").agg(F.count("*").alias("n"))


@query(f"""{WITH}, part AS (SELECT * FROM edges WHERE relationship = 'in_region')
SELECT '  "' || id || '" [shape=box, label="' || name || '"];' AS line FROM nodes WHERE id IN (SELECT src FROM part UNION SELECT dst FROM part)
UNION ALL SELECT '  "' || src || '" -> "' || dst || '" [label="in_region"];' FROM part
UNION ALL SELECT unnest(['digraph G {{', '  rankdir=LR;', '  node [shape=box, fontname="Helvetica", fontsize=10];', '  edge [fontname="Helvetica", fontsize=8];', '', '', '}}'])""")
def x2_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.dot_lines(export.gather(graph(spark, sf_dir), relationship="in_region")).select("line")


@query(f"""{WITH},
meta AS (SELECT 'supplier:' || s_suppkey AS id, '{{"acctbal":' || s_acctbal || '}}' AS metadata FROM supplier
UNION ALL SELECT 'customer:' || c_custkey, '{{"acctbal":' || c_acctbal || ',"segment":"' || c_mktsegment || '"}}' FROM customer
UNION ALL SELECT 'part:' || p_partkey, '{{"brand":"' || p_brand || '","ptype":"' || p_type || '","size":' || p_size || ',"price":' || p_retailprice || '}}' FROM part
UNION ALL SELECT 'order:' || o_orderkey, '{{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '","total":' || o_totalprice || '}}' FROM orders),
line AS (SELECT l_orderkey, l_partkey, l_linenumber, '{{"line":' || l_linenumber || ',"quantity":' || l_quantity::INTEGER || '}}' AS text FROM lineitem),
last AS (SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, max(struct_pack(a := l_linenumber, b := text)).b AS metadata FROM line GROUP BY l_orderkey, l_partkey)
SELECT '{{"id":"' || id || '","type":"' || type || '","name":"' || name || '","metadata":' || coalesce(metadata, '{{}}') || '}}' AS json FROM nodes LEFT JOIN meta USING (id)
UNION ALL SELECT '{{"from":"' || src || '","to":"' || dst || '","relationship":"' || relationship || '"' || coalesce(',"metadata":' || metadata, '') || '}}' FROM edges LEFT JOIN last USING (src, dst)""")
def x3_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.json_rows(graph(spark, sf_dir)).select("json")


@query(f"{WITH} SELECT e.src AS node_id, n.type, e.relationship FROM edges e JOIN nodes n ON n.id = e.src WHERE e.dst = 'nation:5' UNION ALL SELECT e.dst, n.type, e.relationship FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src = 'nation:5'")
def r1_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.find_refs(graph(spark, sf_dir), "nation:5").select("node_id", "type", "relationship")


@query(f"{WITH} SELECT substr(e.src, 1, instr(e.src, ':') - 1) AS file, e.src AS node_id, e.relationship FROM edges e WHERE e.dst = 'region:2'")
def r2_rename_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.rename_impact(graph(spark, sf_dir), "region:2")


@query("""WITH RECURSIVE c AS (SELECT conv_id AS focus, turn, ceil(length(text) / 4.0)::BIGINT AS tokens, CASE WHEN turn = 0 THEN 0 WHEN role = 'assistant' THEN 2 ELSE 1 END AS category FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY category, turn) AS i FROM c),
w AS (SELECT focus, i, category, turn, tokens, CASE WHEN category = 0 OR tokens <= 300 THEN tokens ELSE 0 END AS used, CASE WHEN category > 0 AND tokens > 300 THEN category ELSE -1 END AS closed,
  category = 0 OR tokens <= 300 AS kept FROM o WHERE i = 1
UNION ALL SELECT o.focus, o.i, o.category, o.turn, o.tokens,
  CASE WHEN w.closed <> o.category AND (o.category = 0 OR w.used + o.tokens <= 300) THEN w.used + o.tokens ELSE w.used END,
  CASE WHEN w.closed <> o.category AND NOT (o.category = 0 OR w.used + o.tokens <= 300) THEN o.category ELSE w.closed END,
  w.closed <> o.category AND (o.category = 0 OR w.used + o.tokens <= 300) FROM w JOIN o ON o.focus = w.focus AND o.i = w.i + 1)
SELECT focus, category, turn AS ord, tokens, used FROM w WHERE kept""")
def r4_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    category = F.when(F.col("turn") == 0, 0).when(F.col("role") == "assistant", 2).otherwise(1)
    return context.admit(c.select(F.col("conv_id").alias("focus"), category.alias("category"), F.col("turn").alias("ord"), T.token_estimate(F.col("text")).alias("tokens")), 300)


@query("SELECT page_id, ceil(length(html) / 4.0)::BIGINT AS tokens, array_to_string(string_split(html, chr(10))[1:2], chr(10)) AS head FROM pages")
def s11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.token_estimate(F.col("html")).alias("tokens"), context.lines_of(F.col("html"), F.lit(1), F.lit(2)).alias("head"))


# -- changes


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id::VARCHAR AS key, epoch_us(min(ts)) // 1000 AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e) GROUP BY user_id, k""")
def t2_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user"))
    return changes.debounce(e, "30 minutes", "user").select("key", F.unix_millis("start").alias("start"), "n")


@query("SELECT user_id::VARCHAR AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS op FROM events GROUP BY user_id")
def t7_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("op"))
    return changes.coalesce_changes(e)


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN contains(text, 'fs.') OR contains(text, 'readFile') OR contains(text, 'writeFile') OR contains(text, 'appendFile') OR contains(text, 'unlink') OR contains(text, 'mkdir') THEN CASE WHEN contains(text, 'read') THEN 'file_read' ELSE 'file_write' END
WHEN contains(text, 'fetch') OR contains(text, 'axios') OR contains(text, 'http.') OR contains(text, 'https.') THEN 'network'
WHEN contains(text, 'db.') OR contains(text, 'prisma.') OR contains(text, 'mongoose.') OR contains(text, '.query') OR contains(text, '.find') OR contains(text, '.create') OR contains(text, '.update') OR contains(text, '.delete') OR contains(text, '.save') THEN CASE WHEN contains(text, 'find') OR contains(text, 'get') OR contains(text, 'query') OR contains(text, 'select') THEN 'db_read' ELSE 'db_write' END
WHEN contains(text, 'console.') THEN 'console' WHEN contains(text, 'process.') OR contains(text, 'child_process') THEN 'process' WHEN contains(text, 'document.') OR contains(text, 'window.') OR contains(text, 'getElementById') OR contains(text, 'querySelector') THEN 'dom' WHEN contains(text, 'localStorage') OR contains(text, 'sessionStorage') THEN 'storage' END AS label
FROM (SELECT html AS text FROM pages UNION ALL SELECT text FROM documents UNION ALL SELECT word || '.' || event_type FROM events, (SELECT unnest(['fs', 'db', 'db.find', 'http', 'console', 'process', 'window', 'localStorage', 'x']) AS word))) GROUP BY label""")
def f13_side_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier of call chains over all texts, pages and chains made of events."""
    words = F.explode(F.array(*(F.lit(w) for w in ("fs", "db", "db.find", "http", "console", "process", "window", "localStorage", "x"))))
    chains = table(spark, sf_dir, "events").select("event_type", words.alias("word")).select(F.concat("word", F.lit("."), "event_type").alias("text"))
    texts = table(spark, sf_dir, "pages").select(F.col("html").alias("text")).unionByName(table(spark, sf_dir, "documents").select("text")).unionByName(chains)
    return texts.select(T.side_effect(F.col("text")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(f"""WITH h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), c AS (SELECT page_id, href, unnest([href, href || '/', '/en/' || length(href), '/fr/' || length(href), '/de/' || length(href) * 7]) AS file, unnest([0, 1, 2, 3, 4]) AS rank FROM h)
SELECT page_id, href, arg_min(file, rank) AS file FROM c WHERE file IN (SELECT {_PATH} FROM pages) GROUP BY page_id, href""")
def j14_first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of pages, each to the first of its candidate paths that a page has."""
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    n = F.length("href")
    among = F.array(F.col("href"), F.concat("href", F.lit("/")), F.concat(F.lit("/en/"), n.cast("string")), F.concat(F.lit("/fr/"), n.cast("string")), F.concat(F.lit("/de/"), (n * 7).cast("string")))
    wanted = links.select("page_id", "href", F.posexplode(among).alias("rank", "file"))
    return refs.first_existing(wanted, p.select(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("file")), "page_id", "href")
