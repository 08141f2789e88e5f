"""Traversal, find, statistics, difference, export, references and state, on small graphs."""

import json

import pytest

from quernstone.operators import context, diff, export, graph as G, refs, search, stats, store
from quernstone.operators.find import find
from quernstone.operators.model import EDGES, KV, NODES, NOTES, Graph


def make(spark, nodes, edges, notes=(), kv=()):
    n = [(i, ident, kind, ident if name is None else name, boost, json.dumps(meta) if meta is not None else None) for i, (ident, kind, name, boost, meta) in enumerate(nodes)]
    e = [(i, a, b, r, json.dumps(m) if m else None) for i, (a, b, r, m) in enumerate(edges)]
    return Graph(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES), spark.createDataFrame(list(notes), NOTES), spark.createDataFrame(list(kv), KV))


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


@pytest.fixture(scope="module")
def calls(spark):
    names = [(n, "function", None, 0.0, None) for n in ("main", "server", "handler", "auth")] + [(n, "module", None, 0.0, None) for n in ("db", "utils")]
    return make(spark, names, [(a, b, "calls", None) for a, b in (("main", "server"), ("server", "handler"), ("server", "auth"), ("handler", "db"), ("auth", "db"))])


def test_neighbours(calls):
    assert ids(G.neighbours(calls, "server", "outgoing")) == {"handler", "auth"}
    assert ids(G.neighbours(calls, "db", "incoming")) == {"handler", "auth"}
    assert ids(G.neighbours(calls, "server")) == {"main", "handler", "auth"}
    assert ids(G.neighbours(calls, "utils", "outgoing")) == set()
    with pytest.raises(ValueError):
        G.neighbours(calls, "utils", "sideways")


def test_traverse(calls):
    nodes, edges, depth = G.traverse(calls, "main")
    assert ids(nodes) == {"main", "server", "handler", "auth", "db"} and edges.count() == 5 and depth == 3
    assert ids(G.traverse(calls, "main", max_depth=1)[0]) == {"main", "server"}
    assert ids(G.traverse(calls, "db", "incoming")[0]) == {"db", "handler", "auth", "server", "main"}
    nodes, edges, depth = G.traverse(calls, "utils")
    assert nodes.count() == 1 and edges.count() == 0 and depth == 0
    assert ids(G.traverse_depth_first(calls, "main")) == {"main", "server", "handler", "auth", "db"}


def test_shortest_path(calls):
    path = lambda a, b, **k: [r.id for r in G.shortest_path(calls, a, b, **k).orderBy("step").collect()]
    assert path("main", "server") == ["main", "server"]
    assert path("main", "utils") == [] and path("main", "main") == ["main"]
    assert path("handler", "main", direction="outgoing") == []
    assert path("main", "db") == ["main", "server", "auth", "db"]


def test_cycles_parallel_edges_and_ends_without_nodes(spark):
    g = make(spark, [("x", "f", None, 0.0, None), ("y", "f", None, 0.0, None)], [("x", "y", "calls", None), ("y", "x", "calls", None), ("x", "y", "imports", None), ("x", "x", "calls", None), ("y", "ghost", "calls", None), ("ghost", "y", "calls", None)])
    nodes, edges, depth = G.traverse(g, "x", "both")
    assert ids(nodes) == {"x", "y"} and edges.count() == 6 and depth == 2
    assert {(r.id, r.degree) for r in G.degrees(g.edges).collect()} == {("x", 5), ("y", 5), ("ghost", 2)}
    assert G.edge_list(g, "x").count() == 5
    assert G.topological_order({"a": ["b"], "b": [], "c": ["a"]}) == ["b", "a", "c"]
    with pytest.raises(ValueError):
        G.topological_order({"a": ["b"], "b": ["a"]})


def test_depth_of_chains(spark):
    n = 20
    g = make(spark, [(f"f{i}", "file", None, 0.0, None) for i in range(n)], [(f"f{i}", f"f{i + 1}", "imports", None) for i in range(n)])
    assert G.max_dependency_depth(g) == n


@pytest.fixture(scope="module")
def handlers(spark):
    meta = lambda c, e, line: {"complexity": c, "exported": e, "line": line}
    nodes = [("a.ts:handlerAlpha", "function", "handlerAlpha", 0.0, meta(9, True, 10)), ("b.ts:handlerBeta", "function", "handlerBeta", 0.0, meta(2, True, 20)), ("c.ts:handlerGamma", "function", "handlerGamma", 0.0, meta(7, False, 30)), ("a.ts", "file", "a.ts", 0.0, {"functions": 1})]
    kv = [("deploy:last", '{"status": "green", "attempts": 3}', 1, 2), ("plain", '"a string of needs"', 1, 3)]
    return make(spark, nodes, [("a.ts", "a.ts:handlerAlpha", "defines", None), ("b.ts", "a.ts", "imports", {"specifiers": ["handlerAlpha"]})], [(0, "thing", "needs a look", 1), (1, "thing", "and more", 2)], kv)


def test_find(handlers):
    alpha, beta, gamma = "a.ts:handlerAlpha", "b.ts:handlerBeta", "c.ts:handlerGamma"
    assert ids(find(handlers, type="function", where={"complexity": {"gt": 5}})) == {alpha, gamma}
    assert ids(find(handlers, text="handler", where={"complexity": {"gt": 5}})) == {alpha, gamma}
    assert ids(find(handlers, text="handler", where={"exported": True})) == {alpha, beta}
    assert [r.id for r in find(handlers, text="handler", sort="complexity", type="function").collect()] == [alpha, gamma, beta]
    assert ids(find(handlers, text="handler", near={"node": "a.ts", "maxDepth": 1})) == {alpha}
    assert ids(find(handlers, text="green", where={"attempts": {"gt": 2}})) == {"deploy:last"}
    assert [(r.name, r.metadata) for r in find(handlers, text="look").collect()] == [("thing", None)]
    assert find(handlers, text="needs", where={"complexity": {"gt": 1}}).count() == 0
    assert find(handlers, limit=0).count() == 0


def test_predicates(spark):
    rows = [1, "1", None, True, [1], {"a": 1}, 1.5]
    g = make(spark, [(str(i), "t", None, 0.0, {"k": v}) for i, v in enumerate(rows)] + [("none", "t", None, 0.0, {})], [])
    by = lambda w: ids(find(g, where={"k": w}))
    assert by(1) == {"0"} and by("1") == {"1"} and by(None) == {"2"} and by(True) == {"3"} and by([1]) == set()
    assert by({"exists": False}) == {"2", "none"} and by({"exists": True, "gt": 9}) == {"0", "1", "3", "4", "5", "6"}
    assert by({"gte": 1}) == {"0", "6"} and by({"in": [1, "1", None]}) == {"0", "1", "2"} and by({"contains": "1"}) == {"1"}
    assert len(by({})) == 8 and len(by({"odd": 1})) == 8


def test_search(handlers, spark):
    idx = search.index(search.documents(handlers))
    assert search.query_terms('a NOT "b" or near (c)') == ["a", "b", "c"]
    assert search.search(idx, "  ").count() == 0
    hit = search.search(idx, "look", handlers.nodes).first()
    assert (hit.key, hit.matched_fields) == ("note:thing", ["description"])
    g = make(spark, [("alphaOne", "f", None, 0.0, None), ("alphaTwo", "f", None, 50.0, None)], [])
    found = search.search(search.index(search.documents(g)), "alpha", g.nodes).collect()
    assert [r.key for r in found] == ["alphaTwo", "alphaOne"] and found[0].score == 100
    assert {r.key: r.value for r in search.hydrate(search.search(idx, "green"), handlers).collect()} == {"deploy:last": '{"status": "green", "attempts": 3}'}


def test_statistics(handlers):
    s = stats.compute(handlers)
    assert s["totalNodes"] == 4 and s["avgComplexity"] == 6 and s["maxComplexity"]["id"] == "a.ts:handlerAlpha"
    assert s["hotspots"][0] == {"id": "a.ts:handlerAlpha", "complexity": 9.0, "degree": 1, "score": 18.0}
    assert s["mostConnected"][0] == {"id": "a.ts", "degree": 2} and s["maxDependencyDepth"] == 0


def test_references(handlers):
    found = {(r.kind, r.node_id, r.relationship, r.file) for r in refs.find_refs(handlers, "handlerAlpha").collect()}
    assert found == {("definition", "a.ts", "defines", "a.ts")}
    assert refs.find_refs(handlers, "nothing").count() == 0
    assert {(r.file, r.node_id, r.relationship) for r in refs.rename_impact(handlers, "handlerAlpha").collect()} == {("a.ts", "a.ts", "definition")}


def test_difference_and_snapshots(handlers, spark, tmp_path):
    diff.write_snapshot(handlers, str(tmp_path), "one")
    old = diff.read_snapshot(spark, str(tmp_path), "one")
    assert diff.list_snapshots(spark, str(tmp_path)) == ["one"]
    assert diff.compare_nodes(old.nodes, handlers.nodes.withColumn("boost", handlers.nodes.seq * 1.0)).count() == 0
    new = Graph(handlers.nodes.where("id <> 'a.ts'"), handlers.edges.limit(0))
    got = diff.compare(old, new)
    assert [tuple(r) for r in got["nodes"].collect()] == [("a.ts", "removed")]
    assert {r.edge for r in got["edges"].collect()} == {"a.ts -[defines]-> a.ts:handlerAlpha", "b.ts -[imports]-> a.ts"}
    assert {r.change for r in diff.compare(None, handlers)["nodes"].collect()} == {"added"}


def test_export(spark):
    g = make(spark, [('q"x', "file", 'q"x', 0.0, {"a": [1, 2], "b": None, "c": {"d": 1}, "e": True}), ("effect:db", "x", None, 0.0, None)], [('q"x', "effect:db", "has_effect", None)])
    text = export.to_dot(g, include_metadata=True)
    assert '  "q\\"x" [shape=folder, label="q\\"x\\\\na=[2], e=true"];' in text.split("\n")
    assert '  "effect:db" [shape=octagon, label="effect:db"];' in text and text.startswith("digraph G {") and text.endswith("}")
    assert export.gather(g, type="file").edges.count() == 1 and export.gather(g, near={"node": "effect:db"}).nodes.count() == 2
    assert export.json_rows(g, False).count() == 3


def test_logs(spark):
    nodes = spark.createDataFrame([(1, "put", "a", "t", "one", "{}"), (2, "put", "b", "t", "b", None), (4, "put", "a", "t", "two", None), (5, "delete", "b", None, None, None)], "seq long, op string, id string, type string, name string, metadata string")
    boosts = spark.createDataFrame([(3, "a", 7.0), (6, "zzz", 1.0)], "seq long, id string, boost double")
    assert [tuple(r) for r in store.current_nodes(nodes, boosts).collect()] == [(1, "a", "t", "two", 7.0, None)]
    edges = spark.createDataFrame([(1, "put", "a", "b", "r", "1"), (2, "put", "a", "b", "r", "2"), (3, "put", "a", "c", "r", None), (4, "delete", "a", "c", "r", None), (6, "put", "b", "c", "r", None)], "seq long, op string, src string, dst string, relationship string, metadata string")
    assert {tuple(r) for r in store.current_edges(edges).collect()} == {(1, "a", "b", "r", "2"), (6, "b", "c", "r", None)}
    gone = spark.createDataFrame([(5, "b")], "seq long, id string")
    assert {r.seq for r in store.current_edges(edges, gone).collect()} == {6}
    kv = store.current_kv(spark.createDataFrame([(1, "put", "User:a", "1", 10), (2, "put", "user:b", "null", 11), (3, "put", "User:a", "2", 12), (4, "put", "x", "1", 13), (5, "delete", "x", None, 14), (6, "put", "use_:c", "1", 15)], "seq long, op string, key string, value string, ts long")).cache()
    assert [tuple(r) for r in store.kv_like(kv, "user:%").collect()] == [("User:a", "2", 10, 12), ("user:b", "null", 11, 11)]
    assert [store.kv_get(kv, k).first().found for k in ("user:b", "User:a", "no")] == [False, True, False]
    assert ids(store.Namespace("user").query(kv), "key") == {"a", "b"}
    public, internal = store.adopt_prefix(kv, kv.limit(0), "use_:")
    assert ids(internal, "key") == {"use_:c"} and ids(public, "key") == {"User:a", "user:b"}


def test_context_budget(spark):
    rows = [("f", 0, 0, 90), ("f", 1, 0, 5), ("f", 2, 0, 50), ("f", 2, 1, 1), ("f", 3, 0, 5), ("f", 3, 1, 1)]
    got = context.admit(spark.createDataFrame(rows, "focus string, category int, ord long, tokens long"), 100)
    assert [(r.category, r.ord, r.used) for r in got.orderBy("category", "ord").collect()] == [(0, 0, 90), (1, 0, 95), (3, 0, 100)]
