"""The steps that whole-graph queries share: degrees, differences, cuts, statistics, narrow and crowded fronts."""

from pyspark.sql import functions as F

from quernstone.operators import diff, graph as G, stats
from quernstone.operators.lineage import cut
from quernstone.operators.model import EDGES, NODES, Graph


def made(spark, pairs):
    return spark.createDataFrame([(i, a, b, r, None) for i, (a, b, r) in enumerate(pairs)], EDGES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_degrees_hash(spark):
    """F8, F9, F11: the first end is found without sorting all ends."""
    edges = made(spark, [("x", "y", "a"), ("y", "x", "b"), ("x", "x", "a"), ("z", "z", "c"), ("w", "y", "a")])
    wanted = {("x", 4, 0, 0), ("y", 3, 0, 1), ("z", 2, 3, 0), ("w", 1, 4, 0)}
    assert {tuple(r) for r in G.degrees(edges).collect()} == wanted
    assert {tuple(r) for r in G.degrees(edges, G.ends_by_relationship(edges)).collect()} == wanted
    assert "SortAggregate" not in plan(G.degrees(edges))


def test_statistics_read_edges_once(spark):
    """F8: relationships, the most connected and hotspots come of one pass."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    nodes = spark.createDataFrame([(i, k, "f", k, 0.0, '{"complexity": 2}') for i, k in enumerate("xyz")], NODES)
    edges = made(spark, [("x", "y", "a"), ("y", "x", "b"), ("x", "z", "a")]).mapInArrow(seen, EDGES)
    s = stats.compute(Graph(nodes, edges), root_type="none")
    assert s["edges"] == {"a": 2, "b": 1} and s["totalEdges"] == 3 and s["mostConnected"][0] == {"id": "x", "degree": 3}
    assert s["hotspots"][0] == {"id": "x", "complexity": 2.0, "degree": 3, "score": 8.0}
    assert read.value == 3


def test_difference_in_one_aggregate(spark):
    """no joins; edges that repeat count each, and a null equals nothing."""
    old = made(spark, [("a", "b", "r"), ("a", "c", "r"), ("a", "c", "r"), ("n", None, "r")])
    new = made(spark, [("a", "b", "r"), ("a", "d", "r"), ("n", None, "r")])
    got = diff.compare_edges(old, new)
    assert sorted((r.edge or "", r.change) for r in got.collect()) == [("", "added"), ("", "removed"), ("a -[r]-> c", "removed"), ("a -[r]-> c", "removed"), ("a -[r]-> d", "added")]
    assert "Join" not in plan(got)


def test_cut_computes_once(spark):
    """a checkpoint computed its last stage twice."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    kept = cut(spark.range(100).mapInArrow(seen, "id long"))
    assert kept.count() == 100 and kept.agg(F.sum("id")).first()[0] == 4950 and read.value == 100
    assert cut(spark.range(0)).count() == 0


def test_many_rows_on_few_ids(spark):
    """a front of many roots on few ids meets the steps of these ids alone."""
    pairs = [(f"p{n}", f"s{(n + k) % 7}", "r") for n in range(1500) for k in range(3)] + [(f"s{n}", f"n{n % 2}", "r") for n in range(7)] + [("n0", "g", "r"), ("n1", "g", "r"), ("g", "s0", "r")]
    roots = spark.createDataFrame([(f"p{n}",) for n in range(1500)], "root string")
    beside = {}
    for a, b, _ in pairs:
        beside.setdefault(a, []).append(b)
    wanted = set()
    for n in range(1500):
        far, front = {f"p{n}": 0}, [f"p{n}"]
        while front:
            ahead = {b: a for a in front for b in beside.get(a, []) if b not in far}
            far |= {b: far[a] + 1 for b, a in ahead.items()}
            front = list(ahead)
        wanted |= {(f"p{n}", i, d) for i, d in far.items()}
    got = {tuple(r) for r in G.distances(made(spark, pairs), roots).collect()}
    assert got == wanted
