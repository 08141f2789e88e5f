"""Catalog queries over whole tables, held against plain Python that shares nothing with their SQL."""

import json
from collections import Counter

import pyarrow.parquet as pq

from quernstone.plans import catalog

SF = "/root/testdata/sf0.001"


def columns(name, *wanted):
    read = pq.read_table(f"{SF}/{name}.parquet", columns=list(dict.fromkeys(wanted)))
    return list(zip(*(read.column(c).to_pylist() for c in wanted)))


def plain_edges():
    """{(src, dst, relationship): least seq} of all five relationships."""
    span, found = 10**12, {}

    def put(seq, *key):
        found[key] = min(seq, found.get(key, seq))

    for n, r in columns("nation", "n_nationkey", "n_regionkey"):
        put(n, f"nation:{n}", f"region:{r}", "in_region")
    for c, n in columns("customer", "c_custkey", "c_nationkey"):
        put(span + c, f"customer:{c}", f"nation:{n}", "in_nation")
    for s, n in columns("supplier", "s_suppkey", "s_nationkey"):
        put(span + span // 2 + s, f"supplier:{s}", f"nation:{n}", "in_nation")
    for o, c in columns("orders", "o_orderkey", "o_custkey"):
        put(2 * span + o, f"order:{o}", f"customer:{c}", "placed_by")
    for o, p, s, i in columns("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"):
        put(3 * span + o * 8 + i, f"order:{o}", f"part:{p}", "contains")
        put(4 * span + o * 8 + i, f"part:{p}", f"supplier:{s}", "supplied_by")
    return found


def test_shortest_path_over_all_relationships(spark):
    beside = {}
    for a, b, _ in plain_edges():
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    front, seen, length = {"customer:1"}, {"customer:1"}, 0
    while front and "region:2" not in seen:
        front = {b for a in front for b in beside[a]} - seen
        seen |= front
        length += 1
    assert length == 5
    assert [r.length for r in catalog.queries()["g4_shortest_path"](spark, SF).collect()] == [length]


def test_deletes_over_all_relationships(spark):
    keys = plain_edges()
    gone = {f"nation:{n}" for (n,) in columns("nation", "n_nationkey") if n % 2 == 0}
    counted = lambda kept: dict(Counter(r for _, _, r in kept))
    got = lambda name: {r.relationship: r.n for r in catalog.queries()[name](spark, SF).collect()}
    assert got("m3_node_delete") == counted(k for k in keys if not {k[0], k[1]} & gone)
    assert got("m4_edge_delete") == counted(k for k in keys if k[1:] != ("region:1", "in_region"))


def test_ranges_over_all_kinds(spark):
    found = {f"supplier:{k}": x for k, x in columns("supplier", "s_suppkey", "s_acctbal")} | {f"customer:{k}": x for k, x in columns("customer", "c_custkey", "c_acctbal")}
    got = catalog.queries()["p3_ranges"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((k, x) for k, x in found.items() if -500 <= x <= 1000)
    assert any(r.id.startswith("customer:") for r in got)


def test_difference_of_all_edges(spark):
    text = lambda k: f"{k[0]} -[{k[2]}]-> {k[1]}"
    wanted = [(text(k), "removed" if seq % 5 == 0 else "added") for k, seq in plain_edges().items() if (seq % 5 == 0) != (seq % 3 == 0)]
    assert sorted(map(tuple, catalog.queries()["d1_compare_edges"](spark, SF).collect())) == sorted(wanted)


def test_json_of_the_whole_graph(spark):
    kinds = {
        "region": ("region", "r_regionkey", "r_name", {}),
        "nation": ("nation", "n_nationkey", "n_name", {}),
        "supplier": ("supplier", "s_suppkey", "s_name", {"acctbal": "s_acctbal"}),
        "customer": ("customer", "c_custkey", "c_name", {"acctbal": "c_acctbal", "segment": "c_mktsegment"}),
        "part": ("part", "p_partkey", "p_name", {"brand": "p_brand", "ptype": "p_type", "size": "p_size", "price": "p_retailprice"}),
        "order": ("orders", "o_orderkey", "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority", "total": "o_totalprice"}),
    }
    wanted = []
    for kind, (name, key, title, more) in kinds.items():
        for k, t, *values in columns(name, key, title, *more.values()):
            wanted.append({"id": f"{kind}:{k}", "type": kind, "name": str(t), "metadata": dict(zip(more, values))})
    last = {}
    for o, p, i, q in sorted(columns("lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), key=lambda x: (x[2], str(int(x[3])) + "}")):  # lines that repeat go by their text
        last[f"order:{o}", f"part:{p}"] = {"line": i, "quantity": int(q)}
    for a, b, r in plain_edges():
        wanted.append({"from": a, "to": b, "relationship": r} | ({"metadata": last[a, b]} if r == "contains" else {}))
    got = [json.loads(r.json) for r in catalog.queries()["x3_json"](spark, SF).collect()]
    text = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert text(got) == text(wanted)


def test_size_guard_in_bytes(spark, tmp_path):
    texts = ["a" * 400_000, "a" * 500_000, "a" * 500_001, "ä" * 250_001, "ä" * 250_000]
    rows = [(3 * i + k, t, len(t)) for i, t in enumerate(texts) for k in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.path: (r.size, r.state) for r in catalog.queries()["s3_hash_skip"](spark, str(tmp_path)).collect()}
    sizes = [len(t.encode()) for t in texts]
    assert got == {f"doc:{3 * i + k}": (n, "too_large" if n > 500_000 else ("unchanged", "parse")[k]) for i, n in enumerate(sizes) for k in (0, 1)}
