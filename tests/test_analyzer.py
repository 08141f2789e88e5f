"""Source files to a graph, incremental scans, context for a symbol, watching."""

import json
import time

from quernstone.analyzer.parse import parse
from quernstone.analyzer.scan import candidates, facts, scan
from quernstone.functions.tools import Registry, ToolError, template_pattern, validate
from quernstone.operators import context
from quernstone.streaming import changes

MAIN = """import { check, limit as cap } from "./lib/check";
import type { Shape } from "./types";
import fs from "fs";
// a comment with function words() {
export class Box extends Base implements Shape, Other {
  private size: number = 3;
  constructor(size: number) { this.size = size; }
  static make(n = 2): Box { return new Box(n); }
  area = (x: number) => x * this.size;
}
export const PI: number = 3.14, other = { function: 1, a: /[}"]/ };
export async function load(url: string, ...rest: string[]): Promise<string> {
  const ok = check(url) && rest.length > 0;
  for (const r of rest) {
    if (r && url) { await fetch(`${url}/${r}`); }
    else { continue; }
  }
  return ok ? "y" : "n";
}
const twice = (f) => f(f(1));
"""
CHECK = "export function check(x) {\n  return x || false;\n}\nmodule.exports.extra = 1;\n"
TYPES = "export interface Shape extends Base<number> { a: string }\nexport type Way = 'in' | 'out';\nenum E { A }\n"
FILES = {"main.ts": MAIN, "lib/check/index.js": CHECK, "types.ts": TYPES}


def test_facts_of_a_file():
    m = parse(MAIN)
    assert m.errors == []
    assert m.imports == [("./lib/check", ["check", "cap"], False), ("./types", ["Shape"], True), ("fs", ["fs"], False)]
    load = next(f for f in m.functions if f.name == "load")
    assert (load.params, load.is_async, load.exported, load.loops, load.complexity) == (["url", "rest"], True, True, 1, 4)
    assert (load.cognitive, load.nesting, load.lines) == (1 + 2 + 1 + 1, 3, 6)
    assert [(c.name, c.extends, c.implements, [f.name for f in c.methods]) for c in m.classes] == [("Box", "Base", ["Shape", "Other"], ["make", "area"])]
    assert {(v[0], v[2], v[3]) for v in m.variables} == {("PI", True, "number"), ("other", True, None)}
    assert [f.name for f in m.functions if f.arrow] == ["area", "twice"]
    assert any(c.chain == "fetch" and c.is_await and c.function is load for c in m.calls)
    assert parse(TYPES).interfaces == [("Shape", 1, ["Base"])] and parse(TYPES).types[0][::2] == ("Way", "'in' | 'out'")


def test_chains_errors_and_requires():
    assert [(c.name, c.chain) for c in parse("foo?.bar(); a.b?.c.d();").calls] == [("foo", "foo?.bar"), ("a", "a.b?.c.d")]
    assert len(parse("function a( { }\nfunction b( { }\n").errors) >= 2
    m = parse("const x = require('./y'); exports.z = 1; function z() {} import('./later')")
    assert m.imports == [("./y", ["x"], False)] and m.dynamic == ["./later"] and m.functions[0].exported
    assert parse("const m = new Map<string, Array<Set<number>>>(); let a = b < c && d > e;").errors == []


def test_candidates():
    assert candidates("a/b.ts", "../c")[:2] == ["c.ts", "c.tsx"] and candidates("a.ts", "react") == []
    assert candidates("a/b.ts", "./d.js") == ["a/d.js"]


def source_frame(spark, files):
    return spark.createDataFrame([(p, len(t), t) for p, t in files.items()], "path string, size long, content string")


def test_scan(spark):
    done = scan(source_frame(spark, FILES | {"broken.ts": "function ( {", "big.ts": "x" * 500_001}))
    g = done["graph"]
    edges = {(r.src, r.dst, r.relationship) for r in g.edges.collect()}
    assert ("main.ts", "lib/check/index.js", "imports") in edges and ("main.ts", "types.ts", "imports") in edges
    assert ("main.ts:load", "lib/check/index.js:check", "calls") in edges and ("main.ts:load", "effect:network", "has_effect") in edges
    assert ("main.ts:Box", "Base", "extends") in edges and ("main.ts:Box", "main.ts:Box.make", "has_method") in edges
    meta = {r.id: json.loads(r.metadata) for r in g.nodes.collect()}
    assert meta["main.ts:load"]["complexity"] == 4 and meta["main.ts"]["imports"] == 3
    assert [r.path for r in done["errors"].collect()] == ["broken.ts"]
    assert {r.path: r.state for r in done["states"].collect()}["big.ts"] == "too_large"
    hashes = done["states"].where("state = 'parse'").select("path", "hash")
    again = scan(source_frame(spark, FILES | {"types.ts": TYPES + "\n"}), hashes=hashes)
    assert {r.path: r.state for r in again["states"].collect()} == {"main.ts": "unchanged", "lib/check/index.js": "unchanged", "types.ts": "parse"}


def test_seq_follows_paths_and_text(spark):
    files = {f"f{n:02}.js": "function b() { a(); }\nfunction a() {}\nclass Z {}\n" for n in reversed(range(30))}
    graph = scan(source_frame(spark, files).repartition(5))["graph"]
    ids = [r.id for r in graph.nodes.orderBy("seq").collect()]
    assert ids == [f"{path}{symbol}" for path in sorted(files) for symbol in ("", ":b", ":a", ":Z")]
    edges = graph.edges.orderBy("seq").collect()
    assert len({r.seq for r in edges}) == len(edges) and [r.src.split(":")[0] for r in edges] == sorted(r.src.split(":")[0] for r in edges)
    assert scan(source_frame(spark, {}))["graph"].nodes.count() == 0


def test_context_of_a_symbol(spark):
    files = source_frame(spark, FILES)
    done = context.build(scan(files)["graph"], files, "load")
    assert [(s["relationship"], s["nodeId"]) for s in done["sections"]][:3] == [("focus", "main.ts:load"), ("parent", "main.ts"), ("dependency", "lib/check/index.js:check")]
    assert {s["relationship"] for s in done["sections"]} == {"focus", "parent", "dependency", "type"}
    assert done["prompt"].startswith("// --- main.ts (**FOCUS**, parent) ---") and "import fs" in done["prompt"]
    assert context.build(scan(files)["graph"], files, "nope")["prompt"] == "// Symbol not found: nope"
    small = context.build(scan(files)["graph"], files, "load", budget=10)
    assert [s["relationship"] for s in small["sections"]] == ["focus"]


def test_facts_never_fail():
    for text in ("", "{{{{", "`${`", "class", "export", "import {", "function", "const", "a.b.", "=>", "@", "\x00퟿", "type X", "interface Y"):
        facts("f.ts", text)


def test_watch(spark, tmp_path):
    folder, seen = tmp_path / "src", []
    (folder / "node_modules").mkdir(parents=True)
    (folder / "a.ts").write_text("let a = 1")
    (folder / "node_modules" / "b.ts").write_text("let b = 1")
    (folder / "c.txt").write_text("no")
    assert [r.path.rsplit("/", 1)[1] for r in changes.list_sources(spark, str(folder)).collect()] == ["a.ts"]
    watcher = changes.Watcher(spark)
    watcher.start(str(folder), lambda df, n: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect()), str(tmp_path / "cp"), once=True)
    end = time.time() + 60
    while watcher.watching and time.time() < end:
        time.sleep(0.2)
    watcher.stop()
    assert seen == ["a.ts"]


def test_debounce(spark):
    rows = spark.createDataFrame([("k", 0.0), ("k", 0.2), ("k", 0.9)], "k string, s double").selectExpr("k", "timestamp_seconds(s) AS ts")
    assert sorted(r.n for r in changes.debounce(rows, key="k").collect()) == [1, 2]


def test_bus_and_registry():
    bus, got = changes.Bus(), []
    bus.on("e", lambda p: 1 / 0)
    bus.on("e", got.append)
    bus.emit("e", 5)
    assert got == [5] and len(bus.errors) == 1
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string", "minLength": 2}, "n": {"type": "integer", "minimum": 1, "maximum": 3}, "l": {"type": "array", "items": {"enum": [1, 2]}}}}
    assert validate(schema, {"a": "xy", "n": 2, "l": [1]}) == []
    assert [p for p, _ in validate(schema, {"a": "x", "n": 9, "l": [1, 7]})] == ["a", "n", "l[1]"]
    assert validate(schema, {}) == [("a", "required")] and validate({"type": "integer"}, 1.5)[0][1] == "expected integer, got number"
    r = Registry()
    r.register("t", "", schema, lambda a, n=1: a * n)
    assert r.call("t", {"a": "xy", "n": 2}) == {"result": "xyxy"} and r.call("t", {})["error"]["code"] == "invalid_input"
    r.templates["note://{id}"] = lambda id: id
    r.resources["note://fixed"] = lambda: "f"
    assert r.read("note://7") == "7" and r.read("note://fixed") == "f"
    assert template_pattern("a.{x}")[0].match("abc") is None
    try:
        r.read("zz")
    except ToolError as error:
        assert error.code == "not_found"
