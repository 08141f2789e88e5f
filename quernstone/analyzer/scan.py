"""From source files to the nodes and edges of a code graph."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import side_effect
from ..operators.lineage import cut
from ..operators.model import Graph
from ..operators.store import to_scan, upsert_edges
from ..session import ship
from .parse import parse

FACTS = "path string, kind string, ord int, id string, type string, name string, src string, dst string, relationship string, metadata string, candidates array<string>, chain string"
SUFFIXES = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def candidates(path: str, source: str) -> list[str]:
    """The files that an import of source in path may mean, the first that exists being meant; none for packages."""
    if source[:1] not in (".", "/"):
        return []
    stack: list[str] = []
    for part in ((path.rpartition("/")[0] + "/" + source) if source[0] == "." else source).split("/"):
        if part == "..":
            del stack[-1:]
        elif part not in (".", ""):
            stack.append(part)
    whole = "/".join(stack)
    return [whole] if whole.endswith((".ts", ".tsx", ".js", ".jsx")) else [whole + s for s in SUFFIXES]


def facts(path: str, text: str) -> list[tuple]:
    """Rows (kind, ord, id, type, name, src, dst, relationship, metadata, candidates, chain) of one file."""
    m = parse(text)
    if m.errors:
        return [("error", 0, None, None, "\n".join(m.errors), None, None, None, None, None, None)]
    out: list[tuple] = []

    def node(ident: str, kind: str, name: str, **meta) -> None:
        out.append(("node", len(out), ident, kind, name, None, None, None, json.dumps({k: v for k, v in meta.items() if v is not None}), None, None))

    def edge(src: str, dst: str | None, relationship: str, meta: dict | None = None, among: list[str] | None = None, suffix: str | None = None) -> None:
        out.append(("edge", len(out), suffix, None, None, src, dst, relationship, json.dumps(meta) if meta is not None else None, among, None))

    node(path, "file", path, functions=len(m.functions), classes=len(m.classes), imports=len(m.imports), exports=m.exports, interfaces=len(m.interfaces), typeAliases=len(m.types))
    for f in m.functions:
        if f.name:
            node(f"{path}:{f.name}", "function", f.name, params=f.params, line=f.line, exported=f.exported, **{"async": f.is_async}, complexity=f.complexity, cognitive=f.cognitive, maxNesting=f.nesting, loopCount=f.loops, lineCount=f.lines, generator=f.generator or None, arrow=f.arrow or None, returnType=f.returns, decorators=f.decorators or None)
            edge(path, f"{path}:{f.name}", "defines")
            if f.exported:
                edge(path, f"{path}:{f.name}", "exports")
    for c in m.classes:
        if c.name:
            ident = f"{path}:{c.name}"
            node(ident, "class", c.name, line=c.line, exported=c.exported, extends=c.extends, implements=c.implements or None, decorators=c.decorators or None)
            edge(path, ident, "defines")
            if c.exported:
                edge(path, ident, "exports")
            if c.extends:
                edge(ident, c.extends, "extends")
            for one in c.implements:
                edge(ident, one, "implements")
            for f in c.methods:
                node(f"{ident}.{f.name}", "function", f"{c.name}.{f.name}", params=f.params, line=f.line, method=True, static=f.static, complexity=f.complexity, cognitive=f.cognitive)
                edge(ident, f"{ident}.{f.name}", "has_method")
    imported: dict[str, list[str]] = {}
    for source, names, type_only in m.imports:
        among = candidates(path, source)
        if among:
            edge(path, None, "imports", {"specifiers": names, "typeOnly": type_only}, among)
            imported |= {n: among for n in names}
    for source in m.dynamic:
        if candidates(path, source):
            edge(path, None, "dynamic_imports", None, candidates(path, source))
    for name, line, exported, annotation in m.variables:
        if exported:
            node(f"{path}:{name}", "variable", name, line=line, exported=True, typeAnnotation=annotation)
            edge(path, f"{path}:{name}", "exports")
    for name, line, extends in m.interfaces:
        node(f"{path}:{name}", "interface", name, line=line, extends=extends or None)
        edge(path, f"{path}:{name}", "defines")
        for one in extends:
            edge(f"{path}:{name}", one, "extends")
    for name, line, definition in m.types:
        node(f"{path}:{name}", "type", name, line=line, definition=definition or None)
        edge(path, f"{path}:{name}", "defines")
    known = {}
    for f in m.functions:
        known.setdefault(f.name, f)
    qualified = lambda f: f"{path}:{f.owner}.{f.name}" if f.owner else f"{path}:{f.name}"
    for call in m.calls:
        if call.function is None or not call.function.name:
            continue
        meta = ({"fullChain": call.chain} if call.chain != call.name else {}) | ({"isNew": True} if call.is_new else {}) | ({"isAwait": True} if call.is_await else {})
        if call.name in known:
            edge(qualified(call.function), qualified(known[call.name]), "calls", meta)
        elif call.name in imported:
            edge(qualified(call.function), None, "calls", meta, imported[call.name], call.name)
        out.append(("effect", len(out), None, None, None, f"{path}:{call.function.name}", None, "has_effect", None, None, call.chain))
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FACTS.split(", ")]
    types = [pa.int32() if n == "ord" else pa.list_(pa.string()) if n == "candidates" else pa.string() for n in names]
    for batch in batches:
        rows = [(path, *row) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in facts(path, text or "")]
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def ranks(files: DataFrame) -> DataFrame:
    """(path, rank) of the distinct paths: rank grows with path, and rank + n keeps apart and in order the n < 2**20 of each.

    The range a path is sorted into is 16 bits of its rank and its place there 27, so nothing is counted or collected; it is
    a checkpoint, as other bounds of ranges would give other ranks.
    """
    place = F.monotonically_increasing_id()
    apart = F.shiftleft(F.shiftright(place, 33), 47) + F.shiftleft(place.bitwiseAND(F.lit((1 << 33) - 1)), 20)
    return cut(files.select("path").distinct().orderBy("path").select("path", apart.alias("rank")))


def scan(files: DataFrame, listing: DataFrame | None = None, hashes: DataFrame | None = None, force: bool = False) -> dict[str, DataFrame]:
    """{graph, errors, states} of files (path, size, content): what the parsed files say, those with errors, and every file's state.

    Files are parsed in Python, one at a time, in a map; imports without an extension are
    resolved by a join with the listing (paths; by default that of files); side effects are
    told by built-in functions.  seq follows the order of paths, and within a file that of
    its text.
    """
    ship()
    spark = files.sparkSession
    if hashes is None:
        hashes = spark.createDataFrame([], "path string, hash bigint")
    states = to_scan(files, hashes, force)
    found = states.where("state = 'parse'").select("path", "content").mapInArrow(_run, FACTS)
    found = found.join(ranks(files), "path", "left").withColumn("seq", F.col("rank") + F.col("ord")).drop("rank")
    nodes = found.where("kind = 'node'").groupBy("id").agg(F.max_by(F.struct("type", "name", "metadata"), "seq").alias("n"), F.min("seq").alias("seq"))
    nodes = nodes.select("seq", "id", "n.type", "n.name", F.lit(0.0).alias("boost"), "n.metadata")
    plain = found.where("kind = 'edge' AND candidates IS NULL").select("seq", "src", "dst", "relationship", "metadata")
    open_ = found.where("kind = 'edge' AND candidates IS NOT NULL").select("seq", "src", F.col("id").alias("symbol"), "relationship", "metadata", F.size("candidates").alias("n"), F.posexplode("candidates").alias("rank", "file"))
    there = (files if listing is None else listing).select(F.col("path").alias("file"), F.lit(True).alias("there"))
    # A path with an extension is taken as it stands.
    resolved = open_.join(there, "file", "left").where("there OR n = 1").groupBy("seq", "src", "relationship", "metadata", "symbol").agg(F.min_by("file", "rank").alias("file"))
    resolved = resolved.select("seq", "src", F.concat("file", F.when(F.col("symbol").isNotNull(), F.concat(F.lit(":"), "symbol")).otherwise("")).alias("dst"), "relationship", "metadata")
    label = side_effect(F.col("chain"))
    effects = found.where("kind = 'effect'").withColumn("label", label).where("label IS NOT NULL").select("seq", "src", F.concat(F.lit("effect:"), "label").alias("dst"), "relationship", F.to_json(F.struct(F.col("label").alias("type"), F.col("chain").alias("apiCall"))).alias("metadata"))
    edges = upsert_edges(plain.unionByName(resolved).unionByName(effects))
    errors = found.where("kind = 'error'").select("path", F.col("name").alias("message"))
    return {"graph": Graph(nodes, edges), "errors": errors, "states": states}
