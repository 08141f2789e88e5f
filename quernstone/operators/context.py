"""Context for a symbol or a document within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_of, token_estimate
from .graph import collect_related
from .model import Graph, json_number
from .refs import resolve


def admit(candidates: DataFrame, budget: int) -> DataFrame:
    """(focus, category, ord, tokens, used) of the candidates (focus, category, ord, tokens) that the budget admits.

    In the order of category and ord, a candidate that would exceed the budget ends its
    category; later categories still try.  Category 0 is always admitted.  A fold over the
    sorted candidates of a focus, in the JVM.
    """
    ordered = F.array_sort(F.collect_list(F.struct("category", "ord", "tokens")))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(-1).alias("closed"), F.array().cast("array<struct<category:int,ord:bigint,tokens:bigint,used:bigint>>").alias("out"))

    def step(acc, x):
        over = (x["category"] > 0) & (acc["used"] + x["tokens"] > budget)
        ended = acc["closed"] == x["category"]
        used = acc["used"] + x["tokens"]
        row = F.struct(x["category"].alias("category"), x["ord"].alias("ord"), x["tokens"].alias("tokens"), used.alias("used"))
        return (
            F.when(ended, acc)
            .when(over, F.struct(acc["used"].alias("used"), x["category"].alias("closed"), acc["out"].alias("out")))
            .otherwise(F.struct(used.alias("used"), acc["closed"].alias("closed"), F.array_append(acc["out"], row).alias("out")))
        )

    typed = candidates.select("focus", F.col("category").cast("int").alias("category"), F.col("ord").cast("bigint").alias("ord"), F.col("tokens").cast("bigint").alias("tokens"))
    folded = typed.groupBy("focus").agg(F.aggregate(ordered, start, step).alias("acc"))
    return folded.select("focus", F.explode("acc.out").alias("x")).select("focus", "x.*")


def lines_of(content, start, end, context: int = 0):
    """Lines start to end (from 1) of a text, and so many before and after."""
    first = F.greatest(F.lit(1), start - context).cast("int")
    return F.array_join(F.slice(F.split(content, "\n"), first, (end + context - first + 1).cast("int")), "\n")


def import_block(content):
    """The lines of imports, comments and blanks that a file starts with; other lines before them are passed over."""
    kept = F.transform(F.split(content, "\n"), lambda line: F.struct(line.alias("line"), (F.trim(line).rlike(r"^(import\b|//|/\*|\*|$)")).alias("ok")))
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        return (
            F.when(acc["done"], acc)
            .when(x["ok"], F.struct(F.lit(False).alias("done"), F.array_append(acc["out"], x["line"]).alias("out")))
            .otherwise(F.struct((F.size(acc["out"]) > 0).alias("done"), acc["out"].alias("out")))
        )

    return F.trim(F.array_join(F.aggregate(kept, start, step)["out"], "\n"))


RELATION = {0: "focus", 1: "parent", 2: "dependency", 3: "type", 4: "caller"}


def build(graph: Graph, files: DataFrame, symbol: str, budget: int = 4000, context: int = 0, depth: int = 1) -> dict:
    """{focus, sections, tokenEstimate, prompt} of a symbol: itself, its file's imports, what it uses, types of imported files, callers.

    files has path and content.  What isn't found or has no place in a file is left out;
    the budget is admit()'s.
    """
    spark = graph.nodes.sparkSession
    known = resolve(graph, symbol)
    if known is None:
        return {"focus": symbol, "sections": [], "tokenEstimate": 0, "prompt": f"// Symbol not found: {symbol}"}
    node, _, kind = known
    file = node if kind == "file" else (node.split(":", 1)[0] if node.find(":") > 0 else None)
    wanted = spark.createDataFrame([(node, 0, 0)] + ([(file, 1, 0)] if file and kind != "file" else []), "id string, category int, rank int")
    uses = collect_related(graph, node, "outgoing", ["calls", "extends", "implements"], depth).select("id", F.lit(2).alias("category"), F.col("depth").alias("rank"))
    callers = collect_related(graph, node, "incoming", ["calls"], 1).select("id", F.lit(4).alias("category"), F.col("depth").alias("rank"))
    wanted = wanted.unionByName(uses).unionByName(callers)
    if file:
        imported = graph.edges.where((F.col("src") == file) & (F.col("relationship") == "imports")).select(F.col("dst").alias("mid"))
        defined = graph.edges.where(F.col("relationship") == "defines").select(F.col("src").alias("mid"), F.col("dst").alias("id"))
        types = graph.nodes.where(F.col("type").isin("interface", "type")).select("id")
        wanted = wanted.unionByName(imported.join(defined, "mid").join(types, "id", "left_semi").select("id", F.lit(3).alias("category"), F.lit(0).alias("rank")).distinct())
    wanted = wanted.groupBy("id").agg(F.min(F.struct("category", "rank")).alias("at")).select("id", "at.*")
    line, count = json_number(F.col("metadata"), "line"), json_number(F.col("metadata"), "lineCount")
    rows = wanted.join(graph.nodes, "id").withColumns({"file": F.when(F.col("type") == "file", F.col("name")).otherwise(file_of(F.col("id"))), "line": line, "last": line + F.when(count > 0, count).otherwise(20)})
    rows = rows.join(files.select(F.col("path").alias("file"), "content"), "file")
    source = F.when(F.col("type") == "file", import_block(F.col("content"))).when(F.col("line") > 0, lines_of(F.col("content"), F.col("line"), F.col("last"), context))
    rows = rows.withColumn("source", source).where("trim(source) <> ''").withColumn("tokens", token_estimate(F.col("source")))
    rows = rows.withColumn("ord", F.col("rank") * F.lit(1 << 40) + F.col("seq")).withColumn("focus", F.lit(node))
    kept = admit(rows, budget).select("category", "ord").join(rows, ["category", "ord"]).orderBy("category", "ord")
    sections = [{"nodeId": r["id"], "type": r["type"], "name": r["name"], "file": r["file"], "lines": None if r["type"] == "file" else (int(r["line"]), int(r["last"])), "source": r["source"], "relationship": RELATION[r["category"]], "tokens": r["tokens"]} for r in kept.collect()]
    return {"focus": node, "sections": sections, "tokenEstimate": sum(s["tokens"] for s in sections), "prompt": format_prompt(sections)}


def format_prompt(sections: list[dict]) -> str:
    """Sections as one text, by file in the order of their first."""
    if not sections:
        return "// No context available"
    by_file: dict[str, list[dict]] = {}
    for section in sections:
        by_file.setdefault(section["file"], []).append(section)
    out = []
    for file, own in by_file.items():
        named = ", ".join("**FOCUS**" if s["relationship"] == "focus" else s["relationship"] for s in own)
        out.append(f"// --- {file} ({named}) ---")
        for s in own:
            if s["type"] != "file":
                at = f":{s['lines'][0]}-{s['lines'][1]}" if s["lines"] else ""
                out.append(f"// {s['type']} {s['name']}{at} [{s['relationship']}]")
            out += [s["source"], ""]
    return "\n".join(out).strip()
