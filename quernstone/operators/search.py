"""Full-text search: BM25 over words, trigrams where words find too little."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import phrase_count, python_tokens, substring_count, tokens
from .model import Graph, json_kind, json_string

K1, B = 1.2, 0.75
MIN_WORD_HITS, CANDIDATES, TRIGRAM_FACTOR = 5, 100, 0.7


def documents(graph: Graph) -> DataFrame:
    """(key, type, title, description) of nodes, of notes (one document an entity, in the order of time) and of key-value entries.

    A key that two kinds claim is the later kind's: notes have keys of their own, and an
    entry takes that of a node.
    """
    nodes = graph.nodes.select(F.col("id").alias("key"), "type", F.col("name").alias("title"), F.coalesce(json_string(F.col("metadata"), "description"), F.lit("")).alias("description"))
    whole = nodes
    if graph.kv is not None:
        value = F.try_parse_json("value")
        text = F.when(json_kind(value) == "string", F.try_variant_get(value, "$", "string")).when(json_kind(value).isin("array", "object"), F.col("value")).otherwise("")
        whole = nodes.join(graph.kv.select("key"), "key", "left_anti").unionByName(graph.kv.select("key", F.lit("recall").alias("type"), F.col("key").alias("title"), text.alias("description")))
    if graph.notes is not None:
        texts = F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "text"))), lambda n: n["text"])
        whole = whole.unionByName(graph.notes.groupBy("entity").agg(F.array_join(texts, "\n").alias("description")).select(F.concat(F.lit("note:"), "entity").alias("key"), F.lit("note").alias("type"), F.col("entity").alias("title"), "description"))
    return whole


def index(docs: DataFrame) -> DataFrame:
    """docs with the words of either column and their number; write it to keep it for many queries."""
    made = docs.withColumns({"title_words": tokens(F.col("title")), "text_words": tokens(F.col("description"))})
    return made.withColumn("size", (F.size("title_words") + F.size("text_words")).cast("bigint"))


def query_terms(query: str) -> list[str]:
    """The terms of a query: its first 255 characters without operators and quotes, split at spaces."""
    bare = re.sub("[\"'‘’“”*^{}():\\\\/]", "", query[:255])
    return re.sub(r"\b(AND|OR|NOT|NEAR)\b", "", bare, flags=re.IGNORECASE).split()


def idf_of(n: int, having: int) -> float:
    """The weight of a phrase that so many of n documents have; a common one weighs next to nothing."""
    found = log((n - having + 0.5) / (having + 0.5))
    return found if found > 0 else 1e-6


def bm25(times: Column, idf: float, size: Column, mean: float | None) -> Column:
    """What a phrase adds to the score of a document of size words that has it so many times."""
    return F.lit(idf) * (times * (K1 + 1)) / (times + K1 * (1 - B + B * size / F.lit(mean or 1.0)))


@dataclass
class _Phrase:
    title: Column
    text: Column


def _scored(docs: DataFrame, phrases: list[_Phrase], size: Column) -> DataFrame:
    """docs in which each phrase is, with raw (the sum of BM25 over phrases), in_title and in_text.

    One aggregate has the number of documents, their mean size and those with each phrase;
    it is of one row and joined by broadcast.
    """
    counted = docs.withColumns({f"__t{i}": p.title for i, p in enumerate(phrases)} | {f"__d{i}": p.text for i, p in enumerate(phrases)} | {"__size": size})
    hit = [F.col(f"__t{i}") + F.col(f"__d{i}") for i in range(len(phrases))]
    totals = counted.agg(F.count("*").alias("n"), F.avg("__size").alias("mean"), *(F.count_if(h > 0).alias(f"n{i}") for i, h in enumerate(hit))).first()
    every = F.lit(True)
    raw = F.lit(0.0)
    for i, h in enumerate(hit):
        every = every & (h > 0)
        raw = raw + bm25(h, idf_of(totals["n"], totals[f"n{i}"]), F.col("__size"), totals["mean"])
    found = counted.where(every).withColumn("raw", raw)
    in_title = F.lit(False)
    in_text = F.lit(False)
    for i in range(len(phrases)):
        in_title, in_text = in_title | (F.col(f"__t{i}") > 0), in_text | (F.col(f"__d{i}") > 0)
    return found.withColumns({"in_title": in_title, "in_text": in_text}).select("key", "type", "title", "description", "raw", "in_title", "in_text")


def word_hits(indexed: DataFrame, terms: list[str]) -> DataFrame | None:
    """Documents that hold every term as a run of words, with raw scores; None if no term has a word."""
    phrases = [p for p in (python_tokens(t) for t in terms) if p]
    if not phrases:
        return None
    return _scored(indexed, [_Phrase(phrase_count(F.col("title_words"), p), phrase_count(F.col("text_words"), p)) for p in phrases], F.col("size"))


def trigram_hits(indexed: DataFrame, query: str) -> DataFrame | None:
    """Documents that hold the whole query as a part of a column, with raw scores over trigrams; None if it is too short."""
    part = query[:255].replace('"', "").lower()
    if len(part) < 3:
        return None
    shingles = lambda c: F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - 2, F.lit(0)).cast("bigint")
    of = lambda c: substring_count(F.lower(F.coalesce(F.col(c), F.lit(""))), part)
    return _scored(indexed, [_Phrase(of("title"), of("description"))], shingles("title") + shingles("description"))


def search(indexed: DataFrame, query: str, nodes: DataFrame | None = None, types: list[str] | None = None, limit: int | None = 20, candidates: int | None = CANDIDATES) -> DataFrame:
    """(key, type, title, description, score, matched_fields), best first.

    The 100 best by words are candidates (all, where candidates is None, as limit may be); if there are fewer than five, the 100 best by
    trigrams join them at 0.7 of their score.  Then the boosts of nodes are added and types
    kept.  The score is ten times the sum, from 0 to 100.  Ties go by key.
    """
    terms = query_terms(query)
    by_word = word_hits(indexed, terms) if terms else None
    return ranked(indexed.sparkSession, by_word, lambda: trigram_hits(indexed, query), nodes, types, limit, None, candidates)


def ranked(spark: SparkSession, by_word: DataFrame | None, trigrams: Callable[[], DataFrame | None], nodes: DataFrame | None, types: list[str] | None, limit: int | None, fetch: Callable[[list[str] | DataFrame], DataFrame] | None = None, candidates: int | None = CANDIDATES) -> DataFrame:
    """The result of search from hits by words, and those by trigrams where they are called for; fetch gets the documents of keys where hits don't have them."""
    if by_word is None:
        return spark.createDataFrame([], "key string, type string, title string, description string, score double, matched_fields array<string>")
    best = lambda df: df if candidates is None else df.orderBy(F.desc("raw"), "key").limit(candidates)
    if candidates is None:
        n, found = by_word.limit(MIN_WORD_HITS).count(), by_word
        of = by_word.select("key")
    else:
        # At most 100 candidates, so the documents are read once for them whatever follows.
        rows = best(by_word).collect()
        n, found = len(rows), spark.createDataFrame(rows, by_word.schema)
        of = [r["key"] for r in rows]
    if fetch:
        found = found.drop("type").join(fetch(of), "key").select("key", "type", "title", "description", "raw", "in_title", "in_text")
    if n < MIN_WORD_HITS:
        more = trigrams()
        if more is not None:
            found = found.unionByName(best(more).join(found.select("key"), "key", "left_anti").withColumn("raw", F.col("raw") * TRIGRAM_FACTOR))
    if types:
        found = found.where(F.col("type").isin(types))
    boost = F.lit(0.0)
    if nodes is not None:
        found = found.join(nodes.select(F.col("id").alias("key"), "boost").join(found.select("key") if candidates is None else F.broadcast(found.select("key")), "key", "left_semi"), "key", "left")
        boost = F.coalesce("boost", F.lit(0.0))
    fields = F.array_compact(F.array(F.when(F.col("in_title"), F.lit("title")), F.when(F.col("in_text"), F.lit("description"))))
    found = found.select("key", "type", "title", "description", F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("raw") + boost) * 10)).alias("score"), fields.alias("matched_fields"))
    return found.orderBy(F.desc("score"), "key").limit(limit) if limit is not None else found


def hydrate(hits: DataFrame, graph: Graph) -> DataFrame:
    """hits with value: the JSON of the node, of the key's value, or of the entity's notes.  Joined after the limit, so hits are few."""
    few = F.broadcast(hits.select("key"))
    nodes = graph.nodes.join(few.withColumnRenamed("key", "id"), "id", "left_semi").select(F.col("id").alias("key"), F.to_json(F.struct("id", "type", "name", "metadata")).alias("value"))
    values = nodes
    if graph.kv is not None:
        values = values.unionByName(graph.kv.join(few, "key", "left_semi").select("key", "value"))
    if graph.notes is not None:
        notes = graph.notes.withColumn("key", F.concat(F.lit("note:"), "entity")).join(few, "key", "left_semi")
        values = values.unionByName(notes.groupBy("key").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ts", "text")))).alias("value")))
    return hits.join(values.groupBy("key").agg(F.first("value").alias("value")), "key", "left")
