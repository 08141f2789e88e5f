"""A search index that is kept: segments of documents and of their postings, updated by generations, of which a query reads its terms' pages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import python_tokens, token_count, tokens
from ..session import ship
from .lineage import small
from .search import CANDIDATES, bm25, idf_of, query_terms, ranked, trigram_hits

DOCS = "key string, type string, title string, description string"
POSTINGS = "term string, key string, type string, size bigint, in_title array<int>, in_text array<int>"

#: Words that are sorted at once, and documents that travel to Python at once.
RUN_WORDS, BATCH_DOCS = 1 << 21, 500


def _run(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of some documents (key, type, size, t, d), by term and then in the order of the documents."""
    docs = pa.Table.from_batches(pieces).combine_chunks()
    words, doc, place, side = [], [], [], []
    for n, name in enumerate("td"):
        for lists in docs.column(name).chunks:
            before = 0 if not doc or side[-1][0] != n else doc[-1][1]
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            words.append(lists.flatten())
            doc.append((np.repeat(np.arange(before, before + len(size)), size), before + len(size)))
            place.append(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            side.append((n, np.full(int(size.sum()), n, np.int8)))
    coded = pa.chunked_array(words).combine_chunks()
    coded = (pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    if not len(coded):
        return
    doc, place, side = np.concatenate([d for d, _ in doc]), np.concatenate(place).astype(np.int32), np.concatenate([s for _, s in side])
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    group = rank[coded.indices.to_numpy()] * docs.num_rows + doc
    by = np.argsort(group, kind="stable")  # titles come first, and places go up
    group, place, side = group[by], place[by], side[by]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    term, of = np.divmod(group[first], docs.num_rows)
    lists = []
    for n in (0, 1):
        ends = np.cumsum(np.add.reduceat((side == n).astype(np.int32), first), dtype=np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(place[side == n])))
    whole = lambda name: pa.concat_arrays(docs.column(name).chunks).take(pa.array(of))
    made = pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(order[term])), whole("key"), whole("type"), whole("size"), *lists], names=["term", "key", "type", "size", "in_title", "in_text"])
    for at in range(0, made.num_rows, 1 << 15):
        yield made.slice(at, 1 << 15)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the postings of about RUN_WORDS words."""
    held, words = [], 0
    for batch in batches:
        held.append(batch)
        words += pc.sum(batch.column(2)).as_py() or 0
        if words >= RUN_WORDS:
            yield from _run(held)
            held, words = [], 0
    if held:
        yield from _run(held)


class StoredIndex:
    """Documents (key, type, title, description) under a folder that all executors share.

    A version of the index has the documents, in segments that are sorted by their key;
    postings (one row a term and document, with the places of the term in either column), written where the
    documents are, in runs sorted by term; and totals.  Postings aren't shuffled: a query skips the pages
    of a segment whose range has none of its terms.  Upserts and deletes are appended
    as generations: a row of a key counts if no later generation names the key.  rebuild
    writes a new version, which counts once its totals are there, so a job that
    is lost on the way leaves the old one.  Of equal keys in one batch the last by seq (or the greatest row) counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._forget()

    def _forget(self) -> None:
        self._state: dict | None = None

    # -- what is stored

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        """Numbers of all versions that have ever been begun."""
        system, path = self._fs()
        root = path(self.folder)
        names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def _whole(self, version: int) -> bool:
        system, path = self._fs()
        return system.exists(path(f"{self.folder}/v{version}/totals/gen=0/_SUCCESS"))

    def exists(self) -> bool:
        return any(self._whole(v) for v in self._versions())

    def state(self) -> dict:
        """{version, gen, n, size}: the version that counts, its last generation, and what BM25 needs of the whole."""
        if self._state is None:
            whole = [v for v in self._versions() if self._whole(v)]
            if not whole:
                raise LookupError(f"no index in {self.folder}")
            at = f"{self.folder}/v{whole[-1]}"
            row = self.spark.read.parquet(f"{at}/totals").agg(F.max("gen").alias("gen"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("changed").alias("changed")).first()
            self._state = {"version": whole[-1], "at": at, **row.asDict()}
        return self._state

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (key, gen, ...) that no later generation has replaced or deleted."""
        state = self.state()
        if not state["changed"]:
            return rows
        log = self.spark.read.parquet(f"{state['at']}/changes").groupBy(F.col("key").alias("of")).agg(F.max("gen").alias("last"))
        joined = rows.join(small(log, state["changed"]), F.col("key") == F.col("of"), "left")
        return joined.where("last IS NULL OR gen >= last").drop("of", "last")

    def documents(self) -> DataFrame:
        """The documents as they stand."""
        return self._live(self.spark.read.parquet(f"{self.state()['at']}/docs")).select("key", "type", "title", "description")

    # -- writing

    def _write(self, at: str, gen: int, docs: DataFrame, replaced: DataFrame | None, changed: int, spread: bool = True) -> None:
        ship()
        # Sizes are counted after the shuffle, so that a source of one file is read by many tasks.
        kept = docs.select("key", "type", "title", "description")
        kept = (kept.repartition("key") if spread else kept).withColumn("size", (token_count(F.col("title")) + token_count(F.col("description"))).cast("bigint"))
        kept.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{at}/docs/gen={gen}")
        stored = self.spark.read.schema(f"{DOCS}, size bigint").parquet(f"{at}/docs/gen={gen}")
        words = stored.select("key", "type", "size", tokens(F.col("title")).alias("t"), tokens(F.col("description")).alias("d"))
        batch, was = "spark.sql.execution.arrow.maxRecordsPerBatch", self.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        self.spark.conf.set(batch, BATCH_DOCS)
        try:
            words.mapInArrow(_postings, POSTINGS).write.mode("overwrite").parquet(f"{at}/postings/gen={gen}")
        finally:
            self.spark.conf.set(batch, was)
        delta = stored.select(F.lit(1).alias("n"), "size")
        if replaced is not None:
            delta = delta.unionByName(replaced.select(F.lit(-1).alias("n"), (-F.col("size")).alias("size")))
        totals = delta.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("size"))
        totals.select("n", "size", F.lit(changed).cast("bigint").alias("changed")).coalesce(1).write.mode("overwrite").parquet(f"{at}/totals/gen={gen}")

    def rebuild(self, docs: DataFrame | None = None) -> StoredIndex:
        """Index docs, or what is indexed, anew: one version without a log."""
        spread = docs is not None  # what is indexed lies in segments, one of each key
        docs = _last_of_each(docs) if spread else self.documents()
        number = max(self._versions(), default=0) + 1
        self._write(f"{self.folder}/v{number}", 0, docs, None, 0, spread)
        self._forget()
        return self

    def apply(self, changes: DataFrame) -> StoredIndex:
        """Append a generation: changes (seq, op, key, type, title, description), of which the last of each key counts; op "delete" takes it out."""
        state = self.state()
        gen = state["gen"] + 1
        last = _last_of_each(changes, "op").persist()
        changed = last.count()
        # A generation without totals never counted; it is written over.
        last.select("key", "op").write.mode("overwrite").parquet(f"{state['at']}/changes/gen={gen}")
        held = self.spark.read.parquet(f"{state['at']}/docs").where(F.col("gen") < gen).join(small(last.select("key"), changed), "key", "left_semi")
        replaced = self._live(held).select("size")
        self._write(state["at"], gen, last.where("op <> 'delete'"), replaced, changed)
        last.unpersist()
        self._forget()
        return self

    # -- reading

    def postings(self, words: list[str]) -> DataFrame:
        """(term, key, type, size, in_title, in_text) of live documents, read from the pages of these words alone."""
        state = self.state()
        rows = self.spark.read.schema(f"{POSTINGS}, gen int").parquet(f"{state['at']}/postings").where(_any_of("term", sorted(set(words))))
        return self._live(rows.where(F.col("gen") <= state["gen"])).select("term", "key", "type", "size", "in_title", "in_text")

    def word_hits(self, terms: list[str]) -> DataFrame | None:
        """(key, type, raw, in_title, in_text) of documents that hold every term as a run of words; None if no term has a word."""
        phrases = [p for p in (python_tokens(t) for t in terms) if p]
        if not phrases:
            return None
        words = sorted({w for p in phrases for w in p})
        found = self.postings(words)
        where = lambda w, side: F.coalesce(F.max(F.when(F.col("term") == w, F.col(side))), F.array().cast("array<int>"))
        names = {w: i for i, w in enumerate(words)}
        if len(words) == 1:
            held = found.select("key", "type", "size", F.col("in_title").alias("t0"), F.col("in_text").alias("d0"))
        else:
            held = found.groupBy("key", "type", "size").agg(*(where(w, side).alias(f"{c}{names[w]}") for w in words for c, side in (("t", "in_title"), ("d", "in_text"))))

        def count(phrase: list[str], side: str) -> Column:
            starts = F.col(f"{side}{names[phrase[0]]}")
            for i, w in enumerate(phrase[1:], 1):
                starts = F.array_intersect(starts, F.transform(f"{side}{names[w]}", lambda p, i=i: p - i))
            return F.size(starts)

        counted = held.select("key", "type", "size", *(count(p, "t").alias(f"__t{i}") for i, p in enumerate(phrases)), *(count(p, "d").alias(f"__d{i}") for i, p in enumerate(phrases)))
        hit = [F.col(f"__t{i}") + F.col(f"__d{i}") for i in range(len(phrases))]
        state = self.state()
        n, mean = state["n"], (state["size"] / state["n"] if state["n"] else 0.0)
        having = counted.agg(*(F.count_if(h > 0).alias(f"n{i}") for i, h in enumerate(hit))).first()
        raw, every, in_title, in_text = F.lit(0.0), F.lit(True), F.lit(False), F.lit(False)
        for i, h in enumerate(hit):
            raw = raw + bm25(h, idf_of(n, having[i]), F.col("size"), mean)
            every, in_title, in_text = every & (h > 0), in_title | (F.col(f"__t{i}") > 0), in_text | (F.col(f"__d{i}") > 0)
        return counted.where(every).select("key", "type", raw.alias("raw"), in_title.alias("in_title"), in_text.alias("in_text"))

    def fetch(self, keys: list[str] | DataFrame) -> DataFrame:
        """The documents of some keys, from their pages alone, or of those of a table (key)."""
        if isinstance(keys, DataFrame):
            return self.documents().join(keys, "key", "left_semi")
        rows = self.spark.read.parquet(f"{self.state()['at']}/docs").where(_any_of("key", keys))
        return self._live(rows).select("key", "type", "title", "description")

    def search(self, query: str, nodes: DataFrame | None = None, types: list[str] | None = None, limit: int | None = 20, candidates: int | None = CANDIDATES) -> DataFrame:
        """As search.search, of what is stored: words are looked up in postings; texts are read only where trigrams must be."""
        terms = query_terms(query)
        by_word = self.word_hits(terms) if terms else None
        return ranked(self.spark, by_word, lambda: trigram_hits(self.documents(), query), nodes, types, limit, self.fetch, candidates)


def _any_of(name: str, values: list[str]) -> Column:
    """Whether a column is one of values; an OR is pushed down to pages as it is, a long IN as its range."""
    return reduce(lambda a, b: a | b, (F.col(name) == v for v in values), F.lit(False))


def _last_of_each(rows: DataFrame, *more: str) -> DataFrame:
    """One row of each key: that of the greatest seq, if there is one, else the greatest.

    Only rows of keys that are there more than once are compared, as they are sorted for it.
    """
    columns = [*more, "type", "title", "description"]
    order = F.struct("seq", *columns) if "seq" in rows.columns else F.struct(*columns)
    rows = rows.where("key IS NOT NULL")
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").persist()
    n = many.count()
    single = rows.select("key", *columns)
    if n:
        repeated = rows.join(small(many, n), "key", "left_semi").groupBy("key").agg(F.max_by(F.struct(*columns), order).alias("x")).select("key", "x.*")
        single = single.join(small(many, n), "key", "left_anti").unionByName(repeated)
    else:
        many.unpersist()
    return single
