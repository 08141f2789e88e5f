"""State as append-only logs, of which the latest row of a key counts.

A log has the columns of its table, seq (the order of writing) and, where rows may be
taken back, op ("put" or "delete").  Plain files know no update, so each view is one window
over its key; compact by writing the view as a new log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import like


def _latest(log: DataFrame, *keys: str) -> DataFrame:
    last = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return log.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def current_nodes(log: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """The nodes of a log (seq, op, id, type, name, metadata): the last of each id, in place of the first.

    A put replaces type, name and metadata (to none, if it has none) and keeps seq; the
    boosts log (seq, id, boost) is apart, so a put keeps boost too; a boost of no node is lost.
    """
    gone = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy("id"))
    marked = log.withColumn("__gone", F.coalesce(gone, F.lit(-(1 << 62))))
    alive = marked.where("op = 'put' AND seq > __gone")
    nodes = _latest(alive.withColumn("__first", F.min("seq").over(Window.partitionBy("id"))), "id")
    nodes = nodes.select(F.col("__first").alias("seq"), "id", "type", "name", "metadata", "__gone")
    if boosts is None:
        return nodes.select("seq", "id", "type", "name", F.lit(0.0).alias("boost"), "metadata")
    last = boosts.groupBy("id").agg(F.max(F.struct("seq", "boost")).alias("b"))
    joined = nodes.join(last, "id", "left")
    counts = (F.col("b.seq") > F.col("seq")) & (F.col("b.seq") > F.col("__gone"))
    return joined.select("seq", "id", "type", "name", F.when(counts, F.col("b.boost")).otherwise(0.0).alias("boost"), "metadata")


def current_edges(log: DataFrame, deleted_nodes: DataFrame | None = None) -> DataFrame:
    """The edges of a log (seq, op, src, dst, relationship, metadata): one of each ends and relationship, with the last metadata.

    deleted_nodes (seq, id) takes all edges that were put before and touch the node.
    """
    key = ["src", "dst", "relationship"]
    if deleted_nodes is not None:
        last = deleted_nodes.groupBy("id").agg(F.max("seq").alias("at"))
        for end in ("src", "dst"):
            log = log.join(last.select(F.col("id").alias(end), "at"), end, "left").where("at IS NULL OR at < seq").drop("at")
    gone = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy(*key))
    alive = log.withColumn("__gone", F.coalesce(gone, F.lit(-(1 << 62)))).where("op = 'put' AND seq > __gone")
    edges = _latest(alive.withColumn("__first", F.min("seq").over(Window.partitionBy(*key))), *key)
    return edges.select(F.col("__first").alias("seq"), *key, "metadata")


def upsert_edges(rows: DataFrame) -> DataFrame:
    """One edge of each ends and relationship of rows, with the last metadata (of equal seq the greater text) and the first seq: an aggregate, so it combines before the shuffle."""
    made = rows.groupBy("src", "dst", "relationship").agg(F.max_by("metadata", F.struct("seq", "metadata")).alias("metadata"), F.min("seq").alias("seq"))
    return made.select("seq", "src", "dst", "relationship", "metadata")


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes without those of ids (id), and edges without those that touch one."""
    kept = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti").select(*nodes.columns), kept.select(*edges.columns)


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys, ["src", "dst", "relationship"], "left_anti").select(*edges.columns)


def current_kv(log: DataFrame) -> DataFrame:
    """Entries of a log (seq, op, key, value, ts): the last value of each key, when it was made and when last set; deleted keys are gone."""
    gone = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy("key"))
    alive = log.withColumn("__gone", F.coalesce(gone, F.lit(-(1 << 62)))).where("op = 'put' AND seq > __gone")
    return alive.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.min("ts").alias("created_at"), F.max_by("ts", "seq").alias("updated_at"))


def kv_like(kv: DataFrame, pattern: str) -> DataFrame:
    """Entries whose key is LIKE pattern (ASCII letters in either case), the last set first."""
    return kv.where(like(F.col("key"), pattern)).orderBy(F.desc("updated_at"), "key")


def kv_get(kv: DataFrame, key: str) -> DataFrame:
    """(key, value, found) of one key, in one row; a stored null counts as not found."""
    one = kv.where(F.col("key") == key).agg(F.first("value").alias("value"))
    there = F.coalesce(F.col("value") != "null", F.lit(False))
    return one.select(F.lit(key).alias("key"), F.when(there, F.col("value")).alias("value"), there.alias("found"))


class Namespace:
    """Keys under a prefix: written with it, seen without it.  It may be nested."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def namespace(self, prefix: str) -> Namespace:
        return Namespace(f"{self.prefix}:{prefix}")

    def key(self, key: Column) -> Column:
        return F.concat(F.lit(self.prefix + ":"), key)

    def query(self, kv: DataFrame, pattern: str = "%") -> DataFrame:
        found = kv_like(kv, f"{self.prefix}:{pattern}")
        return found.withColumn("key", F.expr(f"substring(key, {len(self.prefix) + 2})"))


def adopt_prefix(public: DataFrame, internal: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Move the keys that begin with exactly prefix from public to internal, where those there already stay."""
    mine = public.where(F.col("key").startswith(prefix))
    return public.where(~F.col("key").startswith(prefix)), internal.unionByName(mine.join(internal.select("key"), "key", "left_anti").select(*internal.columns))


def slice_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind, key, op) of the slices (path, kind, key) of files that were scanned again: put all of new, delete what old has and new hasn't."""
    puts = new.select("path", "kind", "key").distinct().withColumn("op", F.lit("put"))
    again = old.join(new.select("path").distinct(), "path", "left_semi")
    return puts.unionByName(again.join(new, ["path", "kind", "key"], "left_anti").select("path", "kind", "key").withColumn("op", F.lit("delete")))


def gone_files(hashes: DataFrame, seen: DataFrame) -> DataFrame:
    """Paths of stored hashes that a scan hasn't seen."""
    return hashes.select("path").join(seen.select("path"), "path", "left_anti")


def to_scan(files: DataFrame, hashes: DataFrame, force: bool = False, max_bytes: int = 500_000) -> DataFrame:
    """files (path, size, content) with state: parse, or skip for their size or an equal hash (hashes: path, hash)."""
    made = files.withColumn("hash", F.xxhash64("content")).join(hashes.withColumnRenamed("hash", "known"), "path", "left")
    same = F.lit(False) if force else F.coalesce(F.col("hash") == F.col("known"), F.lit(False))
    return made.withColumn("state", F.when(F.col("size") > max_bytes, "too_large").when(same, "unchanged").otherwise("parse")).drop("known")


def add_note(notes: DataFrame, entity: str, text: str, ts: int) -> DataFrame:
    """notes (seq, entity, text, ts) with one more, which comes last among those of its time; an entity needs no node."""
    last = notes.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return notes.unionByName(notes.sparkSession.createDataFrame([(last + 1, entity, text, ts)], "seq bigint, entity string, text string, ts bigint"))


def notes_of(notes: DataFrame, entity: str | None = None) -> DataFrame:
    """(entity, place, text, ts) of the notes of an entity, or of each; place counts from 1 in the order of time and seq."""
    mine = notes if entity is None else notes.where(F.col("entity") == entity)
    return mine.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy("ts", "seq"))).select("entity", "place", "text", "ts")


def merge_offsets(records: DataFrame, ord_col: str, id_col: str, per_range: int = 4096) -> DataFrame:
    """(ord, offset): what must be added to the ids of each part so that those of all parts are distinct; the sum of the greatest ids of the parts before.

    Parts are numbered by ord_col, an integer.  Their greatest ids are summed within ranges of parts, and the
    ranges' sums before each range, so no task has more than one range or the list of ranges.
    """
    most = records.groupBy(F.col(ord_col).cast("bigint").alias("ord")).agg(F.max(id_col).cast("bigint").alias("most")).withColumn("range", F.floor(F.col("ord") / per_range))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = most.groupBy("range").agg(F.sum("most").alias("whole")).select("range", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = most.withColumn("run", F.coalesce(F.sum("most").over(within), F.lit(0)))
    return placed.join(ranges, "range").select("ord", (F.col("start") + F.col("run")).alias("offset"))


def merged_ids(records: DataFrame, ord_col: str, id_col: str, *reference_cols: str) -> DataFrame:
    """records of many parts with their ids, and their references to ids of their part, made distinct; 0 stays 0, as it refers to nothing."""
    offsets = merge_offsets(records, ord_col, id_col).withColumnsRenamed({"ord": "__ord", "offset": "__offset"})
    joined = records.join(offsets, F.col(ord_col) == F.col("__ord"))
    moved = {c: F.when(F.col(c) == 0, F.col(c)).otherwise(F.col(c) + F.col("__offset")) for c in (id_col, *reference_cols)}
    return joined.withColumns(moved).drop("__ord", "__offset")
