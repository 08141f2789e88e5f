"""Shards that each match the mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_of, col, hash_key, inner, never_null, shuffle_partitions


def stratified_shards(docs: DataFrame, shards: int, seed: int = 1, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with position (from 0, in the whole order) and shard (0 to shards - 1).

    Rows of a source are shuffled by a seeded hash of their id and ranked; rank r of n
    has the fractional rank (2r - 1) / 2n.  All rows are ordered by fractional rank, then
    source and key, and cut into shards of equal length to within a row, so each holds every source in proportion, to within
    a row for each source.

    Neither ranking is done by one task: keys are uniform, so ranks are counts of the key
    ranges before plus a row number within (source, range); fractional ranks are uniform
    too, so positions are found alike by ranges of them.  The tables of counts have
    sources x ranges rows at most and are hash-partitioned like the rows they join.

    A null source is a source; a null id is ordered as an empty one; ties of keys (repeated ids) are
    ordered by id, then as Spark has them, their positions being alike in every column but
    those not named here; an empty table gives no rows.  Other columns are kept; those named position or shard are replaced.
    """
    q = inner(docs)
    ranges = max(64, 4 * shuffle_partitions(docs))
    keyed = docs.withColumns({q("key"): hash_key(seed, id_col), q("source"): never_null(source_col)}).withColumn(q("range"), bucket_of(F.col(q("key")), ranges))
    counts = keyed.groupBy(F.col(q("source")).alias(q("of")), F.col(q("range")).alias(q("at"))).agg(F.count("*").alias("n"))
    of = Window.partitionBy(q("of"))
    places = counts.select(q("of"), q("at"), F.sum("n").over(of).alias(q("size")), (F.sum("n").over(of.orderBy(q("at")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias(q("before")))
    within = Window.partitionBy(q("source"), q("range")).orderBy(q("key"), col(id_col))
    ranked = keyed.withColumn(q("row"), F.row_number().over(within)).join(places.hint("shuffle_merge"), (F.col(q("source")) == F.col(q("of"))) & (F.col(q("range")) == F.col(q("at"))))
    ranked = ranked.withColumn(q("frac"), (2 * (F.col(q("before")) + F.col(q("row"))) - 1).cast("double") / (2 * F.col(q("size"))))
    ranked = ranked.withColumn(q("slot"), F.floor(F.col(q("frac")) * ranges).cast("int")).drop(q("of"), q("at"), q("before"), q("row"), q("range"))
    # Of a source of n rows, those with a fractional rank before slot / ranges are known by n alone.
    sizes = counts.groupBy(q("of")).agg(F.sum("n").alias("n"))
    slots = sizes.select("n", F.explode(F.sequence(F.lit(1), F.lit(ranges))).alias("slot"))
    edge = F.col("slot").cast("double") / ranges
    near = F.floor(edge * F.col("n") + 0.5).cast("bigint")
    frac = lambda r: (2 * r - 1).cast("double") / (2 * F.col("n"))
    slot_of = lambda r: F.floor(frac(r) * ranges)
    below = sum((F.when((near + k >= 1) & (near + k <= F.col("n")) & (slot_of(near + k) < F.col("slot")), 1).otherwise(0) for k in (-1, 0, 1)), F.greatest(F.least(near - 2, F.col("n")), F.lit(0)))
    starts = slots.groupBy(F.col("slot").alias(q("slot_at"))).agg(F.sum(below).cast("bigint").alias(q("start")))
    total = F.max(F.when(F.col(q("slot_at")) == ranges, F.col(q("start")))).over(Window.partitionBy())
    starts = starts.select(q("slot_at"), q("start"), total.alias(q("total")))
    starts = starts.union(starts.where(F.col(q("slot_at")) == ranges).select(F.lit(0), F.lit(0).cast("bigint"), q("total")))
    order = Window.partitionBy(q("slot")).orderBy(q("frac"), col(source_col), q("key"), col(id_col))
    rows = ranked.withColumn(q("row"), F.row_number().over(order)).join(starts.hint("shuffle_merge"), F.col(q("slot")) == F.col(q("slot_at")))
    rows = rows.withColumn("position", F.col(q("start")) + F.col(q("row")) - 1)
    return rows.withColumn("shard", F.floor(F.col("position") * shards / F.col(q("total"))).cast("bigint")).drop(q("key"), q("source"), q("size"), q("frac"), q("slot"), q("row"), q("slot_at"), q("start"), q("total"))


def sql(shards: int, seed: int = 1) -> str:
    return f"""
WITH d AS (SELECT *, md5(concat('{seed}', ':', coalesce(doc_id::VARCHAR, ''))) AS k FROM documents),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source)) AS frac FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY frac, source NULLS FIRST, k, doc_id NULLS FIRST) - 1 AS position, count(*) OVER () AS total FROM r)
SELECT doc_id, text, lang, source, n_chars, position::BIGINT AS position, (position * {shards} // total)::BIGINT AS shard FROM p"""
