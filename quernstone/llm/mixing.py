"""Mixing sources to target weights by exact token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_of, col, hash_key, inner, never_null, shuffle_partitions, words


def tempered_budgets(tokens: DataFrame, alpha: float, epochs: float | None = None) -> DataFrame:
    """(source, budget) from (source, n): weights in proportion to n ** alpha.

    epochs None: the budgets sum to the corpus' tokens.  Else the total is such that every
    source is passed at least epochs times.
    """
    weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    whole = Window.partitionBy()
    share = weight / F.sum(weight).over(whole)
    total = F.sum("n").over(whole).cast("double") if epochs is None else F.max(F.col("n") * epochs / share).over(whole)
    return tokens.where("n > 0").select("source", F.round(share * total).cast("bigint").alias("budget"))


def mix_to_budgets(docs: DataFrame, alpha: float, epochs: float | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of a mixture: each source passed in hash-random order until its exact budget.

    Adds n_tokens, epoch (from 0), start (tokens of the source taken before, in all
    epochs) and take (n_tokens, or less for the one row in which the budget ends), and so
    the takes of a source sum to its budget exactly.  Sources that are small for their
    weight are repeated; those that are large are cut.  Tokens are words (common.words).

    A row's key is a hash of seed and id.  Keys are uniform, so equal ranges of them are
    buckets of equal size within each source, and a source is never sorted by one task.
    Token sums of the buckets are prefix-summed (a table of sources x buckets), and added to the
    running sums within buckets, which are hash-partitioned alike, so texts are shuffled
    once.

    A null source is a source; a null text has no tokens; rows of no tokens go with the
    place their key has; ties of keys are ordered by id and text; repeated rows count
    each; rows of sources without tokens are left out; an empty table gives no rows.
    Other columns are kept; those named n_tokens, epoch, start or take are replaced.
    """
    q = inner(docs)
    buckets = max(64, 4 * shuffle_partitions(docs))
    keyed = docs.withColumn("n_tokens", words(text_col)).withColumns({q("key"): hash_key(seed, id_col), q("from"): never_null(source_col)}).withColumn(q("bucket"), bucket_of(F.col(q("key")), buckets))
    sums = keyed.groupBy(F.col(q("from")).alias("source"), F.col(q("bucket")).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    by_source = Window.partitionBy("source")
    placed = sums.select("source", "bucket", F.sum("n").over(by_source).alias("size"), (F.sum("n").over(by_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    budgets = tempered_budgets(sums.groupBy("source").agg(F.sum("n").alias("n")), alpha, epochs)
    budgets = budgets.select(F.col("source").alias(q("of")), F.col("budget").alias(q("budget")))
    places = placed.join(budgets, F.col("source") == F.col(q("of"))).select(F.col("source").alias(q("source")), F.col("bucket").alias(q("at")), F.col("size").alias(q("size")), F.col("before").alias(q("before")), q("budget"))
    order = [F.col(q("key")), col(id_col), col(text_col)]
    within = Window.partitionBy(q("from"), q("bucket")).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.withColumn(q("run"), F.sum("n_tokens").over(within) - F.col("n_tokens"))
    joined = run.join(places.hint("shuffle_merge"), (F.col(q("from")) == F.col(q("source"))) & (F.col(q("bucket")) == F.col(q("at"))))
    before = F.col(q("before")) + F.col(q("run"))
    full, rest = F.floor(F.col(q("budget")) / F.col(q("size"))), F.col(q("budget")) % F.col(q("size"))
    copies = joined.withColumns({q("first"): before, q("full"): full.cast("bigint"), q("rest"): rest}).withColumn(q("copies"), F.col(q("full")) + F.when(F.col(q("first")) < F.col(q("rest")), 1).otherwise(0)).where(F.col(q("copies")) > 0)
    rows = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(q("copies")) - 1)))
    rows = rows.withColumns({"start": F.col("epoch") * F.col(q("size")) + F.col(q("first")), "take": F.when(F.col("epoch") < F.col(q("full")), F.col("n_tokens")).otherwise(F.least("n_tokens", F.col(q("rest")) - F.col(q("first"))))})
    return rows.drop(q("key"), q("from"), q("bucket"), q("run"), q("source"), q("at"), q("size"), q("before"), q("budget"), q("first"), q("full"), q("rest"), q("copies"))


def sql(alpha: float, seed: int = 1) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, text, md5(concat('{seed}', ':', coalesce(doc_id::VARCHAR, ''))) AS k,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0)::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS size FROM d GROUP BY source HAVING sum(n_tokens) > 0),
w AS (SELECT source, size, pow(size::DOUBLE, {alpha}) AS w FROM s),
b AS (SELECT source, size, round(w / (SELECT sum(w) FROM w) * (SELECT sum(size)::DOUBLE FROM w))::BIGINT AS budget FROM w),
r AS (SELECT d.*, b.size, b.budget // b.size AS full_epochs, b.budget % b.size AS rest,
  (sum(n_tokens) OVER (PARTITION BY d.source ORDER BY k, doc_id, text ROWS UNBOUNDED PRECEDING) - n_tokens)::BIGINT AS first
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, text, n_tokens, epoch, (epoch * size + first)::BIGINT AS start,
  (CASE WHEN epoch < full_epochs THEN n_tokens ELSE least(n_tokens, rest - first) END)::BIGINT AS take
FROM (SELECT *, unnest(range(full_epochs + CASE WHEN first < rest THEN 1 ELSE 0 END))::BIGINT AS epoch FROM r)"""


def cut_texts(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of mix_to_budgets of some tokens, with texts ended after ``take`` words, and n_chars (if it is there) made to fit.

    Rows of no tokens (null and empty texts) are kept as they are; those of which nothing is taken go; repeated rows
    are each cut; an empty table gives no rows; other columns are kept.
    """
    ended = F.array_join(F.slice(F.split(col(text_col), r"(?<=[^ \t\n\r\f\x0B])(?=[ \t\n\r\f\x0B])"), F.lit(1), F.col("take").cast("int")), "")
    rows = mixed.where("n_tokens = 0 OR take > 0")
    text = F.when(F.col("take") >= F.col("n_tokens"), col(text_col)).otherwise(ended)
    rows = rows.withColumn(text_col, text)
    if "n_chars" in rows.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("take") >= F.col("n_tokens"), F.col("n_chars")).otherwise(F.length(col(text_col)).cast("bigint")))
    return rows
