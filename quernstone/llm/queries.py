"""The queries of the training-data operators, with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, exact_dup, line_dedup, mixing, near_dup, nbsvm, packing, sharding, warc
from .common import table

ALPHA, SHARDS, RATIO = 0.7, 64, 0.05
#: The stated query set of searches.
ASKING = "vec_id % 100 = 0"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def op1_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation but the last as a preference pair with the next."""
    return chat.format_preferences(chat.spliced_pairs(table(spark, sf_dir, "conversations")))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations packed: at most 2048 tokens, 16 segments and 1536 loss-bearing tokens a bin."""
    return packing.pack(packing.conversation_examples(table(spark, sf_dir, "conversations"))).withColumnRenamed("id", "conv_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that are frequent in their source."""
    docs = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), ratio=RATIO)
    return docs.select("doc_id", "source", "text", "n_dropped")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near copy among all documents, with the one kept."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights of tokens ** 0.7 by source; as many tokens as there are."""
    return mixing.mix_to_budgets(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ALPHA)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 64 shards that each match the mixture of sources."""
    return sharding.stratified_shards(table(spark, sf_dir, "documents"), SHARDS)


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of a recrawl of all pages, resolved."""
    return warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, as their labels teach it."""
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exact copy among all documents, with its owner."""
    return exact_dup.exact_owners(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all embeddings, of every embedding whose id is divisible by 100."""
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), asking=ASKING).withColumn("similarity", F.round("similarity", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_chat_preferences, op2_vector_packing, op3_line_dedup, op4_near_duplicates, op5_mixing, op6_sharding, op7_revisits, op8_quality_classifier, op9_exact_copies, op10_nearest_neighbours)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_preferences": chat.SQL,
        "op3_line_dedup": line_dedup.sql(RATIO),
        "op5_mixing": mixing.sql(ALPHA),
        "op6_sharding": sharding.sql(SHARDS),
        "op7_revisits": warc.SQL,
        "op9_exact_copies": exact_dup.SQL,
        "op10_nearest_neighbours": ann.sql(asking=ASKING),
    }
