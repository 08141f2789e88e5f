"""A corpus from raw documents to packed training rows, in five stages.

Every stage takes documents (doc_id, text, lang, source, n_chars); columns besides are left out, whatever their
names.  An empty table gives no rows.  No stage changes the type of an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import line_dedup, mixing, near_dup, nbsvm, packing
from quernstone.llm.common import cut, small, table
from quernstone.llm.queries import ALPHA, DOCUMENT, RATIO


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject.

    Null and empty texts, and those without a word, are kept, as there is nothing to judge; a null id is kept;
    repeated rows go or stay together; without labels of both classes all are kept.
    """
    return nbsvm.classify(docs, table(spark, sf_dir, "labels"), keep=DOCUMENT).where("kept").select(*DOCUMENT)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that are frequent in their source; those that had nothing else go.

    Null and empty texts lose nothing and are kept, as are null ids; a null source is a source; repeated rows are one page
    and are treated alike.  n_chars is counted again where a line went.
    """
    done = line_dedup.drop_boilerplate(docs, ratio=RATIO)
    done = done.where("n_dropped = 0 OR trim(text) <> ''")
    return done.selectExpr("doc_id", "text", "lang", "source", "CASE WHEN n_dropped = 0 THEN n_chars ELSE length(text) END AS n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id.

    Null and empty texts, and those without a word, are in no group and are kept, as are null ids.  Rows that repeat an
    id are one document, and go or stay together.
    """
    copies = cut(near_dup.near_duplicates(docs).select("doc_id"))
    return docs.join(small(copies, copies.count(), 16), "doc_id", "left_anti").select(*DOCUMENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights of tokens ** 0.7, every document once at least; the text in which a budget ends is cut there.

    A null source is a source; one without tokens is left out, and null or empty texts of others have no tokens and go with their
    place; repeated rows and null ids count each; ties go by id and text.
    """
    mixed = mixing.mix_to_budgets(docs, ALPHA, epochs=1.0)
    return mixing.cut_texts(mixed).select(*DOCUMENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in bins of at most 2048 tokens, 16 segments and 2040 loss-bearing tokens.

    A text beyond a limit is split; null and empty texts have no piece; null ids are kept; repeated rows are each placed.
    """
    return packing.pack(packing.document_examples(docs), loss=2040).withColumnRenamed("id", "doc_id")


STAGES = [("quality_classifier", classify), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: Neither the classifier nor BagMinHash has an SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
