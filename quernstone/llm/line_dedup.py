"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, inner, small


def _line_hash(line: Column) -> Column:
    """64 bits of a line without its outer spaces, seeded into its length."""
    key = F.trim(line)
    return F.xxhash64(key, F.length(key))


def boilerplate_lines(docs: DataFrame, text_col: str, host_col: str, ratio: float) -> DataFrame:
    """(host, line, pages): hashes of lines on more than ratio of the other pages of a host that has them."""
    text = col(text_col).cast("string")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    pages = docs.select(col(host_col).alias("host"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"), F.array_distinct(F.transform(lines, _line_hash)).alias("lines"))
    pages = pages.groupBy("host", "h", "n").agg(F.first("lines").alias("lines"))
    counted = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where("pages > 1")
    totals = docs.select(col(host_col).alias("of"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("n")).distinct().groupBy("of").agg(F.count("*").alias("total"))
    share = F.col("pages") - 1 > (F.col("total") - 1) * ratio
    return counted.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(share).select("host", "line", "pages")


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.05) -> DataFrame:
    """docs with the lines dropped that are frequent within their host, and their number in n_dropped.

    A line counts once a page, without outer spaces.  For each page that has it, the pages
    with it are divided by the total of the host, both without the page itself: a line is
    boilerplate if (pages - 1) / (total - 1) is beyond ratio, which alone decides.  So a
    line of one page is kept however small its host, and one on every page is dropped from
    two pages on.  Pages of one host with equal texts are one page (their texts' 64-bit hash
    and length tell), so that copies don't make boilerplate of all their lines.  Lines of
    spaces alone are never counted or dropped.

    Only hashes of lines are shuffled, combined on the map side; then each host's hashes
    meet its pages in one join: a host has at most (lines a page) / ratio of them, and
    they are broadcast only if their counted size fits, else pages are shuffled by host
    and split where a host is hot.

    A null text stays null, and all of a host's are one page; a null host is a host; a text
    of which all lines are dropped is empty, and its row stays; each of repeated rows is
    treated alike; an empty table gives no rows.  Other columns are kept, whatever their names; one named
    n_dropped is replaced.
    """
    found = cut(boilerplate_lines(docs, text_col, host_col, ratio))
    q = inner(docs)
    host, lines_of, kept = q("host"), q("lines"), q("kept")
    per_host = found.groupBy(F.col("host").alias(host)).agg(F.collect_set("line").alias(lines_of))
    n = found.count()
    joined = docs.join(small(per_host, n, 64), col(host_col).eqNullSafe(F.col(host)), "left")
    drops = lambda x: (F.trim(x) != "") & F.array_contains(F.col(lines_of), _line_hash(x))
    lines = F.split(col(text_col).cast("string"), "\n")
    cleaned = joined.withColumn(kept, F.when(F.col(lines_of).isNotNull() & col(text_col).isNotNull(), F.filter(lines, lambda x: ~drops(x))))
    return cleaned.withColumns(
        {
            text_col: F.when(F.col(kept).isNull(), col(text_col)).otherwise(F.array_join(kept, "\n")),
            "n_dropped": F.when(F.col(kept).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("bigint"),
        }
    ).drop(host, lines_of, kept)


def sql(ratio: float = 0.05) -> str:
    return f"""
WITH p AS (SELECT row_number() OVER () AS pid, source, text FROM (SELECT DISTINCT source, text FROM documents)),
lines AS (SELECT DISTINCT pid, source, trim(u) AS line FROM (SELECT pid, source, unnest(string_split(text, chr(10))) AS u FROM p) WHERE trim(u) <> ''),
totals AS (SELECT source, count(*) AS total FROM p GROUP BY source),
boiler AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  GROUP BY l.source, l.line, t.total HAVING count(*) > 1 AND count(*) - 1 > (t.total - 1) * {ratio}),
drops AS (SELECT source, list(line) AS lines FROM boiler GROUP BY source)
SELECT d.doc_id, d.source,
  CASE WHEN b.lines IS NULL THEN d.text
       ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(b.lines, trim(x))), chr(10)) END AS text,
  CASE WHEN b.lines IS NULL OR d.text IS NULL THEN 0
       ELSE len(list_filter(string_split(d.text, chr(10)), lambda x: trim(x) <> '' AND list_contains(b.lines, trim(x)))) END::BIGINT AS n_dropped
FROM documents d LEFT JOIN drops b ON d.source IS NOT DISTINCT FROM b.source"""
