"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the cluster's shared folder.

    The folder is that of ``spark.checkpoint.dir``.  Where it is unset a local master gets a
    folder of this machine, as in tests; any other is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="quernstone-checkpoint-"))
    return df.checkpoint(eager=True)


def inner(df: DataFrame) -> Callable[[str], str]:
    """A maker of column names for inner use, none of which df has, in any case of letters."""
    tag = "__q_"
    while any(c.lower().startswith(tag) for c in df.columns):
        tag = "_" + tag
    return lambda name: tag + name


def kind_of(df: DataFrame, name: str) -> str:
    """The type of a column as in a schema string."""
    return next(f for f in df.schema.fields if f.name.lower() == name.lower()).dataType.simpleString()


def orderable(df: DataFrame, name: str) -> Column:
    """A column as bigint if it is of an integral type, else as a string."""
    kind = next(f for f in df.schema.fields if f.name.lower() == name.lower()).dataType
    return col(name).cast("bigint" if isinstance(kind, IntegralType) else "string")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Bytes up to which a side whose row count is known may be broadcast; a hash relation takes several times as much on the driver.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def hash_key(seed: int, *names: str) -> Column:
    """A hash-random key of 32 hex digits: uniform, and the same in any SQL engine.

    A null counts as an empty string.
    """
    parts = [F.coalesce(col(n).cast("string"), F.lit("")) for n in names]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def bucket_of(key: Column, buckets: int) -> Column:
    """The equal-width range of the key space, 0 to buckets - 1, that a key is in.

    Keys of hash_key are uniform, so this is a range partition that needs no sample.
    """
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * F.lit(buckets) / F.lit(1 << 32)).cast("int")


#: White space is ASCII's; written out as engines differ in what \\s holds.
WORD = r"[^ \t\n\r\f\x0B]+"


def words(name: str) -> Column:
    """The number of runs of characters other than white space; 0 for a null."""
    return F.coalesce(F.regexp_count(col(name).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def never_null(name: str) -> Column:
    """A string for each value of a column, null's too, so that windows and joins on it share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), col(name).cast("string")), F.lit(""))
