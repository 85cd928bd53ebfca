"""Helpers shared by the corpus operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clvforge.session import durable_cut, ship_package

#: ASCII white space, the only white space that the contracts name.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any store works."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, stay out of the work; null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    return durable_cut(df)


def join_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """``rows`` with the columns of a lookup that has one row a key (null-safe inner join).

    Keys that more than one in ``share`` rows bear are ``share`` at most; their part of the lookup is
    broadcast, so that no task gets all rows of such a key. ``rows`` should be a written table: it is read
    three times.
    """
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    added = [F.col(f"l.{c}").alias(c) for c in lookup.columns if c not in keys]
    least = rows.count() // share
    hot = F.broadcast(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_many")).filter(F.col("_many") > least + 1).select(*keys))
    often = F.broadcast(lookup.alias("l").join(hot.alias("h"), same("l", "h"), "left_semi"))
    r = rows.alias("r")
    rest = r.join(hot.alias("h"), same("r", "h"), "left_anti").alias("r")
    return (r.join(often.alias("l"), same("r", "l")).select("r.*", *added)
            .unionByName(rest.join(lookup.alias("l"), same("r", "l")).select("r.*", *added)))
