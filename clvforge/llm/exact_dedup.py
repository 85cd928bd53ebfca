"""Exact dedup by content sort, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clvforge.llm.common import ASCII_SPACE, cut, shuffle_partitions

_KEYS = ("_prefix", "_print", "_salt")


def normalised(text) -> F.Column:
    """The text without its ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    norm = normalised(F.col(text_col).cast("string"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.substring(norm.cast("binary"), 1, 32).alias("_prefix"),
                       F.xxhash64(norm).alias("_print"))


def _sorted_cells(keyed: DataFrame, parts: int, id_col: str, text_col: str) -> DataFrame:
    """Range-partition by sampled splitters, sort, and compare neighbours in full.

    The splitters are cut on a 32-byte prefix, a fingerprint and a salt, so that the sample which
    reaches the driver stays small whatever the texts' lengths; equal texts agree in the first two.
    Sort and comparison go on to the whole normalised text. The range partitioning also satisfies
    the window's clustering, so there is no second exchange.
    """
    text = F.col(f"_row.`{text_col}`").cast("string")
    rows = (keyed.repartitionByRange(parts, *_KEYS)
            .withColumn("_norm", normalised(text))
            .withColumn("_chars", F.length(F.coalesce(text, F.lit(""))))
            .withColumn("_id", F.col(f"_row.`{id_col}`").cast("long")))
    order = [F.desc("_chars"), F.asc_nulls_last("_id")]
    w = Window.partitionBy(*_KEYS, "_norm").orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (rows.withColumn("_rank", F.row_number().over(w))
            .withColumn("_best", F.first("_id").over(whole))
            .withColumn("_best_chars", F.first("_chars").over(whole))
            .withColumn("_size", F.count(F.lit(1)).over(whole)))


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       partitions: int | None = None) -> DataFrame:
    """Group equal texts by an external sort of their normalised bytes.

    Texts are equal when identical after deleting ASCII white space. Of equal texts the row with the
    most code points, then the smallest id, stays (null ids last). Returns one row per input row:
    ``_row`` (struct of all input columns, whatever their names), ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``. Null and empty texts form one group like any other. Exactly one row
    of a group is kept, also among repeated rows with the same id. An empty table gives no rows.

    A text with more copies than half a partition's share of the rows is salted by id into cells of
    about that size. There are at most ``2 * partitions`` such texts, so the table of them and the
    table of their cells are small; cells are merged afterwards by their full text.
    """
    spark = docs.sparkSession
    parts = partitions or shuffle_partitions(spark)
    keyed = _keyed(docs, text_col)
    rows = docs.count()
    share = max(32, rows // (2 * parts))
    hot = cut(keyed.groupBy("_print").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > share)
              .select("_print", F.ceil(F.col("_n") / share).alias("_salts")))
    salted = keyed.join(F.broadcast(hot), "_print", "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(-1))
        .otherwise(F.pmod(F.xxhash64(F.col(f"_row.`{id_col}`")), F.coalesce("_salts", F.lit(1)))))
    cells = (_sorted_cells(salted.filter("_salt >= 0"), parts, id_col, text_col)
             .filter("_rank = 1")
             .select("_print", "_salt", "_norm", "_best", "_best_chars", "_size"))
    one = Window.partitionBy("_print", "_norm")
    best = F.max(F.struct(F.col("_best_chars"), F.col("_best").isNotNull(), -F.col("_best"), F.col("_salt"))).over(one)
    merged = cells.select("_print", "_salt", F.sha2("_norm", 256).alias("_sha"), (-best["col3"]).alias("_all_best"),
                          best["_salt"].alias("_all_salt"), F.sum("_size").over(one).alias("_all_size"))
    found = _sorted_cells(salted, parts, id_col, text_col).select(
        "_row", "_print", "_salt", "_rank", "_best", "_size", F.sha2("_norm", 256).alias("_sha"))
    out = found.join(F.broadcast(cut(merged)), ["_print", "_salt", "_sha"], "left")
    return out.select(
        "_row",
        F.when(F.col("_all_size").isNull(), F.col("_best")).otherwise(F.col("_all_best")).alias("keep_id"),
        F.coalesce("_all_size", "_size").alias("group_size"),
        ((F.col("_rank") == 1) & (F.col("_all_size").isNull() | (F.col("_all_salt") == F.col("_salt")))).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    out = content_sort_dedup(docs, **options).filter("kept")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
