"""Map the star-schema test tables onto invoice lines.

``lineitem ⋈ orders ⋈ part ⋈ customer ⋈ nation`` becomes one row per invoice
line with the eight transaction columns. Only the needed columns are read, so
the parquet scans carry a pruned ``ReadSchema``; the nation dimension is a
fixed 25-row table and is the only side broadcast by hand — the other joins
are left to Catalyst/AQE, which broadcasts only sides under the size threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clvforge import schemas as S


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_price_expr(extended: str, qty: str) -> F.Column:
    """round(extended / qty, 2), half-up, computed on integer cents.

    The extended price carries two decimals, so rounding on cents is exact and
    gives the same answer in every engine (float ``round`` does not).
    """
    cents = F.round(F.col(extended) * 100).cast("bigint")
    q = F.col(qty).cast("bigint")
    return F.floor((cents * 2 + q).cast("double") / (q * 2).cast("double")).cast("double") / 100


def transactions_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines from the star tables (see FIXTURES F8)."""
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    cust = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    cust_nation = cust.join(F.broadcast(nation),
                            cust.c_nationkey == nation.n_nationkey)
    # customers meet the orders first, so that the lines are shuffled twice, not three times
    placed = orders.join(cust_nation, orders.o_custkey == cust_nation.c_custkey)
    joined = (li.join(placed, li.l_orderkey == placed.o_orderkey)
                .join(part, li.l_partkey == part.p_partkey))
    return joined.select(
        F.concat(F.when(F.col("o_orderstatus") == "P", F.lit("C")).otherwise(F.lit("")),
                 F.col("o_orderkey").cast("string")).alias(S.INVOICE),
        F.concat(F.substring("p_type", 1, 1), F.col("p_partkey").cast("string")).alias(S.STOCK),
        F.col("p_name").alias(S.DESCRIPTION),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity"))
         .otherwise(F.col("l_quantity")).cast("int").alias(S.QTY),
        F.col("o_orderdate").cast("timestamp_ntz").alias(S.TS),
        exact_price_expr("l_extendedprice", "l_quantity").alias(S.PRICE),
        F.when(F.col("o_custkey") % 50 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("o_custkey")).alias(S.CUST),
        F.col("n_name").alias(S.COUNTRY),
    )


def transactions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as invoice lines with sub-day timestamps (FIXTURES F9).

    One line per purchase event: quantity 1, price = event value, product from
    the event's ``k`` property, no country (exercises the 'Unknown' default).
    """
    ev = _table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props")
    return ev.where(F.col("event_type") == "purchase").select(
        F.col("event_id").cast("string").alias(S.INVOICE),
        F.concat(F.lit("K"), F.get_json_object("props", "$.k")).alias(S.STOCK),
        F.lit(None).cast("string").alias(S.DESCRIPTION),
        F.lit(1).alias(S.QTY),
        F.col("ts").cast("timestamp_ntz").alias(S.TS),
        F.col("value").cast("double").alias(S.PRICE),
        F.col("user_id").cast("bigint").alias(S.CUST),
        F.lit(None).cast("string").alias(S.COUNTRY),
    )
