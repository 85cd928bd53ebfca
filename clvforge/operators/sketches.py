"""Mergeable sketches kept by month, merged instead of counted again (options of B4 and D4).

Distinct counts use HyperLogLog sketches, price quantiles KLL sketches; both are Spark's own
aggregates, combined on the map side and merged without the lines they came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clvforge import schemas as S

#: Relative standard error of a distinct count with 2^k registers is about 1.04 / sqrt(2^k).
HLL_K = 12
#: Rank error of a KLL sketch of this size is below 1 % with 99 % confidence.
KLL_K = 800


def product_sketches(lines: DataFrame, k: int = HLL_K) -> DataFrame:
    """(customer_id, month, products): a sketch of the stock codes of each customer and month."""
    return lines.groupBy(S.CUST, F.trunc(S.TS, "month").alias("month")).agg(F.hll_sketch_agg(S.STOCK, k).alias("products"))


def distinct_products_of(sketches: DataFrame, out: str = "n_unique_products") -> DataFrame:
    """D4 by merging: distinct stock codes of each customer over all months of the sketches."""
    return sketches.groupBy(S.CUST).agg(F.hll_sketch_estimate(F.hll_union_agg("products")).alias(out))


def price_sketches(lines: DataFrame, k: int = KLL_K) -> DataFrame:
    """(month, prices): a sketch of each month's line prices."""
    return lines.groupBy(F.trunc(S.TS, "month").alias("month")).agg(
        F.kll_sketch_agg_double(F.col(S.PRICE).cast("double"), F.lit(k)).alias("prices"))


def price_quantile_of(sketches: DataFrame, q: float = 0.99, out: str = "price_cap") -> DataFrame:
    """B4's cap by merging: one row with the price at rank ``q`` over all months of the sketches."""
    merged = sketches.agg(F.kll_merge_agg_double("prices").alias("all"))
    return merged.select(F.kll_sketch_get_quantile_double("all", F.lit(float(q))).alias(out))
