"""Cohort columns and cohort retention/value tables.

Work is pre-aggregated to (customer, month) before any per-customer join:
a customer has at most one row per active month there, so even a customer
with a third of all lines contributes a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clvforge import schemas as S
from clvforge.session import durable_cut


def month_index(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.year(c) * 12 + F.month(c)


def _customer_months(tx: DataFrame, with_revenue: bool = False) -> DataFrame:
    m = F.trunc(S.TS, "month").alias("invoice_month")
    if with_revenue:
        return tx.groupBy(S.CUST, m).agg(F.sum(S.REVENUE).alias("revenue"))
    return tx.select(S.CUST, m).distinct()


def _first_month(cm: DataFrame) -> DataFrame:
    return cm.groupBy(S.CUST).agg(F.min("invoice_month").alias("cohort_month"))


def cohort_columns(tx: DataFrame) -> DataFrame:
    """cohort_month (first purchase month), invoice_month and
    cohort_index (months since the cohort month) on every line.

    First months come from a per-customer aggregate joined back on the key
    (AQE: broadcast when small at runtime, skew-split when a key is hot)."""
    first = tx.groupBy(S.CUST).agg(F.trunc(F.min(S.TS), "month").alias("cohort_month"))
    j = tx.join(first, S.CUST, "left")
    inv_m = F.trunc(S.TS, "month")
    return (j.withColumn("invoice_month", inv_m)
             .withColumn("cohort_index", (month_index(inv_m) - month_index("cohort_month")).cast("int")))


def retention_counts(tx: DataFrame) -> DataFrame:
    """Distinct customers per (cohort_month, cohort_index)."""
    cm = _customer_months(tx)
    j = cm.join(_first_month(cm), S.CUST)
    idx = (month_index("invoice_month") - month_index("cohort_month")).cast("int")
    return (j.groupBy("cohort_month", idx.alias("cohort_index"))
             .agg(F.count(F.lit(1)).alias("n_customers")))


def retention_cohorts(tx: DataFrame, max_cohorts: int | None = None,
                      max_index: int | None = None, wide: bool = False) -> DataFrame:
    """G1: retention % = customers active at index k / cohort size (index 0)
    × 100. Long form (cohort_month, cohort_index, n_customers, cohort_size,
    retention_pct); absent cells are absent (null in the wide form).
    ``max_cohorts``/``max_index`` crop to the first cohorts / months."""
    counts = retention_counts(tx)
    sizes = (counts.where(F.col("cohort_index") == 0)
                   .select("cohort_month", F.col("n_customers").alias("cohort_size")))
    r = (counts.join(sizes, "cohort_month", "left")
               .withColumn("retention_pct", F.col("n_customers") / F.col("cohort_size") * 100))
    if max_cohorts is not None:
        first = (counts.select("cohort_month").distinct()
                       .orderBy("cohort_month").limit(max_cohorts))
        r = r.join(F.broadcast(first), "cohort_month", "left_semi")
    if max_index is not None:
        r = r.where(F.col("cohort_index") < max_index)
    if wide:
        n_idx = max_index if max_index is not None else None
        piv = (list(range(n_idx)) if n_idx is not None else None)
        return (r.groupBy("cohort_month").pivot("cohort_index", piv)
                 .agg(F.first("retention_pct")).orderBy("cohort_month"))
    return r


def cohort_value(tx: DataFrame, customers: DataFrame | None = None,
                 clv_col: str = "clv") -> DataFrame:
    """Revenue per (cohort_month, cohort_index) with the cohort size and,
    when a customer table is given, the cohort's mean predicted value.
    The customer-months are materialised: they are read for the months and for the cohorts."""
    cm = durable_cut(_customer_months(tx, with_revenue=True))
    first = _first_month(cm)
    j = cm.join(first, S.CUST)
    idx = (month_index("invoice_month") - month_index("cohort_month")).cast("int")
    rev = (j.groupBy("cohort_month", idx.alias("cohort_index"))
            .agg(F.sum("revenue").alias("revenue"),
                 F.count(F.lit(1)).alias("active_customers")))
    size = first.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
    out = rev.join(size, "cohort_month", "left")
    if customers is not None:
        v = (first.join(customers.select(S.CUST, clv_col), S.CUST)
                  .groupBy("cohort_month").agg(F.avg(clv_col).alias("avg_clv")))
        out = out.join(v, "cohort_month", "left")
    return out
