"""Dashboard and report aggregates over the customer and segment tables
(D18, D19, D21, D23–D25, L2–L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clvforge import schemas as S
from clvforge.functions import rules as R
from clvforge.operators.ranks import exact_quantiles_by, quantile_row


def portfolio_stats(customers: DataFrame, clv: str = "bgnbd_gg_clv") -> DataFrame:
    """Customers, mean value, total revenue, and the at-risk count
    (P(alive) < .5 and value above the median of all customers)."""
    med = quantile_row(customers, clv, 0.5, "_m").scalar()
    return customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.avg(clv).alias("avg_clv"),
        F.sum("total_revenue_obs").alias("total_revenue"),
        F.count_if((F.col("prob_alive") < 0.5) & (F.col(clv) > med)).alias("at_risk"))


# The segments whose revenue counts as at risk.
AT_RISK_SEGMENTS = ["At Risk", "Hibernating", "Lost"]


def revenue_at_risk(stats: DataFrame) -> DataFrame:
    """Revenue and share held by the At Risk, Hibernating, Lost segments."""
    risky = F.when(F.col("segment").isin(AT_RISK_SEGMENTS), F.col("segment_revenue")).otherwise(0.0)
    return stats.agg(F.sum(risky).alias("at_risk_revenue"),
                     F.sum("segment_revenue").alias("total_revenue"),
                     (F.sum(risky) / F.sum("segment_revenue") * 100).alias("risk_pct"))


def histogram(df: DataFrame, col: str, bins: int = 50, axis_quantile: float | None = None) -> DataFrame:
    """Fixed-width histogram over [min, max] (last bin closed) of all
    rows, one row per bin, empty bins included. ``axis_quantile`` adds the
    quantile at which a plot would end its axis; it drops no row. Bounds are
    scalar subqueries; the counting is one grouped aggregate over ``bins`` keys."""
    d = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    b = d.agg(F.struct(F.min("_x").alias("mn"), F.max("_x").alias("mx"))).scalar()
    mn, mx = b.getField("mn"), b.getField("mx")
    width = F.when(mx > mn, mx - mn).otherwise(F.lit(1.0))
    idx = F.least(F.floor((F.col("_x") - mn) * bins / width).cast("bigint"), F.lit(bins - 1))
    g = d.withColumn("bin", idx).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    full = every.join(g, "bin", "left")
    out = full.select("bin", F.coalesce("count", F.lit(0)).alias("count"),
                      (mn + (mx - mn) * F.col("bin") / bins).alias("bin_lo"),
                      (mn + (mx - mn) * (F.col("bin") + 1) / bins).alias("bin_hi"))
    if axis_quantile is not None:
        out = out.withColumn("axis_limit", quantile_row(d, "_x", axis_quantile, "_axis").scalar())
    return out


def error_summary(customers: DataFrame, actual: str = "holdout_revenue",
                  predicted: str = "bgnbd_gg_clv") -> DataFrame:
    """Mean, median and sample std of predicted − actual where actual > 0."""
    e = customers.where(F.col(actual) > 0).select((F.col(predicted) - F.col(actual)).alias("_e"))
    med = quantile_row(e, "_e", 0.5, "_m").scalar()
    return e.agg(F.avg("_e").alias("mean_error"), F.max(med).alias("median_error"),
                 F.stddev_samp("_e").alias("std_error"), F.count(F.lit(1)).alias("n"))


def value_summary(customers: DataFrame, clv: str = "bgnbd_gg_clv", cac: float = 50.0) -> DataFrame:
    """Mean value, total potential, value : acquisition-cost ratio,
    margin per customer and the verdict (≥ 3 healthy, ≥ 1 acceptable)."""
    a = customers.agg(F.avg(clv).alias("avg_clv"), F.count(F.lit(1)).alias("total_customers"))
    ratio = F.col("avg_clv") / cac
    return a.select(
        "avg_clv", "total_customers",
        (F.col("avg_clv") * F.col("total_customers")).alias("total_clv_potential"),
        F.lit(float(cac)).alias("cac"), ratio.alias("clv_cac_ratio"),
        (F.col("avg_clv") - cac).alias("margin_per_customer"),
        F.when(ratio >= 3, "healthy").when(ratio >= 1, "acceptable").otherwise("below break-even")
         .alias("verdict"))


def clv_by_segment_summary(customers: DataFrame, clv: str = "bgnbd_gg_clv") -> DataFrame:
    """Quartiles, mean, min, max of value per segment (exact quartiles
    from the grouped distributed rank table)."""
    base = customers.select("segment", clv)
    q = exact_quantiles_by(base, ["segment"], clv, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    a = base.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg(clv).alias("mean"),
                                    F.min(clv).alias("min"), F.max(clv).alias("max"))
    return a.join(q, "segment", "left").select("segment", "n", "q1", "median", "q3", "mean", "min", "max")


def segment_summary(stats: DataFrame) -> DataFrame:
    """L2: segment, count, share, mean revenue, priority and action."""
    a = R.attach_actions(stats)
    return a.select("segment", "customer_count", F.round("revenue_share_pct", 2).alias("revenue_share_pct"),
                    (F.round(F.col("avg_revenue_per_customer") * 100) / 100).alias("avg_clv"),
                    "priority", F.col("action").alias("recommended_action"))


def budget_summary(rfm_total: DataFrame) -> DataFrame:
    """L4: revenue share, budget share (as listed, and normalised to 100 %)
    and action per segment."""
    g = rfm_total.groupBy("segment").agg(F.count(S.CUST).alias("customer_count"),
                                         F.sum("TotalRevenue").alias("total_revenue"))
    a = R.attach_actions(g)
    all_rows = Window.partitionBy(F.lit(1))  # one row per segment: bounded
    return a.select(
        "segment", "customer_count",
        F.round(F.col("total_revenue") / F.sum("total_revenue").over(all_rows) * 100, 2)
         .alias("revenue_share_pct"),
        "budget_pct",
        (F.col("budget_pct") * 100.0 / F.sum("budget_pct").over(all_rows)).alias("budget_pct_normalised"),
        F.col("action").alias("recommended_action"), "priority")


def rfm_for_histories(hist: DataFrame, n: int = 5) -> DataFrame:
    """L3: histories of a batch of customers → recency (days before the
    batch's last entry + 1 day), purchase count, mean amount → scores →
    segment → action (the per-request endpoint cannot score one row).

    ``status`` is null, or says that a customer has no entry in any history:
    the endpoint answers such a request with an error, here it is a row
    without scores."""
    from clvforge.operators.rfm import score_rfm, segment_customers
    from clvforge.sources.histories import explode_histories
    rows = explode_histories(hist)
    snap = rows.agg(F.max(S.TS) + F.make_dt_interval(F.lit(1))).scalar()
    a = rows.groupBy(S.CUST).agg(F.max(S.TS).alias("_l"), F.count(F.lit(1)).alias("Frequency"),
                                 F.avg(S.REVENUE).alias("Monetary"))
    rfm = a.select(S.CUST, F.timestamp_diff("DAY", F.col("_l"), snap).alias("Recency"),
                   "Frequency", "Monetary")
    seg = segment_customers(score_rfm(rfm, n))
    done = R.attach_actions(seg).select(
        S.CUST, "Recency", "Frequency", "Monetary", F.col("R_score").alias("r_score"),
        F.col("F_score").alias("f_score"), F.col("M_score").alias("m_score"),
        F.col("RFM_score").alias("rfm_score"), "segment", "priority",
        F.col("action").alias("recommended_action"), F.lit(None).cast("string").alias("status"))
    empty = (hist.groupBy(S.CUST).agg(F.sum(F.greatest(F.size("transactions"), F.lit(0))).alias("_n"))
             .where("_n = 0 OR _n IS NULL").select(S.CUST, F.lit(NO_TRANSACTIONS).alias("status")))
    return done.unionByName(empty, allowMissingColumns=True)


#: Fixed value: what the endpoint says of a history without entries.
NO_TRANSACTIONS = "No valid transactions provided"
