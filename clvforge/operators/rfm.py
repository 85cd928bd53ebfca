"""Recency-frequency-monetary tables, scores, segments and segment reports
(C2, C3, D9–D13, E4, E5, H1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clvforge import schemas as S
from clvforge.functions.rules import segment_expr
from clvforge.operators.features import days_between
from clvforge.session import durable_cut
from clvforge.operators.ranks import equal_width_score_table, quantile_bin_score, split_points


def compute_rfm(tx: DataFrame, snapshot=None, with_total: bool = False) -> DataFrame:
    """Per customer, days from last purchase to the snapshot (default:
    max timestamp + 1 day), distinct invoices, mean line revenue.
    D10 (``with_total``) adds total revenue."""
    if snapshot is None:
        snap = tx.agg(F.max(S.TS) + F.make_dt_interval(F.lit(1))).scalar()
    else:
        snap = F.lit(snapshot).cast("timestamp_ntz")
    aggs = [F.max(S.TS).alias("_last"),
            F.countDistinct(S.INVOICE).alias("Frequency"),
            F.avg(S.REVENUE).alias("Monetary")]
    if with_total:
        aggs.append(F.sum(S.REVENUE).alias("TotalRevenue"))
    a = tx.groupBy(S.CUST).agg(*aggs)
    cols = [S.CUST,
            F.coalesce(days_between(F.col("_last"), snap), F.lit(0)).alias("Recency"),
            "Frequency",
            F.coalesce(F.col("Monetary"), F.lit(0.0)).alias("Monetary")]
    if with_total:
        cols.append("TotalRevenue")
    return a.select(*cols)


def compute_rfm_total(tx: DataFrame, snapshot=None) -> DataFrame:
    """D9 plus total revenue."""
    return compute_rfm(tx, snapshot, with_total=True)


def score_rfm(rfm: DataFrame, n: int = 5, recency: str = "Recency",
              frequency: str = "Frequency", monetary: str = "Monetary", written: bool = False) -> DataFrame:
    """1..n scores from equal-width bins of the average rank; recency is
    reversed (recent = high). RFM_score = 100R + 10F + M.

    Each score is computed once per *distinct value* (distributed rank table)
    and joined back on the value column. The input is materialised first
    (unless it is ``written`` already): it is read four times, and a recomputed
    float mean could differ in its last bit from the value the rank table was
    built on. A null has no rank and gets the middle score.
    """
    rfm = rfm if written else durable_cut(rfm)
    cuts = split_points(rfm, [recency, frequency, monetary])
    out = rfm
    for col, name, rev in ((recency, "R_score", True), (frequency, "F_score", False),
                           (monetary, "M_score", False)):
        t = equal_width_score_table(rfm, col, n, rev, name, splits=cuts[col])
        out = out.join(t, col, "left").withColumn(name, F.coalesce(name, F.lit((n + 1) // 2)))
    out = out.withColumn(
        "RFM_score", (F.col("R_score") * 100 + F.col("F_score") * 10 + F.col("M_score")).cast("int"))
    return out.select(*rfm.columns, "R_score", "F_score", "M_score", "RFM_score")


def score_rfm_quantile(rfm: DataFrame, n: int = 5, recency: str = "Recency",
                       frequency: str = "Frequency", monetary: str = "Monetary",
                       tiebreak: str = S.CUST) -> DataFrame:
    """E5: equal-count bins of the first-occurrence rank (ties ordered by
    ``tiebreak``); recency reversed. The input is materialised first: it is read four times."""
    rfm = out = durable_cut(rfm)
    for col, name, rev in ((recency, "R_score", True), (frequency, "F_score", False),
                           (monetary, "M_score", False)):
        scored = quantile_bin_score(rfm.select(tiebreak, col), col, tiebreak, n, "_s")
        s = (F.lit(n + 1) - F.col("_s")) if rev else F.col("_s")
        out = out.join(scored.select(tiebreak, s.cast("int").alias(name)), tiebreak, "left")
    out = out.withColumn(
        "RFM_score", (F.col("R_score") * 100 + F.col("F_score") * 10 + F.col("M_score")).cast("int"))
    return out.select(*rfm.columns, "R_score", "F_score", "M_score", "RFM_score")


def segment_customers(rfm: DataFrame) -> DataFrame:
    """H1: rule-based segment from the three scores."""
    return rfm.withColumn("segment", segment_expr())


def customer_revenue(tx: DataFrame) -> DataFrame:
    return tx.groupBy(S.CUST).agg(F.sum(S.REVENUE).alias("total_revenue"))


def attach_customer_revenue(rfm: DataFrame, tx: DataFrame) -> DataFrame:
    """Left join each customer's total revenue."""
    return rfm.join(customer_revenue(tx), S.CUST, "left")


def attach_rfm(customers: DataFrame, rfm: DataFrame) -> DataFrame:
    """Left join scores and segment onto the customer table."""
    return customers.join(
        rfm.select(S.CUST, "R_score", "F_score", "M_score", "RFM_score", "segment"),
        S.CUST, "left")


def segment_stats(rfm: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """Per segment counts, revenue sum and mean, mean scores and raw
    R/F/M, and revenue share in % (2 dp), largest share first. Revenue is that
    of the lines ``tx``, or the column TotalRevenue (D10) of ``rfm``."""
    j = rfm.withColumnRenamed("TotalRevenue", "total_revenue") if tx is None else attach_customer_revenue(rfm, tx)
    g = j.groupBy("segment").agg(
        F.count(S.CUST).alias("customer_count"),
        F.sum("total_revenue").alias("segment_revenue"),
        F.avg("total_revenue").alias("avg_revenue_per_customer"),
        F.avg("R_score").alias("avg_R_score"),
        F.avg("F_score").alias("avg_F_score"),
        F.avg("M_score").alias("avg_M_score"),
        F.avg("Recency").alias("avg_recency"),
        F.avg("Frequency").alias("avg_frequency"),
        F.avg("Monetary").alias("avg_monetary"))
    # a handful of segment rows: a global window over them is bounded
    total = F.sum("segment_revenue").over(_all_rows())
    return (g.withColumn("revenue_share_pct",
                         F.round(F.col("segment_revenue") / total * 100, 2))
             .orderBy(F.desc("revenue_share_pct"), F.asc("segment")))


def _all_rows():
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(1))


def segment_stats_brief(rfm_total: DataFrame) -> DataFrame:
    """The notebook's rounded summary on total revenue."""
    g = rfm_total.groupBy("segment").agg(
        F.count(S.CUST).alias("Count"),
        F.round(F.avg("Recency"), 2).alias("Avg_Recency"),
        F.round(F.avg("Frequency"), 2).alias("Avg_Frequency"),
        F.round(F.avg("Monetary"), 2).alias("Avg_Monetary"),
        F.round(F.sum("TotalRevenue"), 2).alias("Total_Revenue"),
        F.round(F.avg("TotalRevenue"), 2).alias("Avg_Revenue"))
    total = F.sum("Total_Revenue").over(_all_rows())
    return (g.withColumn("Revenue_Share_pct", F.round(F.col("Total_Revenue") / total * 100, 2))
             .orderBy(F.desc("Total_Revenue"), F.asc("segment")))


def rfm_heatmap(rfm: DataFrame, value: str = "Monetary", n: int = 5,
                fill_missing_cells: bool = False) -> DataFrame:
    """Mean ``value`` per (R_score, F_score), long form over the full
    n × n grid. Whole rows/columns without data are 0 (reference fill);
    a missing cell inside a populated row and column stays null unless
    ``fill_missing_cells``."""
    spark = rfm.sparkSession
    cells = rfm.groupBy("R_score", "F_score").agg(F.avg(value).alias("avg_value"))
    grid = spark.range(n * n).select((F.col("id") / n).cast("int").__add__(1).alias("R_score"),
                                      (F.col("id") % n + 1).cast("int").alias("F_score"))
    rows_present = rfm.select("R_score").distinct().withColumn("_r", F.lit(True))
    cols_present = rfm.select("F_score").distinct().withColumn("_f", F.lit(True))
    j = (grid.join(cells, ["R_score", "F_score"], "left")
             .join(F.broadcast(rows_present), "R_score", "left")
             .join(F.broadcast(cols_present), "F_score", "left"))
    outside = F.col("_r").isNull() | F.col("_f").isNull()
    fill = outside | F.lit(bool(fill_missing_cells))
    return j.select("R_score", "F_score",
                    F.when(F.col("avg_value").isNull() & fill, F.lit(0.0))
                     .otherwise(F.col("avg_value")).alias("avg_value"))


def rfm_heatmap_wide(rfm: DataFrame, value: str = "Monetary", n: int = 5) -> DataFrame:
    """D13 wide form: one row per R score, one column per F score."""
    return (rfm.groupBy("R_score").pivot("F_score", list(range(1, n + 1)))
               .agg(F.avg(value)).orderBy(F.desc("R_score")))
