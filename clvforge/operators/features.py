"""Customer-level aggregates.

All per-customer work is a ``groupBy(customer_id)`` whose partial aggregation
combines rows map-side, so a customer holding a large share of all lines costs
one partial row per map task. The only order-dependent aggregate — gaps between
successive purchases — uses range-partitioned chunks (see ``gap_stats``) rather
than a window partitioned by customer, which would put a hot customer's whole
history into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clvforge import schemas as S
from clvforge.session import durable_cut


def days_between(start: str | Column, end: str | Column) -> Column:
    """Whole days elapsed from ``start`` to ``end`` (floored for end ≥ start,
    like pandas ``Timedelta.days``) — not calendar-date difference."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("DAY", s, e)


def fmt_ts(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def moments(df: DataFrame, key: str = S.CUST, ts: str = S.TS) -> DataFrame:
    """Each key's distinct timestamps with ``_n``, the rows that hold them."""
    return df.groupBy(key, ts).agg(F.count(F.lit(1)).alias("_n"))


def gap_stats(df: DataFrame, key: str = S.CUST, ts: str = S.TS,
              n_chunks: int | None = None, months: bool = False, counted: bool = False) -> DataFrame:
    """Per key: number, sum and max of floored day gaps between successive
    ``ts`` values (sorted by ts), and with ``months`` the number of distinct
    calendar months.

    Rows are first counted per (key, ts) (unless ``df`` holds ``moments`` already, ``counted``), combined map-side: n equal
    timestamps are n − 1 gaps of zero days, and only distinct pairs go on.
    Phase 1 range-partitions these on (key, ts) — a hot key is spread over many
    contiguous chunks — and computes gaps inside each (chunk, key) with a lag
    window, keeping first/last ts per chunk. Phase 2 orders a key's chunks
    (at most ``n_chunks`` rows per key) and adds the gaps across chunk
    boundaries. Sorted by time, months only change forward, so distinct
    months = month starts inside chunks − chunks that continue the previous
    chunk's month; this keeps a second distinct count out of the main
    aggregate (no row expansion there).
    """
    nb = n_chunks or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    r = ((df if counted else moments(df, key, ts)).where(F.col(ts).isNotNull())
           .repartitionByRange(nb, key, ts)
           .withColumn("_chunk", F.spark_partition_id()))
    w1 = Window.partitionBy("_chunk", key).orderBy(ts)
    g = r.withColumn("_gap", days_between(F.lag(ts).over(w1), F.col(ts)))
    aggs = [F.min(ts).alias("_first"), F.max(ts).alias("_last"),
            (F.count("_gap") + F.sum(F.col("_n") - 1)).alias("_ng"), F.sum("_gap").alias("_sg"),
            F.greatest(F.max("_gap"), F.max(F.when(F.col("_n") > 1, 0))).alias("_mg")]
    if months:
        m = F.trunc(ts, "month")
        prev = F.lag(m).over(w1)
        g = g.withColumn("_mstart", F.when(prev.isNull() | (prev != m), 1).otherwise(0))
        aggs.append(F.sum("_mstart").alias("_ms"))
    chunks = g.groupBy("_chunk", key).agg(*aggs)
    w2 = Window.partitionBy(key).orderBy("_chunk")
    prev_last = F.lag("_last").over(w2)
    b = chunks.withColumn("_bg", days_between(prev_last, F.col("_first")))
    out = [(F.sum("_ng") + F.count("_bg")).alias("n_gaps"),
           (F.coalesce(F.sum("_sg"), F.lit(0)) + F.coalesce(F.sum("_bg"), F.lit(0))).alias("sum_gaps"),
           F.greatest(F.max("_mg"), F.max("_bg")).alias("max_gap")]
    if months:
        b = b.withColumn("_mdup", F.when(F.trunc(prev_last, "month") == F.trunc("_first", "month"), 1)
                         .otherwise(0))
        out.append((F.sum("_ms") - F.sum("_mdup")).alias("n_unique_months"))
    return b.groupBy(key).agg(*out)


def purchase_gaps(obs: DataFrame, with_months: bool = False, counted: bool = False) -> DataFrame:
    """Mean and max floored day gap between successive lines; 0 when the
    customer has fewer than two lines (and D7 when ``with_months``)."""
    g = gap_stats(obs, months=with_months, counted=counted)
    return g.select(
        S.CUST,
        F.when(F.col("n_gaps") > 0, F.col("sum_gaps") / F.col("n_gaps"))
         .otherwise(F.lit(0.0)).alias("avg_days_between_purchases"),
        F.when(F.col("n_gaps") > 0, F.col("max_gap").cast("double"))
         .otherwise(F.lit(0.0)).alias("max_purchase_gap"),
        *([F.col("n_unique_months")] if with_months else []))


def _line_aggregates(obs: DataFrame) -> list[Column]:
    return [
        F.min(S.TS).alias("_first_ts"), F.max(S.TS).alias("_last_ts"),
        F.count(F.lit(1)).alias("n_transactions"),
        F.sum(S.REVENUE).alias("total_revenue_obs"),
        F.avg(S.REVENUE).alias("avg_revenue_per_txn"),
        F.coalesce(F.stddev_samp(S.REVENUE), F.lit(0.0)).alias("std_revenue_per_txn"),
        F.sum(S.QTY).cast("bigint").alias("total_quantity"),
        F.countDistinct(S.STOCK).alias("n_unique_products"),
        F.coalesce(F.mode(S.COUNTRY, True), F.lit("Unknown")).alias(S.COUNTRY),
    ]


def customer_features(obs: DataFrame) -> DataFrame:
    """The customer table: one grouped pass (D2–D5) plus one ordered
    pass (D6, D7).

    T counts days from first purchase to the last observation timestamp
    (a scalar subquery); recency ≥ 0 and T ≥ 1 are clamped.
    """
    end = obs.agg(F.max(S.TS)).scalar()
    agg = obs.groupBy(S.CUST).agg(*_line_aggregates(obs))
    gaps = purchase_gaps(obs, with_months=True)
    return feature_columns(agg.join(gaps, S.CUST, "left"), end)


def feature_columns(j: DataFrame, end: Column, more: list | None = None) -> DataFrame:
    """The columns of D1 from a customer's aggregates and gaps; ``end`` is the last observed timestamp."""
    return j.select(
        S.CUST,
        fmt_ts("_first_ts").alias("first_purchase_date"),
        fmt_ts("_last_ts").alias("last_purchase_date"),
        "n_transactions", "total_revenue_obs", "avg_revenue_per_txn",
        "std_revenue_per_txn", "total_quantity", "n_unique_products", S.COUNTRY,
        (F.col("n_transactions") - 1).alias("frequency"),
        F.greatest(days_between("_first_ts", "_last_ts"), F.lit(0)).alias("recency"),
        F.greatest(days_between(F.col("_first_ts"), end), F.lit(1)).alias("T"),
        F.col("avg_revenue_per_txn").alias("monetary_value"),
        F.coalesce("avg_days_between_purchases", F.lit(0.0)).alias("avg_days_between_purchases"),
        F.coalesce("max_purchase_gap", F.lit(0.0)).alias("max_purchase_gap"),
        "n_unique_months", *(more or []))


def purchase_span(obs: DataFrame) -> DataFrame:
    """first/last purchase, line count, frequency, recency, T."""
    end = obs.agg(F.max(S.TS)).scalar()
    a = obs.groupBy(S.CUST).agg(F.min(S.TS).alias("_f"), F.max(S.TS).alias("_l"),
                                F.count(F.lit(1)).alias("n_transactions"))
    return a.select(
        S.CUST, fmt_ts("_f").alias("first_purchase_date"), fmt_ts("_l").alias("last_purchase_date"),
        "n_transactions", (F.col("n_transactions") - 1).alias("frequency"),
        F.greatest(days_between("_f", "_l"), F.lit(0)).alias("recency"),
        F.greatest(days_between(F.col("_f"), end), F.lit(1)).alias("T"))


def spend_stats(obs: DataFrame) -> DataFrame:
    """D3: revenue sum, mean, sample std (0 for one line), total quantity."""
    return obs.groupBy(S.CUST).agg(
        F.sum(S.REVENUE).alias("total_revenue_obs"),
        F.avg(S.REVENUE).alias("avg_revenue_per_txn"),
        F.coalesce(F.stddev_samp(S.REVENUE), F.lit(0.0)).alias("std_revenue_per_txn"),
        F.avg(S.REVENUE).alias("monetary_value"),
        F.sum(S.QTY).cast("bigint").alias("total_quantity"))


def distinct_products(obs: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct stock codes per customer (exact or HyperLogLog++)."""
    agg = (F.approx_count_distinct(S.STOCK) if approx else F.countDistinct(S.STOCK))
    return obs.groupBy(S.CUST).agg(agg.alias("n_unique_products"))


def modal_country(obs: DataFrame) -> DataFrame:
    """Most frequent country, smallest on ties, 'Unknown' when none."""
    return obs.groupBy(S.CUST).agg(
        F.coalesce(F.mode(S.COUNTRY, True), F.lit("Unknown")).alias(S.COUNTRY))


def active_months(obs: DataFrame) -> DataFrame:
    """Distinct calendar months with a purchase."""
    return obs.groupBy(S.CUST).agg(
        F.countDistinct(F.trunc(S.TS, "month")).alias("n_unique_months"))


def holdout_revenue(hold: DataFrame) -> DataFrame:
    """Revenue per customer in the holdout part."""
    return hold.groupBy(S.CUST).agg(F.sum(S.REVENUE).alias("holdout_revenue"))


def attach_holdout(customers: DataFrame, hold_rev: DataFrame) -> DataFrame:
    """Left join the holdout target; customers without one get 0."""
    return (customers.join(hold_rev, S.CUST, "left")
                     .withColumn("holdout_revenue", F.coalesce("holdout_revenue", F.lit(0.0))))


def _snapshot(tx: DataFrame) -> Column:
    """max timestamp + 1 day, as a scalar subquery."""
    return tx.agg(F.max(S.TS) + F.make_dt_interval(F.lit(1))).scalar()


def invoice_summary(tx: DataFrame) -> DataFrame:
    """Invoice-level frequency (distinct invoices − 1), recency (first to
    last), T (first purchase to max + 1 day)."""
    a = tx.groupBy(S.CUST).agg(F.countDistinct(S.INVOICE).alias("_n"),
                               F.min(S.TS).alias("_f"), F.max(S.TS).alias("_l"))
    return a.select(
        S.CUST, (F.col("_n") - 1).alias("frequency"),
        days_between("_f", "_l").alias("recency"),
        days_between(F.col("_f"), _snapshot(tx)).alias("T"))


def spend_summary(tx: DataFrame) -> DataFrame:
    """Distinct invoices − 1 and mean line revenue."""
    return tx.groupBy(S.CUST).agg(
        (F.countDistinct(S.INVOICE) - 1).alias("frequency"),
        F.avg(S.REVENUE).alias("monetary_value"))


def invoice_features(tx: DataFrame) -> DataFrame:
    """Two-level features; gaps follow invoice dates (not invoice ids).

    Two passes over the lines: one for each customer's sums, one that keeps each (customer, invoice,
    stock code, country) once with its first timestamp. Both are written; invoices, gaps and
    distinct counts come from the second, the snapshot from the first. No line is expanded."""
    lines = durable_cut(tx.groupBy(S.CUST).agg(
        F.min(S.TS).alias("_f"), F.max(S.TS).alias("_l"),
        F.avg(S.REVENUE).alias("monetary_value"),
        F.sum(S.REVENUE).alias("total_revenue"),
        F.coalesce(F.stddev_samp(S.REVENUE), F.lit(0.0)).alias("revenue_std")))
    kept = durable_cut(tx.groupBy(S.CUST, S.INVOICE, S.STOCK, S.COUNTRY).agg(F.min(S.TS).alias("_ts")))
    inv = kept.groupBy(S.CUST, S.INVOICE).agg(F.min("_ts").alias("_inv_ts"))
    gaps = gap_stats(inv, S.CUST, "_inv_ts")

    def distinct_count(pairs: DataFrame, col: str, out: str) -> DataFrame:
        return pairs.groupBy(S.CUST).agg(F.count(col).alias(out))

    j = (lines.join(distinct_count(inv, S.INVOICE, "n_invoices"), S.CUST)
              .join(distinct_count(kept.select(S.CUST, S.STOCK).distinct(), S.STOCK, "n_unique_products"), S.CUST)
              .join(distinct_count(kept.select(S.CUST, S.COUNTRY).distinct(), S.COUNTRY, "n_unique_countries"), S.CUST)
              .join(gaps, S.CUST, "left"))
    snapshot = lines.agg(F.max("_l") + F.make_dt_interval(F.lit(1))).scalar()
    return j.select(
        S.CUST, (F.col("n_invoices") - 1).alias("frequency"),
        days_between("_f", "_l").alias("recency"),
        days_between(F.col("_f"), snapshot).alias("T"),
        "monetary_value", "total_revenue", "n_invoices", "n_unique_products",
        "n_unique_countries",
        F.when(F.col("n_gaps") > 0, F.col("max_gap")).otherwise(F.lit(0)).cast("double")
         .alias("max_gap_days"),
        "revenue_std")


def lifetime_days(tx: DataFrame) -> DataFrame:
    """Days from first to last purchase per customer."""
    a = tx.groupBy(S.CUST).agg(F.min(S.TS).alias("_f"), F.max(S.TS).alias("_l"))
    return a.select(S.CUST, days_between("_f", "_l").alias("lifetime_days"))


def acquisition_by_month(tx: DataFrame) -> DataFrame:
    """New customers per first-purchase month."""
    first = tx.groupBy(S.CUST).agg(F.trunc(F.min(S.TS), "month").alias("cohort_month"))
    return (first.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("new_customers"))
                 .orderBy("cohort_month"))
