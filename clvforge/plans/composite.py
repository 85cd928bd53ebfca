"""Composite plans: the customer value table and the end-to-end run (L1).

The customer table is materialised once in the shared checkpoint folder: it
feeds several downstream plans, and a cut lineage means a lost executor
recomputes one stage, not the whole chain. The lines are not written.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clvforge import schemas as S
from clvforge.operators import clean as C
from clvforge.operators import features as FT
from clvforge.operators import rfm as RF
from clvforge.operators import value as V
from clvforge.session import durable_cut


class Bounds:
    """The ends of the observation and holdout parts as literals, so that they reach the scan.

    One aggregation gives each calendar day's last timestamp (a row a day reaches the driver); only
    where the observation part ends within a day is that day looked at again."""

    def __init__(self, tx_clean: DataFrame, holdout_days: int = 90, gap_days: int = 1):
        day = F.to_date(S.TS)
        last = {r["day"]: r["last"] for r in tx_clean.groupBy(day.alias("day")).agg(F.max(S.TS).alias("last")).collect() if r["last"]}
        self.end = max(last.values(), default=None)
        self.obs_end = self.end - timedelta(days=holdout_days) if last else None
        self.hold_start = self.obs_end + timedelta(days=gap_days) if last else None
        done = [t for t in last.values() if t <= self.obs_end] if last else []
        self.obs_last = max(done, default=None)
        edge = self.obs_end.date() if last else None
        if edge in last and last[edge] > self.obs_end:
            within = tx_clean.where((day == F.lit(edge)) & (F.col(S.TS) <= self.at(self.obs_end))).agg(F.max(S.TS)).first()[0]
            self.obs_last = within or self.obs_last

    @staticmethod
    def at(moment: datetime | None):
        return F.lit(None if moment is None else moment.isoformat(" ")).cast("timestamp_ntz")

    @property
    def observed(self):
        return F.col(S.TS) <= self.at(self.obs_end)

    @property
    def held(self):
        return F.col(S.TS) >= self.at(self.hold_start)


class Moments:
    """The customers' distinct timestamps, written from one pass over the lines, and the bounds found on them."""

    def __init__(self, tx_clean: DataFrame, holdout_days: int = 90):
        self.table = durable_cut(FT.moments(tx_clean))
        self.bounds = Bounds(self.table, holdout_days)


def customer_base(tx_clean: DataFrame, holdout_days: int = 90, seen: Moments | None = None) -> DataFrame:
    """D1, D8, D9 and E4, H1 from two passes over the lines: the customers' timestamps (``seen``), which give the
    bounds and the gaps, and one conditional aggregate for both parts. Written once; the scores are joined on by
    value."""
    seen = seen or Moments(tx_clean, holdout_days)
    b = seen.bounds
    own = lambda c: F.when(b.observed, c)
    lines = tx_clean.where(b.observed | b.held)
    agg = lines.groupBy(S.CUST).agg(
        F.min(own(F.col(S.TS))).alias("_first_ts"), F.max(own(F.col(S.TS))).alias("_last_ts"),
        F.count(own(F.lit(1))).alias("n_transactions"), F.sum(own(F.col(S.REVENUE))).alias("total_revenue_obs"),
        F.avg(own(F.col(S.REVENUE))).alias("avg_revenue_per_txn"),
        F.coalesce(F.stddev_samp(own(F.col(S.REVENUE))), F.lit(0.0)).alias("std_revenue_per_txn"),
        F.sum(own(F.col(S.QTY))).cast("bigint").alias("total_quantity"),
        F.countDistinct(own(F.col(S.STOCK))).alias("n_unique_products"), F.countDistinct(own(F.col(S.INVOICE))).alias("_f"),
        F.coalesce(F.mode(own(F.col(S.COUNTRY)), True), F.lit("Unknown")).alias(S.COUNTRY),
        F.coalesce(F.sum(F.when(b.held, F.col(S.REVENUE))), F.lit(0.0)).alias("holdout_revenue")).where("n_transactions > 0")
    gaps = FT.purchase_gaps(seen.table.where(b.observed), with_months=True, counted=True)
    snapshot = b.at(b.obs_last + timedelta(days=1) if b.obs_last else None)
    cust = FT.feature_columns(agg.join(gaps, S.CUST, "left"), b.at(b.obs_last), [
        "holdout_revenue", F.coalesce(FT.days_between(F.col("_last_ts"), snapshot), F.lit(0)).alias("_r"), "_f",
        F.coalesce(F.col("avg_revenue_per_txn"), F.lit(0.0)).alias("_m")])
    scored = RF.score_rfm(durable_cut(cust), recency="_r", frequency="_f", monetary="_m", written=True)
    return RF.segment_customers(scored).drop("_r", "_f", "_m")


def customer_table(tx_clean: DataFrame, bg: dict | None = None, gg: dict | None = None,
                   fit: bool = False, penalty: float = 0.1, holdout_days: int = 90,
                   seen: Moments | None = None) -> tuple[DataFrame, dict, dict]:
    """Features (D1) with holdout target (C1), RFM scores and segment (D9, E4, H1, C2), probability
    columns and value (I9)."""
    return V.fit_probabilistic(customer_base(tx_clean, holdout_days, seen), bg, gg, penalty, fit)


def segment_table(tx_clean: DataFrame, holdout_days: int = 90, bounds: Bounds | None = None) -> tuple[DataFrame, DataFrame]:
    """RFM with segments on the observation part, and its statistics (D11), from one pass over the lines."""
    b = bounds or Bounds(tx_clean, holdout_days)
    snapshot = b.obs_last + timedelta(days=1) if b.obs_last else None
    rfm = RF.compute_rfm(tx_clean.where(b.observed), snapshot and snapshot.isoformat(" "), with_total=True)
    seg = RF.segment_customers(RF.score_rfm(rfm))
    return seg.drop("TotalRevenue"), RF.segment_stats(seg)


def run_pipeline(tx_raw: DataFrame, out_dir: str | None = None, fit: bool = True,
                 train_model: bool = True, tune_trials: int = 20, fmt: str = "parquet",
                 holdout_days: int = 90) -> dict:
    """L1: B7 → E1 → B8 → D1/C1 → D9, E4, H1, C2, D11 → I9 → J11 → A5–A7.

    Returns the produced tables (and publishes them when ``out_dir`` is given).
    """
    from clvforge.operators import cohorts as CO
    from clvforge.sources import io as IO

    tx_clean = C.clean_transactions(tx_raw, literal_cap=True)
    tx_cohort = CO.cohort_columns(tx_clean)
    seen = Moments(tx_clean, holdout_days)
    cust, bg, gg = customer_table(tx_clean, fit=fit, holdout_days=holdout_days, seen=seen)
    cust = durable_cut(cust)
    seg, stats = segment_table(tx_clean, holdout_days, seen.bounds)
    result = {"customers": cust, "rfm": seg, "segment_stats": stats,
              "transactions": tx_cohort, "bgnbd_params": bg, "gg_params": gg}
    if train_model:
        from clvforge.plans.ml import train_value_model
        trained = train_value_model(cust, tune_trials=tune_trials)
        result.update(trained)
        result["customers"] = trained["scored"]
    if out_dir:
        spark = tx_raw.sparkSession
        tables = {k: result[k] for k in IO.OUTPUT_TABLES if k in result}
        with IO.publication(spark, out_dir) as folder:  # tables, parameters and models appear together
            IO.write_tables(tables, folder, fmt)
            IO.save_params(spark, "bgnbd", {k: v for k, v in bg.items() if k in ("r", "alpha", "a", "b")}, f"{folder}/params_bgnbd")
            IO.save_params(spark, "gamma_gamma", {k: v for k, v in gg.items() if k in ("p", "q", "v")}, f"{folder}/params_gamma_gamma")
            if train_model:
                from clvforge.plans.ml import save_models
                save_models(spark, result["models"], result["best_model"], f"{folder}/models")
                meta = IO.run_metadata(spark, cust.count(), result["feature_names"], result["metrics"], result["best_model"])
                meta.write.mode("overwrite").parquet(f"{folder}/run_metadata")
    result["key"] = S.CUST
    return result
