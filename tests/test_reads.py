"""Inputs that are dear to compute are computed as often as the operators say, however often their rows are used."""
import datetime as dt

import pandas as pd
import pytest

from clvforge.operators.cohorts import cohort_value
from clvforge.operators.rfm import score_rfm_quantile
from clvforge.plans import catalog_value as CV
from clvforge.plans.composite import Bounds, Moments, customer_base, segment_table


def counted(df):
    """``df`` whose rows are counted as they are computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema), seen


def lines(spark, n=120):
    day = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(days=(i * 37) % 300, hours=i % 5)
    pdf = pd.DataFrame([(f"i{i // 2}", f"S{i % 7}", 1 + i % 4, day(i), 1.5 + i % 9, i % 11, "France" if i % 3 else None,
                         (1 + i % 4) * (1.5 + i % 9)) for i in range(n)],
                       columns=["invoice", "stock_code", "quantity", "invoice_ts", "price", "customer_id", "country", "revenue"])
    return spark.createDataFrame(pdf, "invoice string, stock_code string, quantity int, invoice_ts timestamp_ntz, price double, "
                                      "customer_id long, country string, revenue double")


def test_quantile_scores_compute_their_input_once(spark):
    df, seen = counted(spark.range(50).selectExpr("id AS customer_id", "id % 7 AS Recency", "id % 5 AS Frequency", "id * 1.5 AS Monetary"))
    assert len(score_rfm_quantile(df).collect()) == 50 and seen.value == 50


def test_cohort_value_reads_the_lines_once(spark):
    df, seen = counted(lines(spark))
    got = cohort_value(df).collect()
    assert seen.value == 120 and sum(r["revenue"] for r in got) == pytest.approx(lines(spark).toPandas()["revenue"].sum())


def _customers(spark):
    return counted(spark.range(40).selectExpr(
        "id AS customer_id", "id * 10.0 AS bgnbd_gg_clv", "(id % 10) / 10.0 AS prob_alive", "'Loyal' AS segment", "id AS recency",
        "id * 3.0 AS holdout_revenue"))


@pytest.mark.parametrize("query", ["q_at_risk", "q_at_risk_mean", "q_vip", "q_top_share", "q_pct_above", "q_hist_clv", "q_hist_err",
                                   "q_error_summary", "q_clv_seg", "q_pairs"])
def test_queries_score_each_customer_once(spark, monkeypatch, query):
    df, seen = _customers(spark)
    monkeypatch.setattr(CV, "customers", lambda *_: df)
    assert getattr(CV, query)(spark, "").collect() and seen.value == 40


def test_scaling_reads_the_features_once(spark, monkeypatch):
    df, seen = counted(spark.range(60).selectExpr("id AS customer_id", "id AS frequency", "id * 2 AS recency", "id * 1.5 AS total_revenue_obs",
                                                  "id % 5 AS n_unique_products"))
    monkeypatch.setattr(CV, "features", lambda *_: df)
    assert len(CV.q_scale(spark, "").collect()) == 60 and seen.value == 60


def test_customer_base_reads_the_lines_twice(spark):
    df, seen = counted(lines(spark))
    got = customer_base(df).toPandas()
    assert seen.value == 240 and len(got) == 11
    assert Moments(lines(spark)).bounds.__dict__ == Bounds(lines(spark)).__dict__


def test_segments_share_the_bounds_of_the_customers(spark):
    df, seen = counted(lines(spark))
    bounds = Moments(lines(spark)).bounds
    shared, own = segment_table(df, bounds=bounds)[0].toPandas(), segment_table(lines(spark))[0].toPandas()
    assert seen.value == 120 and shared.sort_values("customer_id").values.tolist() == own.sort_values("customer_id").values.tolist()
