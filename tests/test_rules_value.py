"""Rule chains and request scoring (FIXTURES F2, F4)."""
import pandas as pd
from pyspark.sql import functions as F

from clvforge.functions import rules as R
from clvforge.operators import rfm as RF
from clvforge.operators import value as V


def test_segment_rules_first_match(spark):
    rows = [(5, 5, 5, "Champions"), (1, 4, 1, "Loyal"), (3, 2, 1, "Potential Loyalists"),
            (4, 1, 1, "New Customers"), (2, 3, 1, "At Risk"), (2, 2, 5, "Hibernating"),
            (1, 1, 1, "Hibernating"), (3, 1, 1, "Needs Attention")]
    df = spark.createDataFrame(rows, "R_score int, F_score int, M_score int, expected string")
    out = df.withColumn("segment", R.segment_expr()).collect()
    assert all(r.segment == r.expected for r in out)


def test_score_and_segment_sample_rfm(spark):
    # FIXTURES F2
    pdf = pd.DataFrame({"customer_id": [1, 2, 3, 4, 5], "Recency": [10, 30, 100, 200, 365],
                        "Frequency": [10, 5, 3, 2, 1], "Monetary": [500.0, 200.0, 100.0, 50.0, 20.0]})
    out = RF.segment_customers(RF.score_rfm(spark.createDataFrame(pdf))).toPandas().sort_values("customer_id")
    exp_r = pd.cut(pdf.Recency.rank(method="average"), bins=5, labels=[5, 4, 3, 2, 1]).astype(int)
    exp_f = pd.cut(pdf.Frequency.rank(method="average"), bins=5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert list(out.R_score) == list(exp_r) and list(out.F_score) == list(exp_f)
    assert out.iloc[0].segment == "Champions"
    assert set(out.segment) <= set(R.SEGMENTS)


def test_score_requests_branches(spark):
    # FIXTURES F4 plus the fallback branches
    rows = [("12345", 5.0, 30.0, 180.0, 150.0, 20, "UK"),
            ("new", 0.0, 0.0, 10.0, 0.0, None, None),
            ("one", 0.0, 0.0, 10.0, 40.0, 1, "UK"),
            ("odd", 3.0, 50.0, 20.0, 80.0, 2, "UK")]
    df = spark.createDataFrame(rows, "customer_id string, frequency double, recency double, T double, "
                                     "monetary_value double, n_unique_products int, country string")
    ok, bad = V.validate_requests(df)
    assert bad.count() == 0
    out = {r.customer_id: r for r in V.score_requests(ok).collect()}
    assert out["new"].expected_purchases_90d == 50.0 and out["new"].prob_alive == 0.8
    assert abs(out["one"].expected_purchases_90d - round(40 * 0.1 * 90 / 365, 2)) < 1e-9
    assert out["odd"].prob_alive == 0.5  # recency > T: fallback
    r = out["12345"]
    assert 0 <= r.prob_alive <= 1 and r.ci_lower <= r.predicted_clv_12m <= r.ci_upper
    assert r.rfm_segment == "Champions"  # recency ≤ 30, frequency ≥ 5, spend ≥ 100


def test_percentile_band_and_actions(spark):
    df = spark.range(100).select(F.col("id").alias("customer_id"), (F.col("id") * 10.0).alias("clv"))
    out = R.clv_percentile_band(df, "clv").groupBy("clv_band").count().toPandas().set_index("clv_band")
    assert out.loc["VIP", "count"] == 10 and out.loc["Low Value", "count"] == 40
    a = spark.createDataFrame([("Champions", 0.9, 10.0), ("Lost", 0.1, 600.0), ("X", 0.5, 0.0)],
                              "segment string, prob_alive double, clv double")
    texts = [r.t for r in a.select(R.recommended_action_expr().alias("t")).collect()]
    assert texts == [R.ACTION_TEXTS["champions"], R.ACTION_TEXTS["lost"], R.ACTION_TEXTS["monitor"]]


def test_validate_requests_rejects_out_of_range(spark):
    rows = [("ok", 1.0, 2.0, 3.0, 4.0, None, None), ("neg", -1.0, 2.0, 3.0, 4.0, 1, "UK"),
            ("zeroT", 1.0, 2.0, 0.0, 4.0, 1, "UK"), ("nullspend", 1.0, 2.0, 3.0, None, 1, "UK")]
    df = spark.createDataFrame(rows, "customer_id string, frequency double, recency double, T double, "
                                     "monetary_value double, n_unique_products int, country string")
    ok, bad = V.validate_requests(df)
    okr = ok.collect()
    assert [r.customer_id for r in okr] == ["ok"]
    assert okr[0].n_unique_products == 0 and okr[0].country == "UK"  # defaults
    assert sorted(r.customer_id for r in bad.collect()) == ["neg", "nullspend", "zeroT"]
