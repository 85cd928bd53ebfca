"""Distributed ranks and quantiles against pandas."""
import numpy as np
import pandas as pd

from clvforge.operators import ranks as RK


def _frame(spark, values):
    pdf = pd.DataFrame({"customer_id": np.arange(len(values)), "v": values})
    return spark.createDataFrame(pdf), pdf


def test_average_rank_matches_pandas(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 30, 500).astype(float)
    df, pdf = _frame(spark, vals)
    got = RK.average_rank(df, "v", "r", n_buckets=7).toPandas().sort_values("customer_id")
    exp = pdf["v"].rank(method="average").to_numpy()
    assert np.allclose(got["r"].to_numpy(), exp)


def test_equal_width_score_matches_pd_cut(spark):
    rng = np.random.default_rng(2)
    for n_rows in (7, 12, 50, 333):
        vals = np.round(rng.gamma(2.0, 10.0, n_rows), 1)
        df, pdf = _frame(spark, vals)
        got = RK.equal_width_score(df, "v", 5, out="s", n_buckets=5).toPandas().sort_values("customer_id")
        exp = pd.cut(pdf["v"].rank(method="average"), bins=5, labels=[1, 2, 3, 4, 5]).astype(int)
        assert (got["s"].to_numpy() == exp.to_numpy()).all(), n_rows


def test_constant_column_gets_middle_bin(spark):
    df, _ = _frame(spark, np.full(20, 4.0))
    got = RK.equal_width_score(df, "v", 5, out="s").toPandas()
    assert set(got["s"]) == {3}


def test_quantile_bins_match_qcut(spark):
    rng = np.random.default_rng(3)
    for n_rows in (12, 100, 257):
        vals = rng.integers(0, 10, n_rows).astype(float)
        df, pdf = _frame(spark, vals)
        got = RK.quantile_bin_score(df, "v", "customer_id", 5, "s").toPandas().sort_values("customer_id")
        exp = pd.qcut(pdf["v"].rank(method="first"), q=5, labels=[1, 2, 3, 4, 5]).astype(int)
        assert (got["s"].to_numpy() == exp.to_numpy()).all(), n_rows


def test_exact_quantile_matches_numpy(spark):
    rng = np.random.default_rng(4)
    vals = np.round(rng.lognormal(3, 1, 1001), 2)
    df, _ = _frame(spark, vals)
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        got = RK.exact_quantile(df, "v", q).first()["q"]
        assert abs(got - np.quantile(vals, q)) < 1e-9


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "v": rng.normal(size=300)})
    df = spark.createDataFrame(pdf)
    got = RK.exact_quantiles_by(df, ["g"], "v", [0.25, 0.5, 0.75], ["a", "b", "c"]).toPandas()
    for _, row in got.iterrows():
        vs = pdf.loc[pdf.g == row.g, "v"]
        assert np.allclose([row.a, row.b, row.c], vs.quantile([0.25, 0.5, 0.75]).to_numpy())


def test_rank_table_plan_has_no_single_partition_exchange(spark):
    df, _ = _frame(spark, np.arange(100, dtype=float))
    t = RK.value_rank_table(df, "v", n_buckets=4)
    plan = t._jdf.queryExecution().executedPlan().toString()
    # the only unpartitioned window runs over the per-bucket totals (n_buckets rows)
    assert plan.count("SinglePartition") <= 1


def test_hot_value_holding_a_third_of_rows(spark):
    rng = np.random.default_rng(9)
    vals = rng.normal(size=900)
    vals[:300] = 0.25  # one value holds a third of all rows
    rng.shuffle(vals)
    df, pdf = _frame(spark, vals)
    got = RK.average_rank(df, "v", "r", n_buckets=8).toPandas().sort_values("customer_id")
    assert np.allclose(got["r"].to_numpy(), pdf["v"].rank(method="average").to_numpy())
    rn = RK.global_row_number(df, ["v", "customer_id"], "rn", n_partitions=8).toPandas()
    exp = pdf.sort_values(["v", "customer_id"]).reset_index(drop=True)
    exp["rn"] = np.arange(1, len(exp) + 1)
    m = rn.merge(exp[["customer_id", "rn"]], on="customer_id", suffixes=("", "_exp"))
    assert (m["rn"] == m["rn_exp"]).all()
    q = RK.exact_quantile(df, "v", 0.5).first()["q"]
    assert abs(q - np.quantile(vals, 0.5)) < 1e-12
