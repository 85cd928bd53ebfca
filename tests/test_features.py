"""Customer features: floored days, skew-safe gaps vs brute force, mode ties."""
from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from clvforge import schemas as S
from clvforge.operators import features as FT


def _lines(spark, rows):
    pdf = pd.DataFrame(rows, columns=[S.CUST, S.TS, S.REVENUE, S.COUNTRY, S.STOCK, S.QTY])
    return spark.createDataFrame(pdf), pdf


def test_days_are_floored_elapsed(spark):
    t0 = datetime(2023, 1, 1, 10, 0)
    rows = [(1, t0, 1.0, "UK", "K1", 1), (1, t0 + timedelta(hours=47), 1.0, "UK", "K1", 1)]
    df, _ = _lines(spark, rows)
    r = FT.customer_features(df).first()
    assert r["recency"] == 1  # 47 h is one whole day (calendar difference would say 2)
    assert r["max_purchase_gap"] == 1.0


def test_gap_stats_match_brute_force_with_tiny_chunks(spark):
    rng = np.random.default_rng(7)
    rows = []
    base = datetime(2022, 1, 1)
    for c in range(6):
        n = 300 if c == 0 else int(rng.integers(1, 20))  # customer 0 is hot
        for _ in range(n):
            rows.append((c, base + timedelta(hours=float(rng.uniform(0, 24 * 400))), 1.0, "UK", "K", 1))
    df, pdf = _lines(spark, rows)
    got = FT.gap_stats(df, n_chunks=16, months=True).toPandas().set_index(S.CUST).sort_index()
    for c, g in pdf.groupby(S.CUST):
        gaps = g[S.TS].sort_values().diff().dt.days.dropna()
        row = got.loc[c]
        assert row["n_gaps"] == len(gaps)
        assert row["n_unique_months"] == g[S.TS].dt.to_period("M").nunique()
        if len(gaps):
            assert row["sum_gaps"] == gaps.sum()
            assert row["max_gap"] == gaps.max()


def test_customer_features_match_pandas(spark):
    rng = np.random.default_rng(8)
    base = datetime(2023, 1, 1)
    rows = [(int(rng.integers(0, 15)), base + timedelta(days=int(rng.integers(0, 200))),
             float(rng.integers(1, 100)), ["UK", "France", None][int(rng.integers(0, 3))],
             f"K{int(rng.integers(0, 5))}", int(rng.integers(1, 5))) for _ in range(300)]
    df, pdf = _lines(spark, rows)
    got = FT.customer_features(df).toPandas().set_index(S.CUST).sort_index()
    mx = pdf[S.TS].max()
    for c, g in pdf.groupby(S.CUST):
        r = got.loc[c]
        assert r["n_transactions"] == len(g)
        assert np.isclose(r["total_revenue_obs"], g[S.REVENUE].sum())
        std = g[S.REVENUE].std()
        assert np.isclose(r["std_revenue_per_txn"], 0.0 if np.isnan(std) else std)
        assert r["frequency"] == len(g) - 1
        assert r["recency"] == max((g[S.TS].max() - g[S.TS].min()).days, 0)
        assert r["T"] == max((mx - g[S.TS].min()).days, 1)
        modes = g[S.COUNTRY].mode()
        assert r[S.COUNTRY] == (modes.iloc[0] if len(modes) else "Unknown")
        assert r["n_unique_products"] == g[S.STOCK].nunique()
        assert r["n_unique_months"] == g[S.TS].dt.to_period("M").nunique()
        gaps = g[S.TS].sort_values().diff().dt.days.dropna()
        assert np.isclose(r["avg_days_between_purchases"], gaps.mean() if len(gaps) else 0.0)
