"""Cleaning rules on hand-made rows (FIXTURES F1 edges)."""
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from clvforge import schemas as S
from clvforge.operators import clean as C


def _tx(spark, rows):
    return spark.createDataFrame(rows, S.TRANSACTION_SCHEMA)


def _rows():
    d = datetime
    return [
        ("12345", "ABC", None, 10, d(2023, 1, 1), 5.0, 1, "UK"),
        ("C12345", "ABC", None, -5, d(2023, 1, 2), 10.0, 2, "UK"),
        ("67890", "DEF", None, 20, d(2023, 1, 3), 3.0, 1, "France"),
        ("11111", "GHI", None, 5, d(2023, 1, 5), 8.0, 3, "UK"),
        (None, "XYZ", None, 1, d(2023, 1, 6), 2.0, 4, "UK"),       # null invoice stays
        ("22222", None, None, 1, d(2023, 1, 6), 2.0, 4, "UK"),     # null stock code stays
        ("33333", "a1", None, 1, d(2023, 1, 7), 2.0, 5, "UK"),     # lower-case a stays
        ("44444", "M9", None, 1, d(2023, 1, 7), 2.0, 5, "UK"),     # M removed
        ("55555", "K1", None, 1, d(2023, 1, 7), 0.0, 5, "UK"),     # price 0 removed
        ("66666", "K2", None, 1, d(2023, 1, 7), 3.0, None, "UK"),  # no customer removed
    ]


def test_null_safe_prefix_filters(spark):
    df = _tx(spark, _rows())
    kept = {r[S.INVOICE] for r in C.drop_cancelled(df).collect()}
    assert None in kept and "C12345" not in kept
    codes = {r[S.STOCK] for r in C.drop_adjustments(df).collect()}
    assert None in codes and "a1" in codes and "M9" not in codes and "ABC" not in codes


def test_clean_order_and_cap(spark):
    df = _tx(spark, _rows())
    out = C.clean_transactions(df).toPandas()
    # cap = p99 over rows passing B1-B2 (pandas linear interpolation)
    pdf = pd.DataFrame(_rows(), columns=[f.name for f in S.TRANSACTION_SCHEMA.fields])
    pdf = pdf[~pdf[S.INVOICE].astype(str).str.startswith("C")]
    pdf = pdf[(pdf[S.QTY] > 0) & (pdf[S.PRICE] > 0)]
    cap = pdf[S.PRICE].quantile(0.99)
    pdf = pdf[pdf[S.PRICE] <= cap]
    pdf = pdf[pdf[S.CUST].notna()]
    pdf = pdf[~pdf[S.STOCK].astype(str).str.match(r"^[AM]", na=False)]
    assert sorted(out[S.INVOICE].astype(str)) == sorted(pdf[S.INVOICE].astype(str))
    assert (out[S.REVENUE] == out[S.QTY] * out[S.PRICE]).all()


def test_clean_materialized_equals_lazy(spark):
    df = _tx(spark, _rows())
    a = sorted(map(tuple, C.clean_transactions(df).collect()), key=repr)
    b = sorted(map(tuple, C.clean_transactions(df, literal_cap=True).collect()), key=repr)
    assert a == b


def test_split_gap_rows_in_neither(spark):
    d = datetime
    rows = [(str(i), "K", None, 1, d(2023, 1, 1) + pd.Timedelta(hours=12 * i).to_pytimedelta(), 1.0, 1, "UK")
            for i in range(0, 400)]
    df = C.add_revenue(_tx(spark, rows))
    obs, hold = C.split_observation_holdout(df, holdout_days=90)
    mx = max(r[4] for r in rows)
    end = mx - pd.Timedelta(days=90).to_pytimedelta()
    start = end + pd.Timedelta(days=1).to_pytimedelta()
    assert obs.count() == sum(r[4] <= end for r in rows)
    assert hold.count() == sum(r[4] >= start for r in rows)
    assert obs.count() + hold.count() < len(rows)


def test_fill_invalid_and_clip(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (-float("inf"),)], "x double")
    out = [r.x for r in C.fill_invalid(df, ["x"]).collect()]
    assert out == [1.0, 0.0, 0.0, 0.0, 0.0]
    c = spark.range(5).select(C.clip(F.col("id").cast("double"), 1.0, 3.0).alias("c"))
    assert [r.c for r in c.collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]
