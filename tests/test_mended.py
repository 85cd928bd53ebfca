"""Reads by header name, fits that tell how they ended, closed-form ridge, reusable feature codes, saved models."""
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from clvforge.functions.special import np_hyp2f1
from clvforge.operators.evaluate import regression_metrics
from clvforge.operators.reports import histogram
from clvforge.plans import ml
from clvforge.sources.io import read_customer_outputs, read_transactions

HEADER = "Price,Invoice,Quantity,InvoiceDate,StockCode,Description,Country,Customer ID"


def _csv(tmp_path, *rows):
    (tmp_path / "t.csv").write_text("\n".join([HEADER, *rows]) + "\n", encoding="latin-1")
    return str(tmp_path / "t.csv")


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = _csv(tmp_path, "2.5,10001,3,2020-01-02,S1,caf\xe9,France,17.0", ",10002,1,2020-01-03,,x,,")
    rows = read_transactions(spark, path).orderBy("invoice").collect()
    assert (rows[0]["price"], rows[0]["quantity"], rows[0]["customer_id"], rows[0]["description"]) == (2.5, 3, 17.0, "caf\xe9")
    assert rows[1]["price"] is None and rows[1]["customer_id"] is None and rows[0]["invoice_ts"] == "2020-01-02"


def test_corrupt_csv_rows_raise_or_are_flagged(spark, tmp_path):
    path = _csv(tmp_path, "2.5,1,3,2020-01-02,S1,x,France,17.0", "dear,2,3,2020-01-02,S1,x,France,17.0", "1.0,3")
    with pytest.raises(Exception, match="does not fit"):
        read_transactions(spark, path).collect()
    flags = {r["invoice"]: r["bad_row"] for r in read_transactions(spark, path, bad_rows="flag").collect()}
    assert flags == {"1": False, "2": True, "3": True}
    (tmp_path / "u.csv").write_text("Invoice,Price\n1,2\n")
    with pytest.raises(ValueError, match="no column"):
        read_transactions(spark, str(tmp_path / "u.csv"))


def test_only_absent_tables_are_skipped(spark, tmp_path):
    (tmp_path / "rfm").mkdir()
    (tmp_path / "rfm" / "part-0.parquet").write_bytes(b"not a table")
    assert read_customer_outputs(spark, str(tmp_path), names=("customers",)) == {}
    with pytest.raises(Exception):
        read_customer_outputs(spark, str(tmp_path), names=("customers", "rfm"))


@pytest.mark.parametrize("z", [0.9, 0.999, 0.9999999])
def test_hypergeometric_near_one(z):
    # 2F1(1/2, 1; 3/2; z) = artanh(sqrt z) / sqrt z has c - a - b = 0; with b = 1/2 it is arcsin.
    got = np_hyp2f1(0.5, 0.5, 1.5, z)[0]
    assert got == pytest.approx(math.asin(math.sqrt(z)) / math.sqrt(z), rel=1e-12)


def test_hypergeometric_does_not_return_unfinished_sums():
    with pytest.raises(ArithmeticError):
        np_hyp2f1(1.0, 1.0, 2.0, 0.9999999, max_terms=1000)
    assert np_hyp2f1(1.0, 1.0, 2.0, 0.5)[0] == pytest.approx(2 * math.log(2))


@pytest.mark.parametrize("scale", [1.0, 250.0])
def test_ridge_equals_the_closed_form(spark, scale):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(200, 2))
    y = scale * (x @ [3.0, -1.2] + draw.normal(size=200) + 5)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", ml.TARGET])
    got = ml.fit_ridge(df, alpha=50.0).coefficients.toArray()
    xc, yc = x - x.mean(0), y - y.mean()
    assert got == pytest.approx(np.linalg.solve(xc.T @ xc + 50 * np.eye(2), xc.T @ yc), rel=1e-6)


def test_histogram_counts_all_rows_in_all_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 9, 100]] + [(None,)], "x double")
    rows = histogram(df, "x", 10, axis_quantile=0.5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [4, 0, 0, 0, 0, 0, 0, 0, 0, 1] and {r["axis_limit"] for r in rows} == {1.0}


def test_r2_in_one_pass(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.0), (4.0, 4.5)], "a double, p double")
    assert regression_metrics(df, "a", "p").first()["r2"] == pytest.approx(1 - 1.5 / 4.666666666666667)


def test_codes_do_not_change_on_a_subset(spark, sf_small):
    from clvforge.plans.catalog import clean
    from clvforge.plans.composite import customer_table
    cust = customer_table(clean(spark, sf_small))[0].cache()
    p = ml.FeaturePreparer().fit(cust)
    whole = {r[0]: r[1] for r in p.transform(cust).select("customer_id", ml.COUNTRY_CODE).collect()}
    some = cust.where("customer_id % 3 = 0")
    part = {r[0]: r[1] for r in p.transform(some).select("customer_id", ml.COUNTRY_CODE).collect()}
    assert part and all(whole[k] == v for k, v in part.items())


def test_alive_grid_has_all_cells(spark):
    from clvforge.functions import probability as P
    from clvforge.operators.value import alive_grid_full
    rows = alive_grid_full(spark).collect()
    assert len(rows) == 50 * 73 and {r["recency"] for r in rows} == set(range(0, 365, 5))
    p = P.PUBLISHED_BGNBD
    for r in rows[::97]:
        x, t = r["frequency"], r["recency"]
        want = 0.0 if not x else 1 / (1 + p["a"] / (p["b"] + x - 1) * ((p["alpha"] + t + 1) / (p["alpha"] + t)) ** (p["r"] + x))
        assert r["prob_alive"] == pytest.approx(want, rel=1e-9)


def test_tables_are_released(spark):
    import os
    from clvforge.session import _TABLES, durable_cut, release_tables, table_mark
    mark = table_mark()
    durable_cut(spark.range(3))
    path = _TABLES[-1].removeprefix("file:")
    assert os.path.isdir(path)
    release_tables(spark, mark)
    assert not os.path.exists(path) and table_mark() == mark


def test_a_hot_day_is_one_pair_and_no_line_is_expanded(spark):
    from datetime import datetime
    from clvforge.operators.features import gap_stats, invoice_features
    rows = [(1, datetime(2020, 1, 1))] * 500 + [(1, datetime(2020, 1, 11)), (2, datetime(2020, 1, 1))]
    df = spark.createDataFrame(rows, "customer_id long, invoice_ts timestamp_ntz")
    got = {r["customer_id"]: (r["n_gaps"], r["sum_gaps"], r["max_gap"]) for r in gap_stats(df).collect()}
    assert got[1] == (500, 10, 10) and got[2][0] == 0
    tx = spark.createDataFrame([(1, "i", "s", 2.0, datetime(2020, 1, 1), "c")],
                               "customer_id long, invoice string, stock_code string, revenue double, invoice_ts timestamp_ntz, country string")
    assert "Expand" not in invoice_features(tx)._jdf.queryExecution().toString()
