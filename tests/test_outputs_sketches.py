"""Published sets of tables, merged sketches, shares above many thresholds."""
import os

import pytest
from pyspark.sql import functions as F

from clvforge.operators import features as FT
from clvforge.operators import sketches as SK
from clvforge.operators.value import percent_above
from clvforge.sources.io import current_run, read_customer_outputs, write_outputs


def tables(spark, n):
    row = lambda name: spark.createDataFrame([(f"{name} {n}", "Loyal", float(n))], "id string, segment string, value double")
    return {name: row(name) for name in ("customers", "rfm", "segment_stats", "feature_importance")}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_failed_run_leaves_the_old_set(spark, tmp_path, fmt):
    out = str(tmp_path / "out")
    seen = lambda: {k: [r["id"] for r in v.collect()] for k, v in read_customer_outputs(spark, out, fmt).items()}
    want = lambda n: {k: [f"{k} {n}"] for k in tables(spark, n)}
    assert seen() == {}
    write_outputs(tables(spark, 1), out, fmt)
    assert seen() == want(1)
    broken = tables(spark, 2)
    broken["segment_stats"] = broken["segment_stats"].withColumn("value", F.raise_error(F.lit("a task failed")).cast("double"))
    with pytest.raises(Exception, match="a task failed"):
        write_outputs(broken, out, fmt)  # after two of four tables are written
    assert seen() == want(1) and len(os.listdir(f"{out}/runs")) == 1
    old = read_customer_outputs(spark, out, fmt)
    write_outputs(tables(spark, 3), out, fmt)
    assert seen() == want(3) and [r["id"] for r in old["rfm"].collect()] == ["rfm 1"]  # a reader of the old set goes on
    write_outputs(tables(spark, 4), out, fmt)
    assert seen() == want(4) and len(os.listdir(f"{out}/runs")) == 2 and current_run(spark, out).startswith(f"{out}/runs/")


def test_one_table_only_is_a_set_too(spark, tmp_path):
    out = str(tmp_path / "out")
    write_outputs(tables(spark, 1), out)
    write_outputs({"rfm": tables(spark, 2)["rfm"]}, out)
    assert set(read_customer_outputs(spark, out)) == {"rfm"}  # tables of two runs never mix


def test_merged_sketches_equal_one_pass_within_their_bounds(spark, sf_small):
    from clvforge.plans.catalog import obs, tx
    lines = obs(spark, sf_small)
    months = SK.product_sketches(lines)
    merged = {r[0]: r[1] for r in SK.distinct_products_of(months).collect()}
    once = {r[0]: r[1] for r in lines.groupBy("customer_id").agg(F.hll_sketch_estimate(F.hll_sketch_agg("stock_code", SK.HLL_K))).collect()}
    exact = {r[0]: r[1] for r in FT.distinct_products(lines).collect()}
    approx = {r[0]: r[1] for r in FT.distinct_products(lines, approx=True).collect()}
    assert merged == once and months.count() > len(merged) == len(exact) == len(approx)
    assert all(abs(merged[k] - exact[k]) <= max(0.5, 3 * 1.04 / 64 * exact[k]) for k in exact)
    assert all(abs(approx[k] - exact[k]) <= max(1, 0.2 * exact[k]) for k in exact)
    wide = spark.range(60_000).selectExpr("id % 3 AS customer_id", "CAST(id % 17 AS STRING) AS m", "concat('s', id % 20000) AS stock_code",
                                          "timestamp_ntz'2020-01-01' + make_interval(0, int(id % 17)) AS invoice_ts", "CAST(id * 7919 % 60000 AS DOUBLE) AS price")
    got = {r[0]: r[1] for r in SK.distinct_products_of(SK.product_sketches(wide)).collect()}
    assert all(abs(v - 20000) < 4 * 1.04 / 64 * 20000 for v in got.values()) and len(got) == 3
    for q in (0.5, 0.99):
        cap = SK.price_quantile_of(SK.price_sketches(wide), q).first()[0]
        assert abs(wide.where(F.col("price") <= cap).count() / 60_000 - q) < 0.01
    assert tx(spark, sf_small).count() > 0


def test_price_cap_by_sketch(spark, sf_small):
    from clvforge.operators import clean as C
    from clvforge.plans.catalog import tx
    lines = C.drop_nonpositive(C.drop_cancelled(tx(spark, sf_small)))
    exact, rough = C.trim_price_outliers(lines).count(), C.trim_price_outliers(lines, exact=False).count()
    assert abs(exact - rough) <= 0.002 * lines.count() + 1


def test_percent_above_for_many_thresholds(spark):
    values = [float(v % 97) / 4 for v in range(1000)] + [500.0] * 300
    df = spark.createDataFrame([(v,) for v in [*values, None]], "bgnbd_gg_clv double")
    asked = [-1e9, 0.0, 0.1, 24.0, 24.0, 23.99, 499.0, 500.0, 501.0] + [i / 7 for i in range(200)]
    got = {r["threshold"]: r["pct_above"] for r in percent_above(df, spark.createDataFrame([(t,) for t in [*asked, None]], "threshold double")).collect()}
    assert set(got) == set(asked)
    for t, p in got.items():
        assert p == pytest.approx(100 * sum(v > t for v in values) / len(values)), t
    few = percent_above(df, [24.0, 500.0])
    assert {r[0]: r[1] for r in few.collect()} == {24.0: pytest.approx(100 * 300 / 1300), 500.0: 0.0}
    plan = percent_above(df, spark.createDataFrame([(1.0,)], "threshold double"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
