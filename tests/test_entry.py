"""Driver contract and a few SQL twins on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as E

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def test_entry_runs(spark, sf_small):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "segment" in df.columns and "action" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["segment_customers", "customer_features", "score_probabilistic",
                                  "at_risk", "retention_cohorts", "score_requests", "segment_actions", "invoice_features",
                                  "split_train_validation", "scale_features"])
def test_sql_twin_matches(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    sp = E.queries()[name](spark, sf_small).toPandas()
    dd = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    cols = sorted(sp.columns)

    def norm(pdf):
        out = []
        for rec in pdf[cols].itertuples(index=False):
            out.append(tuple(None if (v is None or v != v) else (round(v, 6) if isinstance(v, float) else v)
                             for v in rec))
        return sorted(out, key=repr)
    assert norm(sp) == norm(dd)


def test_results_do_not_depend_on_session_time_zone(spark, sf_small):
    q = E.queries()["customer_features"]
    utc = sorted(map(tuple, q(spark, sf_small).collect()), key=repr)
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        other = sorted(map(tuple, q(spark, sf_small).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == other
