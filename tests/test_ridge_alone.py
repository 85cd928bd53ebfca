"""The ridge query trains the ridge only."""
import pytest

from clvforge.plans import catalog_value as Q
from clvforge.plans import ml


def test_ridge_query_fits_no_booster_and_gives_the_training_runs_coefficients(spark, monkeypatch):
    cols = [c for c in ml.BASE_FEATURES + ml.MODEL_FEATURES]
    rows = [(i, "A" if i % 3 else "B", float(i % 5 and (i * 37 % 101) + 0.5), *[float((i * (7 + 2 * k) + k) % (13 + 3 * k)) for k in range(len(cols))])
            for i in range(1, 400)]
    cust = spark.createDataFrame(rows, "customer_id long, country string, holdout_revenue double, " + ", ".join(f"{c} double" for c in cols)).cache()
    small = ml.BoostParams(trees=2, depth=2)
    whole = ml.train_value_model(cust, tune_trials=0, params=small, alt=small)
    monkeypatch.setattr(Q, "customers", lambda *a: cust)

    def no_booster(*a, **b):
        raise AssertionError("a booster was trained")

    monkeypatch.setattr(ml, "TrainingSet", no_booster)
    got = {r["feature"]: r["coefficient"] for r in Q.q_ridge(spark, "any").collect()}
    assert list(got) == whole["feature_names"]
    assert list(got.values()) == pytest.approx(whole["models"]["ridge"].coefficients.toArray().tolist(), rel=1e-9, abs=1e-9)
