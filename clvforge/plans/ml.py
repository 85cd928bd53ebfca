"""Machine-learned customer value.

Boosted trees of our own (``boosting``), a guided search scored by validation MAE (``tuning``), a
ridge baseline, quantile-boosted prediction intervals, permutation importance and tree attributions.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clvforge import schemas as S
from clvforge.functions.rules import country_bucket
from clvforge.operators.clean import fill_invalid
from clvforge.operators.evaluate import interval_coverage, regression_metrics
from clvforge.operators.ranks import global_row_number, quantile_row
from clvforge.plans.boosting import BoostedModel, BoostParams, TrainingSet
from clvforge.plans.tuning import search

# Feature lists (names as in the customer table).
BASE_FEATURES = ["frequency", "recency", "T", "monetary_value", "total_revenue_obs",
                 "avg_revenue_per_txn", "std_revenue_per_txn", "n_unique_products",
                 "n_unique_months", "avg_days_between_purchases", "max_purchase_gap",
                 "n_transactions"]
MODEL_FEATURES = ["bgnbd_predicted_purchases", "prob_alive", "gamma_gamma_monetary"]
RFM_FEATURES = ["R_score", "F_score", "M_score"]
COUNTRY_CODE = "country_encoded_num"
TARGET = "holdout_revenue"


def feature_names(with_rfm: bool = False) -> list[str]:
    return BASE_FEATURES + MODEL_FEATURES + ([*RFM_FEATURES] if with_rfm else []) + [COUNTRY_CODE]


class FeaturePreparer:
    """J1 (pre-vector part), fitted once and reused.

    ``fit`` learns the country codes: the top-n countries and 'Other', coded in
    alphabetical order (≤ n + 1 rows). ``transform`` gives model columns their
    defaults when absent (0 purchases, P(alive) 1, spend = monetary), joins the
    codes — a country not among them is 'Other' — and sets NaN/null/±inf to 0.
    So a customer's row does not depend on which others are prepared with it.
    """

    def __init__(self, with_rfm: bool = False, top_countries: int = 10, codes: list[str] | None = None):
        self.with_rfm, self.top_countries, self.codes = with_rfm, top_countries, codes

    @property
    def names(self) -> list[str]:
        return feature_names(self.with_rfm)

    def fit(self, customers: DataFrame) -> "FeaturePreparer":
        bucketed = country_bucket(customers, self.top_countries, S.COUNTRY, "country_encoded")
        rows = bucketed.select("country_encoded").distinct().collect()  # ≤ top_countries + 1 rows
        self.codes = sorted(r[0] for r in rows if r[0] is not None)
        return self

    def transform(self, customers: DataFrame) -> DataFrame:
        if self.codes is None:
            raise ValueError("fit the country codes first")
        d = customers
        if "bgnbd_predicted_purchases" not in d.columns:
            d = d.withColumn("bgnbd_predicted_purchases", F.lit(0.0))
        if "prob_alive" not in d.columns:
            d = d.withColumn("prob_alive", F.lit(1.0))
        if "gamma_gamma_monetary" not in d.columns:
            d = d.withColumn("gamma_gamma_monetary", F.col("monetary_value"))
        other = float(self.codes.index("Other")) if "Other" in self.codes else float(len(self.codes))
        known = [F.when(F.col(S.COUNTRY) == c, F.lit(float(i))) for i, c in enumerate(self.codes) if c != "Other"]
        d = d.withColumn(COUNTRY_CODE, F.coalesce(*known, F.lit(other)))
        d = d.select(S.CUST, *[F.col(c).cast("double").alias(c) for c in self.names if c != COUNTRY_CODE],
                     COUNTRY_CODE, *[c for c in (TARGET,) if c in d.columns])
        return fill_invalid(d, self.names)

    def save(self, spark, path: str) -> None:
        """The fitted codes and options as a one-row table."""
        spark.createDataFrame([(self.with_rfm, self.top_countries, self.codes)],
                              "with_rfm boolean, top_countries int, codes array<string>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> "FeaturePreparer":
        r = spark.read.parquet(path).first()
        return FeaturePreparer(r["with_rfm"], r["top_countries"], list(r["codes"]))


def prepare_features(customers: DataFrame, with_rfm: bool = False,
                     top_countries: int = 10) -> tuple[DataFrame, list[str]]:
    """Fit and transform on the same customers."""
    p = FeaturePreparer(with_rfm, top_countries).fit(customers)
    return p.transform(customers), p.names


def assemble(names: list[str]) -> Pipeline:
    """J1 (vector part) + J3: assemble then standardise (sample std)."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)])


def split_hash(col: str = S.CUST, seed: int = 42) -> "F.Column":
    """A number below 2^31 that depends on all of id and seed: two rounds of multiply, add and shift."""
    mask = (1 << 31) - 1
    x = F.pmod(F.col(col).cast("bigint"), F.lit(1 << 31)).bitwiseXOR(F.lit((seed * 2654435761) & mask))
    for shift, factor, add in ((16, 1103515245, 12345), (13, 22695477, 2531011)):
        x = x.bitwiseXOR(F.shiftright(x, shift))
        x = (x * F.lit(factor) + F.lit(add)).bitwiseAND(F.lit(mask))
    return x.bitwiseXOR(F.shiftright(x, 15))


def split_train_validation(df: DataFrame, fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Repeatable split by a hash of the customer id and the seed, independent of partitioning
    and row order; splits by different seeds are unrelated."""
    limit = F.lit(int(round(fraction * (1 << 31))))
    h = split_hash(seed=seed)
    return df.where(h >= limit), df.where(h < limit)


def tune_boosted(train: DataFrame, names: list[str], trials: int = 20, seed: int = 42,
                 parallel: int = 4) -> tuple[BoostParams, list[tuple[dict, float]]]:
    """Guided search for the least MAE on a validation part of ``train``; the best settings and
    all trials. ``parallel`` trials run at once, each knowing the others' settings."""
    fit_rows, valid = split_train_validation(train, 0.2, seed + 1)
    rows = TrainingSet(fit_rows, names, TARGET, S.CUST, valid)
    if not valid.take(1) or not fit_rows.take(1):
        raise ValueError("too few rows to hold some out for the search")
    tried = search(lambda many: rows.errors([BoostParams(seed=seed, **m) for m in many], parallel), trials, parallel, seed)
    best = min(tried, key=lambda t: t[1])[0]
    return BoostParams(seed=seed, **best), tried


#: J5 without a search; J6 grows best-first to 31 leaves.
MAIN = BoostParams(trees=300, depth=6, rate=0.05, rows=0.8, columns=0.8)
ALT = BoostParams(trees=300, depth=6, rate=0.05, leaves=31, min_child=20, l2=0.0)


def fit_boosted(train: DataFrame, names: list[str], params: BoostParams = MAIN) -> BoostedModel:
    """Main boosted regressor, level by level with second-order gains."""
    return TrainingSet(train, names, TARGET, S.CUST).fit([params])[0]


def fit_boosted_alt(train: DataFrame, names: list[str], params: BoostParams = ALT) -> BoostedModel:
    """Second booster, leaf by leaf."""
    return TrainingSet(train, names, TARGET, S.CUST).fit([params])[0]


def fit_ridge(train: DataFrame, alpha: float = 1.0) -> object:
    """Ridge baseline minimising Σ err² + α‖w‖².

    Spark minimises the mean of err² / 2 of the label divided by its
    population standard deviation, with λ/2‖w‖² on that scale divided once more by the
    deviation; so λ = α / n · std(label)."""
    n, std = train.agg(F.count(F.lit(1)), F.stddev_pop(F.col(TARGET).cast("double"))).first()
    return LinearRegression(featuresCol="features", labelCol=TARGET, regParam=alpha / max(n, 1) * (std or 1.0),
                            elasticNetParam=0.0, standardization=False, solver="normal").fit(train)


def training_rows(customers: DataFrame, seed: int = 42, with_rfm: bool = False) -> tuple[FeaturePreparer, DataFrame, DataFrame]:
    """The fitted preparer, and the training and held-out rows of customers with holdout revenue."""
    preparer = FeaturePreparer(with_rfm).fit(customers)
    feats = preparer.transform(customers)
    return preparer, *split_train_validation(feats.where(F.col(TARGET) > 0), 0.2, seed)


def train_ridge(train: DataFrame, names: list[str]) -> tuple[PipelineModel, object]:
    """The fitted scaler and the ridge baseline on its vectors; needs no other model."""
    prep: PipelineModel = assemble(names).fit(train)
    return prep, fit_ridge(prep.transform(train))


class QuantileInterval:
    """An interval between two quantile-boosted models, widened or narrowed by one offset.

    The offset is the level's quantile of how far rows that no model saw lie outside of the two
    (negative inside), so that the share of targets within is right on such rows. It comes from a
    part of the training rows, by the exact distributed quantile."""

    def __init__(self, lower: float = 0.1, upper: float = 0.9, models: tuple | None = None, offset: float = 0.0):
        self.lower, self.upper, self.models, self.offset = lower, upper, models, offset

    def params(self, p: BoostParams) -> list[BoostParams]:
        return [BoostParams(**{**vars(p), "loss": "quantile", "alpha": a, "min_child": max(p.min_child, 5)})
                for a in (self.lower, self.upper)]

    def fit(self, train: DataFrame, names: list[str], params: BoostParams = MAIN, held: float = 0.2) -> "QuantileInterval":
        fit_rows, aside = split_train_validation(train, held, params.seed + 2)
        self.models = tuple(TrainingSet(fit_rows, names, TARGET, S.CUST).fit(self.params(params)))
        seen = self._both(aside)
        out = F.greatest(F.col("pred_lower") - F.col(TARGET), F.col(TARGET) - F.col("pred_upper"))
        row = quantile_row(seen.select(out.alias("_out")), "_out", self.upper - self.lower, "_q").first()
        self.offset = float(row["_q"]) if row and row["_q"] is not None else 0.0
        return self

    def _both(self, df: DataFrame) -> DataFrame:
        return self.models[1].transform(self.models[0].transform(df, "pred_lower"), "pred_upper")

    def transform(self, df: DataFrame) -> DataFrame:
        both = self._both(df)
        return (both.withColumn("pred_lower", F.col("pred_lower") - self.offset)
                    .withColumn("pred_upper", F.col("pred_upper") + self.offset))

    def save(self, spark, path: str) -> None:
        for name, m in zip(("lower", "upper"), self.models):
            m.save(spark, f"{path}/{name}")
        spark.createDataFrame([(self.lower, self.upper, self.offset)],
                              "lower double, upper double, offset double").write.mode("overwrite").parquet(f"{path}/offset")

    @staticmethod
    def load(spark, path: str) -> "QuantileInterval":
        r = spark.read.parquet(f"{path}/offset").first()
        both = tuple(BoostedModel.load(spark, f"{path}/{name}") for name in ("lower", "upper"))
        return QuantileInterval(r["lower"], r["upper"], both, r["offset"])


def fit_interval(train: DataFrame, names: list[str], lower: float = 0.1, upper: float = 0.9,
                 params: BoostParams = MAIN) -> QuantileInterval:
    """The interval between two quantiles of the target."""
    return QuantileInterval(lower, upper).fit(train, names, params)


def predict_interval(model: BoostedModel, interval: QuantileInterval, df: DataFrame) -> DataFrame:
    """Point prediction with lower ≤ prediction ≤ upper."""
    p = interval.transform(model.transform(df))
    return (p.withColumn("pred_lower", F.least("pred_lower", "prediction"))
             .withColumn("pred_upper", F.greatest("pred_upper", "prediction")))


def top_importance(model: BoostedModel, spark, n: int = 15) -> DataFrame:
    """features by their share of the booster's gain, largest first."""
    rows = sorted(model.importance(), key=lambda t: (-t[1], t[0]))[:n]
    return spark.createDataFrame(rows, "feature string, importance double")


def permutation_importance(model: BoostedModel, df: DataFrame, names: list[str],
                           permute: list[str] | None = None, seed: int = 42) -> DataFrame:
    """J10, second view: rise in MAE when one column is randomly permuted. The permutation pairs the
    k-th row in customer order with the k-th row in a random order; both global row numbers are
    distributed (no single-partition sort)."""
    spark = df.sparkSession
    error = lambda d: model.transform(d, "_p").agg(F.avg(F.abs(F.col("_p") - F.col(TARGET)))).first()[0]
    base = error(df)
    columns = permute or names
    left = global_row_number(df, [S.CUST], "_rn")
    right = global_row_number(df.select(*[F.col(c).alias(f"_perm_{c}") for c in columns],
                                        F.xxhash64(F.col(S.CUST), F.lit(seed)).alias("_r"), S.CUST), ["_r", S.CUST], "_rn")
    paired = left.join(right.drop(S.CUST, "_r"), "_rn").drop("_rn").cache()  # one permutation serves all columns
    rows = [(c, float(error(paired.withColumn(c, F.col(f"_perm_{c}"))) - base)) for c in columns]
    paired.unpersist()
    return spark.createDataFrame(sorted(rows, key=lambda t: -t[1]), "feature string, mae_increase double")


def train_value_model(customers: DataFrame, tune_trials: int = 20, seed: int = 42, with_rfm: bool = False,
                      params: BoostParams = MAIN, alt: BoostParams = ALT) -> dict:
    """J1 → customers with holdout revenue → J2 → J4 → J5, J6, J7 (on J3) → J8 → metrics on
    the held-out split (K1, K2, K3) → scored customers.

    ``tune_trials=0`` skips the search and takes ``params``. The best model is the one with the
    least MAE on the held-out split."""
    preparer, train, valid = training_rows(customers, seed, with_rfm)
    names = preparer.names
    train, valid = train.cache(), valid.cache()
    try:
        trials: list[tuple[dict, float]] = []
        if tune_trials:
            params, trials = tune_boosted(train, names, tune_trials, seed)
        with ThreadPoolExecutor(1) as beside:  # the interval's models have rows of their own; neither waits for the other
            later = beside.submit(fit_interval, train, names, params=params)
            main, second = TrainingSet(train, names, TARGET, S.CUST).fit([params, alt])
            prep, ridge = train_ridge(train, names)
            interval = later.result()
        metrics, rows = {}, []
        scored_by = {"boosted": main.transform(valid), "boosted_alt": second.transform(valid), "ridge": ridge.transform(prep.transform(valid))}
        for name, p in scored_by.items():
            r = regression_metrics(p, TARGET, "prediction").collect()[0].asDict()
            metrics[name] = r
            rows.append((name, float(r["mae"] or 0), float(r["rmse"] or 0), float(r["r2"] or 0),
                         float(r["mape"] or 0), int(r["n"])))
        cov = interval_coverage(predict_interval(main, interval, valid), TARGET, "pred_lower", "pred_upper")
        metrics["interval_coverage_80"] = cov.collect()[0]["coverage_pct"]
    finally:
        train.unpersist()
        valid.unpersist()
    spark = customers.sparkSession
    metrics_df = spark.createDataFrame(rows, "model string, mae double, rmse double, r2 double, mape double, n long")
    models = {"boosted": main, "boosted_alt": second, "ridge": ridge, "interval": interval, "prep": prep, "preparer": preparer}
    scored = customers.join(score_customers(models, customers), S.CUST, "left")
    return {"metrics": metrics, "metrics_df": metrics_df, "scored": scored,
            "feature_importance": top_importance(main, spark, len(names)),
            "feature_names": names, "best_model": min(rows, key=lambda r: r[1])[0], "params": params, "trials": trials,
            "models": models, "validation": valid}


def model_predictions(models: dict, prepared: DataFrame) -> DataFrame:
    """Prepared rows with one column a fitted model: boosted, boosted_alt, ridge."""
    out = models["boosted_alt"].transform(models["boosted"].transform(prepared, "boosted"), "boosted_alt")
    return models["ridge"].transform(models["prep"].transform(out)).withColumnRenamed("prediction", "ridge").drop("raw_features", "features")


def score_customers(models: dict, customers: DataFrame) -> DataFrame:
    """Predictions with intervals for any customers, by fitted (or loaded) models."""
    return predict_interval(models["boosted"], models["interval"], models["preparer"].transform(customers)).select(
        S.CUST, F.col("prediction").alias("ml_predicted_clv"), "pred_lower", "pred_upper")


def save_models(spark, models: dict, best_model: str, path: str) -> None:
    """All fitted parts under one folder: the boosters' and the interval's node tables, Spark ML
    writers, the country codes and the name of the best model."""
    for name in ("boosted", "boosted_alt", "interval"):
        models[name].save(spark, f"{path}/{name}")
    for name in ("ridge", "prep"):
        models[name].write().overwrite().save(f"{path}/{name}")
    models["preparer"].save(spark, f"{path}/preparer")
    spark.createDataFrame([(best_model,)], "best_model string").write.mode("overwrite").parquet(f"{path}/best_model")


def load_models(spark, path: str) -> tuple[dict, str]:
    """The parts that ``save_models`` wrote, and the best model's name (Q16)."""
    models = {"boosted": BoostedModel.load(spark, f"{path}/boosted"), "boosted_alt": BoostedModel.load(spark, f"{path}/boosted_alt"),
              "interval": QuantileInterval.load(spark, f"{path}/interval"), "ridge": LinearRegressionModel.load(f"{path}/ridge"),
              "prep": PipelineModel.load(f"{path}/prep"), "preparer": FeaturePreparer.load(spark, f"{path}/preparer")}
    return models, spark.read.parquet(f"{path}/best_model").first()[0]
