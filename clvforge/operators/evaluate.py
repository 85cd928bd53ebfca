"""Model evaluation as single-pass aggregates (K1–K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clvforge import schemas as S


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """K1: MAE, RMSE, R² and MAPE (over actual > 0) in one aggregate; the
    total sum of squares is the population variance times the row count."""
    spread = F.var_pop(F.col(actual).cast("double")) * F.count(F.col(actual))
    err = F.col(actual) - F.col(predicted)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.sum(err * err) / F.when(spread != 0, spread)).alias("r2"),
        (F.avg(F.when(F.col(actual) > 0, F.abs(err / F.col(actual)))) * 100).alias("mape"))


def interval_coverage(df: DataFrame, actual: str, lower: str, upper: str) -> DataFrame:
    """K2: % of actual values inside [lower, upper]."""
    inside = (F.col(actual) >= F.col(lower)) & (F.col(actual) <= F.col(upper))
    return df.agg((F.avg(F.when(inside, 1.0).otherwise(0.0)) * 100).alias("coverage_pct"),
                  F.count(F.lit(1)).alias("n"))


def compare_models(df: DataFrame, actual: str, models: dict[str, str]) -> DataFrame:
    """K3: MAE, RMSE and Pearson r per model, keyed rows (no positional
    alignment): unpivot the prediction columns, then one grouped aggregate."""
    names = list(models)
    pairs = ", ".join(f"'{n}', `{models[n]}`" for n in names)
    long = df.selectExpr(f"`{actual}` AS _a", f"stack({len(names)}, {pairs}) AS (model, _p)")
    err = F.col("_a") - F.col("_p")
    return long.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.corr("_a", "_p").alias("correlation"))


def prediction_pairs(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """K4: actual vs predicted rows where actual > 0, with the shared axis
    maximum (a global max over the filtered rows)."""
    f = df.where(F.col(actual) > 0)
    ax = f.agg(F.max(F.greatest(F.col(actual), F.col(predicted)))).scalar()
    return f.select(S.CUST, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"),
                    ax.alias("axis_max"))


