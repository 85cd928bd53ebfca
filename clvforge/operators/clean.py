"""Row filters and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clvforge import schemas as S
from clvforge.operators.ranks import quantile_row


def _null_safe(pred: Column) -> Column:
    """A predicate on a null value is false (pandas ``astype(str)`` turns a
    null into the text 'nan', which matches no prefix)."""
    return F.coalesce(pred, F.lit(False))


def drop_cancelled(df: DataFrame) -> DataFrame:
    """B1: drop invoices whose number starts with 'C'; null invoices stay."""
    return df.where(~_null_safe(F.col(S.INVOICE).startswith("C")))


def drop_nonpositive(df: DataFrame) -> DataFrame:
    """B2: keep quantity > 0 and price > 0 (nulls fail both)."""
    return df.where((F.col(S.QTY) > 0) & (F.col(S.PRICE) > 0))


def parse_invoice_ts(df: DataFrame, fmt: str | None = None) -> DataFrame:
    """A2: text or zoned timestamps to wall-clock timestamps (TIMESTAMP_NTZ).

    Invoice times are local wall-clock values, as in the source files; with
    no zone attached, day differences and month boundaries never depend on
    the session time zone or daylight-saving shifts."""
    dt = df.schema[S.TS].dataType
    if isinstance(dt, T.StringType):
        c = F.to_timestamp_ntz(S.TS, F.lit(fmt)) if fmt else F.to_timestamp_ntz(S.TS)
    elif isinstance(dt, T.TimestampNTZType):
        return df
    else:
        c = F.col(S.TS).cast("timestamp_ntz")
    return df.withColumn(S.TS, c)


def add_revenue(df: DataFrame) -> DataFrame:
    """revenue = quantity × price."""
    return df.withColumn(S.REVENUE, F.col(S.QTY) * F.col(S.PRICE))


def trim_price_outliers(df: DataFrame, q: float = 0.99, exact: bool = True) -> DataFrame:
    """Keep price ≤ the q-quantile of price over ``df``.

    The threshold is a one-row aggregate (exact: distributed rank table;
    approximate: ``percentile_approx`` sketch) used as an uncorrelated scalar
    subquery: computed once, then a literal in the filter.
    """
    cap = quantile_row(df, S.PRICE, q, "_price_cap", exact).scalar()
    return df.where(F.col(S.PRICE) <= cap)


def drop_missing_customer(df: DataFrame) -> DataFrame:
    """Rows need a customer id; cast it to long."""
    return (df.where(F.col(S.CUST).isNotNull())
              .withColumn(S.CUST, F.col(S.CUST).cast("bigint")))


def drop_adjustments(df: DataFrame) -> DataFrame:
    """Drop stock codes starting with 'A' or 'M' (case-sensitive);
    null codes stay."""
    return df.where(~_null_safe(F.col(S.STOCK).rlike("^[AM]")))


def clean_transactions(df: DataFrame, price_q: float = 0.99, exact: bool = True,
                       ts_format: str | None = None, literal_cap: bool = False) -> DataFrame:
    """B1, B2, A2, B3, B4, B5, B6 in the reference order (the price cap is
    taken over rows that passed B1–B2 only).

    Lazily, the cap is a scalar subquery. With ``literal_cap`` it is found at
    once, from a scan that reads only what the price and the first two rules
    need, and becomes a literal in the filter: later plans push it into the
    scan and still prune columns, since no row is written."""
    base = (df.transform(drop_cancelled)
              .transform(drop_nonpositive)
              .transform(lambda d: parse_invoice_ts(d, ts_format))
              .transform(add_revenue))
    if literal_cap:
        cap = quantile_row(base.select(S.PRICE), S.PRICE, price_q, "_cap", exact).first()["_cap"]
        trimmed = base.where(F.col(S.PRICE) <= F.lit(cap)) if cap is not None else base.limit(0)
    else:
        trimmed = trim_price_outliers(base, price_q, exact)
    return trimmed.transform(drop_missing_customer).transform(drop_adjustments)


def split_observation_holdout(df: DataFrame, holdout_days: int = 90,
                              observation_days: int | None = None,
                              gap_days: int = 1) -> tuple[DataFrame, DataFrame]:
    """observation = ts ≤ max − holdout; holdout = ts ≥ max − holdout + gap.

    ``max`` is a scalar subquery (computed once). Rows inside
    the gap belong to neither part (reference behaviour, kept). With
    ``observation_days`` the observation part also gets a lower bound.
    """
    mx = df.agg(F.max(S.TS)).scalar()
    obs_end = mx - F.make_dt_interval(F.lit(holdout_days))
    hold_start = obs_end + F.make_dt_interval(F.lit(gap_days))
    obs_pred = F.col(S.TS) <= obs_end
    if observation_days is not None:
        obs_pred = obs_pred & (F.col(S.TS) > obs_end - F.make_dt_interval(F.lit(observation_days)))
    return df.where(obs_pred), df.where(F.col(S.TS) >= hold_start)


def split_parts(df: DataFrame, holdout_days: int = 90, gap_days: int = 1) -> DataFrame:
    """B8 as one DataFrame: a ``part`` column ('observation' / 'holdout');
    rows in the gap are dropped."""
    mx = df.agg(F.max(S.TS)).scalar()
    obs_end = mx - F.make_dt_interval(F.lit(holdout_days))
    hold_start = obs_end + F.make_dt_interval(F.lit(gap_days))
    part = (F.when(F.col(S.TS) <= obs_end, F.lit("observation"))
             .when(F.col(S.TS) >= hold_start, F.lit("holdout")))
    return df.withColumn("part", part).where(F.col("part").isNotNull())


def valid_for_purchase_model(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows the purchase model may be fitted on."""
    if strict:
        pred = ((F.col("frequency") > 0) & (F.col("recency") > 0)
                & (F.col("recency") <= F.col("T")))
    else:
        pred = (F.col("frequency") >= 0) & (F.col("recency") >= 0) & (F.col("T") > 0)
    return df.where(pred)


def repeat_customers(df: DataFrame, monetary_col: str | None = "monetary_value") -> DataFrame:
    """Frequency > 0 (and positive spend when a spend column is given)."""
    pred = F.col("frequency") > 0
    if monetary_col:
        pred = pred & (F.col(monetary_col) > 0)
    return df.where(pred)


def clip(col: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a column to [lo, hi] (either side optional)."""
    c = F.col(col) if isinstance(col, str) else col
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def fill_invalid(df: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    """NaN, null and ±infinity become ``value``."""
    for c in cols:
        x = F.col(c)
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        df = df.withColumn(c, F.when(bad, F.lit(value)).otherwise(x))
    return df


def count_by(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    """Value counts, largest first (ties by value)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias(out))
              .orderBy(F.desc(out), F.asc(col)))


def lookup_customer(df: DataFrame, ids: DataFrame, key: str = S.CUST) -> DataFrame:
    """Rows whose key is in ``ids`` (left semi join on the distinct ids,
    so a repeated id never skews the build side; AQE broadcasts a small id
    list at runtime)."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def dataset_profile(tx: DataFrame) -> DataFrame:
    """Rows, distinct customers, first and last timestamp."""
    return tx.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.countDistinct(S.CUST).alias("n_customers"),
                  F.min(S.TS).alias("min_ts"), F.max(S.TS).alias("max_ts"))
