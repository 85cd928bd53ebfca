"""Customer value from the probability models, scoring of request rows and
ranked target lists (B11, C4, E6, F1–F6, H5–H6, I2–I9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clvforge import schemas as S
from clvforge.functions import probability as P
from clvforge.functions import rules as R
from clvforge.operators.clean import clip
from clvforge.operators.ranks import quantile_row, split_points, value_rank_table
from clvforge.session import durable_cut


def round_to(col: str | Column, digits: int) -> Column:
    """Round half away from zero on the scaled value (engine-independent)."""
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.round(c * scale) / scale


def _strict(x="frequency", tx="recency", T_="T") -> Column:
    return (F.col(x) > 0) & (F.col(tx) > 0) & (F.col(tx) <= F.col(T_))


def add_probability_alive(df: DataFrame, params: dict | None = None,
                          out: str = "prob_alive") -> DataFrame:
    """I3 on every row."""
    return df.withColumn(out, P.probability_alive(params or P.PUBLISHED_BGNBD))


def add_expected_purchases(df: DataFrame, params: dict | None = None, t: float = 90,
                           out: str = "expected_purchases") -> DataFrame:
    """I2 on every row."""
    return df.withColumn(out, P.expected_purchases(params or P.PUBLISHED_BGNBD, t))


def add_expected_spend(df: DataFrame, params: dict | None = None, margin: float = P.MARGIN,
                       out: str = "gamma_gamma_monetary") -> DataFrame:
    """Repeat customers with positive spend get the Gamma-Gamma mean ×
    margin; everyone else monetary × margin."""
    gg = P.expected_spend(params or P.PUBLISHED_GG) * margin
    fallback = F.col("monetary_value") * margin
    eligible = (F.col("frequency") > 0) & (F.col("monetary_value") > 0)
    return df.withColumn(out, F.when(eligible, F.coalesce(gg, fallback)).otherwise(fallback))


def discounted_clv(df: DataFrame, bg: dict | None = None, gg: dict | None = None,
                   months: int = 12, rate: float = 0.01, start: int = 0,
                   margin: float = P.MARGIN, out: str = "discounted_clv") -> DataFrame:
    """30-day expected purchases × expected profit × Σ 1/(1+rate)^k."""
    factor = P.discount_factor(months, rate, start)
    monthly = P.expected_purchases(bg or P.PUBLISHED_BGNBD, 30.0)
    profit = P.expected_spend(gg or P.PUBLISHED_GG) * margin
    return df.withColumn(out, monthly * profit * F.lit(factor))


def simple_clv_expr(purchases="bgnbd_predicted_purchases", spend="gamma_gamma_monetary",
                    cap: float = P.CLV_CAP) -> Column:
    """I8: purchases in 90 days → 12 monthly equivalents × spend, capped."""
    return F.least(F.col(purchases) / 90 * 30 * 12 * F.col(spend), F.lit(cap))


def fit_probabilistic(customers: DataFrame, bg: dict | None = None, gg: dict | None = None,
                      penalty: float = 0.1, fit: bool = False,
                      one_time_rule: str = "money") -> tuple[DataFrame, dict, dict]:
    """Purchase count and P(alive) for customers the model is valid for
    (frequency > 0, 0 < recency ≤ T); one-time buyers get
    monetary·0.1·90/365 purchases, others 0; P(alive) defaults to 0.5; spend
    by I6; value by I8. With ``fit`` the parameters are estimated first
    (I1 on the strict rows, I5 on repeat customers). ``one_time_rule``
    'yearly' gives one-time buyers one purchase per year (90/365 in 90
    days), as the reference's comment describes; 'money' is what it codes."""
    if fit:
        from clvforge.operators.clean import valid_for_purchase_model, repeat_customers
        bg = P.fit_bgnbd(valid_for_purchase_model(customers, strict=True), penalty)
        gg = P.fit_gamma_gamma(repeat_customers(customers), penalty)
        for name, model in (("purchase", bg), ("spend", gg)):
            if not model["converged"]:
                raise RuntimeError(f"the fit of the {name} model has not converged (gradient {model['grad_norm']:.3g})")
    bg = bg or P.PUBLISHED_BGNBD
    gg = gg or P.PUBLISHED_GG
    valid = _strict()
    one_time = (F.lit(90.0 / 365.0) if one_time_rule == "yearly"
                else F.col("monetary_value") * 0.1 / 365 * 90)
    purchases = (F.when(valid, P.expected_purchases(bg, 90.0, only=valid))
                  .when(F.col("frequency") == 0, one_time)
                  .otherwise(F.lit(0.0)))
    alive = F.when(valid, P.probability_alive(bg)).otherwise(F.lit(0.5))
    out = (customers.withColumn("bgnbd_predicted_purchases", purchases)
                    .withColumn("prob_alive", alive)
                    .transform(lambda d: add_expected_spend(d, gg))
                    .withColumn("bgnbd_gg_clv", simple_clv_expr()))
    return out, bg, gg


def attach_model_columns(customers: DataFrame, preds: DataFrame,
                         defaults: dict[str, float] | None = None) -> DataFrame:
    """C4: keyed attach of model outputs (fixes the positional re-indexing of
    the reference); missing customers get the given defaults."""
    j = customers.join(preds, S.CUST, "left")
    for c, v in (defaults or {}).items():
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return j


# -- scoring request rows (H5, H6, B11) ---------------------------------------

def validate_requests(req: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Defaults for missing optional fields, then split into valid rows
    (frequency, recency, monetary ≥ 0, T > 0) and rejected rows."""
    d = (req.withColumn("n_unique_products", F.coalesce("n_unique_products", F.lit(0)))
            .withColumn(S.COUNTRY, F.coalesce(S.COUNTRY, F.lit("UK"))))
    ok = ((F.col("frequency") >= 0) & (F.col("recency") >= 0) & (F.col("T") > 0)
          & (F.col("monetary_value") >= 0))
    ok = F.coalesce(ok, F.lit(False))
    return d.where(ok), d.where(~ok)


def fallback_purchases_expr(frequency="frequency", monetary="monetary_value") -> tuple[Column, Column]:
    """H6: no valid history → monetary·0.1·90/365 (50 when spend is 0);
    P(alive) 0.8 for a single purchase, 0.5 otherwise."""
    m = F.col(monetary)
    purchases = F.when(m > 0, m * 0.1 * 90 / 365).otherwise(F.lit(50.0))
    alive = F.when(F.col(frequency) == 0, F.lit(0.8)).otherwise(F.lit(0.5))
    return purchases, alive


def model_error_purchases_expr(frequency="frequency", T_="T") -> Column:
    """H6 (model-error branch): frequency · 90 / T (frequency when T ≤ 0)."""
    f, t = F.col(frequency), F.col(T_)
    return F.when(t > 0, f * 90.0 / t).otherwise(f.cast("double"))


def alive_grid(customers: DataFrame, params: dict | None = None) -> DataFrame:
    """I4: P(alive) over the observed (frequency, recency) pairs with
    T = recency + 1; 0 for frequency 0 (as the diagnostic grid draws it)."""
    g = customers.select("frequency", "recency").distinct()
    p = P.probability_alive(params or P.PUBLISHED_BGNBD, "frequency", "recency",
                            F.col("recency") + 1)
    return g.withColumn("prob_alive", F.when(F.col("frequency") > 0, p).otherwise(F.lit(0.0)))


def alive_grid_full(spark, params: dict | None = None, frequencies: int = 50, recency_end: int = 365,
                    recency_step: int = 5) -> DataFrame:
    """I4 as drawn: frequency 0 … 49 × recency 0, 5, …, 360, T = recency + 1.
    The grid is a fixed number of cells, made from two ranges."""
    g = (spark.range(frequencies).select(F.col("id").alias("frequency"))
         .select("frequency", F.explode(F.sequence(F.lit(0), F.lit(recency_end - 1), F.lit(recency_step))).alias("recency")))
    return alive_grid(g, params)


def score_requests(req: DataFrame, bg: dict | None = None, estimate_segment: bool = True,
                   segment_col: str | None = None) -> DataFrame:
    """H5: one projection over request rows: model or fallback purchases,
    P(alive), 10 % spend, 12-month value, clamps, interval ×0.3 / ×2.0,
    value band, segment (H2 estimate, or a given column) and action (H9)."""
    bg = bg or P.PUBLISHED_BGNBD
    d = (req.withColumn("frequency", F.greatest(F.col("frequency").cast("double"), F.lit(0.0)))
            .withColumn("recency", F.greatest(F.col("recency").cast("double"), F.lit(0.0)))
            .withColumn("T", F.greatest(F.col("T").cast("double"), F.lit(1.0)))
            .withColumn("monetary_value", F.greatest(F.col("monetary_value").cast("double"), F.lit(0.0))))
    valid = _strict()
    fb_p, fb_a = fallback_purchases_expr()
    d = (d.withColumn("_purch", F.when(valid, P.expected_purchases(bg, 90.0, only=valid)).otherwise(fb_p))
          .withColumn("_alive", F.when(valid, P.probability_alive(bg)).otherwise(fb_a))
          .withColumn("_spend", F.when(F.col("monetary_value") > 0, F.col("monetary_value") * 0.10)
                      .otherwise(F.lit(10.0))))
    d = d.withColumn("_clv12", F.col("_purch") / 90 * 30 * F.col("_spend") * 12)
    d = (d.withColumn("_purch", clip("_purch", 0.0, 10000.0))
          .withColumn("_alive", clip("_alive", 0.0, 1.0))
          .withColumn("_clv12", clip("_clv12", 0.0, P.CLV_CAP)))
    if segment_col:
        seg = F.coalesce(F.col(segment_col), F.lit("Unknown"))
    elif estimate_segment:
        seg = R.estimate_segment_expr()
    else:
        seg = F.lit("Unknown")
    lo, hi = R.interval_scale("_clv12", 0.3, 2.0)
    return d.select(
        F.col(S.CUST).cast("string").alias(S.CUST),
        round_to(F.col("_purch") * F.col("_spend"), 2).alias("predicted_clv_90d"),
        round_to("_clv12", 2).alias("predicted_clv_12m"),
        round_to("_alive", 4).alias("prob_alive"),
        round_to("_purch", 2).alias("expected_purchases_90d"),
        seg.alias("rfm_segment"),
        R.clv_band_expr("_clv12").alias("clv_segment"),
        round_to(F.greatest(lo, F.lit(0.0)), 2).alias("ci_lower"),
        round_to(hi, 2).alias("ci_upper"),
        R.recommended_action_expr(seg, "_alive", "_clv12").alias("recommended_action"),
        round_to("_clv12", 2).alias("bgnbd_clv"))


def requests_from_customers(customers: DataFrame) -> DataFrame:
    """Request rows shaped like the scoring body, from a customer table."""
    return customers.select(
        F.col(S.CUST).cast("string").alias(S.CUST),
        F.col("frequency").cast("double").alias("frequency"),
        F.col("recency").cast("double").alias("recency"),
        F.col("T").cast("double").alias("T"),
        F.col("monetary_value").cast("double").alias("monetary_value"),
        F.col("n_unique_products").cast("int").alias("n_unique_products"),
        F.col(S.COUNTRY).alias(S.COUNTRY))


# -- ranked target lists (F1–F6) and shares (E6) ---------------------------------

def _quantile(df: DataFrame, col: str, q: float = 0.5, exact: bool = True) -> Column:
    """q-quantile over ALL rows of ``df`` as a scalar subquery (exact: the
    distributed rank table, no per-value map in one task; else a sketch)."""
    return quantile_row(df, col, q, "_q", exact).scalar()


def _top(df: DataFrame, order_col: str, limit: int) -> DataFrame:
    # orderBy + limit plans TakeOrderedAndProject: per-partition top-k, then merge
    return df.orderBy(F.desc(order_col), F.asc(S.CUST)).limit(limit)


def top_customers(customers: DataFrame, limit: int = 100, clv: str = "bgnbd_gg_clv") -> DataFrame:
    """largest predicted value, with segment, P(alive) and revenue."""
    t = _top(customers, clv, limit)
    return t.select(F.col(S.CUST).cast("string").alias(S.CUST),
                    round_to(clv, 2).alias("predicted_clv"),
                    F.coalesce("segment", F.lit("Unknown")).alias("segment"),
                    round_to("prob_alive", 4).alias("prob_alive"),
                    round_to("total_revenue_obs", 2).alias("total_revenue_obs"))


def at_risk(customers: DataFrame, limit: int = 50, clv: str = "bgnbd_gg_clv",
            exact: bool = True) -> DataFrame:
    """F2 (and churn risk): P(alive) < 0.5 and value above the median of ALL
    customers; top by value, with the H9 action."""
    med = _quantile(customers, clv, 0.5, exact)
    f = customers.where((F.col("prob_alive") < 0.5) & (F.col(clv) > med))
    t = _top(f, clv, limit)
    return t.select(F.col(S.CUST).cast("string").alias(S.CUST),
                    round_to(clv, 2).alias("predicted_clv"),
                    F.coalesce("segment", F.lit("Unknown")).alias("segment"),
                    round_to("prob_alive", 4).alias("prob_alive"),
                    round_to(F.col("recency").cast("double"), 1).alias("recency"),
                    R.recommended_action_expr(F.coalesce("segment", F.lit("Unknown")),
                                              "prob_alive", clv).alias("recommended_action"))


def at_risk_above_mean(customers: DataFrame, clv: str = "bgnbd_gg_clv") -> DataFrame:
    """P(alive) < 0.5 and value above the mean, sorted by value."""
    mean = customers.agg(F.avg(clv)).scalar()
    f = customers.where((F.col("prob_alive") < 0.5) & (F.col(clv) > mean))
    return f.orderBy(F.desc(clv), F.asc(S.CUST))


def vip(customers: DataFrame, limit: int = 50, clv: str = "bgnbd_gg_clv", exact: bool = True) -> DataFrame:
    """value above the 90th percentile and P(alive) > 0.7."""
    cut = _quantile(customers, clv, 0.9, exact)
    f = customers.where((F.col(clv) > cut) & (F.col("prob_alive") > 0.7))
    t = _top(f, clv, limit)
    return t.select(F.col(S.CUST).cast("string").alias(S.CUST),
                    round_to(clv, 2).alias("predicted_clv"),
                    round_to("prob_alive", 4).alias("prob_alive"),
                    F.coalesce("segment", F.lit("Unknown")).alias("segment"),
                    F.lit(R.VIP_ACTION).alias("action"))


def win_back(customers: DataFrame, limit: int = 50, exact: bool = True) -> DataFrame:
    """Hibernating customers with revenue above the median of all."""
    cut = _quantile(customers, "total_revenue_obs", 0.5, exact)
    f = customers.where((F.col("segment") == "Hibernating") & (F.col("total_revenue_obs") > cut))
    t = _top(f, "total_revenue_obs", limit)
    return t.select(F.col(S.CUST).cast("string").alias(S.CUST),
                    round_to("total_revenue_obs", 2).alias("historical_revenue"),
                    F.coalesce("last_purchase_date", F.lit("Unknown")).alias("last_purchase"),
                    F.lit(R.WIN_BACK_ACTION).alias("action"))


def nurture(customers: DataFrame, limit: int = 50, exact: bool = True) -> DataFrame:
    """New Customers with spend above the median of all."""
    cut = _quantile(customers, "monetary_value", 0.5, exact)
    f = customers.where((F.col("segment") == "New Customers") & (F.col("monetary_value") > cut))
    t = _top(f, "monetary_value", limit)
    return t.select(F.col(S.CUST).cast("string").alias(S.CUST),
                    round_to("monetary_value", 2).alias("avg_order_value"),
                    F.col("n_unique_products").cast("int").alias("n_unique_products"),
                    F.lit(R.NURTURE_ACTION).alias("action"))


def percent_above(customers: DataFrame, thresholds: DataFrame | list[float], clv: str = "bgnbd_gg_clv") -> DataFrame:
    """Share (%) of customers whose value exceeds each requested value: (threshold, pct_above).

    ``thresholds`` is a list, or a table with a column ``threshold`` and as many rows as you like (null
    ones have no row in the result). Distinct values with their ranks and the requests are bucketed by the
    same split points and sorted together within each bucket; a request takes the count of the last
    value before it, or that of the buckets below. No request meets all values.
    """
    if not isinstance(thresholds, DataFrame):
        thresholds = customers.sparkSession.createDataFrame([(float(v),) for v in thresholds], "threshold double")
    splits = split_points(customers, [clv])[clv]
    ranked = durable_cut(value_rank_table(customers, clv, splits=splits).select(
        F.col(clv).cast("double").alias("v"), (F.col("_less") + F.col("_cnt")).alias("upto"), F.lit(0).alias("asked")))
    asked = thresholds.select(F.col("threshold").cast("double").alias("v")).where("v IS NOT NULL").distinct().select(
        "v", F.lit(None).cast("long").alias("upto"), F.lit(1).alias("asked"))
    edges = F.array(*[F.lit(float(s)) for s in splits]).cast("array<double>")
    bucket = F.size(F.filter(edges, lambda s: s <= F.col("v"))).alias("bucket")
    ranked, asked = ranked.select("*", bucket), asked.select("*", bucket)
    below = ranked.groupBy("bucket").agg(F.max("upto").alias("top"))  # one row a bucket
    lower = asked.select("bucket").distinct().join(F.broadcast(below.withColumnRenamed("bucket", "other")), F.expr("other < bucket"), "left") \
        .groupBy("bucket").agg(F.coalesce(F.max("top"), F.lit(0)).alias("before"))
    w = Window.partitionBy("bucket").orderBy("v", "asked").rowsBetween(Window.unboundedPreceding, 0)
    met = ranked.unionByName(asked).withColumn("seen", F.last("upto", ignorenulls=True).over(w)).where("asked = 1")
    n = customers.where(F.col(clv).isNotNull()).agg(F.count(F.lit(1))).scalar()
    share = (n - F.coalesce("seen", "before")) * 100.0 / n
    return met.join(F.broadcast(lower), "bucket", "left").select(F.col("v").alias("threshold"), share.alias("pct_above"))


def top_share_value(customers: DataFrame, top_pct: float, clv: str = "bgnbd_gg_clv",
                    exact: bool = True) -> DataFrame:
    """E6 companion: the value a customer must exceed to be in the top
    ``top_pct`` % (the (1 − top_pct/100)-quantile), and that group's share."""
    cut = _quantile(customers, clv, 1 - top_pct / 100.0, exact)
    return customers.agg(
        F.first(F.lit(float(top_pct))).alias("top_pct"),
        F.max(cut).alias("min_value"),
        (F.avg(F.when(F.col(clv) > cut, 1.0).otherwise(0.0)) * 100).alias("pct_above"))
