"""Registered queries, part 2: ranks, cohorts, model-based value, rules,
target lists, reports and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from clvforge import schemas as S
from clvforge.functions import probability as P
from clvforge.functions import rules as R
from clvforge.operators import cohorts as CO
from clvforge.operators import features as FT
from clvforge.operators import ranks as RK
from clvforge.operators import reports as RP
from clvforge.operators import rfm as RF
from clvforge.operators import value as V
from clvforge.plans import sqlblocks as Q
from clvforge.plans.catalog import (FEAT, RFM_TOTAL_PIPE, clean, features, obs, register, tx,
                                    rfm_scored)
from clvforge.plans.normalize import sql_wrap
from clvforge.plans.composite import Moments, customer_table, segment_table

BG, GG = P.PUBLISHED_BGNBD, P.PUBLISHED_GG
RFM_SQL = Q.with_(*Q.PIPE, *Q.rfm_blocks())
CUST_SQL = Q.with_(*Q.PIPE, *Q.customer_table_blocks(BG, GG))
CUST_R = CUST_SQL + ", cr AS (SELECT * FROM customers)\n"


def customers(spark, d):
    """The customer value table with the published model parameters."""
    return customer_table(clean(spark, d))[0]


def written_customers(spark, d, *columns):
    """These columns of the customer table, written: what reads them more than once scores each customer once."""
    from clvforge.session import durable_cut
    return durable_cut(customers(spark, d).select(*columns))


# -- E: ranks -------------------------------------------------------------------------

@register("average_rank", sql_wrap(
    RFM_SQL + "SELECT customer_id, Monetary, rank() OVER (ORDER BY Monetary) + "
              "(count(*) OVER (PARTITION BY Monetary) - 1) / 2.0 AS monetary_rank FROM rfm",
    ["Monetary", "monetary_rank"]))
def q_avg_rank(spark, d):
    from clvforge.session import durable_cut
    r = durable_cut(RF.compute_rfm(obs(spark, d)).select(S.CUST, "Monetary"))
    return RK.average_rank(r, "Monetary", "monetary_rank")


@register("first_rank", sql_wrap(
    RFM_SQL + "SELECT customer_id, Frequency, row_number() OVER (ORDER BY Frequency, customer_id) "
              "AS frequency_rank FROM rfm"))
def q_first_rank(spark, d):
    r = RF.compute_rfm(obs(spark, d)).select(S.CUST, "Frequency")
    return RK.global_row_number(r, ["Frequency", S.CUST], "frequency_rank")


def _qbin(col: str, n: int = 5) -> str:
    rn = f"row_number() OVER (ORDER BY {col}, customer_id)"
    den = "(count(*) OVER () - 1)"
    return (f"(CASE WHEN {den} <= 0 THEN 1 ELSE greatest(1, CAST(ceil(CAST(({rn} - 1) * {n} AS DOUBLE) "
            f"/ CAST({den} AS DOUBLE)) AS BIGINT)) END)")


@register("score_rfm_quantile", sql_wrap(
    Q.with_(*Q.PIPE, *Q.rfm_blocks(with_total=True)) +
    f"SELECT customer_id, Recency, Frequency, Monetary, TotalRevenue, "
    f"CAST(6 - {_qbin('Recency')} AS INTEGER) AS R_score, CAST({_qbin('Frequency')} AS INTEGER) AS F_score, "
    f"CAST({_qbin('Monetary')} AS INTEGER) AS M_score, "
    f"CAST((6 - {_qbin('Recency')}) * 100 + {_qbin('Frequency')} * 10 + {_qbin('Monetary')} AS INTEGER) "
    f"AS RFM_score FROM rfm", ["Monetary", "TotalRevenue"]))
def q_score_q(spark, d):
    return RF.score_rfm_quantile(RF.compute_rfm_total(obs(spark, d)))


@register("percent_above", CUST_SQL +
          "SELECT t.threshold, avg(CASE WHEN bgnbd_gg_clv > t.threshold THEN 1.0 ELSE 0.0 END) * 100 "
          "AS pct_above FROM customers, (VALUES (200.0), (1000.0), (5000.0)) t(threshold) GROUP BY t.threshold")
def q_pct_above(spark, d):
    return V.percent_above(written_customers(spark, d, "bgnbd_gg_clv"), [200.0, 1000.0, 5000.0])


@register("percent_above_requests", sql_wrap(
    CUST_SQL + ", asked AS (SELECT DISTINCT floor(o_totalprice / 100) AS threshold FROM orders) "
    "SELECT threshold, (SELECT count(*) FROM customers WHERE bgnbd_gg_clv > threshold) * 100.0 / (SELECT count(*) FROM customers) "
    "AS pct_above FROM asked", ["pct_above"]))
def q_pct_requests(spark, d):
    """E6 for a table of requests: one for each distinct order total, in hundreds."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.floor(F.col("o_totalprice").cast("double") / 100).cast("double").alias("threshold"))
    return V.percent_above(written_customers(spark, d, "bgnbd_gg_clv"), orders.distinct())


@register("top_share_value", sql_wrap(
    CUST_R + "SELECT 10.0 AS top_pct, quantile_cont(bgnbd_gg_clv, 0.9) AS min_value, "
             "avg(CASE WHEN bgnbd_gg_clv > (SELECT quantile_cont(bgnbd_gg_clv, 0.9) FROM cr) "
             "THEN 1.0 ELSE 0.0 END) * 100 AS pct_above FROM cr", ["min_value", "pct_above"]))
def q_top_share(spark, d):
    return V.top_share_value(written_customers(spark, d, "bgnbd_gg_clv"), 10.0)


# -- G: cohorts -----------------------------------------------------------------------

CM = "strftime(CAST(date_trunc('month', {}) AS DATE), '%Y-%m-%d')"
MIDX = "(year({0}) * 12 + month({0}))"


@register("cohort_columns", sql_wrap(
    Q.with_(*Q.PIPE[:4]) + f"""SELECT x.* EXCLUDE (cm), {CM.format('cm')} AS cohort_month,
  {CM.format('invoice_ts')} AS invoice_month,
  CAST({MIDX.format('invoice_ts')} - {MIDX.format('cm')} AS INTEGER) AS cohort_index
FROM (SELECT *, min(invoice_ts) OVER (PARTITION BY customer_id) AS cm FROM clean) x""",
    ["price", "revenue"], ["invoice_ts"]))
def q_cohort_cols(spark, d):
    return CO.cohort_columns(clean(spark, d))


RET_SQL = Q.with_(*Q.PIPE[:4], f"""cmon AS (SELECT DISTINCT customer_id, date_trunc('month', invoice_ts) AS m FROM clean)""",
                  "fm AS (SELECT customer_id, min(m) AS c FROM cmon GROUP BY customer_id)",
                  f"""cnt AS (SELECT fm.c AS cohort, CAST({MIDX.format('cmon.m')} - {MIDX.format('fm.c')} AS INTEGER)
       AS cohort_index, count(*) AS n_customers FROM cmon JOIN fm USING (customer_id) GROUP BY 1, 2)""")


@register("retention_cohorts", sql_wrap(
    RET_SQL + f"""SELECT {CM.format('a.cohort')} AS cohort_month, a.cohort_index, a.n_customers,
  b.n_customers AS cohort_size, a.n_customers / b.n_customers * 100 AS retention_pct
FROM cnt a LEFT JOIN cnt b ON a.cohort = b.cohort AND b.cohort_index = 0""", ["retention_pct"]))
def q_retention(spark, d):
    return CO.retention_cohorts(clean(spark, d))


@register("cohort_value", sql_wrap(
    Q.with_(*Q.PIPE, *Q.customer_table_blocks(BG, GG),
            "cmr AS (SELECT customer_id, date_trunc('month', invoice_ts) AS m, sum(revenue) AS revenue "
            "FROM clean GROUP BY 1, 2)",
            "fm AS (SELECT customer_id, min(m) AS c FROM cmr GROUP BY customer_id)") +
    f"""SELECT {CM.format('r.c')} AS cohort_month, r.cohort_index, r.revenue, r.active_customers,
  s.cohort_size, v.avg_clv
FROM (SELECT fm.c, CAST({MIDX.format('cmr.m')} - {MIDX.format('fm.c')} AS INTEGER) AS cohort_index,
             sum(cmr.revenue) AS revenue, count(*) AS active_customers
      FROM cmr JOIN fm USING (customer_id) GROUP BY 1, 2) r
LEFT JOIN (SELECT c, count(*) AS cohort_size FROM fm GROUP BY c) s USING (c)
LEFT JOIN (SELECT fm.c, avg(round(customers.bgnbd_gg_clv * 100) / 100) AS avg_clv
           FROM fm JOIN customers USING (customer_id) GROUP BY fm.c) v USING (c)""",
    ["revenue", "avg_clv"]))
def q_cohort_value(spark, d):
    lines = clean(spark, d)
    c = customer_table(lines)[0].withColumn("clv", V.round_to("bgnbd_gg_clv", 2))
    return CO.cohort_value(lines, c, "clv")


# -- I: probability models ------------------------------------------------------------

@register("probability_alive", sql_wrap(
    FEAT + f"SELECT customer_id, frequency, recency, T, {Q.p_alive_sql(BG)} AS prob_alive FROM features",
    ["prob_alive"]))
def q_alive(spark, d):
    return V.add_probability_alive(features(spark, d).select(S.CUST, "frequency", "recency", "T"))


@register("expected_purchases", FEAT +
          f"SELECT customer_id, frequency, recency, T, {Q.r2(Q.expected_purchases_sql(BG, 90.0), 4)} "
          f"AS expected_purchases FROM features")
def q_expected(spark, d):
    f = features(spark, d).select(S.CUST, "frequency", "recency", "T")
    return V.add_expected_purchases(f).withColumn("expected_purchases",
                                                  V.round_to("expected_purchases", 4))


@register("alive_grid", sql_wrap(
    FEAT + f"""SELECT frequency, recency, CASE WHEN frequency > 0 THEN
  {Q.p_alive_sql(BG, 'frequency', 'recency', '(recency + 1)')} ELSE 0.0 END AS prob_alive
FROM (SELECT DISTINCT frequency, recency FROM features) g""", ["prob_alive"]))
def q_alive_grid(spark, d):
    return V.alive_grid(features(spark, d))


@register("expected_spend", sql_wrap(
    FEAT + f"""SELECT customer_id, frequency, monetary_value,
  CASE WHEN frequency > 0 AND monetary_value > 0 THEN coalesce({Q.expected_spend_sql(GG)} * 0.1,
       monetary_value * 0.1) ELSE monetary_value * 0.1 END AS gamma_gamma_monetary FROM features""",
    ["monetary_value", "gamma_gamma_monetary"]))
def q_spend(spark, d):
    f = features(spark, d).select(S.CUST, "frequency", "monetary_value")
    return V.add_expected_spend(f)


@register("discounted_clv", FEAT +
          f"SELECT customer_id, {Q.r2(Q.expected_purchases_sql(BG, 30.0) + ' * ' + Q.expected_spend_sql(GG) + ' * 0.1 * ' + repr(P.discount_factor()), 2)} "
          f"AS discounted_clv FROM features WHERE frequency > 0 AND monetary_value > 0")
def q_discounted(spark, d):
    f = features(spark, d).where((F.col("frequency") > 0) & (F.col("monetary_value") > 0))
    return (V.discounted_clv(f.select(S.CUST, "frequency", "recency", "T", "monetary_value"))
             .select(S.CUST, V.round_to("discounted_clv", 2).alias("discounted_clv")))


CUST_COLS_SQL = ("customer_id, frequency, recency, T, monetary_value, total_revenue_obs, holdout_revenue, "
                 "segment, round(bgnbd_predicted_purchases * 1e4) / 1e4 AS bgnbd_predicted_purchases, "
                 "prob_alive, gamma_gamma_monetary, round(bgnbd_gg_clv * 100) / 100 AS bgnbd_gg_clv")


def _cust_cols(c):
    return c.select(S.CUST, "frequency", "recency", "T", "monetary_value", "total_revenue_obs",
                    "holdout_revenue", "segment",
                    V.round_to("bgnbd_predicted_purchases", 4).alias("bgnbd_predicted_purchases"),
                    "prob_alive", "gamma_gamma_monetary",
                    V.round_to("bgnbd_gg_clv", 2).alias("bgnbd_gg_clv"))


@register("fit_probabilistic")
def q_fit_probabilistic(spark, d):
    """I9 with parameters fitted on the given tables."""
    return _cust_cols(customer_table(clean(spark, d), fit=True)[0])


@register("score_probabilistic", sql_wrap(
    CUST_SQL + f"SELECT {CUST_COLS_SQL} FROM customers",
    ["monetary_value", "total_revenue_obs", "holdout_revenue", "prob_alive", "gamma_gamma_monetary"]))
def q_customers(spark, d):
    return _cust_cols(customers(spark, d))


@register("simple_clv", sql_wrap(
    CUST_SQL + "SELECT customer_id, round(least(bgnbd_predicted_purchases / 90 * 30 * 12 * gamma_gamma_monetary,"
               " 100000.0) * 100) / 100 AS simple_clv FROM customers"))
def q_simple(spark, d):
    c = customers(spark, d)
    return c.select(S.CUST, V.round_to(V.simple_clv_expr(), 2).alias("simple_clv"))


@register("attach_model_columns", sql_wrap(
    FEAT + f"""SELECT f.customer_id, f.frequency, coalesce(p.prob_alive, 0.5) AS prob_alive
FROM features f LEFT JOIN (SELECT customer_id, {Q.p_alive_sql(BG)} AS prob_alive FROM features
  WHERE {Q.strict_sql()}) p USING (customer_id)""", ["prob_alive"]))
def q_attach_model(spark, d):
    f = features(spark, d)
    valid = f.where((F.col("frequency") > 0) & (F.col("recency") > 0) & (F.col("recency") <= F.col("T")))
    preds = V.add_probability_alive(valid).select(S.CUST, "prob_alive")
    return V.attach_model_columns(f.select(S.CUST, "frequency"), preds, {"prob_alive": 0.5})


def _fit_rows(spark, d):
    from clvforge.operators.clean import repeat_customers, valid_for_purchase_model
    f = features(spark, d)
    bg = P.fit_bgnbd(valid_for_purchase_model(f, strict=True), 0.1)
    gg = P.fit_gamma_gamma(repeat_customers(f), 0.1)
    rows = [("bgnbd", k, float(bg[k])) for k in ("r", "alpha", "a", "b")]
    rows += [("gamma_gamma", k, float(gg[k])) for k in ("p", "q", "v")]
    return spark.createDataFrame(rows, "model string, name string, value double")


register("fit_bgnbd_gamma_gamma")(_fit_rows)


# -- H: rules --------------------------------------------------------------------------

@register("estimate_segment", sql_wrap(
    RFM_SQL + f"SELECT customer_id, Recency, Frequency, Monetary, "
              f"CASE WHEN Recency <= 30 AND Frequency >= 5 AND Monetary >= 100 THEN 'Champions' "
              f"WHEN Frequency >= 5 THEN 'Loyal' WHEN Recency <= 60 AND Frequency >= 2 THEN 'Potential Loyalists' "
              f"WHEN Recency <= 30 AND Frequency <= 1 THEN 'New Customers' "
              f"WHEN Recency >= 180 AND Frequency >= 3 THEN 'At Risk' "
              f"WHEN Recency >= 180 AND Frequency <= 2 THEN 'Hibernating' ELSE 'Needs Attention' END "
              f"AS estimated_segment FROM rfm", ["Monetary"]))
def q_estimate_segment(spark, d):
    r = RF.compute_rfm(obs(spark, d))
    return r.withColumn("estimated_segment", R.estimate_segment_expr("Recency", "Frequency", "Monetary"))


BAND_SQL = ("CASE WHEN {0} >= 5000 THEN 'VIP' WHEN {0} >= 1000 THEN 'High Value' "
            "WHEN {0} >= 200 THEN 'Medium Value' ELSE 'Low Value' END")


@register("clv_band", CUST_SQL + f"SELECT customer_id, {BAND_SQL.format('bgnbd_gg_clv')} AS clv_band FROM customers")
def q_band(spark, d):
    return customers(spark, d).select(S.CUST, R.clv_band_expr("bgnbd_gg_clv").alias("clv_band"))


@register("clv_percentile_band", CUST_SQL + """, cuts AS (SELECT quantile_cont(clv, 0.4) AS p40,
  quantile_cont(clv, 0.6) AS p60, quantile_cont(clv, 0.9) AS p90
  FROM (SELECT round(bgnbd_gg_clv * 100) / 100 AS clv FROM customers))
SELECT customer_id, CASE WHEN clv >= p60 THEN (CASE WHEN clv >= p90 THEN 'VIP' ELSE 'High Value' END)
  WHEN clv >= p40 THEN 'Medium Value' ELSE 'Low Value' END AS clv_band
FROM (SELECT customer_id, round(bgnbd_gg_clv * 100) / 100 AS clv FROM customers), cuts""")
def q_pband(spark, d):
    c = customers(spark, d).select(S.CUST, V.round_to("bgnbd_gg_clv", 2).alias("clv"))
    from clvforge.session import durable_cut
    return R.clv_percentile_band(durable_cut(c), "clv").select(S.CUST, "clv_band")


def _score_sql() -> str:
    e90 = Q.expected_purchases_sql(BG, 90.0)
    pa = Q.p_alive_sql(BG)
    h2 = ("CASE WHEN recency <= 30 AND frequency >= 5 AND monetary_value >= 100 THEN 'Champions' "
          "WHEN frequency >= 5 THEN 'Loyal' WHEN recency <= 60 AND frequency >= 2 THEN 'Potential Loyalists' "
          "WHEN recency <= 30 AND frequency <= 1 THEN 'New Customers' "
          "WHEN recency >= 180 AND frequency >= 3 THEN 'At Risk' "
          "WHEN recency >= 180 AND frequency <= 2 THEN 'Hibernating' ELSE 'Needs Attention' END")
    return FEAT + f""", rq AS (
  SELECT CAST(customer_id AS VARCHAR) AS customer_id, greatest(CAST(frequency AS DOUBLE), 0.0) AS frequency,
         greatest(CAST(recency AS DOUBLE), 0.0) AS recency, greatest(CAST(T AS DOUBLE), 1.0) AS T,
         greatest(monetary_value, 0.0) AS monetary_value FROM features),
s1 AS (SELECT *, CASE WHEN {Q.strict_sql()} THEN {e90}
                      WHEN monetary_value > 0 THEN monetary_value * 0.1 * 90 / 365 ELSE 50.0 END AS p_,
              CASE WHEN {Q.strict_sql()} THEN {pa} WHEN frequency = 0 THEN 0.8 ELSE 0.5 END AS a_,
              CASE WHEN monetary_value > 0 THEN monetary_value * 0.10 ELSE 10.0 END AS s_,
              {h2} AS seg_ FROM rq),
s2 AS (SELECT *, least(greatest(p_ / 90 * 30 * s_ * 12, 0.0), 100000.0) AS c_,
              least(greatest(p_, 0.0), 10000.0) AS pc_, least(greatest(a_, 0.0), 1.0) AS ac_ FROM s1)
SELECT customer_id, {Q.r2('pc_ * s_', 2)} AS predicted_clv_90d, {Q.r2('c_', 2)} AS predicted_clv_12m,
       {Q.r2('ac_', 4)} AS prob_alive, {Q.r2('pc_', 2)} AS expected_purchases_90d, seg_ AS rfm_segment,
       {BAND_SQL.format('c_')} AS clv_segment, {Q.r2('greatest(c_ * 0.3, 0.0)', 2)} AS ci_lower,
       {Q.r2('c_ * 2.0', 2)} AS ci_upper, {Q.action_case('seg_', 'ac_', 'c_')} AS recommended_action,
       {Q.r2('c_', 2)} AS bgnbd_clv
FROM s2"""


@register("score_requests", _score_sql())
def q_score_requests(spark, d):
    return V.score_requests(V.requests_from_customers(features(spark, d)))


@register("fallback_purchases", sql_wrap(
    FEAT + "SELECT customer_id, CASE WHEN monetary_value > 0 THEN monetary_value * 0.1 * 90 / 365 ELSE 50.0 END "
           "AS fallback_purchases, CASE WHEN frequency = 0 THEN 0.8 ELSE 0.5 END AS fallback_alive, "
           f"CASE WHEN T > 0 THEN frequency * 90.0 / T ELSE frequency END AS error_purchases "
           f"FROM features WHERE NOT {Q.strict_sql()}",
    ["fallback_purchases", "fallback_alive", "error_purchases"]))
def q_fallback(spark, d):
    f = features(spark, d).where(~((F.col("frequency") > 0) & (F.col("recency") > 0)
                                   & (F.col("recency") <= F.col("T"))))
    p, a = V.fallback_purchases_expr()
    return f.select(S.CUST, p.alias("fallback_purchases"), a.alias("fallback_alive"),
                    V.model_error_purchases_expr().alias("error_purchases"))


@register("interval_scale", sql_wrap(
    CUST_SQL + "SELECT customer_id, round(bgnbd_gg_clv * 100) / 100 * 0.3 AS api_lower, "
               "round(bgnbd_gg_clv * 100) / 100 * 2.0 AS api_upper, round(bgnbd_gg_clv * 100) / 100 * 0.6 "
               "AS dash_lower, round(bgnbd_gg_clv * 100) / 100 * 1.4 AS dash_upper FROM customers",
    ["api_lower", "api_upper", "dash_lower", "dash_upper"]))
def q_interval(spark, d):
    c = customers(spark, d).withColumn("clv", V.round_to("bgnbd_gg_clv", 2))
    lo, hi = R.interval_scale("clv", 0.3, 2.0)
    lo2, hi2 = R.interval_scale("clv", 0.6, 1.4)
    return c.select(S.CUST, lo.alias("api_lower"), hi.alias("api_upper"),
                    lo2.alias("dash_lower"), hi2.alias("dash_upper"))


@register("quick_estimate", sql_wrap(
    FEAT + "SELECT customer_id, frequency * (1 - recency / 365.0) * 2 * monetary_value * 0.9 AS quick_clv "
           "FROM features", ["quick_clv"]))
def q_quick(spark, d):
    return features(spark, d).select(S.CUST, R.quick_estimate_expr().alias("quick_clv"))


@register("recommended_action", CUST_SQL +
          f"SELECT customer_id, {Q.action_case('segment', 'prob_alive', 'round(bgnbd_gg_clv * 100) / 100')} "
          f"AS recommended_action, {Q.action_brief_case('segment', 'prob_alive', 'round(bgnbd_gg_clv * 100) / 100')} "
          f"AS recommended_action_brief, CASE WHEN prob_alive > 0.7 THEN 'green' WHEN prob_alive > 0.3 "
          f"THEN 'orange' ELSE 'red' END AS alive_band FROM customers")
def q_action(spark, d):
    c = customers(spark, d).withColumn("clv", V.round_to("bgnbd_gg_clv", 2))
    return c.select(S.CUST, R.recommended_action_expr("segment", "prob_alive", "clv").alias("recommended_action"),
                    R.recommended_action_brief_expr("segment", "prob_alive", "clv")
                     .alias("recommended_action_brief"),
                    R.alive_band_expr().alias("alive_band"))


@register("country_bucket", FEAT + """, top AS (SELECT country FROM features GROUP BY country
  ORDER BY count(*) DESC, country ASC LIMIT 10)
SELECT customer_id, country, CASE WHEN country IN (SELECT country FROM top) THEN country ELSE 'Other' END
  AS country_group FROM features""")
def q_country_bucket(spark, d):
    return R.country_bucket(features(spark, d).select(S.CUST, S.COUNTRY))


# -- F: target lists ----------------------------------------------------------------------

def _cust_r(spark, d):
    """The customer table; lists rank unrounded values and round what they report."""
    return customers(spark, d)


@register("top_customers", CUST_R + f"""SELECT CAST(customer_id AS VARCHAR) AS customer_id,
  {Q.r2('bgnbd_gg_clv', 2)} AS predicted_clv, coalesce(segment, 'Unknown') AS segment, {Q.r2('prob_alive', 4)} AS prob_alive,
  {Q.r2('total_revenue_obs', 2)} AS total_revenue_obs
FROM cr ORDER BY bgnbd_gg_clv DESC, customer_id ASC LIMIT 100""")
def q_top(spark, d):
    return V.top_customers(_cust_r(spark, d))


@register("at_risk", CUST_R + f"""SELECT CAST(customer_id AS VARCHAR) AS customer_id, {Q.r2('bgnbd_gg_clv', 2)} AS predicted_clv,
  coalesce(segment, 'Unknown') AS segment, {Q.r2('prob_alive', 4)} AS prob_alive,
  {Q.r2('CAST(recency AS DOUBLE)', 1)} AS recency,
  {Q.action_case("coalesce(segment, 'Unknown')", 'prob_alive', 'bgnbd_gg_clv')} AS recommended_action
FROM cr WHERE prob_alive < 0.5 AND bgnbd_gg_clv > (SELECT quantile_cont(bgnbd_gg_clv, 0.5) FROM cr)
ORDER BY bgnbd_gg_clv DESC, customer_id ASC LIMIT 50""")
def q_at_risk(spark, d):
    return V.at_risk(written_customers(spark, d, S.CUST, "bgnbd_gg_clv", "prob_alive", "segment", "recency"))


@register("at_risk_above_mean", sql_wrap(CUST_R + """SELECT customer_id, bgnbd_gg_clv, prob_alive, segment FROM cr
WHERE prob_alive < 0.5 AND bgnbd_gg_clv > (SELECT avg(bgnbd_gg_clv) FROM cr)""", ["prob_alive", "bgnbd_gg_clv"]))
def q_at_risk_mean(spark, d):
    return V.at_risk_above_mean(written_customers(spark, d, S.CUST, "bgnbd_gg_clv", "prob_alive", "segment")).select(S.CUST, "bgnbd_gg_clv", "prob_alive", "segment")


@register("vip", CUST_R + f"""SELECT CAST(customer_id AS VARCHAR) AS customer_id, {Q.r2('bgnbd_gg_clv', 2)} AS predicted_clv,
  {Q.r2('prob_alive', 4)} AS prob_alive, coalesce(segment, 'Unknown') AS segment,
  '{R.VIP_ACTION}' AS action
FROM cr WHERE bgnbd_gg_clv > (SELECT quantile_cont(bgnbd_gg_clv, 0.9) FROM cr) AND prob_alive > 0.7
ORDER BY bgnbd_gg_clv DESC, customer_id ASC LIMIT 50""")
def q_vip(spark, d):
    return V.vip(written_customers(spark, d, S.CUST, "bgnbd_gg_clv", "prob_alive", "segment"))


@register("win_back", CUST_R + f"""SELECT CAST(customer_id AS VARCHAR) AS customer_id,
  {Q.r2('total_revenue_obs', 2)} AS historical_revenue, coalesce(last_purchase_date, 'Unknown') AS last_purchase,
  '{R.WIN_BACK_ACTION}' AS action
FROM cr WHERE segment = 'Hibernating' AND total_revenue_obs > (SELECT quantile_cont(total_revenue_obs, 0.5) FROM cr)
ORDER BY total_revenue_obs DESC, customer_id ASC LIMIT 50""")
def q_win_back(spark, d):
    return V.win_back(_cust_r(spark, d))


@register("nurture", CUST_R + f"""SELECT CAST(customer_id AS VARCHAR) AS customer_id,
  {Q.r2('monetary_value', 2)} AS avg_order_value, CAST(n_unique_products AS INTEGER) AS n_unique_products,
  '{R.NURTURE_ACTION}' AS action
FROM cr WHERE segment = 'New Customers' AND monetary_value > (SELECT quantile_cont(monetary_value, 0.5) FROM cr)
ORDER BY monetary_value DESC, customer_id ASC LIMIT 50""")
def q_nurture(spark, d):
    return V.nurture(_cust_r(spark, d))


# -- D: reports over the customer table ----------------------------------------------------

@register("portfolio_stats", sql_wrap(CUST_R + """SELECT count(*) AS total_customers, avg(bgnbd_gg_clv) AS avg_clv,
  sum(total_revenue_obs) AS total_revenue,
  count(*) FILTER (WHERE prob_alive < 0.5 AND bgnbd_gg_clv > (SELECT quantile_cont(bgnbd_gg_clv, 0.5) FROM cr))
  AS at_risk FROM cr""", ["avg_clv", "total_revenue"]))
def q_portfolio(spark, d):
    return RP.portfolio_stats(_cust_r(spark, d))


@register("revenue_at_risk", sql_wrap(
    Q.with_(*Q.RFM_PIPE, Q.SEG_STATS) + """SELECT
  sum(CASE WHEN segment IN ('At Risk', 'Hibernating', 'Lost') THEN segment_revenue ELSE 0 END) AS at_risk_revenue,
  sum(segment_revenue) AS total_revenue,
  sum(CASE WHEN segment IN ('At Risk', 'Hibernating', 'Lost') THEN segment_revenue ELSE 0 END)
    / sum(segment_revenue) * 100 AS risk_pct FROM segstats""", ["at_risk_revenue", "total_revenue", "risk_pct"]))
def q_rev_risk(spark, d):
    return RP.revenue_at_risk(segment_table(clean(spark, d))[1])


@register("error_summary", sql_wrap(CUST_R + """SELECT avg(bgnbd_gg_clv - holdout_revenue) AS mean_error,
  quantile_cont(bgnbd_gg_clv - holdout_revenue, 0.5) AS median_error,
  stddev_samp(bgnbd_gg_clv - holdout_revenue) AS std_error, count(*) AS n
FROM cr WHERE holdout_revenue > 0""", ["mean_error", "median_error", "std_error"]))
def q_error_summary(spark, d):
    return RP.error_summary(written_customers(spark, d, S.CUST, "holdout_revenue", "bgnbd_gg_clv"))


@register("value_summary", sql_wrap(CUST_R + """SELECT avg(bgnbd_gg_clv) AS avg_clv, count(*) AS total_customers,
  avg(bgnbd_gg_clv) * count(*) AS total_clv_potential, 50.0 AS cac, avg(bgnbd_gg_clv) / 50.0 AS clv_cac_ratio,
  avg(bgnbd_gg_clv) - 50.0 AS margin_per_customer,
  CASE WHEN avg(bgnbd_gg_clv) / 50.0 >= 3 THEN 'healthy' WHEN avg(bgnbd_gg_clv) / 50.0 >= 1 THEN 'acceptable'
       ELSE 'below break-even' END AS verdict FROM cr""",
    ["avg_clv", "total_clv_potential", "cac", "clv_cac_ratio", "margin_per_customer"]))
def q_value_summary(spark, d):
    return RP.value_summary(_cust_r(spark, d))


@register("clv_by_segment_summary", sql_wrap(CUST_R + """SELECT segment, count(*) AS n,
  quantile_cont(bgnbd_gg_clv, 0.25) AS q1, quantile_cont(bgnbd_gg_clv, 0.5) AS median,
  quantile_cont(bgnbd_gg_clv, 0.75) AS q3, avg(bgnbd_gg_clv) AS mean, min(bgnbd_gg_clv) AS min,
  max(bgnbd_gg_clv) AS max FROM cr GROUP BY segment""", ["q1", "median", "q3", "mean", "min", "max"]))
def q_clv_seg(spark, d):
    return RP.clv_by_segment_summary(written_customers(spark, d, S.CUST, "segment", "bgnbd_gg_clv"))


def _hist_sql(src: str, col: str, n: int = 50, axis: str | None = None) -> str:
    limit = f", (SELECT quantile_cont({col}, {axis}) FROM {src}) AS axis_limit" if axis else ""
    width = "CASE WHEN mx > mn THEN mx - mn ELSE 1.0 END"
    return f"""SELECT e.bin, coalesce(c.n, 0) AS count, mn + (mx - mn) * e.bin / {n} AS bin_lo,
  mn + (mx - mn) * (e.bin + 1) / {n} AS bin_hi{limit}
FROM (SELECT CAST(range AS BIGINT) AS bin FROM range({n})) e
  CROSS JOIN (SELECT min({col}) AS mn, max({col}) AS mx FROM {src}) r
  LEFT JOIN (SELECT least(CAST(floor(({col} - mn) * {n} / {width}) AS BIGINT), {n} - 1) AS bin, count(*) AS n
             FROM {src}, (SELECT min({col}) AS mn, max({col}) AS mx FROM {src}) q WHERE {col} IS NOT NULL GROUP BY 1) c
  ON c.bin = e.bin"""


@register("histogram_revenue", sql_wrap(
    Q.with_(*Q.PIPE[:4]) + _hist_sql("clean", "revenue", 50, "0.99"), ["bin_lo", "bin_hi", "axis_limit"]))
def q_hist_rev(spark, d):
    return RP.histogram(clean(spark, d), S.REVENUE, 50, axis_quantile=0.99)


@register("histogram_log_revenue", sql_wrap(
    Q.with_(*Q.PIPE[:4], "lr AS (SELECT ln(1 + revenue) AS log_revenue FROM clean)")
    + _hist_sql("lr", "log_revenue", 50), ["bin_lo", "bin_hi"]))
def q_hist_log(spark, d):
    c = clean(spark, d).select(F.log1p(S.REVENUE).alias("log_revenue"))
    return RP.histogram(c, "log_revenue", 50)


@register("histogram_clv", sql_wrap(CUST_R + _hist_sql("cr", "bgnbd_gg_clv", 50), ["bin_lo", "bin_hi"]))
def q_hist_clv(spark, d):
    return RP.histogram(written_customers(spark, d, "bgnbd_gg_clv"), "bgnbd_gg_clv", 50)


@register("histogram_purchases", sql_wrap(
    Q.with_(*Q.PIPE[:4], "pc AS (SELECT customer_id, CAST(count(DISTINCT invoice) AS DOUBLE) AS n_purchases "
                         "FROM clean GROUP BY customer_id)")
    + _hist_sql("pc", "n_purchases", 50, "0.99"), ["bin_lo", "bin_hi", "axis_limit"]))
def q_hist_purch(spark, d):
    pc = clean(spark, d).groupBy(S.CUST).agg(F.countDistinct(S.INVOICE).cast("double").alias("n_purchases"))
    return RP.histogram(pc, "n_purchases", 50, axis_quantile=0.99)


@register("histogram_lifetime", sql_wrap(
    Q.with_(*Q.PIPE[:4], "lt AS (SELECT customer_id, CAST(date_diff('day', min(invoice_ts), max(invoice_ts)) AS DOUBLE) "
                         "AS lifetime_days FROM clean GROUP BY customer_id)")
    + _hist_sql("lt", "lifetime_days", 50), ["bin_lo", "bin_hi"]))
def q_hist_lifetime(spark, d):
    return RP.histogram(FT.lifetime_days(clean(spark, d)), "lifetime_days", 50)


@register("histogram_error", sql_wrap(
    CUST_R + ", er AS (SELECT bgnbd_gg_clv - holdout_revenue AS error FROM cr WHERE holdout_revenue > 0)\n"
    + _hist_sql("er", "error", 50), ["bin_lo", "bin_hi"]))
def q_hist_err(spark, d):
    e = written_customers(spark, d, "holdout_revenue", "bgnbd_gg_clv").where(F.col("holdout_revenue") > 0).select(
        (F.col("bgnbd_gg_clv") - F.col("holdout_revenue")).alias("error"))
    return RP.histogram(e, "error", 50)


# -- K: evaluation of the probabilistic value against the holdout target -------------------

@register("regression_metrics", sql_wrap(CUST_R + """SELECT count(*) AS n, avg(abs(holdout_revenue - bgnbd_gg_clv)) AS mae,
  sqrt(avg((holdout_revenue - bgnbd_gg_clv) * (holdout_revenue - bgnbd_gg_clv))) AS rmse,
  1 - sum((holdout_revenue - bgnbd_gg_clv) * (holdout_revenue - bgnbd_gg_clv))
      / sum((holdout_revenue - m) * (holdout_revenue - m)) AS r2,
  avg(CASE WHEN holdout_revenue > 0 THEN abs((holdout_revenue - bgnbd_gg_clv) / holdout_revenue) END) * 100 AS mape
FROM cr, (SELECT avg(holdout_revenue) AS m FROM cr) mm""", ["mae", "rmse", "r2", "mape"]))
def q_metrics(spark, d):
    from clvforge.operators import evaluate as EV
    return EV.regression_metrics(_cust_r(spark, d), "holdout_revenue", "bgnbd_gg_clv")


@register("compare_models", sql_wrap(CUST_R + """SELECT 'BG/NBD + Gamma-Gamma' AS model, count(*) AS n,
  avg(abs(holdout_revenue - bgnbd_gg_clv)) AS mae,
  sqrt(avg((holdout_revenue - bgnbd_gg_clv) * (holdout_revenue - bgnbd_gg_clv))) AS rmse,
  corr(holdout_revenue, bgnbd_gg_clv) AS correlation FROM cr WHERE holdout_revenue > 0
UNION ALL SELECT 'Quick estimate' AS model, count(*) AS n,
  avg(abs(holdout_revenue - q)) AS mae, sqrt(avg((holdout_revenue - q) * (holdout_revenue - q))) AS rmse,
  corr(holdout_revenue, q) AS correlation
FROM (SELECT holdout_revenue, frequency * (1 - recency / 365.0) * 2 * monetary_value * 0.9 AS q FROM cr
      WHERE holdout_revenue > 0) z""", ["mae", "rmse", "correlation"]))
def q_compare(spark, d):
    from clvforge.operators import evaluate as EV
    c = _cust_r(spark, d).where(F.col("holdout_revenue") > 0)
    c = c.withColumn("quick", R.quick_estimate_expr())
    return EV.compare_models(c, "holdout_revenue",
                             {"BG/NBD + Gamma-Gamma": "bgnbd_gg_clv", "Quick estimate": "quick"})


@register("prediction_pairs", sql_wrap(CUST_R + """SELECT customer_id, holdout_revenue AS actual,
  bgnbd_gg_clv AS predicted, max(greatest(holdout_revenue, bgnbd_gg_clv)) OVER () AS axis_max
FROM cr WHERE holdout_revenue > 0""", ["actual", "predicted", "axis_max"]))
def q_pairs(spark, d):
    from clvforge.operators import evaluate as EV
    return EV.prediction_pairs(written_customers(spark, d, S.CUST, "holdout_revenue", "bgnbd_gg_clv"), "holdout_revenue", "bgnbd_gg_clv")


@register("interval_coverage", sql_wrap(CUST_R + """SELECT avg(CASE WHEN holdout_revenue >= bgnbd_gg_clv * 0.3
  AND holdout_revenue <= bgnbd_gg_clv * 2.0 THEN 1.0 ELSE 0.0 END) * 100 AS coverage_pct, count(*) AS n
FROM cr WHERE holdout_revenue > 0""", ["coverage_pct"]))
def q_coverage(spark, d):
    from clvforge.operators import evaluate as EV
    c = _cust_r(spark, d).where(F.col("holdout_revenue") > 0)
    c = c.withColumn("lo", F.col("bgnbd_gg_clv") * 0.3).withColumn("hi", F.col("bgnbd_gg_clv") * 2.0)
    return EV.interval_coverage(c, "holdout_revenue", "lo", "hi")


# -- L: composites -------------------------------------------------------------------------

@register("segment_summary", sql_wrap(
    Q.with_(*Q.RFM_PIPE, Q.SEG_STATS, Q.SEG_STATS_FINAL, Q.actions_values()) +
    f"""SELECT s.segment, s.customer_count, round(s.revenue_share_pct, 2) AS revenue_share_pct,
  {Q.r2('s.avg_revenue_per_customer', 2)} AS avg_clv, coalesce(a.priority, 'Medium') AS priority,
  coalesce(a.action, 'Standard engagement') AS recommended_action
FROM segfinal s LEFT JOIN acts a USING (segment)""", ["revenue_share_pct"]))
def q_seg_summary(spark, d):
    return RP.segment_summary(segment_table(clean(spark, d))[1])


@register("budget_summary", sql_wrap(
    Q.with_(*RFM_TOTAL_PIPE, Q.actions_values(), """b AS (
  SELECT segment, count(customer_id) AS customer_count, sum(TotalRevenue) AS total_revenue FROM seg GROUP BY segment)""")
    + """SELECT b.segment, b.customer_count, round(b.total_revenue / sum(b.total_revenue) OVER () * 100, 2)
  AS revenue_share_pct, a.budget_pct, a.budget_pct * 100.0 / sum(a.budget_pct) OVER () AS budget_pct_normalised,
  coalesce(a.action, 'Standard engagement') AS recommended_action, coalesce(a.priority, 'Medium') AS priority
FROM b LEFT JOIN acts a USING (segment)""", ["revenue_share_pct", "budget_pct_normalised"]))
def q_budget(spark, d):
    seg = RF.segment_customers(RF.score_rfm(RF.compute_rfm_total(obs(spark, d))))
    return RP.budget_summary(seg)


@register("rfm_for_histories", sql_wrap(
    Q.with_(*Q.PIPE[:4], "snap AS (SELECT max(invoice_ts) + INTERVAL 1 DAY AS s FROM clean)",
            f"""rfm AS (SELECT customer_id, {Q.days('max(invoice_ts)', 'any_value(snap.s)')} AS Recency, count(*) AS Frequency,
  avg(revenue) AS Monetary FROM clean, snap GROUP BY customer_id)""", *Q.score_blocks(), Q.SEG, Q.actions_values())
    + f"""SELECT CAST(customer_id AS VARCHAR) AS customer_id, Recency, Frequency, Monetary, R_score AS r_score, F_score AS f_score,
  M_score AS m_score, RFM_score AS rfm_score, segment, coalesce(priority, 'Medium') AS priority,
  coalesce(action, 'Standard engagement') AS recommended_action, CAST(NULL AS VARCHAR) AS status
FROM seg LEFT JOIN acts USING (segment)
UNION ALL SELECT DISTINCT 'none-' || CAST(c_custkey AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  '{RP.NO_TRANSACTIONS}' FROM customer WHERE c_custkey % 100 = 0""", ["Monetary"]))
def q_rfm_hist(spark, d):
    """L3 over the lines' histories and some customers without any."""
    from clvforge.sources.histories import histories_from_lines
    hist = histories_from_lines(clean(spark, d))
    bare = (spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 100 = 0")
            .select(F.concat(F.lit("none-"), F.col("c_custkey").cast("string")).alias(S.CUST))
            .withColumn("transactions", F.array().cast(hist.schema["transactions"].dataType)))
    return RP.rfm_for_histories(hist.select(S.CUST, "transactions").unionByName(bare))


@register("alive_grid_full")
def q_alive_grid_full(spark, d):
    """I4 as drawn: frequency 0 to 49 by recency 0 to 360, with the parameters fitted on the given lines."""
    fit = {r["name"]: r["value"] for r in _fit_rows(spark, d).where("model = 'bgnbd'").collect()}
    return V.alive_grid_full(spark, {k: fit[k] for k in ("r", "alpha", "a", "b")})


# -- J: machine-learned value (rows-only checks; numerics covered by tests) ---------------

_TRAINED: dict[tuple[str, str], dict] = {}


def _trained(spark, d):
    """One training per session and data folder serves all ML queries: the whole J11 with its 20 trials."""
    from clvforge.plans.ml import train_value_model
    key = (spark.sparkContext.applicationId, d)
    if key not in _TRAINED:
        from clvforge.session import durable_cut
        _TRAINED[key] = {**train_value_model(cust := durable_cut(customers(spark, d))), "customers": cust}
    return _TRAINED[key]


@register("prepare_features", sql_wrap(
    CUST_SQL + """, top AS (SELECT country FROM customers GROUP BY country ORDER BY count(*) DESC, country ASC LIMIT 10),
enc AS (SELECT *, CASE WHEN country IN (SELECT country FROM top) THEN country ELSE 'Other' END AS country_encoded
        FROM customers),
codes AS (SELECT country_encoded, CAST(dense_rank() OVER (ORDER BY country_encoded) - 1 AS DOUBLE)
          AS country_encoded_num FROM (SELECT DISTINCT country_encoded FROM enc))
SELECT customer_id, CAST(frequency AS DOUBLE) AS frequency, CAST(recency AS DOUBLE) AS recency,
  CAST(T AS DOUBLE) AS T, monetary_value, total_revenue_obs, avg_revenue_per_txn, std_revenue_per_txn,
  CAST(n_unique_products AS DOUBLE) AS n_unique_products, CAST(n_unique_months AS DOUBLE) AS n_unique_months,
  avg_days_between_purchases, max_purchase_gap, CAST(n_transactions AS DOUBLE) AS n_transactions,
  round(bgnbd_predicted_purchases * 1e4) / 1e4 AS bgnbd_predicted_purchases, prob_alive, gamma_gamma_monetary,
  country_encoded_num, holdout_revenue
FROM enc JOIN codes USING (country_encoded)""",
    ["monetary_value", "total_revenue_obs", "avg_revenue_per_txn", "std_revenue_per_txn",
     "avg_days_between_purchases", "max_purchase_gap", "prob_alive", "gamma_gamma_monetary",
     "holdout_revenue"]))
def q_prepare(spark, d):
    from clvforge.plans.ml import prepare_features
    c = customers(spark, d).withColumn("bgnbd_predicted_purchases",
                                       V.round_to("bgnbd_predicted_purchases", 4))
    return prepare_features(c)[0]


SPLIT_HASH = """xor(x4, x4 >> 15) AS h FROM (SELECT *, (xor(x2, x2 >> 13) * 22695477 + 2531011) & 2147483647 AS x4
FROM (SELECT *, (xor(x1, x1 >> 16) * 1103515245 + 12345) & 2147483647 AS x2
FROM (SELECT *, xor(customer_id % 2147483648, (42 * 2654435761) & 2147483647) AS x1 FROM {}) a1) a2) a3"""


@register("split_train_validation", FEAT + "SELECT customer_id, CASE WHEN h < 429496730 THEN 'validation' ELSE 'train' END AS part "
          "FROM (SELECT customer_id, " + SPLIT_HASH.format("features") + ") z")
def q_split_tv(spark, d):
    from clvforge.plans.ml import split_train_validation
    tr, va = split_train_validation(features(spark, d).select(S.CUST))
    return tr.withColumn("part", F.lit("train")).unionByName(va.withColumn("part", F.lit("validation")))


_SCALED = ["frequency", "recency", "total_revenue_obs", "n_unique_products"]


@register("scale_features", sql_wrap(
    FEAT + ", parts AS (SELECT *, " + SPLIT_HASH.format("features") + "), m AS (SELECT " + ", ".join(
        f"avg(CAST({c} AS DOUBLE)) AS a_{c}, stddev_samp(CAST({c} AS DOUBLE)) AS s_{c}" for c in _SCALED)
    + " FROM parts WHERE h >= 429496730) SELECT customer_id, " + ", ".join(f"({c} - a_{c}) / s_{c} AS {c}" for c in _SCALED)
    + " FROM parts, m", _SCALED))
def q_scale(spark, d):
    """Fitted on the training part, applied to all customers."""
    from pyspark.ml.functions import vector_to_array
    from clvforge.plans.ml import assemble, split_train_validation
    from clvforge.session import durable_cut
    feats = durable_cut(features(spark, d).select(S.CUST, *[F.col(c).cast("double").alias(c) for c in _SCALED]))  # read twice
    prep = assemble(_SCALED).fit(split_train_validation(feats)[0])
    out = vector_to_array("features")
    return prep.transform(feats).select(S.CUST, *[out[i].alias(c) for i, c in enumerate(_SCALED)])


@register("tune_boosted")
def q_tune(spark, d):
    """The 20 trials of the guided search with their validation MAE, and which is best."""
    tried = _trained(spark, d)["trials"]
    best = min(e for _, e in tried)
    keys = sorted(tried[0][0])
    return spark.createDataFrame([(i, float(e), e == best, *[float(m[k]) for k in keys]) for i, (m, e) in enumerate(tried)],
                                 "trial int, mae double, best boolean, " + ", ".join(f"{k} double" for k in keys))


def _prepared_validation(spark, d):
    t = _trained(spark, d)
    return t, t["validation"]


@register("fit_boosted")
def q_boosted(spark, d):
    """Predictions of the main booster on the held-out split."""
    t, valid = _prepared_validation(spark, d)
    return t["models"]["boosted"].transform(valid).select(S.CUST, "holdout_revenue", "prediction")


@register("fit_boosted_alt")
def q_boosted_alt(spark, d):
    """Predictions of the leaf-wise booster on the held-out split."""
    t, valid = _prepared_validation(spark, d)
    return t["models"]["boosted_alt"].transform(valid).select(S.CUST, "holdout_revenue", "prediction")


@register("fit_interval")
def q_interval(spark, d):
    """J8 with K2: coverage of the 80 % interval on the held-out split."""
    from clvforge.operators import evaluate as EV
    t, valid = _prepared_validation(spark, d)
    return EV.interval_coverage(t["models"]["interval"].transform(valid), "holdout_revenue", "pred_lower", "pred_upper")


@register("tree_attributions")
def q_attributions(spark, d):
    """Mean absolute attribution of each feature on the held-out split."""
    from clvforge.plans.attribution import mean_attribution
    t, valid = _prepared_validation(spark, d)
    return mean_attribution(t["models"]["boosted"], valid)


@register("compare_models_ml")
def q_compare_ml(spark, d):
    """K3 with all models, on the held-out split."""
    from clvforge.operators import evaluate as EV
    from clvforge.plans.ml import model_predictions
    t, valid = _prepared_validation(spark, d)
    both = model_predictions(t["models"], valid).join(t["customers"].select(S.CUST, "bgnbd_gg_clv"), S.CUST)
    return EV.compare_models(both, "holdout_revenue", {"BG/NBD + Gamma-Gamma": "bgnbd_gg_clv", "Boosted trees": "boosted",
                                                      "Boosted trees, leaf-wise": "boosted_alt", "Ridge": "ridge"})


@register("train_value_model")
def q_train(spark, d):
    return _trained(spark, d)["metrics_df"]


@register("fit_ridge")
def q_ridge(spark, d):
    """The baseline's coefficients, by J1, J2, J3 and J7; they depend on no search and no booster."""
    from clvforge.plans.ml import train_ridge, training_rows
    from clvforge.session import durable_cut
    preparer, train, _ = training_rows(durable_cut(customers(spark, d)))
    w = train_ridge(train, preparer.names)[1].coefficients.toArray().tolist()
    return spark.createDataFrame(list(zip(preparer.names, w)), "feature string, coefficient double")


@register("permutation_importance")
def q_permutation(spark, d):
    """J10 on the held-out split, all features."""
    from clvforge.plans.ml import permutation_importance
    t = _trained(spark, d)
    return permutation_importance(t["models"]["boosted"], t["validation"], t["feature_names"])


@register("top_importance")
def q_importance(spark, d):
    return _trained(spark, d)["feature_importance"]


@register("predict_interval")
def q_predict_interval(spark, d):
    return _trained(spark, d)["scored"].select(S.CUST, "ml_predicted_clv", "pred_lower", "pred_upper")


# -- A: sinks and sources round trip ------------------------------------------------------

def _scratch(spark) -> str:
    import uuid
    from clvforge.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{uuid.uuid4().hex}"


@register("read_transactions", sql_wrap(
    Q.with_(Q.TX) + "SELECT * REPLACE (CAST(customer_id AS DOUBLE) AS customer_id) FROM tx",
    ["price", "customer_id"], ["invoice_ts"]))
def q_read_csv(spark, d):
    """A1: the fixture lines written as a latin-1 CSV with the raw header,
    then scanned with the declared schema and parsed (A2)."""
    from clvforge.sources.io import read_transactions
    path = _scratch(spark)
    raw = tx(spark, d).select(
        F.col(S.INVOICE).alias("Invoice"), F.col(S.STOCK).alias("StockCode"),
        F.col(S.DESCRIPTION).alias("Description"), F.col(S.QTY).alias("Quantity"),
        F.date_format(S.TS, "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"), F.col(S.PRICE).alias("Price"),
        F.col(S.CUST).cast("double").alias("Customer ID"), F.col(S.COUNTRY).alias("Country"))
    raw.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    from clvforge.operators.clean import parse_invoice_ts
    return parse_invoice_ts(read_transactions(spark, path), "yyyy-MM-dd HH:mm:ss")


_TABLE_SUMS = """SELECT 'rfm' AS name, segment AS part, count(*) AS n, sum(Monetary) AS total FROM seg GROUP BY segment
UNION ALL SELECT 'segment_stats' AS name, segment AS part, customer_count AS n, segment_revenue AS total FROM segfinal
UNION ALL SELECT 'customers' AS name, segment AS part, count(*) AS n, sum(bgnbd_gg_clv) AS total FROM customers GROUP BY segment
UNION ALL SELECT 'feature_importance' AS name, country AS part, count(*) AS n, sum(holdout_revenue) AS total FROM customers GROUP BY country"""


@register("write_outputs", sql_wrap(
    Q.with_(*Q.RFM_PIPE, Q.SEG_STATS, Q.SEG_STATS_FINAL,
            *[b for b in Q.customer_table_blocks(BG, GG) if b not in Q.RFM_PIPE]) + _TABLE_SUMS, ["total"]))
def q_write_outputs(spark, d):
    """A5 + A4: all four tables published as one set and read back; sums of each table's contents. (The fourth
    table's place is taken by a table that SQL can state, per country.)"""
    from clvforge.session import durable_cut
    from clvforge.sources.io import read_customer_outputs, write_outputs
    path = _scratch(spark)
    c = clean(spark, d)
    seen = Moments(c)
    seg, stats = segment_table(c, bounds=seen.bounds)
    cust = durable_cut(customer_table(c, seen=seen)[0])  # read for its own table and for the countries'
    country = cust.groupBy(S.COUNTRY).agg(F.count(F.lit(1)).alias("n"), F.sum("holdout_revenue").alias("total"))
    write_outputs({"customers": cust, "rfm": seg, "segment_stats": stats, "feature_importance": country}, path, partition_segments=True)
    back = read_customer_outputs(spark, path)
    row = lambda name, df, part, n, total: df.select(F.lit(name).alias("name"), F.col(part).alias("part"), n.alias("n"), total.alias("total"))
    grouped = lambda df, total: df.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"))
    return (row("rfm", grouped(back["rfm"], "Monetary"), "segment", F.col("n"), F.col("total"))
            .unionByName(row("segment_stats", back["segment_stats"], "segment", F.col("customer_count"), F.col("segment_revenue")))
            .unionByName(row("customers", grouped(back["customers"], "bgnbd_gg_clv"), "segment", F.col("n"), F.col("total")))
            .unionByName(row("feature_importance", back["feature_importance"], S.COUNTRY, F.col("n"), F.col("total"))))


@register("save_load_params")
def q_params(spark, d):
    """Fitted parameters saved as a table and loaded back."""
    from clvforge.sources.io import load_params, params_frame, save_params
    path = _scratch(spark)
    rows = {r["name"]: r["value"] for r in _fit_rows(spark, d).where("model = 'bgnbd'").collect()}
    save_params(spark, "bgnbd", rows, path)
    return params_frame(spark, "bgnbd", load_params(spark, path, "bgnbd"))


@register("run_metadata")
def q_meta(spark, d):
    """One-row run summary."""
    from clvforge.sources.io import run_metadata
    t = _trained(spark, d)
    return run_metadata(spark, t["customers"].count(), t["feature_names"], t["metrics"], t["best_model"]).drop("training_date")


@register("end_to_end_run")
def q_end_to_end(spark, d):
    """L1: the end-to-end run; returns the scored customer table."""
    from clvforge.plans.composite import run_pipeline
    out = run_pipeline(tx(spark, d))
    return out["customers"].select(S.CUST, "segment", "bgnbd_gg_clv", "ml_predicted_clv",
                                   "pred_lower", "pred_upper")


@register("transactions_from_events", sql_wrap(
    Q.with_(Q.EVENTS_TX, Q.BASE, Q.CAP, Q.CLEAN, *Q.split_blocks(holdout_days=7), *Q.FEATURES) +
    "SELECT * FROM features",
    ["total_revenue_obs", "avg_revenue_per_txn", "std_revenue_per_txn", "monetary_value",
     "avg_days_between_purchases", "max_purchase_gap"]))
def q_events(spark, d):
    """customer features on sub-day purchase events (7-day holdout)."""
    from clvforge.operators import clean as C
    from clvforge.sources.star import transactions_from_events
    o, _ = C.split_observation_holdout(
        C.clean_transactions(transactions_from_events(spark, d), literal_cap=True), holdout_days=7)
    return FT.customer_features(o)
