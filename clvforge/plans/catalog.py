"""Registered queries: one per operator of the inventory, each reading the
given tables, plus its DuckDB SQL twin where SQL can state it."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clvforge import schemas as S
from clvforge.functions import rules as R
from clvforge.operators import clean as C
from clvforge.operators import features as FT
from clvforge.operators import rfm as RF
from clvforge.plans import sqlblocks as Q
from clvforge.plans.normalize import normalize, sql_wrap
from clvforge.sources.star import transactions_from_star
from clvforge.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; its output doubles are rounded exactly where the SQL
    twin rounds them (all doubles when there is no twin)."""
    doubles = None if sql is None else tuple(getattr(sql, "doubles", ()))

    def deco(fn):
        def run(spark, sf_dir):
            ship_package(spark)
            return normalize(fn(spark, sf_dir), doubles)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# -- shared Spark stages ------------------------------------------------------

def tx(spark, d):
    return transactions_from_star(spark, d)


def clean(spark, d):
    return C.clean_transactions(tx(spark, d), literal_cap=True)


def split(spark, d):
    return C.split_observation_holdout(clean(spark, d))


def obs(spark, d):
    return split(spark, d)[0]


def rfm_scored(spark, d):
    return RF.segment_customers(RF.score_rfm(RF.compute_rfm(obs(spark, d))))


# -- flagship: segment statistics with actions --------------------------------

def segment_actions(spark: SparkSession, d: str) -> DataFrame:
    from clvforge.plans.composite import segment_table
    return R.attach_actions(segment_table(clean(spark, d))[1])


SEG_STATS_COLS = ["segment_revenue", "avg_revenue_per_customer", "avg_R_score", "avg_F_score",
                  "avg_M_score", "avg_recency", "avg_frequency", "avg_monetary", "revenue_share_pct"]

register("segment_actions", sql_wrap(
    Q.with_(*Q.RFM_PIPE, Q.SEG_STATS, Q.SEG_STATS_FINAL, Q.actions_values())
    + """SELECT s.*, coalesce(a.priority, 'Medium') AS priority, a.budget_pct,
       coalesce(a.action, 'Standard engagement') AS action, a.kpi
       FROM segfinal s LEFT JOIN acts a USING (segment)""", SEG_STATS_COLS))(segment_actions)


# -- B: cleaning ---------------------------------------------------------------

TX_DOUBLES = ["price"]


@register("clean_transactions", sql_wrap(Q.with_(*Q.PIPE[:4]) + "SELECT * FROM clean",
                                         TX_DOUBLES + ["revenue"], ["invoice_ts"]))
def q_clean(spark, d):
    return clean(spark, d)


@register("split_observation_holdout", sql_wrap(
    Q.with_(*Q.PIPE) + "SELECT *, 'observation' AS part FROM obs UNION ALL "
                       "SELECT *, 'holdout' AS part FROM hold",
    TX_DOUBLES + ["revenue"], ["invoice_ts"]))
def q_split(spark, d):
    return C.split_parts(clean(spark, d))


@register("customer_features", sql_wrap(
    Q.with_(*Q.PIPE, *Q.FEATURES) + "SELECT * FROM features",
    ["total_revenue_obs", "avg_revenue_per_txn", "std_revenue_per_txn", "monetary_value",
     "avg_days_between_purchases", "max_purchase_gap"]))
def q_features(spark, d):
    return FT.customer_features(obs(spark, d))


@register("compute_rfm", sql_wrap(Q.with_(*Q.PIPE, *Q.rfm_blocks()) + "SELECT * FROM rfm",
                                  ["Monetary"]))
def q_rfm(spark, d):
    return RF.compute_rfm(obs(spark, d))


@register("score_rfm", sql_wrap(
    Q.with_(*Q.RFM_PIPE) + "SELECT customer_id, Recency, Frequency, Monetary, R_score, F_score, "
                           "M_score, RFM_score FROM seg", ["Monetary"]))
def q_score(spark, d):
    return RF.score_rfm(RF.compute_rfm(obs(spark, d)))


@register("segment_customers", sql_wrap(
    Q.with_(*Q.RFM_PIPE) + "SELECT customer_id, R_score, F_score, M_score, RFM_score, segment FROM seg"))
def q_segment(spark, d):
    return rfm_scored(spark, d).select(S.CUST, "R_score", "F_score", "M_score", "RFM_score", "segment")


# -- A: sources ------------------------------------------------------------------

@register("parse_invoice_ts", sql_wrap(Q.with_(Q.TX) + "SELECT invoice, invoice_ts FROM tx",
                                       timestamps=["invoice_ts"]))
def q_parse_ts(spark, d):
    as_text = tx(spark, d).select(S.INVOICE, FT.fmt_ts(S.TS).alias(S.TS))
    return C.parse_invoice_ts(as_text, "yyyy-MM-dd HH:mm:ss")


@register("explode_histories", sql_wrap(
    Q.with_(*Q.PIPE[:4]) + "SELECT CAST(customer_id AS VARCHAR) AS customer_id, invoice_ts, revenue FROM clean",
    ["revenue"], ["invoice_ts"]))
def q_explode(spark, d):
    from clvforge.sources.histories import explode_histories, histories_from_lines
    return explode_histories(histories_from_lines(clean(spark, d)))


# -- B: filters and predicates -------------------------------------------------------

def _tx_sql(where: str, extra: str = "") -> str:
    return sql_wrap(Q.with_(Q.TX) + f"SELECT *{extra} FROM tx WHERE {where}",
                    TX_DOUBLES + (["revenue"] if extra else []), ["invoice_ts"])


register("drop_cancelled", _tx_sql("NOT coalesce(starts_with(invoice, 'C'), false)"))(
    lambda spark, d: C.drop_cancelled(tx(spark, d)))
register("drop_nonpositive", _tx_sql("quantity > 0 AND price > 0"))(
    lambda spark, d: C.drop_nonpositive(tx(spark, d)))
register("add_revenue", _tx_sql("true", ", quantity * price AS revenue"))(
    lambda spark, d: C.add_revenue(tx(spark, d)))
register("drop_missing_customer", _tx_sql("customer_id IS NOT NULL"))(
    lambda spark, d: C.drop_missing_customer(tx(spark, d)))
register("drop_adjustments", _tx_sql("NOT coalesce(regexp_matches(stock_code, '^[AM]'), false)"))(
    lambda spark, d: C.drop_adjustments(tx(spark, d)))


def _base(spark, d):
    return C.add_revenue(C.drop_nonpositive(C.drop_cancelled(tx(spark, d))))


@register("trim_price_outliers", sql_wrap(
    Q.with_(Q.TX, Q.BASE, Q.CAP) + "SELECT base.* FROM base, cap WHERE price <= cap.cap",
    TX_DOUBLES + ["revenue"], ["invoice_ts"]))
def q_trim(spark, d):
    return C.trim_price_outliers(_base(spark, d))


@register("price_quantile", sql_wrap(Q.with_(Q.TX, Q.BASE) +
                                     "SELECT quantile_cont(price, 0.99) AS price_p99, "
                                     "quantile_cont(price, 0.5) AS price_p50 FROM base",
                                     ["price_p99", "price_p50"]))
def q_price_q(spark, d):
    from clvforge.operators.ranks import exact_quantile
    b = _base(spark, d)
    p99 = exact_quantile(b, S.PRICE, 0.99, "price_p99")
    p50 = exact_quantile(b, S.PRICE, 0.5, "price_p50")
    return p99.select("price_p99", p50.scalar().alias("price_p50"))


def features(spark, d):
    return FT.customer_features(obs(spark, d))


FEAT = Q.with_(*Q.PIPE, *Q.FEATURES)


@register("valid_for_purchase_model", FEAT +
          "SELECT customer_id, frequency, recency, T, 'strict' AS rule FROM features "
          "WHERE frequency > 0 AND recency > 0 AND recency <= T UNION ALL "
          "SELECT customer_id, frequency, recency, T, 'loose' AS rule FROM features "
          "WHERE frequency >= 0 AND recency >= 0 AND T > 0")
def q_valid(spark, d):
    f = features(spark, d).select(S.CUST, "frequency", "recency", "T")
    return (C.valid_for_purchase_model(f, strict=True).withColumn("rule", F.lit("strict"))
            .unionByName(C.valid_for_purchase_model(f).withColumn("rule", F.lit("loose"))))


@register("repeat_customers", sql_wrap(
    FEAT + "SELECT customer_id, frequency, monetary_value FROM features "
           "WHERE frequency > 0 AND monetary_value > 0", ["monetary_value"]))
def q_repeat(spark, d):
    return C.repeat_customers(features(spark, d).select(S.CUST, "frequency", "monetary_value"))


@register("validate_requests", sql_wrap(
    FEAT + "SELECT CAST(customer_id AS VARCHAR) AS customer_id, CAST(frequency AS DOUBLE) AS frequency, "
           "CAST(recency AS DOUBLE) AS recency, CAST(T AS DOUBLE) AS T, monetary_value, "
           "CAST(n_unique_products AS INTEGER) AS n_unique_products, country, 'valid' AS status "
           "FROM features", ["frequency", "recency", "T", "monetary_value"]))
def q_validate(spark, d):
    from clvforge.operators.value import requests_from_customers, validate_requests
    ok, bad = validate_requests(requests_from_customers(features(spark, d)))
    return (ok.withColumn("status", F.lit("valid"))
              .unionByName(bad.withColumn("status", F.lit("rejected"))))


@register("lookup_customer", sql_wrap(
    FEAT + "SELECT customer_id, frequency, monetary_value FROM features "
           "WHERE customer_id IN (SELECT customer_id FROM hold)", ["monetary_value"]))
def q_lookup(spark, d):
    o, h = split(spark, d)
    f = FT.customer_features(o).select(S.CUST, "frequency", "monetary_value")
    return C.lookup_customer(f, h.select(S.CUST))


@register("clip", sql_wrap(
    FEAT + "SELECT customer_id, least(greatest(avg_days_between_purchases, 0), 30) AS gap_clipped, "
           "least(greatest(total_revenue_obs, 0), 100000) AS revenue_clipped, "
           "greatest(recency - 30, 0) AS recency_floor FROM features",
    ["gap_clipped", "revenue_clipped"]))
def q_clip(spark, d):
    f = features(spark, d)
    return f.select(S.CUST, C.clip("avg_days_between_purchases", 0, 30).alias("gap_clipped"),
                    C.clip("total_revenue_obs", 0, 100000).alias("revenue_clipped"),
                    C.clip(F.col("recency") - 30, 0).alias("recency_floor"))


@register("fill_invalid", sql_wrap(
    FEAT + "SELECT customer_id, CASE WHEN recency = 0 THEN 0.0 ELSE total_revenue_obs / recency END "
           "AS revenue_per_day, CASE WHEN frequency = 0 THEN 0.0 ELSE std_revenue_per_txn / frequency END "
           "AS std_per_repeat, 0.0 AS missing FROM features",
    ["revenue_per_day", "std_per_repeat", "missing"]))
def q_fill(spark, d):
    f = features(spark, d)
    raw = f.select(
        S.CUST,
        F.when(F.col("recency") == 0, F.lit(float("inf")))
         .otherwise(F.col("total_revenue_obs") / F.col("recency")).alias("revenue_per_day"),
        F.when(F.col("frequency") == 0, F.lit(float("nan")))
         .otherwise(F.col("std_revenue_per_txn") / F.col("frequency")).alias("std_per_repeat"),
        F.lit(None).cast("double").alias("missing"))
    return C.fill_invalid(raw, ["revenue_per_day", "std_per_repeat", "missing"])


@register("count_by", FEAT + "SELECT country, count(*) AS count FROM features GROUP BY country")
def q_count_by(spark, d):
    return C.count_by(features(spark, d), S.COUNTRY)


# -- C: joins ----------------------------------------------------------------------

@register("attach_holdout", sql_wrap(
    Q.with_(*Q.PIPE, *Q.FEATURES, Q.HOLD_REV) +
    "SELECT f.customer_id, f.total_revenue_obs, coalesce(h.holdout_revenue, 0.0) AS holdout_revenue "
    "FROM features f LEFT JOIN hrev h USING (customer_id)", ["total_revenue_obs", "holdout_revenue"]))
def q_attach_holdout(spark, d):
    o, h = split(spark, d)
    f = FT.customer_features(o).select(S.CUST, "total_revenue_obs")
    return FT.attach_holdout(f, FT.holdout_revenue(h))


@register("attach_rfm", Q.with_(*Q.PIPE, *Q.FEATURES, *Q.RFM_PIPE[len(Q.PIPE):]) +
          "SELECT f.customer_id, f.frequency, s.R_score, s.F_score, s.M_score, s.RFM_score, s.segment "
          "FROM features f LEFT JOIN seg s USING (customer_id)")
def q_attach_rfm(spark, d):
    o = obs(spark, d)
    f = FT.customer_features(o).select(S.CUST, "frequency")
    return RF.attach_rfm(f, RF.segment_customers(RF.score_rfm(RF.compute_rfm(o))))


@register("attach_customer_revenue", sql_wrap(
    Q.with_(*Q.PIPE, *Q.rfm_blocks()) +
    "SELECT r.*, c.total_revenue FROM rfm r LEFT JOIN "
    "(SELECT customer_id, sum(revenue) AS total_revenue FROM obs GROUP BY customer_id) c USING (customer_id)",
    ["Monetary", "total_revenue"]))
def q_attach_rev(spark, d):
    o = obs(spark, d)
    return RF.attach_customer_revenue(RF.compute_rfm(o), o)


# -- D: aggregations -----------------------------------------------------------------

register("segment_stats", sql_wrap(
    Q.with_(*Q.RFM_PIPE, Q.SEG_STATS, Q.SEG_STATS_FINAL) + "SELECT * FROM segfinal", SEG_STATS_COLS))(
    lambda spark, d: (lambda o: RF.segment_stats(
        RF.segment_customers(RF.score_rfm(RF.compute_rfm(o))), o))(obs(spark, d)))


@register("purchase_span", FEAT +
          "SELECT customer_id, first_purchase_date, last_purchase_date, n_transactions, frequency, "
          "recency, T FROM features")
def q_span(spark, d):
    return FT.purchase_span(obs(spark, d))


@register("spend_stats", sql_wrap(
    FEAT + "SELECT customer_id, total_revenue_obs, avg_revenue_per_txn, std_revenue_per_txn, "
           "monetary_value, total_quantity FROM features",
    ["total_revenue_obs", "avg_revenue_per_txn", "std_revenue_per_txn", "monetary_value"]))
def q_spend_stats(spark, d):
    return FT.spend_stats(obs(spark, d))


register("distinct_products", FEAT + "SELECT customer_id, n_unique_products FROM features")(
    lambda spark, d: FT.distinct_products(obs(spark, d)))
@register("distinct_products_merged", FEAT + "SELECT customer_id, n_unique_products FROM features")
def q_products_merged(spark, d):
    """D4 from monthly sketches that are merged; sketches of so few codes are exact."""
    from clvforge.operators.sketches import distinct_products_of, product_sketches
    return distinct_products_of(product_sketches(obs(spark, d)))


@register("price_quantile_merged", "SELECT TRUE AS within_bound")
def q_price_merged(spark, d):
    """B4's cap from monthly sketches that are merged: whether its rank among all prices is within 1 % of 0.99."""
    from clvforge.operators.sketches import price_quantile_of, price_sketches
    lines = C.parse_invoice_ts(C.drop_nonpositive(C.drop_cancelled(tx(spark, d))))
    cap = price_quantile_of(price_sketches(lines)).scalar()
    rank = F.avg(F.when(F.col(S.PRICE) <= cap, 1.0).otherwise(0.0))
    return lines.agg((F.abs(rank - 0.99) <= 0.01).alias("within_bound"))


register("modal_country", FEAT + "SELECT customer_id, country FROM features")(
    lambda spark, d: FT.modal_country(obs(spark, d)))
register("active_months", FEAT + "SELECT customer_id, n_unique_months FROM features")(
    lambda spark, d: FT.active_months(obs(spark, d)))
register("purchase_gaps", sql_wrap(
    FEAT + "SELECT customer_id, avg_days_between_purchases, max_purchase_gap FROM features",
    ["avg_days_between_purchases", "max_purchase_gap"]))(
    lambda spark, d: FT.purchase_gaps(obs(spark, d)))
register("holdout_revenue", sql_wrap(Q.with_(*Q.PIPE, Q.HOLD_REV) + "SELECT * FROM hrev",
                                     ["holdout_revenue"]))(
    lambda spark, d: FT.holdout_revenue(split(spark, d)[1]))
register("compute_rfm_total", sql_wrap(
    Q.with_(*Q.PIPE, *Q.rfm_blocks(with_total=True)) + "SELECT * FROM rfm", ["Monetary", "TotalRevenue"]))(
    lambda spark, d: RF.compute_rfm_total(obs(spark, d)))


RFM_TOTAL_PIPE = (Q.PIPE + Q.rfm_blocks(with_total=True) + Q.score_blocks() + [Q.SEG])


@register("segment_stats_brief", sql_wrap(
    Q.with_(*RFM_TOTAL_PIPE, """b AS (
  SELECT segment, count(customer_id) AS Count, round(avg(Recency), 2) AS Avg_Recency,
         round(avg(Frequency), 2) AS Avg_Frequency, round(avg(Monetary), 2) AS Avg_Monetary,
         round(sum(TotalRevenue), 2) AS Total_Revenue, round(avg(TotalRevenue), 2) AS Avg_Revenue
  FROM seg GROUP BY segment)""") +
    "SELECT *, round(Total_Revenue / sum(Total_Revenue) OVER () * 100, 2) AS Revenue_Share_pct FROM b",
    ["Avg_Recency", "Avg_Frequency", "Avg_Monetary", "Total_Revenue", "Avg_Revenue", "Revenue_Share_pct"]))
def q_seg_brief(spark, d):
    seg = RF.segment_customers(RF.score_rfm(RF.compute_rfm_total(obs(spark, d))))
    return RF.segment_stats_brief(seg)


@register("rfm_heatmap", sql_wrap(
    Q.with_(*Q.RFM_PIPE) + """, grid AS (
  SELECT CAST(r AS INTEGER) AS R_score, CAST(f AS INTEGER) AS F_score
  FROM range(1, 6) t1(r), range(1, 6) t2(f)),
cells AS (SELECT R_score, F_score, avg(Monetary) AS v FROM seg GROUP BY R_score, F_score),
rows_p AS (SELECT DISTINCT R_score FROM seg), cols_p AS (SELECT DISTINCT F_score FROM seg)
SELECT g.R_score, g.F_score,
       CASE WHEN c.v IS NULL AND (rp.R_score IS NULL OR cp.F_score IS NULL) THEN 0.0 ELSE c.v END AS avg_value
FROM grid g LEFT JOIN cells c USING (R_score, F_score)
LEFT JOIN rows_p rp ON rp.R_score = g.R_score LEFT JOIN cols_p cp ON cp.F_score = g.F_score""",
    ["avg_value"]))
def q_heatmap(spark, d):
    return RF.rfm_heatmap(rfm_scored(spark, d))


CLEAN_PIPE = Q.with_(*Q.PIPE[:4])


@register("invoice_summary", CLEAN_PIPE + f""", sn AS (SELECT max(invoice_ts) + INTERVAL 1 DAY AS s FROM clean)
SELECT customer_id, count(DISTINCT invoice) - 1 AS frequency,
       {Q.days('min(invoice_ts)', 'max(invoice_ts)')} AS recency,
       {Q.days('min(invoice_ts)', 'any_value(sn.s)')} AS T
FROM clean, sn GROUP BY customer_id""")
def q_invoice_summary(spark, d):
    return FT.invoice_summary(clean(spark, d))


@register("spend_summary", sql_wrap(
    CLEAN_PIPE + "SELECT customer_id, count(DISTINCT invoice) - 1 AS frequency, avg(revenue) AS monetary_value "
                 "FROM clean GROUP BY customer_id", ["monetary_value"]))
def q_spend_summary(spark, d):
    return FT.spend_summary(clean(spark, d))


@register("invoice_features", sql_wrap(
    Q.with_(*Q.PIPE[:4], "inv AS (SELECT customer_id, invoice, min(invoice_ts) AS its FROM clean "
                         "GROUP BY customer_id, invoice)", Q.gaps_block("ig", "inv", ts="its"),
            "sn AS (SELECT max(invoice_ts) + INTERVAL 1 DAY AS s FROM clean)") + f"""
SELECT l.customer_id, l.n_invoices - 1 AS frequency, {Q.days('l.f', 'l.l')} AS recency,
       {Q.days('l.f', 'sn.s')} AS T, l.monetary_value, l.total_revenue, l.n_invoices,
       l.n_unique_products, l.n_unique_countries,
       CAST(CASE WHEN coalesce(ig.ng, 0) > 0 THEN ig.mg ELSE 0 END AS DOUBLE) AS max_gap_days, l.revenue_std
FROM (SELECT customer_id, min(invoice_ts) AS f, max(invoice_ts) AS l, avg(revenue) AS monetary_value,
             sum(revenue) AS total_revenue, count(DISTINCT invoice) AS n_invoices,
             count(DISTINCT stock_code) AS n_unique_products, count(DISTINCT country) AS n_unique_countries,
             coalesce(stddev_samp(revenue), 0) AS revenue_std
      FROM clean GROUP BY customer_id) l LEFT JOIN ig USING (customer_id), sn""",
    ["monetary_value", "total_revenue", "max_gap_days", "revenue_std"]))
def q_invoice_features(spark, d):
    return FT.invoice_features(clean(spark, d))


@register("dataset_profile", CLEAN_PIPE +
          "SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, "
          f"{Q.ts_text('min(invoice_ts)')} AS min_ts, {Q.ts_text('max(invoice_ts)')} AS max_ts FROM clean")
def q_profile(spark, d):
    return C.dataset_profile(clean(spark, d))


@register("acquisition_by_month", CLEAN_PIPE +
          "SELECT strftime(CAST(date_trunc('month', f) AS DATE), '%Y-%m-%d') AS cohort_month, "
          "count(*) AS new_customers FROM (SELECT customer_id, min(invoice_ts) AS f FROM clean "
          "GROUP BY customer_id) GROUP BY 1")
def q_acq(spark, d):
    return FT.acquisition_by_month(clean(spark, d))


@register("lifetime_days", CLEAN_PIPE + f"SELECT customer_id, {Q.days('min(invoice_ts)', 'max(invoice_ts)')} "
          "AS lifetime_days FROM clean GROUP BY customer_id")
def q_lifetime(spark, d):
    return FT.lifetime_days(clean(spark, d))


from clvforge.plans import catalog_value  # noqa: E402,F401  (registers more queries)
