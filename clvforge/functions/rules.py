"""Scalar business rules as column expressions (H1–H4, H7–H11, C5 dimension).

All rules are ``when`` chains evaluated in the order written (first match
wins), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results:
# segment names, rule thresholds, action texts, the per-segment action table.
# ---------------------------------------------------------------------------
SEGMENTS = ["Champions", "Loyal", "Potential Loyalists", "New Customers",
            "At Risk", "Hibernating", "Lost", "Needs Attention"]

ACTION_TEXTS = {
    "champions": "🎁 Loyalty rewards program - VIP treatment",
    "loyal": "💝 Personalized offers and upselling",
    "at_risk": "🚨 Urgent retention call - special discount",
    "potential": "📧 Loyalty program enrollment - early incentives",
    "new": "👋 Welcome sequence - onboarding campaign",
    "hibernating": "💤 Re-engagement campaign - seasonal offer",
    "lost": "🔄 Win-back campaign - exclusive discount",
    "needs_attention": "🔍 Investigate - segment-specific campaign",
    "monitor": "📊 Monitor - standard engagement",
    "standard": "📊 Standard engagement",
}

# segment, priority, budget share (%), action, KPI
SEGMENT_ACTIONS = [
    ("Champions", "High", 30, "Loyalty rewards program, exclusive offers, VIP treatment",
     "Retain and increase purchase frequency"),
    ("Loyal", "High", 25, "Personalized recommendations, upselling opportunities",
     "Maintain engagement, prevent churn"),
    ("Potential Loyalists", "Medium", 20, "Targeted promotions, loyalty program enrollment",
     "Convert to Loyal segment"),
    ("New Customers", "Medium", 15, "Welcome campaigns, onboarding sequence",
     "Increase second purchase rate"),
    ("At Risk", "High", 25, "Win-back campaigns, special discounts, personalized outreach",
     "Reactivate before churn"),
    ("Hibernating", "Medium", 15, "Re-engagement offers, seasonal promotions",
     "Minimum cost to maintain"),
    ("Lost", "Low", 5, "Low-cost reactivation attempts, exit surveys", "Salvage if possible"),
    ("Needs Attention", "Medium", 10, "Segment-specific campaigns based on R/F/M pattern",
     "Move to higher segment"),
]
DEFAULT_PRIORITY = "Medium"
DEFAULT_ACTION = "Standard engagement"

# Target-list action labels.
VIP_ACTION = "Loyalty rewards program - VIP treatment"
WIN_BACK_ACTION = "Win-back campaign - exclusive discount"
NURTURE_ACTION = "Onboarding campaign - welcome sequence"
# ---------------------------------------------------------------------------


def segment_expr(r="R_score", f="F_score", m="M_score") -> Column:
    """H1: segment from 1–5 scores. 'Lost' sits behind 'Hibernating' and is
    unreachable, as in the reference (kept)."""
    r, f, m = _c(r), _c(f), _c(m)
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
             .when(f >= 4, "Loyal")
             .when((r >= 3) & (f >= 2), "Potential Loyalists")
             .when((r >= 4) & (f <= 1), "New Customers")
             .when((r <= 2) & (f >= 3), "At Risk")
             .when((r <= 2) & (f <= 2), "Hibernating")
             .when((r == 1) & (f == 1), "Lost")
             .otherwise("Needs Attention"))


def estimate_segment_expr(recency="recency", frequency="frequency",
                          monetary="monetary_value") -> Column:
    """H2: segment from raw recency (days), frequency and spend."""
    r, f, m = _c(recency), _c(frequency), _c(monetary)
    return (F.when((r <= 30) & (f >= 5) & (m >= 100), "Champions")
             .when(f >= 5, "Loyal")
             .when((r <= 60) & (f >= 2), "Potential Loyalists")
             .when((r <= 30) & (f <= 1), "New Customers")
             .when((r >= 180) & (f >= 3), "At Risk")
             .when((r >= 180) & (f <= 2), "Hibernating")
             .otherwise("Needs Attention"))


def clv_band_expr(clv="clv") -> Column:
    """H3: fixed value bands."""
    v = _c(clv)
    return (F.when(v >= 5000, "VIP").when(v >= 1000, "High Value")
             .when(v >= 200, "Medium Value").otherwise("Low Value"))


def clv_percentile_band(df: DataFrame, clv: str = "clv", cuts=(0.4, 0.6, 0.9),
                        out: str = "clv_band", exact: bool = True) -> DataFrame:
    """H4: VIP ≥ p90, High ≥ p60, Medium ≥ p40, else Low (cuts configurable).
    The cut values are scalar subqueries over one distributed rank table
    (exact) or a ``percentile_approx`` sketch."""
    from clvforge.operators.ranks import approx_quantile_row, exact_quantiles
    if exact:
        row = exact_quantiles(df, clv, list(cuts))
        p = [row.select(f"q{i}").scalar() for i in range(len(cuts))]
    else:
        p = [approx_quantile_row(df, clv, float(c), "_q").scalar() for c in cuts]
    v = F.col(clv)
    band = (F.when(v >= p[1], F.when(v >= p[2], "VIP").otherwise("High Value"))
             .when(v >= p[0], "Medium Value").otherwise("Low Value"))
    return df.withColumn(out, band)


def interval_scale(clv="clv", lo: float = 0.3, hi: float = 2.0) -> tuple[Column, Column]:
    """H7: a crude interval as factors of the point value."""
    v = _c(clv)
    return v * lo, v * hi


def quick_estimate_expr(frequency="frequency", recency="recency", monetary="monetary_value") -> Column:
    """H8: frequency·(1 − recency/365)·2 · monetary · 0.9."""
    f, r, m = _c(frequency), _c(recency), _c(monetary)
    return f * (1 - r / 365.0) * 2 * m * 0.9


def recommended_action_expr(segment="segment", prob_alive="prob_alive", clv="clv") -> Column:
    """H9: nine-way action text from segment, P(alive) and value."""
    s, p, v = _c(segment), _c(prob_alive), _c(clv)
    t = ACTION_TEXTS
    return (F.when((s == "Champions") & (p > 0.8), t["champions"])
             .when((s == "Loyal") & (p > 0.7), t["loyal"])
             .when((s == "At Risk") & (p < 0.5), t["at_risk"])
             .when(s == "Potential Loyalists", t["potential"])
             .when((s == "New Customers") & (p > 0.9), t["new"])
             .when((s == "Hibernating") & (v > 500), t["hibernating"])
             .when((s == "Lost") & (v > 500), t["lost"])
             .when(s == "Needs Attention", t["needs_attention"])
             .otherwise(t["monitor"]))


def recommended_action_brief_expr(segment="segment", prob_alive="prob_alive", clv="clv") -> Column:
    """The dashboard's five-way variant."""
    s, p, v = _c(segment), _c(prob_alive), _c(clv)
    t = ACTION_TEXTS
    return (F.when((s == "Champions") & (p > 0.8), t["champions"])
             .when((s == "At Risk") & (p < 0.5), t["at_risk"])
             .when(s == "New Customers", t["new"])
             .when((s == "Hibernating") & (v > 500), t["hibernating"])
             .otherwise(t["standard"]))


def alive_band_expr(prob_alive="prob_alive") -> Column:
    """> .7 green, > .3 orange, else red."""
    p = _c(prob_alive)
    return F.when(p > 0.7, "green").when(p > 0.3, "orange").otherwise("red")


_ACTION_SCHEMA = T.StructType([
    T.StructField("segment", T.StringType(), False),
    T.StructField("priority", T.StringType(), False),
    T.StructField("budget_pct", T.IntegerType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("kpi", T.StringType(), False),
])


def segment_actions_frame(spark: SparkSession) -> DataFrame:
    """The eight-row segment action dimension (fixed size: safe to broadcast)."""
    return spark.createDataFrame(SEGMENT_ACTIONS, _ACTION_SCHEMA)


def attach_actions(stats: DataFrame, segment_col: str = "segment") -> DataFrame:
    """Priority, action, budget share and KPI per segment; unknown
    segments get 'Medium' / 'Standard engagement'."""
    dim = segment_actions_frame(stats.sparkSession).withColumnRenamed("segment", segment_col)
    return (stats.join(F.broadcast(dim), segment_col, "left")
                 .withColumn("priority", F.coalesce("priority", F.lit(DEFAULT_PRIORITY)))
                 .withColumn("action", F.coalesce("action", F.lit(DEFAULT_ACTION))))


def country_bucket(customers: DataFrame, n: int = 10, col: str = "country",
                   out: str = "country_group") -> DataFrame:
    """Keep the ``n`` most common values, the rest become 'Other'.

    The top-n list (n rows, ordered by count then value) is broadcast."""
    top = (customers.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
                    .orderBy(F.desc("_n"), F.asc(col)).limit(n)
                    .select(F.col(col).alias("_top")))
    j = customers.join(F.broadcast(top), F.col(col) == F.col("_top"), "left")
    return j.withColumn(out, F.when(F.col("_top").isNotNull(), F.col(col))
                        .otherwise(F.lit("Other"))).drop("_top")
