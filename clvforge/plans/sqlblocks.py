"""DuckDB SQL twins of the library's operators, as composable CTE blocks.

They state the same semantics independently (plain window functions and
aggregates) so the registered Spark queries can be checked value for value.
"""

from __future__ import annotations

from clvforge.functions.rules import ACTION_TEXTS, SEGMENT_ACTIONS


def days(a: str, b: str) -> str:
    """Whole days from a to b (floored elapsed time for b ≥ a)."""
    return f"((epoch_us({b}) - epoch_us({a})) // 86400000000)"


def ts_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def with_(*blocks: str) -> str:
    return "WITH " + ",\n".join(blocks) + "\n"


TX = """tx AS (
  SELECT (CASE WHEN o.o_orderstatus = 'P' THEN 'C' ELSE '' END) || CAST(o.o_orderkey AS VARCHAR) AS invoice,
         substr(p.p_type, 1, 1) || CAST(p.p_partkey AS VARCHAR) AS stock_code,
         p.p_name AS description,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS INTEGER) AS quantity,
         CAST(o.o_orderdate AS TIMESTAMP) AS invoice_ts,
         CAST(floor(CAST(2 * CAST(round(l.l_extendedprice * 100) AS BIGINT) + CAST(l.l_quantity AS BIGINT) AS DOUBLE)
                    / CAST(2 * CAST(l.l_quantity AS BIGINT) AS DOUBLE)) AS DOUBLE) / 100 AS price,
         CASE WHEN o.o_custkey % 50 = 0 THEN NULL ELSE o.o_custkey END AS customer_id,
         n.n_name AS country
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

EVENTS_TX = """tx AS (
  SELECT CAST(event_id AS VARCHAR) AS invoice,
         'K' || json_extract_string(props, '$.k') AS stock_code,
         CAST(NULL AS VARCHAR) AS description,
         1 AS quantity,
         CAST(ts AS TIMESTAMP) AS invoice_ts,
         CAST(value AS DOUBLE) AS price,
         CAST(user_id AS BIGINT) AS customer_id,
         CAST(NULL AS VARCHAR) AS country
  FROM events WHERE event_type = 'purchase')"""

BASE = """base AS (
  SELECT *, quantity * price AS revenue FROM tx
  WHERE NOT coalesce(starts_with(invoice, 'C'), false) AND quantity > 0 AND price > 0)"""

CAP = """cap AS (SELECT quantile_cont(price, 0.99) AS cap FROM base)"""

CLEAN = """clean AS (
  SELECT base.* FROM base, cap
  WHERE base.price <= cap.cap AND base.customer_id IS NOT NULL
    AND NOT coalesce(regexp_matches(base.stock_code, '^[AM]'), false))"""


def split_blocks(holdout_days: int = 90, gap_days: int = 1) -> list[str]:
    return [
        "mx AS (SELECT max(invoice_ts) AS mx FROM clean)",
        f"obs AS (SELECT clean.* FROM clean, mx WHERE invoice_ts <= mx.mx - INTERVAL {holdout_days} DAY)",
        f"hold AS (SELECT clean.* FROM clean, mx WHERE invoice_ts >= mx.mx - INTERVAL {holdout_days} DAY "
        f"+ INTERVAL {gap_days} DAY)",
    ]


SPLIT = split_blocks()
PIPE = [TX, BASE, CAP, CLEAN] + SPLIT


def gaps_block(name: str, src: str, key: str = "customer_id", ts: str = "invoice_ts") -> str:
    return f"""{name} AS (
  SELECT {key}, count(g) AS ng, sum(g) AS sg, max(g) AS mg FROM (
    SELECT {key}, {days(f'lag({ts}) OVER (PARTITION BY {key} ORDER BY {ts})', ts)} AS g FROM {src}) _g
  GROUP BY {key})"""


def mode_block(name: str, src: str, col: str = "country") -> str:
    return f"""{name} AS (
  SELECT customer_id, {col} FROM (
    SELECT customer_id, {col}, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, {col} ASC) AS rn
    FROM {src} WHERE {col} IS NOT NULL GROUP BY customer_id, {col}) _m WHERE rn = 1)"""


FEATURES = [
    """cagg AS (
  SELECT customer_id, min(invoice_ts) AS f, max(invoice_ts) AS l, count(*) AS n_transactions,
         sum(revenue) AS total_revenue_obs, avg(revenue) AS avg_revenue_per_txn,
         coalesce(stddev_samp(revenue), 0) AS std_revenue_per_txn,
         CAST(sum(quantity) AS BIGINT) AS total_quantity,
         count(DISTINCT stock_code) AS n_unique_products,
         count(DISTINCT date_trunc('month', invoice_ts)) AS n_unique_months
  FROM obs GROUP BY customer_id)""",
    mode_block("ctry", "obs"),
    gaps_block("gaps", "obs"),
    "oend AS (SELECT max(invoice_ts) AS e FROM obs)",
    f"""features AS (
  SELECT c.customer_id, {ts_text('c.f')} AS first_purchase_date, {ts_text('c.l')} AS last_purchase_date,
         c.n_transactions, c.total_revenue_obs, c.avg_revenue_per_txn, c.std_revenue_per_txn,
         c.total_quantity, c.n_unique_products, coalesce(ctry.country, 'Unknown') AS country,
         c.n_transactions - 1 AS frequency,
         greatest({days('c.f', 'c.l')}, 0) AS recency,
         greatest({days('c.f', 'oend.e')}, 1) AS T,
         c.avg_revenue_per_txn AS monetary_value,
         CASE WHEN coalesce(g.ng, 0) > 0 THEN g.sg / g.ng ELSE 0.0 END AS avg_days_between_purchases,
         CAST(CASE WHEN coalesce(g.ng, 0) > 0 THEN g.mg ELSE 0 END AS DOUBLE) AS max_purchase_gap,
         c.n_unique_months
  FROM cagg c LEFT JOIN ctry USING (customer_id) LEFT JOIN gaps g USING (customer_id), oend)""",
]

HOLD_REV = "hrev AS (SELECT customer_id, sum(revenue) AS holdout_revenue FROM hold GROUP BY customer_id)"


def rfm_blocks(src: str = "obs", with_total: bool = False) -> list[str]:
    tot = ", sum(revenue) AS TotalRevenue" if with_total else ""
    return [
        f"snap AS (SELECT max(invoice_ts) + INTERVAL 1 DAY AS s FROM {src})",
        f"""rfm AS (
  SELECT customer_id, {days('max(invoice_ts)', 'any_value(snap.s)')} AS Recency,
         count(DISTINCT invoice) AS Frequency, coalesce(avg(revenue), 0) AS Monetary{tot}
  FROM {src}, snap GROUP BY customer_id)""",
    ]


def _bin(x: str, lo: str, hi: str, n: int) -> str:
    return (f"(CASE WHEN {hi} = {lo} THEN {(n + 1) // 2} ELSE greatest(1, CAST(ceil(CAST(({x} - {lo}) * {n} AS DOUBLE)"
            f" / CAST({hi} - {lo} AS DOUBLE)) AS BIGINT)) END)")


def score_blocks(src: str = "rfm", n: int = 5, r: str = "Recency", f: str = "Frequency",
                 m: str = "Monetary", out: str = "scored") -> list[str]:
    def r2(c):
        return f"2 * (rank() OVER (ORDER BY {c}) - 1) + count(*) OVER (PARTITION BY {c}) + 1"
    return [
        f"rk AS (SELECT *, {r2(r)} AS _rr, {r2(f)} AS _fr, {r2(m)} AS _mr FROM {src})",
        "rb AS (SELECT min(_rr) AS rlo, max(_rr) AS rhi, min(_fr) AS flo, max(_fr) AS fhi, "
        "min(_mr) AS mlo, max(_mr) AS mhi FROM rk)",
        f"""{out} AS (
  SELECT rk.* EXCLUDE (_rr, _fr, _mr),
         CAST({n + 1} - {_bin('_rr', 'rlo', 'rhi', n)} AS INTEGER) AS R_score,
         CAST({_bin('_fr', 'flo', 'fhi', n)} AS INTEGER) AS F_score,
         CAST({_bin('_mr', 'mlo', 'mhi', n)} AS INTEGER) AS M_score
  FROM rk, rb)""",
    ]


def segment_case(r: str = "R_score", f: str = "F_score", m: str = "M_score") -> str:
    return (f"CASE WHEN {r} >= 4 AND {f} >= 4 AND {m} >= 4 THEN 'Champions' "
            f"WHEN {f} >= 4 THEN 'Loyal' "
            f"WHEN {r} >= 3 AND {f} >= 2 THEN 'Potential Loyalists' "
            f"WHEN {r} >= 4 AND {f} <= 1 THEN 'New Customers' "
            f"WHEN {r} <= 2 AND {f} >= 3 THEN 'At Risk' "
            f"WHEN {r} <= 2 AND {f} <= 2 THEN 'Hibernating' "
            f"WHEN {r} = 1 AND {f} = 1 THEN 'Lost' "
            f"ELSE 'Needs Attention' END")


SEG = f"""seg AS (
  SELECT *, CAST(R_score * 100 + F_score * 10 + M_score AS INTEGER) AS RFM_score,
         {segment_case()} AS segment FROM scored)"""

RFM_PIPE = PIPE + rfm_blocks() + score_blocks() + [SEG]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def actions_values() -> str:
    rows = ", ".join(f"({_q(s)}, {_q(p)}, {b}, {_q(a)}, {_q(k)})" for s, p, b, a, k in SEGMENT_ACTIONS)
    return f"acts AS (SELECT * FROM (VALUES {rows}) AS t(segment, priority, budget_pct, action, kpi))"


SEG_STATS = """segstats AS (
  SELECT segment, count(customer_id) AS customer_count, sum(total_revenue) AS segment_revenue,
         avg(total_revenue) AS avg_revenue_per_customer, avg(R_score) AS avg_R_score,
         avg(F_score) AS avg_F_score, avg(M_score) AS avg_M_score, avg(Recency) AS avg_recency,
         avg(Frequency) AS avg_frequency, avg(Monetary) AS avg_monetary
  FROM (SELECT seg.*, crev.total_revenue FROM seg LEFT JOIN
        (SELECT customer_id, sum(revenue) AS total_revenue FROM obs GROUP BY customer_id) crev
        USING (customer_id)) j
  GROUP BY segment)"""

SEG_STATS_FINAL = """segfinal AS (
  SELECT *, round(segment_revenue / sum(segment_revenue) OVER () * 100, 2) AS revenue_share_pct
  FROM segstats)"""


def action_case(seg: str = "segment", p: str = "prob_alive", v: str = "clv") -> str:
    t = {k: _q(x) for k, x in ACTION_TEXTS.items()}
    return (f"CASE WHEN {seg} = 'Champions' AND {p} > 0.8 THEN {t['champions']} "
            f"WHEN {seg} = 'Loyal' AND {p} > 0.7 THEN {t['loyal']} "
            f"WHEN {seg} = 'At Risk' AND {p} < 0.5 THEN {t['at_risk']} "
            f"WHEN {seg} = 'Potential Loyalists' THEN {t['potential']} "
            f"WHEN {seg} = 'New Customers' AND {p} > 0.9 THEN {t['new']} "
            f"WHEN {seg} = 'Hibernating' AND {v} > 500 THEN {t['hibernating']} "
            f"WHEN {seg} = 'Lost' AND {v} > 500 THEN {t['lost']} "
            f"WHEN {seg} = 'Needs Attention' THEN {t['needs_attention']} "
            f"ELSE {t['monitor']} END")


def action_brief_case(seg: str = "segment", p: str = "prob_alive", v: str = "clv") -> str:
    t = {k: _q(x) for k, x in ACTION_TEXTS.items()}
    return (f"CASE WHEN {seg} = 'Champions' AND {p} > 0.8 THEN {t['champions']} "
            f"WHEN {seg} = 'At Risk' AND {p} < 0.5 THEN {t['at_risk']} "
            f"WHEN {seg} = 'New Customers' THEN {t['new']} "
            f"WHEN {seg} = 'Hibernating' AND {v} > 500 THEN {t['hibernating']} "
            f"ELSE {t['standard']} END")


# -- probability models (published parameters) ---------------------------------

def _f(v: float) -> str:
    return repr(float(v))


def p_alive_sql(bg: dict, x: str = "frequency", tx: str = "recency", T_: str = "T") -> str:
    r, al, a, b = (_f(bg[k]) for k in ("r", "alpha", "a", "b"))
    log_d = (f"(ln({a}) - ln({b} + greatest({x}, 1) - 1) + ({r} + {x}) * "
             f"(ln({al} + {T_}) - ln({al} + {tx})))")
    return f"(CASE WHEN {x} = 0 THEN 1.0 ELSE 1.0 / (1 + exp(least({log_d}, 700.0))) END)"


def _lpoch(c: float, k: str) -> tuple[str, int]:
    """ln|(c)_k| for k ≥ 1 and its sign, for a constant c > -1, c != 0."""
    if c > 0:
        return f"(lgamma({_f(c)} + {k}) - lgamma({_f(c)}))", 1
    if -1 < c < 0:
        return f"(ln({_f(-c)}) + lgamma({_f(c)} + {k}) - lgamma({_f(c + 1)}))", -1
    raise ValueError("parameter combination outside the SQL series form")


def expected_purchases_sql(bg: dict, t: float, x: str = "frequency", tx: str = "recency",
                           T_: str = "T", terms: int = 2500) -> str:
    """Same closed form as the library: Euler-transformed ₂F₁ series, each
    term from log-gamma values (DuckDB has ``lgamma``)."""
    r, al, a, b = (float(bg[k]) for k in ("r", "alpha", "a", "b"))
    A, B = a + b - 1 - r, a - 1
    la, sa = _lpoch(A, "k")
    lb, sb = _lpoch(B, "k")
    sign = "" if sa * sb > 0 else "-"
    z = f"({_f(t)} / ({_f(al)} + {T_} + {_f(t)}))"
    C = f"({_f(a + b - 1)} + {x})"
    term = (f"{sign}exp({la} + {lb} - (lgamma({C} + k) - lgamma({C})) - lgamma(k + 1.0) "
            f"+ k * ln({z}))")
    hyp = f"(1 + list_sum(list_transform(range(1, {terms + 1}), lambda k: {term})))"
    log_d = (f"(ln({_f(a)}) - ln({_f(b)} + greatest({x}, 1) - 1) + ({_f(r)} + {x}) * "
             f"(ln({_f(al)} + {T_}) - ln({_f(al)} + {tx})))")
    delta = f"(CASE WHEN {x} > 0 THEN exp(least({log_d}, 700.0)) ELSE 0.0 END)"
    return (f"(({_f(a + b - 1)} + {x}) / {_f(a - 1)} * (1 - pow(1 - {z}, {_f(a - 1)}) * {hyp})"
            f" / (1 + {delta}))")


def expected_spend_sql(gg: dict, x: str = "frequency", m: str = "monetary_value") -> str:
    p, q, v = (_f(gg[k]) for k in ("p", "q", "v"))
    return f"({p} * ({v} + {x} * {m}) / ({p} * {x} + {q} - 1))"


def strict_sql(x="frequency", tx="recency", T_="T") -> str:
    return f"({x} > 0 AND {tx} > 0 AND {tx} <= {T_})"


def prob_columns_sql(bg: dict, gg: dict, margin: float = 0.10) -> str:
    """I9 columns over a customer row (frequency, recency, T, monetary_value)."""
    purch = (f"CASE WHEN {strict_sql()} THEN {expected_purchases_sql(bg, 90.0)} "
             f"WHEN frequency = 0 THEN monetary_value * 0.1 / 365 * 90 ELSE 0.0 END")
    alive = f"CASE WHEN {strict_sql()} THEN {p_alive_sql(bg)} ELSE 0.5 END"
    spend = (f"CASE WHEN frequency > 0 AND monetary_value > 0 THEN "
             f"coalesce({expected_spend_sql(gg)} * {_f(margin)}, monetary_value * {_f(margin)}) "
             f"ELSE monetary_value * {_f(margin)} END")
    return (f"{purch} AS bgnbd_predicted_purchases, {alive} AS prob_alive, "
            f"{spend} AS gamma_gamma_monetary")


def customer_table_blocks(bg: dict, gg: dict) -> list[str]:
    """features ⟕ holdout target ⟕ RFM scores/segment, then I9 columns."""
    return FEATURES + [HOLD_REV] + rfm_blocks() + score_blocks() + [SEG, f"""cust0 AS (
  SELECT f.*, coalesce(h.holdout_revenue, 0.0) AS holdout_revenue,
         s.R_score, s.F_score, s.M_score, s.RFM_score, s.segment
  FROM features f LEFT JOIN hrev h USING (customer_id) LEFT JOIN seg s USING (customer_id))""",
        f"cust1 AS (SELECT *, {prob_columns_sql(bg, gg)} FROM cust0)",
        "customers AS (SELECT *, least(bgnbd_predicted_purchases / 90 * 30 * 12 * gamma_gamma_monetary,"
        " 100000.0) AS bgnbd_gg_clv FROM cust1)"]


def r2(col: str, d: int) -> str:
    """Round half away from zero on the scaled value (matches ``round_to``)."""
    s = repr(float(10 ** d))
    return f"(round(({col}) * {s}) / {s})"
