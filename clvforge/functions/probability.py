"""Purchase-frequency (BG/NBD) and spend (Gamma-Gamma) models: scoring as
column expressions, fitting as distributed aggregates (I1–I8).

Formulas follow Fader, Hardie & Lee (2005) for BG/NBD and Fader & Hardie
(2013) for Gamma-Gamma. x = frequency, tx = recency, T = age, all in days.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clvforge.functions.special import beta_nodes, np_digamma, np_hyp2f1, np_lgamma, np_trigamma

# ---------------------------------------------------------------------------
# Published fitted parameters (penalty 0.1), used as defaults
# when no fit is supplied, and the pipeline's business constants.
# ---------------------------------------------------------------------------
PUBLISHED_BGNBD = {"r": 0.700706, "alpha": 1.026672, "a": 0.170720, "b": 1.051809}
PUBLISHED_GG = {"p": 1.212256, "q": 0.402399, "v": 1.198953}
MARGIN = 0.10
CLV_CAP = 100000.0
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def probability_alive(params: dict, x="frequency", tx="recency", T_="T") -> Column:
    """P(alive | x, tx, T) = 1 / (1 + δ), δ = 0 for x = 0, else
    exp(ln a − ln(b + x − 1) + (r + x)(ln(α + T) − ln(α + tx)))."""
    r, al, a, b = (_lit(params[k]) for k in ("r", "alpha", "a", "b"))
    x, tx, T_ = _c(x), _c(tx), _c(T_)
    log_d = (F.log(a) - F.log(b + F.greatest(x, F.lit(1)) - 1)
             + (r + x) * (F.log(al + T_) - F.log(al + tx)))
    # exp overflows to +inf past ~709: P then rounds to 0, as it should
    return F.when(x == 0, F.lit(1.0)).otherwise(F.lit(1.0) / (1 + F.exp(F.least(log_d, F.lit(700.0)))))


def np_expected_purchases(t, x, tx, T_, r, alpha, a, b):
    """E[purchases in (T, T + t] | x, tx, T] in the Euler-transformed form:
    (a+b+x−1)/(a−1) · [1 − (1−z)^(a−1) ₂F₁(a+b−1−r, a−1; a+b+x−1; z)] / (1 + δ),
    z = t / (α + T + t). Avoids the overflow of the direct series."""
    x = np.asarray(x, float)
    tx = np.asarray(tx, float)
    T_ = np.asarray(T_, float)
    t = np.broadcast_to(np.asarray(t, float), x.shape)
    if abs(a - 1.0) < 1e-9:
        a = a + 1e-7  # the closed form is singular at a = 1
    z = t / (alpha + T_ + t)
    hyp = np_hyp2f1(a + b - 1 - r, np.full_like(x, a - 1), a + b + x - 1, z)
    first = (a + b + x - 1) / (a - 1)
    second = 1 - np.power(1 - z, a - 1) * hyp
    log_d = (math.log(a) - np.log(b + np.maximum(x, 1) - 1)
             + (r + x) * (np.log(alpha + T_) - np.log(alpha + tx)))
    delta = np.where(x > 0, np.exp(np.minimum(log_d, 700.0)), 0.0)
    return first * second / (1 + delta)


def expected_purchases(params: dict, t: float = 90.0, x="frequency", tx="recency",
                       T_="T", only=None) -> Column:
    """I2 as a column expression: P(alive) times the mean over p of (1 − (1 + p s)^−(r+x)) / p, s = t / (α + T).

    That is the expectation given that the customer is alive, when λ ~ Gamma(r + x, α + T) is
    integrated out and p ~ Beta(a, b + x); the mean over p is a trapezoidal rule in logit p whose
    nodes and weights are literals, one array for the whole plan. Numerator and denominator are summed
    by the same rule. With ``only`` (a boolean column) other rows get null."""
    r, al, a, b = (float(params[k]) for k in ("r", "alpha", "a", "b"))
    x, tx, T_ = _c(x).cast("double"), _c(tx).cast("double"), _c(T_).cast("double")
    nodes = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c"), F.lit(d).alias("d")) for p, c, d in beta_nodes(a, b, float(t) / al)])
    s, n = F.lit(float(t)) / (F.lit(al) + T_), F.lit(r) + x
    weight = lambda k: F.exp(k["c"] + x * k["d"])
    gain = lambda k: -F.expm1(-n * F.log1p(k["p"] * s)) / k["p"]
    total = lambda f: F.aggregate(nodes, F.lit(0.0), lambda sum_, k: sum_ + f(k))
    value = total(lambda k: weight(k) * gain(k)) / total(weight) * probability_alive(params, x, tx, T_)
    return value if only is None else F.when(only, value)


def expected_spend(params: dict, x="frequency", m="monetary_value") -> Column:
    """I6 core: Gamma-Gamma conditional mean spend p(v + x·m) / (p·x + q − 1)."""
    p, q, v = (_lit(params[k]) for k in ("p", "q", "v"))
    x, m = _c(x), _c(m)
    return p * (v + x * m) / (p * x + q - 1)


def discount_factor(months: int = 12, rate: float = 0.01, start: int = 0) -> float:
    """Σ_{k=start}^{start+months−1} 1/(1+rate)^k (I7; start 0 as coded,
    1 as documented)."""
    return float(sum(1.0 / (1.0 + rate) ** k for k in range(start, start + months)))


# -- fitting -------------------------------------------------------------------

def _bgnbd_terms(p: dict, x, tx, T_):
    """Per-row log-likelihood, gradient and Hessian w.r.t. (r, α, a, b), numpy; shapes (n), (4, n), (4, 4, n)."""
    r, al, a, b = p["r"], p["alpha"], p["a"], p["b"]
    pos = x > 0
    xm = np.maximum(x, 1.0)
    a1 = np_lgamma(r + x) - np_lgamma(r) + r * np.log(al)
    a2 = np_lgamma(a + b) + np_lgamma(b + x) - np_lgamma(b) - np_lgamma(a + b + x)
    a3 = -(r + x) * np.log(al + T_)
    a4 = np.log(a) - np.log(b + xm - 1) - (r + x) * np.log(al + tx)
    mx = np.where(pos, np.maximum(a3, a4), a3)
    e3 = np.exp(a3 - mx)
    e4 = np.where(pos, np.exp(a4 - mx), 0.0)
    ll = a1 + a2 + mx + np.log(e3 + e4)
    w3 = e3 / (e3 + e4)
    w4 = e4 / (e3 + e4)
    zero = np.zeros_like(x)
    g3 = np.stack([-np.log(al + T_), -(r + x) / (al + T_), zero, zero])
    g4 = np.stack([-np.log(al + tx), -(r + x) / (al + tx), zero + 1 / a, -1 / (b + xm - 1)])
    dab, dabx = np_digamma(a + b), np_digamma(a + b + x)
    g = w3 * g3 + w4 * g4 + np.stack([np_digamma(r + x) - np_digamma(r) + np.log(al), r / al + zero, dab - dabx,
                                      dab + np_digamma(b + x) - np_digamma(b) - dabx])
    h = np.zeros((4, 4, len(x)))
    tab, tabx = np_trigamma(a + b), np_trigamma(a + b + x)
    h[0, 0] = np_trigamma(r + x) - np_trigamma(r)
    h[0, 1] = h[1, 0] = 1 / al - w3 / (al + T_) - w4 / (al + tx)
    h[1, 1] = -r / al ** 2 + w3 * (r + x) / (al + T_) ** 2 + w4 * (r + x) / (al + tx) ** 2
    h[2, 2] = tab - tabx - w4 / a ** 2
    h[2, 3] = h[3, 2] = tab - tabx
    h[3, 3] = tab + np_trigamma(b + x) - np_trigamma(b) - tabx + w4 / (b + xm - 1) ** 2
    apart = g3 - g4
    h += w3 * w4 * apart[:, None, :] * apart[None, :, :]
    return ll, g, h


def _gg_terms(p: dict, x, m):
    """Per-row Gamma-Gamma log-likelihood, gradient and Hessian w.r.t. (p, q, v)."""
    pp, q, v = p["p"], p["q"], p["v"]
    px, rate = pp * x, x * m + v
    ll = (np_lgamma(px + q) - np_lgamma(px) - np_lgamma(q) + q * np.log(v)
          + (px - 1) * np.log(m) + px * np.log(x) - (px + q) * np.log(rate))
    g = np.stack([x * (np_digamma(px + q) - np_digamma(px) + np.log(m) + np.log(x) - np.log(rate)),
                  np_digamma(px + q) - np_digamma(q) + np.log(v) - np.log(rate),
                  q / v - (px + q) / rate])
    h = np.zeros((3, 3, len(x)))
    t = np_trigamma(px + q)
    h[0, 0] = x * x * (t - np_trigamma(px))
    h[0, 1] = h[1, 0] = x * t
    h[1, 1] = t - np_trigamma(q)
    h[0, 2] = h[2, 0] = -x / rate
    h[1, 2] = h[2, 1] = 1 / v - 1 / rate
    h[2, 2] = -q / v ** 2 + (px + q) / rate ** 2
    return ll, g, h


def _evaluate(data: DataFrame, names: list[str], terms, cols: list[str],
              thetas: list[np.ndarray], penalty: float):
    """Objective, gradient and Hessian (w.r.t. log-parameters) at several parameter vectors in ONE
    Spark job of one stage: each partition of the (materialised) data returns one row with its
    weighted sums for all vectors; there is a partition a million rows, so the driver adds up few."""
    from clvforge.session import ship_package
    ship_package(data.sparkSession)
    cands = [{n: float(math.exp(v)) for n, v in zip(names, th)} for th in thetas]
    k = len(names)
    width = 2 + k + k * k

    def partial(batches):
        acc = np.zeros((len(cands), width))
        with np.errstate(all="ignore"):
            for pdf in batches:
                xs = [pdf[c].to_numpy(float) for c in cols]
                w = pdf["_w"].to_numpy(float)
                for i, pc in enumerate(cands):
                    ll, g, h = terms(pc, *xs)
                    acc[i] += np.concatenate([[np.sum(w * ll), np.sum(w)], g @ w, (h @ w).ravel()])
        yield pd.DataFrame({"sums": [acc.ravel().tolist()]})

    tot = np.zeros((len(cands), width))
    for row in data.select(*cols, "_w").mapInPandas(partial, "sums array<double>").collect():
        tot += np.array(row["sums"]).reshape(tot.shape)
    out = []
    for (ll_v, n, *rest), th in zip(tot, thetas):
        p, rest = np.exp(th), np.array(rest)
        g, h = rest[:k], rest[k:].reshape(k, k)
        if n <= 0 or not np.isfinite(ll_v) or not np.all(np.isfinite(rest)):
            out.append((np.inf, np.zeros(k), np.eye(k)))
            continue
        f = -ll_v / n + penalty * float(np.sum(p ** 2))
        grad = -g / n * p + 2 * penalty * p * p
        hess = -h / n * np.outer(p, p) + np.diag(-g / n * p + 4 * penalty * p * p)
        out.append((f, grad, hess))
    return out


def _newton(evaluate, theta0: np.ndarray, max_iter: int = 50, gtol: float = 1e-9):
    """Newton's method with a trust region on the log-parameters.

    Each iteration is one distributed evaluation of the steps for three radii (the region's, a quarter
    and four times of it); the best that lessens the objective is taken, and the radius follows it."""
    theta, radius = theta0.astype(float), 1.0
    f, g, h = evaluate([theta])[0]
    history = [f]

    def step(within: float) -> np.ndarray:
        value, axes = np.linalg.eigh(h)
        along = axes.T @ g
        shift = max(0.0, 1e-10 - value.min())
        if np.linalg.norm(along / (value + shift)) <= within:
            return -axes @ (along / (value + shift))
        low, high = shift, shift + np.linalg.norm(g) / within + abs(value).max()
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.linalg.norm(along / (value + mid)) > within else (low, mid)
        return -axes @ (along / (value + high))

    for _ in range(max_iter):
        if np.max(np.abs(g)) < gtol:
            break
        tried = [(within, theta + step(within)) for within in (radius, 4 * radius, radius / 4)]
        evals = evaluate([th for _, th in tried])
        best = min(range(3), key=lambda i: evals[i][0])
        if not evals[best][0] < f:
            if radius < 1e-7 or np.max(np.abs(g)) < 1e-7:
                break
            radius /= 16
            continue
        radius, theta = tried[best]
        f, g, h = evals[best]
        history.append(f)
    return theta, f, g, history


def _with_fit(params: dict, f: float, g: np.ndarray, history: list, small: float = 1e-4) -> dict:
    """Adds how the fit ended; a gradient that is not small is told by a warning and the flag."""
    norm = float(np.max(np.abs(g)))
    if not norm < small:
        warnings.warn(f"the likelihood fit has not converged: gradient {norm:.3g} after {len(history) - 1} iterations",
                      RuntimeWarning, stacklevel=3)
    params.update({"objective": float(f), "grad_norm": norm, "iterations": len(history) - 1,
                   "start_objective": float(history[0]), "converged": norm < small})
    return params


def _few_partitions(data: DataFrame, rows_each: int = 1_000_000) -> DataFrame:
    return data.coalesce(max(1, -(-data.count() // rows_each)))


def collapse_bgnbd(df: DataFrame, x="frequency", tx="recency", T_="T") -> DataFrame:
    """Distinct (x, tx, T) triples with their multiplicity: the likelihood
    only depends on these, and their number is bounded by the calendar, not
    by the customer count."""
    return df.groupBy(F.col(x).alias("x"), F.col(tx).alias("tx"), F.col(T_).alias("T")) \
             .agg(F.count(F.lit(1)).alias("_w"))


def fit_bgnbd(df: DataFrame, penalty: float = 0.01, x="frequency", tx="recency", T_="T",
              init: dict | None = None, max_iter: int = 100) -> dict:
    """Penalised maximum likelihood for r, α, a, b (time unit: days).

    The collapsed triple table is materialised once in the shared checkpoint
    folder; every optimiser iteration is one pass over it."""
    from clvforge.session import durable_cut
    data = _few_partitions(durable_cut(collapse_bgnbd(df, x, tx, T_)))
    names = ["r", "alpha", "a", "b"]
    start = init or {"r": 1.0, "alpha": 1.0, "a": 1.0, "b": 1.0}
    theta0 = np.log([start[n] for n in names])

    def ev(thetas):
        return _evaluate(data, names, _bgnbd_terms, ["x", "tx", "T"], thetas, penalty)

    theta, f, g, hist = _newton(ev, theta0, max_iter)
    out = dict(zip(names, np.exp(theta).tolist()))
    return _with_fit(out, f, g, hist)


def fit_gamma_gamma(df: DataFrame, penalty: float = 0.01, x="frequency", m="monetary_value",
                    init: dict | None = None, max_iter: int = 100, min_rows: int = 10) -> dict:
    """Penalised maximum likelihood for p, q, v on repeat customers with
    positive spend (at least ``min_rows``)."""
    from clvforge.session import durable_cut
    data = durable_cut(
        df.where((F.col(x) > 0) & (F.col(m) > 0))
          .groupBy(F.col(x).alias("x"), F.col(m).alias("m")).agg(F.count(F.lit(1)).alias("_w")))
    data = _few_partitions(data)
    n = data.agg(F.sum("_w")).collect()[0][0] or 0
    if n < min_rows:
        raise ValueError(f"Need at least {min_rows} repeat customers, got {n}")
    names = ["p", "q", "v"]
    start = init or {"p": 1.0, "q": 1.0, "v": 1.0}
    theta0 = np.log([start[k] for k in names])

    def ev(thetas):
        return _evaluate(data, names, _gg_terms, ["x", "m"], thetas, penalty)

    theta, f, g, hist = _newton(ev, theta0, max_iter)
    out = dict(zip(names, np.exp(theta).tolist()))
    return _with_fit(out, f, g, hist)
