"""Special functions for the model likelihoods, vectorised with numpy and
run inside Spark tasks (Spark SQL has no ``lgamma``/``digamma``).

ln Γ and ψ use the Stirling / de Moivre asymptotic series after shifting the
argument by ``SHIFT`` with the recurrence Γ(z+1) = zΓ(z); absolute error below
1e-13 for z > 0.
"""

from __future__ import annotations

import math

import numpy as np

SHIFT = 10
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def np_lgamma(z):
    z = np.asarray(z, dtype=float)
    y = z + SHIFT
    inv = 1.0 / y
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    out = (y - 0.5) * np.log(y) - y + _HALF_LOG_2PI + series
    prod = z.copy()
    for k in range(1, SHIFT):
        prod = prod * (z + k)
    return out - np.log(prod)


def np_digamma(z):
    z = np.asarray(z, dtype=float)
    y = z + SHIFT
    inv = 1.0 / y
    inv2 = inv * inv
    series = inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    out = np.log(y) - 0.5 * inv - series
    for k in range(SHIFT):
        out = out - 1.0 / (z + k)
    return out


def np_trigamma(z):
    z = np.asarray(z, dtype=float)
    y = z + SHIFT
    inv = 1.0 / y
    inv2 = inv * inv
    out = inv + 0.5 * inv2 + inv * inv2 * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 * (1 / 30 - inv2 * 5 / 66))))
    for k in range(SHIFT):
        out = out + 1.0 / (z + k) ** 2
    return out


def beta_nodes(a: float, b: float, steep: float = 1.0, step: float = 0.3) -> list[tuple[float, float, float]]:
    """Nodes of a trapezoidal rule in y = logit p for integrals over (0, 1) of p^(a-1) (1-p)^(b-1+x) g(p), x >= 0.

    Rows (p, c, d): the node's weight is exp(c + x d), up to a common factor. Such integrands are analytic
    up to an imaginary part of pi / 2 at least, so the rule errs by about exp(-pi^2 / step). ``steep``
    says where g changes (near p = 1 / steep); below the first node and above the last one the
    integrand is a power of p or of 1 - p, whose sums over the rest of the grid are in these nodes' weights."""
    low, high = -math.log(max(1.0, steep) * 1e4) - 30.0, 40.0
    n = math.ceil((high - low) / step)
    rows = []
    for k in range(n + 1):
        y = low + k * step
        log_p, log_q = -math.log1p(math.exp(-y)), -math.log1p(math.exp(y))
        c = a * log_p + b * log_q
        if k == 0:
            c -= math.log(-math.expm1(-a * step))
        elif k == n:
            c -= math.log(-math.expm1(-b * step))
        rows.append((math.exp(log_p), c, log_q))
    return rows


def _gamma_ratio(top, bottom) -> np.ndarray:
    """Γ(t₁)Γ(t₂) / (Γ(b₁)Γ(b₂)), signs included; 0 where a bottom argument is a pole."""
    out = np.zeros(len(top[0]))
    for i in range(len(out)):
        if any(v[i] <= 0 and v[i] == math.floor(v[i]) for v in bottom):
            continue
        logs = sum(math.lgamma(v[i]) for v in top) - sum(math.lgamma(v[i]) for v in bottom)
        negative = sum(v[i] < 0 and math.floor(v[i]) % 2 != 0 for v in (*top, *bottom))
        out[i] = (-1) ** negative * math.exp(logs)
    return out


def np_hyp2f1(a, b, c, z, tol: float = 1e-15, max_terms: int = 20_000_000):
    """Gauss hypergeometric function ₂F₁(a, b; c; z) for |z| < 1, vectorised.

    Near z = 1 the series in 1 − z takes over where c − a − b is not close to
    an integer. Rows whose series has not converged after ``max_terms`` terms
    raise an error instead of returning an unfinished sum."""
    a, b, c, z = (np.atleast_1d(np.asarray(v, dtype=float)).copy()
                  for v in np.broadcast_arrays(a, b, c, z))
    e = c - a - b
    near = (z > 0.995) & (np.abs(e - np.round(e)) > 1e-3)
    if near.any():
        out = np.empty_like(z)
        if not near.all():
            out[~near] = _series_2f1(a[~near], b[~near], c[~near], z[~near], tol, max_terms)
        a, b, c, z, e = a[near], b[near], c[near], z[near], e[near]
        y = 1 - z
        out[near] = (_gamma_ratio((c, e), (c - a, c - b)) * _series_2f1(a, b, 1 - e, y, tol, max_terms)
                     + y ** e * _gamma_ratio((c, -e), (a, b)) * _series_2f1(c - a, c - b, 1 + e, y, tol, max_terms))
        return out
    return _series_2f1(a, b, c, z, tol, max_terms)


def _series_2f1(a, b, c, z, tol, max_terms):
    """All rows advance term by term until each row's term is below ``tol``
    relative to its partial sum."""
    term = np.ones_like(z)
    total = np.ones_like(z)
    active = np.ones(z.shape, dtype=bool)
    k = 0
    while active.any() and k < max_terms:
        idx = np.nonzero(active)[0]
        term[idx] = term[idx] * (a[idx] + k) * (b[idx] + k) / ((c[idx] + k) * (k + 1)) * z[idx]
        total[idx] += term[idx]
        k += 1
        done = np.abs(term[idx]) <= tol * np.abs(total[idx])
        active[idx[done]] = False
    if active.any():
        raise ArithmeticError(f"the hypergeometric series did not converge for {int(active.sum())} rows")
    return total
