"""Guided search of settings (J4): a tree of Parzen estimators over past trials."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: The search space, as (name, low, high, scale), scale 'int', 'share' or 'log'.
SPACE = [("trees", 100, 500, "int"), ("depth", 3, 10, "int"), ("rate", 0.01, 0.3, "log"), ("rows", 0.6, 1.0, "share"),
         ("columns", 0.6, 1.0, "share"), ("min_child", 1, 10, "int"), ("l1", 1e-8, 1.0, "log"), ("l2", 1e-8, 1.0, "log")]

#: Trials drawn at random before others are guided by them.
STARTUP = 8


def to_settings(u: np.ndarray, space=SPACE) -> dict:
    """A point of the unit cube as settings."""
    out = {}
    for x, (name, low, high, scale) in zip(np.clip(u, 0, 1).tolist(), space):
        if scale == "int":
            out[name] = int(min(high, low + math.floor(x * (high - low + 1))))
        elif scale == "log":
            out[name] = math.exp(math.log(low) + x * (math.log(high) - math.log(low)))
        else:
            out[name] = low + x * (high - low)
    return out


class Parzen:
    """A density on [0, 1]: equal parts of a uniform and of a truncated normal at each point, as wide as the
    distance to its neighbours."""

    def __init__(self, points: np.ndarray):
        self.at = np.sort(points)
        padded = np.concatenate([[0.0], self.at, [1.0]])
        gap = np.maximum(padded[2:] - padded[1:-1], padded[1:-1] - padded[:-2])
        self.width = np.clip(gap, 1.0 / (1 + len(points)) / 2, 1.0)
        erf = np.vectorize(math.erf, otypes=[float])
        below = lambda x: 0.5 * (1 + erf((x - self.at) / (self.width * math.sqrt(2))))
        self.inside = np.maximum(below(1.0) - below(0.0), 1e-12) if len(points) else np.ones(0)

    def log(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.at) / self.width
        dense = np.exp(-0.5 * z * z) / (self.width * math.sqrt(2 * math.pi)) / self.inside
        return np.log((1.0 + dense.sum(1)) / (1 + len(self.at)))

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = rng.random(n)
        for i, k in enumerate(rng.integers(0, len(self.at) + 1, n)):
            if k:
                x = -1.0
                while not 0 <= x <= 1:
                    x = rng.normal(self.at[k - 1], self.width[k - 1])
                out[i] = x
        return out


def suggest(number: int, done: list[tuple[np.ndarray, float]], pending: list[np.ndarray], dims: int, seed: int,
            startup: int = STARTUP, good: float = 0.25, candidates: int = 32) -> np.ndarray:
    """The next trial's point. Trials that are still running count among the poor ones, so that others keep away."""
    rng = np.random.default_rng([seed, number])
    if len(done) < startup:
        return rng.random(dims)
    order = sorted(done, key=lambda t: t[1])
    n = max(1, math.ceil(good * len(order)))
    best = np.array([u for u, _ in order[:n]])
    poor = np.array([u for u, _ in order[n:]] + pending)
    out = np.zeros(dims)
    for d in range(dims):
        near, far = Parzen(best[:, d]), Parzen(poor[:, d])
        x = near.draw(rng, candidates)
        out[d] = x[int((near.log(x) - far.log(x)).argmax())]
    return out


def search(evaluate: Callable[[list[dict]], list[float]], trials: int = 20, parallel: int = 4, seed: int = 42,
           space=SPACE) -> list[tuple[dict, float]]:
    """All trials with their losses, in order; ``parallel`` of them are evaluated at once. Those drawn at random
    wait for no loss, so all rounds of them are evaluated as one."""
    done: list[tuple[np.ndarray, float]] = []
    while len(done) < trials:
        running: list[np.ndarray] = []
        at_once = parallel if done else -(-STARTUP // parallel) * parallel
        for _ in range(min(at_once, trials - len(done))):
            running.append(suggest(len(done) + len(running), done, running, len(space), seed))
        done += zip(running, evaluate([to_settings(u, space) for u in running]))
    return [(to_settings(u, space), loss) for u, loss in done]
