"""Exact attributions of tree predictions to features (J10): path-dependent Shapley values."""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clvforge.plans.boosting import BoostedModel
from clvforge.session import ship_package


class LeafPaths:
    """Every leaf of a model: its value, its path's features, and of each the share of rows that goes on without knowing it.

    A leaf adds v * prod(o_j over known j) * prod(z_j over unknown j) to the expected prediction, o_j
    telling whether the row satisfies all the path's tests on j, z_j the covers' ratio along them.
    """

    def __init__(self, model: BoostedModel):
        self.base, self.leaves = model.base, []
        for root in model.roots.tolist():
            stack = [(root, {}, 1.0)]
            while stack:
                node, path, _ = stack.pop()
                f = int(model.feature[node])
                if f < 0:
                    if path:
                        self.leaves.append((float(model.value[node]), list(path), [p[0] for p in path.values()],
                                            [p[1] for p in path.values()], np.array([p[2] for p in path.values()])))
                    else:
                        self.base += float(model.value[node])
                    continue
                for kid, low, high in ((int(model.left[node]), -np.inf, model.threshold[node]),
                                       (int(model.right[node]), model.threshold[node], np.inf)):
                    share = model.cover[kid] / model.cover[node] if model.cover[node] else 0.5
                    was = path.get(f, (-np.inf, np.inf, 1.0))
                    stack.append((kid, {**path, f: (max(was[0], low), min(was[1], high), was[2] * share)}, 1.0))

    @property
    def expected(self) -> float:
        """The prediction without knowing any feature."""
        return self.base + sum(v * float(z.prod()) for v, _, _, _, z in self.leaves)

    def shapley(self, x: np.ndarray, features: int) -> np.ndarray:
        """Attributions (rows x features); with the expected prediction they add up to the prediction."""
        out = np.zeros((len(x), features))
        for value, path, low, high, z in self.leaves:
            d = len(path)
            # low < x <= high; a test at a threshold sends NaN right, as the model does
            o = np.stack([((lo == -np.inf) | ~(x[:, f] <= lo)) & ((hi == np.inf) | (x[:, f] <= hi))
                          for f, lo, hi in zip(path, low, high)], 1)
            codes, row = np.unique(o @ (1 << np.arange(d)), return_inverse=True)
            one = ((codes[:, None] >> np.arange(d)) & 1).astype(float)
            weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
            phi = np.zeros_like(one)
            for i in range(d):
                sums = np.zeros((len(codes), d))  # by number of known features among the others
                sums[:, 0] = 1.0
                for j in range(d):
                    if j != i:
                        sums[:, 1:] = sums[:, 1:] * z[j] + sums[:, :-1] * one[:, j:j + 1]
                        sums[:, 0] *= z[j]
                phi[:, i] = value * (one[:, i] - z[i]) * (sums @ weight)
            out[:, path] += phi[row]
        return out


def attribute(model: BoostedModel, df: DataFrame, out: str = "attributions") -> DataFrame:
    """``df`` with an array of attributions, in the order of the model's names; the model is as big as its trees."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(LeafPaths(model))
    n = len(model.names)

    @F.pandas_udf("array<double>")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], 1)
        return pd.Series(list(shared.value.shapley(x, n)))

    return df.withColumn(out, score(*[F.col(c).cast("double") for c in model.names]))


def mean_attribution(model: BoostedModel, df: DataFrame) -> DataFrame:
    """(feature, mean_attribution): mean absolute attribution over all rows, the summary plot's bars."""
    each = attribute(model, df, "_phi").select(F.posexplode("_phi").alias("i", "phi"))
    mean = each.groupBy("i").agg(F.avg(F.abs("phi")).alias("mean_attribution"))
    names = F.array(*[F.lit(c) for c in model.names])
    return mean.select(F.element_at(names, F.col("i") + 1).alias("feature"), "mean_attribution")
