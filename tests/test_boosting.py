"""Boosting against a plain reference, quantile loss, guided search, attributions."""
import itertools
import math

import numpy as np
import pandas as pd
import pytest

from clvforge.plans import ml, tuning
from clvforge.plans.attribution import LeafPaths, mean_attribution
from clvforge.plans.boosting import BoostParams, SparkRows, TrainingSet, train_rows

NAMES = ["a", "b", "c"]


def made(n=700, seed=1):
    draw = np.random.default_rng(seed)
    x = np.stack([draw.normal(size=n), draw.integers(0, 6, n), draw.exponential(size=n)], 1).round(3)
    y = 3 * (x[:, 0] > 0.3) * x[:, 1] + x[:, 2] ** 2 + draw.normal(size=n) * 0.3
    return x, y


def frame(spark, x, y):
    pdf = pd.DataFrame(x, columns=NAMES)
    pdf.insert(0, "customer_id", np.arange(len(y)))
    return spark.createDataFrame(pdf.assign(y=y))


def reference(x, y, edges, p):
    """Trees by plain recursion (level-wise) or a sorted list of leaves (best-first); predictions of the training rows."""
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1)
    soft = lambda g: math.copysign(max(abs(g) - p.l1, 0.0), g)
    score = lambda g, h: soft(g) ** 2 / (h + p.l2 + 1e-12)
    margin = np.full(len(y), y.mean() if p.loss == "squared" else np.quantile(y, p.alpha, method="inverted_cdf"))

    def best(rows, g):
        found = (0.0, None)
        for f in range(x.shape[1]):
            for b in range(64):
                left = rows[bins[rows, f] <= b]
                if p.min_child <= len(left) <= len(rows) - p.min_child and 0 < len(left) < len(rows):
                    gl, gt = g[left].sum(), g[rows].sum()
                    gain = 0.5 * (score(gl, len(left)) + score(gt - gl, len(rows) - len(left)) - score(gt, len(rows)))
                    if gain > found[0] + 1e-9:
                        found = (gain, (f, b))
        return found

    for _ in range(p.trees):
        g = margin - y if p.loss == "squared" else np.where(y > margin, -p.alpha, 1 - p.alpha)
        open_leaves, closed = [(np.arange(len(y)), 0)], []
        while open_leaves and (not p.leaves or len(open_leaves) + len(closed) < p.leaves):
            gains = [best(r, g) if d < p.depth else (0.0, None) for r, d in open_leaves]
            i = int(np.argmax([s for s, _ in gains]))
            if gains[i][1] is None:
                break
            (rows, d), (f, b) = open_leaves.pop(i), gains[i][1]
            open_leaves += [(rows[bins[rows, f] <= b], d + 1), (rows[bins[rows, f] > b], d + 1)]
        for rows, _ in open_leaves:
            value = -soft(g[rows].sum()) / (len(rows) + p.l2) if p.loss == "squared" else np.quantile(
                y[rows] - margin[rows], p.alpha, method="inverted_cdf")
            margin[rows] = margin[rows] + p.rate * value
    return margin


@pytest.mark.parametrize("p", [BoostParams(trees=4, depth=3, rate=0.3, l1=0.5, l2=2.0, min_child=5),
                               BoostParams(trees=4, depth=4, rate=0.3, leaves=7, min_child=5),
                               BoostParams(trees=4, depth=3, rate=0.3, loss="quantile", alpha=0.9, min_child=8)])
def test_boosting_equals_a_plain_reference(spark, p):
    x, y = made(260)
    rows = TrainingSet(frame(spark, x, y), NAMES, "y", "customer_id", bins=16)
    model = rows.fit([p])[0]
    assert rows.local and model.predict(x) == pytest.approx(reference(x, y, rows.edges, p), rel=1e-9)
    got = model.transform(frame(spark, x, y)).orderBy("customer_id").toPandas()["prediction"].to_numpy()
    assert got == pytest.approx(model.predict(x), rel=1e-12)


@pytest.mark.parametrize("p", [BoostParams(trees=5, depth=3, rows=0.7, columns=0.7, rate=0.2), BoostParams(trees=3, leaves=9, depth=6, rate=0.2),
                               BoostParams(trees=3, depth=2, loss="quantile", alpha=0.2, rate=0.5)])
def test_many_blocks_give_the_trees_of_one(spark, p):
    x, y = made()
    df = frame(spark, x, y)
    one, many = TrainingSet(df, NAMES, "y", "customer_id"), TrainingSet(df, NAMES, "y", "customer_id", block_rows=100)
    assert one.local and not many.local
    many.edges = one.edges
    many.blocks = TrainingSet(df, NAMES, "y", "customer_id", block_rows=100).blocks
    assert many.fit([p])[0].predict(x) == pytest.approx(one.fit([p])[0].predict(x), rel=1e-6)


def test_leaf_wise_takes_fewer_aggregations_than_level_wise_for_equal_leaves(spark):
    x, y = made()
    rows = TrainingSet(frame(spark, x, y), NAMES, "y", "customer_id", block_rows=200)
    jobs, leaves = {}, {}
    for kind, p in (("leaf", BoostParams(trees=2, depth=12, leaves=16)), ("level", BoostParams(trees=2, depth=12))):
        r = SparkRows(p, rows.blocks, len(NAMES))
        trees = train_rows(r, p, len(NAMES), rows.bins)[1]
        jobs[kind], leaves[kind] = r.jobs, [sum(f < 0 for f in t.feature) for t in trees]
    assert max(leaves["leaf"]) <= 16 and jobs["leaf"] < jobs["level"]


def test_quantile_interval_covers_its_share(spark):
    x, y = made(6000, 3)
    df = frame(spark, x, y + np.random.default_rng(0).normal(size=6000) * (1 + x[:, 2])).withColumnRenamed("y", ml.TARGET)
    train, test = ml.split_train_validation(df, 0.3, 5)
    interval = ml.fit_interval(train, NAMES, params=BoostParams(trees=60, depth=3, rate=0.1))
    got = interval.transform(test).selectExpr(f"avg(CAST({ml.TARGET} BETWEEN pred_lower AND pred_upper AS DOUBLE))").first()[0]
    assert abs(got - 0.8) < 0.03


def test_splits_by_two_seeds_are_unrelated(spark):
    df = spark.range(20000).withColumnRenamed("id", "customer_id")
    parts = {s: {r[0] for r in ml.split_train_validation(df, 0.2, s)[1].collect()} for s in (0, 1, 42, 43)}
    for a, b in itertools.combinations(parts, 2):
        assert abs(len(parts[a]) / 20000 - 0.2) < 0.015 and abs(len(parts[a] & parts[b]) / len(parts[a]) - 0.2) < 0.03


def test_guided_search_beats_uniform_draws():
    def planted(many):
        keys = ("rate", "depth", "rows")
        return [abs(math.log(m["rate"] / 0.05)) + abs(m["depth"] - 5) / 4 + abs(m["rows"] - 0.8) * 3 for m in many if set(keys) <= set(m)]
    guided, uniform = [], []
    for seed in range(12):
        tried = tuning.search(planted, 20, 4, seed)
        assert tried == tuning.search(planted, 20, 4, seed) and len(tried) == 20
        guided.append(min(v for _, v in tried))
        u = np.random.default_rng(seed)
        uniform.append(min(planted([tuning.to_settings(u.random(8)) for _ in range(20)])))
    assert np.mean(guided) < 0.9 * np.mean(uniform)
    space = {n: (lo, hi) for n, lo, hi, _ in tuning.SPACE}
    assert all(space[k][0] <= v <= space[k][1] for m, _ in tried for k, v in m.items())


def test_attributions_are_the_shapley_values(spark):
    x, y = made(300)
    model = TrainingSet(frame(spark, x, y), NAMES, "y", "customer_id").fit([BoostParams(trees=6, depth=4, rate=0.3)])[0]
    x[3, 0] = np.nan
    paths = LeafPaths(model)
    phi = paths.shapley(x[:40], 3)
    assert phi.sum(1) + paths.expected == pytest.approx(model.predict(x[:40]), rel=1e-9)

    def known(row, subset):  # expected prediction when the features of the subset are known
        total = model.base
        for root in model.roots:
            stack = [(root, 1.0)]
            while stack:
                n, w = stack.pop()
                f = model.feature[n]
                if f < 0:
                    total += w * model.value[n]
                elif f in subset:
                    stack.append((model.left[n] if row[f] <= model.threshold[n] else model.right[n], w))
                else:
                    stack += [(k, w * model.cover[k] / model.cover[n]) for k in (model.left[n], model.right[n])]
        return total
    for r in (0, 3, 7):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (known(x[r], {*s, i}) - known(x[r], set(s)))
                       for k in range(3) for s in itertools.combinations(others, k))
            assert phi[r, i] == pytest.approx(want, abs=1e-9)
    got = {r[0]: r[1] for r in mean_attribution(model, frame(spark, x[:40], y[:40])).collect()}
    assert [got[n] for n in NAMES] == pytest.approx(np.abs(phi).mean(0))


def test_a_training_run_with_trials(spark, sf_small, tmp_path):
    from clvforge.plans.catalog import clean
    from clvforge.plans.composite import customer_table
    cust = customer_table(clean(spark, sf_small))[0].cache()
    out = ml.train_value_model(cust, tune_trials=20)
    assert len(out["trials"]) == 20 and out["metrics_df"].count() == 3 and out["feature_importance"].count() == len(out["feature_names"])
    s = out["scored"].where("ml_predicted_clv IS NOT NULL")
    assert s.count() == cust.count() and s.where("pred_lower > ml_predicted_clv OR ml_predicted_clv > pred_upper").count() == 0
    imp = ml.permutation_importance(out["models"]["boosted"], out["validation"], out["feature_names"], permute=["recency", "T"])
    assert imp.count() == 2 and {r[0] for r in imp.collect()} == {"recency", "T"}
    ml.save_models(spark, out["models"], out["best_model"], str(tmp_path / "m"))
    models, best = ml.load_models(spark, str(tmp_path / "m"))
    assert best == out["best_model"] == min(("boosted", "boosted_alt", "ridge"), key=lambda m: out["metrics"][m]["mae"])
    some = cust.where("customer_id % 3 = 0")
    assert sorted(ml.score_customers(out["models"], some).collect()) == sorted(ml.score_customers(models, some).collect())


def _jobs(spark):
    return max(spark.sparkContext.statusTracker().getJobIdsForGroup(), default=-1)


def test_models_over_the_same_blocks_share_their_jobs(spark):
    x, y = made()
    rows = TrainingSet(frame(spark, x, y), NAMES, "y", "customer_id", block_rows=200)
    params = [BoostParams(trees=5, depth=3, rate=r) for r in (0.1, 0.2, 0.3)]
    assert not rows.local
    jobs = [_jobs(spark)]
    alone = rows.fit(params[-1:])
    jobs.append(_jobs(spark))
    three = rows.fit(params)
    jobs.append(_jobs(spark))
    assert jobs[2] - jobs[1] < 1.5 * (jobs[1] - jobs[0])
    assert three[2].predict(x) == pytest.approx(alone[0].predict(x), rel=1e-9)


def test_sums_by_shuffle_and_margins_written_often_give_the_same_trees(spark):
    from clvforge.plans.boosting import Blocks, BoostedModel, train_together
    from clvforge.session import table_mark
    x, y = made()
    rows = TrainingSet(frame(spark, x, y), NAMES, "y", "customer_id", block_rows=200)
    params = [BoostParams(trees=3, depth=3, rows=0.8, rate=0.3), BoostParams(trees=4, depth=6, leaves=5, rate=0.3)]
    want = [m.predict(x) for m in rows.fit(params)]
    tables = table_mark()
    for shared in (Blocks(rows.blocks, 3, driver_bytes=0), Blocks(rows.blocks, 3, every=2)):
        found = train_together([SparkRows(p, rows.blocks, 3, shared) for p in params], 3, rows.bins)
        shared.close()
        for (base, trees), w in zip(found, want):
            assert BoostedModel.of(NAMES, rows.edges, base, trees).predict(x) == pytest.approx(w, rel=1e-9)
    assert table_mark() == tables  # margins written on the way are deleted


def test_remembered_margins_are_used_only_if_no_later_than_asked_for():
    from clvforge.plans import boosting as B
    draw = np.random.default_rng(0)
    x = draw.integers(0, 9, (2, 50)).astype(np.uint8)
    trees = [(np.array([f, -1, -1], np.int16), np.array([4, 0, 0], np.int16), np.array([1, 0, 0], np.int32), np.array([2, 0, 0], np.int32),
              draw.normal(size=3)) for f in (0, 1, 0)]
    part = lambda written, recent: B._Part(0, BoostParams(), 1.5, written, recent)
    B._HELD.clear()
    full = part(0, trees).margin("run", 7, None, x)
    assert (part(0, trees[:1]).margin("run", 7, None, x) == 1.5 + trees[0][4][np.where(x[0] <= 4, 1, 2)]).all()
    assert (part(0, trees[:2]).margin("run", 7, None, x) == part(0, trees[:2]).margin("new", 7, None, x)).all()
    assert (part(0, trees).margin("run", 7, None, x) == full).all()
    two = part(0, trees[:2]).margin("third", 7, None, x)
    assert (part(2, trees[2:]).margin("fourth", 7, two.tobytes(), x) == full).all()
    B._HELD.clear()


def test_trials_drawn_at_random_are_evaluated_at_once():
    sizes = []

    def evaluate(many):
        sizes.append(len(many))
        return [abs(m["depth"] - 5) + m["rate"] for m in many]

    tried = tuning.search(evaluate, 20, 4, 42)
    assert sizes == [8, 4, 4, 4] and len(tried) == 20
    assert [m for m, _ in tried[:8]] == [tuning.to_settings(np.random.default_rng([42, i]).random(8)) for i in range(8)]


@pytest.mark.parametrize("p", [BoostParams(trees=3, depth=9, rows=0.8, columns=0.7, rate=0.3, l1=0.1), BoostParams(trees=2, depth=7)])
def test_nodes_no_larger_than_a_block_are_grown_in_one_request(spark, p):
    from clvforge.plans.boosting import Blocks, train_together
    x, y = made()
    rows = TrainingSet(frame(spark, x, y), NAMES, "y", "customer_id", block_rows=200)
    assert not rows.local
    found, jobs = [], []
    for unit in (0, 150):
        shared = Blocks(rows.blocks, 3, unit=unit)
        model = SparkRows(p, rows.blocks, 3, shared)
        found.append(train_together([model], 3, rows.bins)[0])
        jobs.append(model.jobs)
        shared.close()
    (base, level_by_level), (other, by_units) = found
    assert base == other and jobs[1] < jobs[0]
    for a, b in zip(level_by_level, by_units):
        assert (a.feature, a.bin, a.left, a.right, a.depth) == (b.feature, b.bin, b.left, b.right, b.depth)
        assert b.value == pytest.approx(a.value, rel=1e-9) and b.cover == a.cover and b.gain == pytest.approx(a.gain, rel=1e-6)


def test_quantile_leaves_of_nodes_grown_in_one_request_are_exact(spark):
    """Splits are not compared: gradients have two values only, so that many gains are equal but for rounding."""
    p = BoostParams(trees=3, depth=7, rows=0.8, loss="quantile", alpha=0.2, rate=0.5, min_child=5)
    from clvforge.plans.boosting import Blocks, train_together
    x, y = made()
    rows = TrainingSet(frame(spark, x, y), NAMES, "y", "customer_id", block_rows=200)
    shared = Blocks(rows.blocks, 3, unit=150)
    base, trees = train_together([SparkRows(p, rows.blocks, 3, shared)], 3, rows.bins)[0]
    shared.close()
    bins, margin = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(rows.edges)]), np.full(len(y), base)
    for t in trees:
        leaf = t.advance(bins, np.zeros(len(y), np.int64))
        assert len(set(leaf)) > 8
        for n in set(leaf.tolist()):
            assert t.value[n] == pytest.approx(p.rate * np.quantile((y - margin)[leaf == n], p.alpha, method="inverted_cdf"), rel=1e-9, abs=1e-12)
        margin = margin + np.array(t.value)[leaf]


def test_more_rows_than_a_spark_block_train_without_a_job_a_level(spark):
    from pyspark.sql import functions as F
    draw = lambda k: (F.xxhash64("customer_id", F.lit(k)) % 1000) / 1000
    df = spark.range(52_000).withColumnRenamed("id", "customer_id").withColumns({"a": draw(1), "b": draw(2), "c": draw(3)})
    df = df.withColumn("y", 3 * F.col("a") + F.col("b") * F.col("c") + draw(4) / 10)
    params = [BoostParams(trees=2, depth=4, rate=0.3, rows=0.8), BoostParams(trees=2, depth=6, leaves=6, rate=0.3),
              BoostParams(trees=1, depth=3, rate=0.3, loss="quantile", alpha=0.9)]
    rows = TrainingSet(df, NAMES, "y", "customer_id")
    assert rows.local
    jobs = [_jobs(spark)]
    for more in (0, 10):
        one = rows.fit([BoostParams(**{**vars(p), "trees": p.trees + more}) for p in params])
        jobs.append(_jobs(spark))
    assert jobs[2] - jobs[1] == jobs[1] - jobs[0] < 5  # however many trees
    one, many = rows.fit(params), TrainingSet(df, NAMES, "y", "customer_id", block_rows=10_000)
    assert not many.local
    many.edges = rows.edges
    x = df.limit(500).select(*NAMES).toPandas().to_numpy()
    for a, b in zip(one[:2], many.fit(params[:2])):
        assert b.predict(x) == pytest.approx(a.predict(x), rel=1e-6)


def test_predictions_follow_each_tree_from_its_root():
    from clvforge.plans.boosting import BoostedModel
    draw = np.random.default_rng(4)
    nodes = []
    for t, inner in enumerate((0, 1, 6, 11)):  # trees with so many splits, grown at random leaves
        tree = {0: [-1, 0.0, 0, 0]}
        for _ in range(inner):
            at = draw.choice([n for n, v in tree.items() if v[0] < 0])
            tree[at] = [int(draw.integers(0, 3)), float(draw.integers(-2, 3)), len(tree), len(tree) + 1]
            for _ in range(2):
                tree[len(tree)] = [-1, 0.0, 0, 0]
        nodes += [(t, n, *v, float(draw.normal()), 1.0, 0.0) for n, v in tree.items()]
    columns = ["tree", "node", "feature", "threshold", "left", "right", "value", "cover", "gain"]
    model = BoostedModel(NAMES, 0.5, pd.DataFrame(nodes, columns=columns))
    x = draw.integers(-3, 4, (300, 3)).astype(float)  # many values are thresholds
    x[::7, 0], x[::11, 1], x[::13, 2] = np.nan, np.inf, -np.inf
    for row, got in zip(x, model.predict(x)):
        want = 0.5
        for t in range(4):
            of, n = {r[1]: r for r in nodes if r[0] == t}, 0
            while of[n][2] >= 0:
                n = of[n][4] if row[of[n][2]] <= of[n][3] else of[n][5]
            want += of[n][6]
        assert got == pytest.approx(want, rel=1e-12)
    assert model.predict(x[:0]).shape == (0,)
