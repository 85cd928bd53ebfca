"""Hard-negative mining against brute force."""
import math

import numpy as np
import pytest

from clvforge.llm.negatives import mine_negatives, pack_keys, unpack_keys
from clvforge.llm.vectors import products


def brute(rows, positives, negatives, low, every, scale):
    ok = [(i, y, [math.floor(scale * x) for x in v]) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, y, v in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (label, vec) in anchors.items():
        scored = sorted((-sum(x * z for x, z in zip(vec, v)), i, y) for i, y, v in ok if i != a and len(v) == len(vec))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside, 1)]
    return sorted(out)


def made():
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] + 0.4 * draw.normal(size=6)).tolist(), (i % 4 if i % 9 else 3)) for i in range(500)]
    rows += [(600 + i, rows[5][1], i % 3) for i in range(40)]  # ties over labels
    rows += [(0, rows[7][1], 2), rows[11], rows[11]]  # a repeated anchor id, repeated rows
    rows += [(-20, rows[3][1], 1), (900, None, 1), (901, [1.0] * 6, None), (902, [float("nan")] * 6, 1),
             (910, [float("inf")] * 6, 1), (911, [None] * 6, 1), (None, rows[0][1], 1), (920, [1.0, 2.0], 1), (921, [2.0, 2.0], 1),
             (922, [2.0, 1.9], 2), (930, [], 0), (931, [], 0), (932, [], 1), (940, [-5.0] * 6, 9), (941, [5.0] * 6, 9)]
    return rows


@pytest.mark.parametrize("asks", [7, 4096])
def test_negatives_match_brute_force(spark, asks):
    df = spark.createDataFrame([(*r, "c", 1, b"x") for r in made()],
                               "vec_id long, embedding array<float>, label int, cell string, kind int, key binary")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = sorted(map(tuple, mine_negatives(df, positives=4, negatives=3, low=70, every=10, scale=64, asks=asks).collect()))
    assert got == brute(rows, 4, 3, 70, 10, 64) and len(got) > 300
    assert mine_negatives(df.limit(0)).count() == 0


def test_keys_keep_order():
    draw = np.random.default_rng(2)
    a, s, i = (np.concatenate([draw.integers(-3, 3, 200), draw.integers(-2 ** 62, 2 ** 62, 50)]) for _ in range(3))
    keys = pack_keys(a, s, i, 0).to_pylist()
    order = sorted(range(len(a)), key=lambda n: (a[n], -s[n], i[n]))
    assert [keys[n] for n in order] == sorted(keys)
    assert unpack_keys(keys) == (a.tolist(), s.tolist(), [0] * len(a), i.tolist())


def test_products_are_exact_or_fail():
    big = np.array([[1 << 40, 3], [5, -(1 << 50)]])
    assert products(big[:1], np.array([[1 << 20, 1]]))[0, 0] == (1 << 60) + 3
    with pytest.raises(OverflowError):
        products(big[:1], np.array([[1 << 30, 1]]))
