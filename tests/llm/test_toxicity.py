"""Toxicity: words and votes, the label model, the linear classifier, held-out accuracy."""
import zlib

import numpy as np
import pytest

from clvforge.llm import toxicity as TX


def lookup():
    keys, number = TX.given_words()
    keys, at = np.unique(keys, return_index=True)
    return TX.Lookup(keys, np.full(len(keys), -1), number[at])


def test_words_are_folded_and_cut_alike_in_any_piece(monkeypatch):
    text = "You IDIOT, Élan élan; stupid!!! x id1ot THE END OF ALL THIS SHOUTING " * 40
    whole = TX.votes([text.encode(), b"", b"ok"], lookup(), True)
    monkeypatch.setattr(TX, "_PIECE", 64)
    parts = TX.votes([text.encode(), b"", b"ok"], lookup(), True)
    assert (whole[0] == parts[0]).all() and all((a == b).all() for a, b in zip(whole[1], parts[1]))
    assert len(np.unique(TX.Piece([(0, "Élan élan ÉLAN".encode())]).word)) == 1
    names = ["mind", *TX.PATTERNS]
    at = [TX._MINED + list(TX.LEXICONS).index("mind"), *range(TX._MINED + TX._GIVEN, TX.VOTERS)]
    got = dict(zip(names, whole[0][0][at]))
    assert got == {"mind": 2, "dense": 2, "address": 2, "shouting": 2, "marks": 2, "masked": 2, "short": 0}
    assert whole[0][1].tolist()[-1] == 2 and not whole[0][1][:-1].any()
    code = TX.encode(whole[0])
    assert (TX.decode(code) == whole[0]).all()


def test_label_model_finds_accuracies_and_correlations(spark):
    draw = np.random.default_rng(7)
    n = 30_000
    y = draw.random(n) < 0.15
    vote = np.zeros((n, TX.VOTERS), np.int64)
    rates = {0: (0.7, 0.02), 1: (0.5, 0.01), 3: (0.3, 0.3), 14: (0.6, 0.05)}
    for j, (hit, false) in rates.items():
        vote[:, j] = draw.random(n) < np.where(y, hit, false)
    vote[:, 5] = np.where(draw.random(n) < 0.95, vote[:, 3], 1 - vote[:, 3])  # says what another says
    label = np.where(draw.random(n) < 0.1, y.astype(int), -1)
    rows = [(int(c), int(la), 1) for c, la in zip(TX.encode(vote), label)]
    patterns = spark.createDataFrame(rows, "code long, label int, n long").groupBy("code", "label").sum("n").withColumnRenamed("sum(n)", "n")
    model = TX.fit_label_model(patterns)
    assert model.prior[1] == pytest.approx(0.15, abs=0.02)
    assert {model.parent[3], model.parent[5]} & {3, 5}  # one is the other's parent
    for j, (hit, false) in rates.items():
        if model.parent[j] < 0:
            assert model.table[1, j, 0, 1] == pytest.approx(hit, abs=0.05) and model.table[0, j, 0, 1] == pytest.approx(false, abs=0.02)
    q = model.posterior(vote, np.full(n, -1))
    assert np.mean((q > 0.5) == y) > 0.93
    double = model.posterior(vote[:1] * 0 + np.eye(1, TX.VOTERS, 3, dtype=np.int64) + np.eye(1, TX.VOTERS, 5, dtype=np.int64), np.array([-1]))
    assert double[0] < 0.05  # two that say the same are no more than one
    nobody = TX.fit_label_model(patterns.filter("label = -1"))  # without labels the given lexicons begin
    assert np.mean((nobody.posterior(vote, np.full(n, -1)) > 0.5) == y) > 0.88


def test_descent_fits_soft_targets():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(800, 3))
    target = 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.5])))
    row, column = np.repeat(np.arange(800), 3), np.tile(np.arange(3), 800)
    w = TX._descend(row, column, x.ravel(), target, np.full(800, 1 / 800), 3)
    assert w == pytest.approx([2.0, -1.0, 0.5], abs=0.1)


def test_held_out_rows_are_told_apart(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in TX.detect_toxicity(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == docs.count() and all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.93
    assert np.mean([got[i]["predicted"] for i in held if not truth[i]]) < 0.05
    learnt = [i for i in truth if not got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in learnt]) > 0.93


def test_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(100, 150)] + [(100, 1, 1), (None, 1, 1), (101, None, None), (7777, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = TX.detect_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and len({r["score"] for r in got if r["doc_id"] in (0, 1, 9, 10)}) == 1
    assert TX.detect_toxicity(no_docs, labels).count() == 0
    rows = [(1, "you are an idiot and a moron, stupid loser"), (2, "a fine day by the sea with friends"), (3, None)] * 30
    rows += [(4, "word " * 400_000 + "idiot " * 3 + "word " * 100_000)]  # 2.5 MB
    none = {r["doc_id"]: r for r in TX.detect_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels.limit(0)).collect()}
    assert none[1]["predicted"] == 1 and none[2]["predicted"] == 0 and none[3]["predicted"] == 0
