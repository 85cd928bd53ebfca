"""Top-k search and the pipeline."""
import math

import numpy as np

import __spark_entry__ as E
import corpus_pipeline
from clvforge.llm.topk import CoverTree, cover_tree_topk


def brute(rows, k, every):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_topk_matches_brute_force(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * draw.normal(size=8)).tolist()) for i in range(600)]
    rows += [(700 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, rows[0][1]),
             (910, [1.0, 2.0]), (911, [3.0, 4.0]), (920, [])]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, asks string")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = cover_tree_topk(df, k=5, every=10, block=64, asks=16).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(rows, 5, 10)
    assert cover_tree_topk(df.limit(0)).count() == 0


def test_pairs_of_blocks_and_of_leaves_are_not_broadcast(spark, monkeypatch):
    """Both grow with the square of the leaves; Spark sees a small file and a few starting nodes."""
    import re

    from clvforge.llm import topk
    draw = np.random.default_rng(2)
    df = spark.createDataFrame([(i, draw.normal(size=6).tolist()) for i in range(900)], "vec_id long, embedding array<double>")
    plans, cut = [], topk.cut

    def seen(rows):
        rows.collect()  # so that the plan is the one that ran
        plans.append(re.sub(r"#\d+L?", "", rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]))
        return cut(rows)
    monkeypatch.setattr(topk, "cut", seen)
    cover_tree_topk(df, k=5, every=10, block=32, asks=16).collect()
    joins = [line for p in plans for line in p.splitlines() if "Join [" in line]
    leaves = [line for line in joins if "salt" in line]
    blocks = [line for line in joins if "Join [asks], [asks], Inner" in line]
    assert leaves and blocks and not [line for line in leaves if "BroadcastHashJoin" in line]
    assert sum("SortMergeJoin" in line for line in blocks) >= 2


def test_cover_tree_invariants():
    x = np.random.default_rng(0).normal(size=(500, 5))
    x[100:150] = x[0]

    def walk(node):
        assert np.sqrt(((x[node.members] - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)
            for c in node.children:
                walk(c)
    walk(CoverTree(x, leaf=8))


def test_pipeline_equals_its_stages_in_plain_words(spark, sf_dir, tmp_path):
    import hashlib
    import re
    from collections import Counter

    import sentencepiece
    import xxhash
    from clvforge.llm import quality
    from clvforge.llm.catalog import model_path
    from clvforge.llm.mixing import mix
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{n}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{n}")
        kept.append((before, docs))
    rows = lambda df: [(r["doc_id"], r["text"] or "") for r in df.collect()]
    good = {r["doc_id"] for r in quality.classify(kept[0][0], labels).collect() if r["score"] >= 0.7}
    assert {i for i, _ in rows(kept[0][1])} == good and len(good) > 100
    first = {}
    for i, t in sorted(rows(kept[1][0]), key=lambda r: (-len(r[1]), r[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), i)
    assert sorted(i for i, _ in rows(kept[1][1])) == sorted(first.values())

    def print_of(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    prints = sorted((i, print_of(t)) for i, t in rows(kept[2][0]))
    group = {i: i for i, _ in prints}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((root(i), root(j)))
                group[y] = x
    assert sorted(i for i, _ in rows(kept[2][1])) == sorted(i for i in group if root(i) == i)
    assert Counter(i for i, _ in rows(kept[3][1])) == Counter({r["doc_id"]: r["copies"] for r in mix(kept[3][0]).collect() if r["copies"]})
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = rows(kept[4][0])
    want = Counter((i, hashlib.sha256(np.array(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest()) for i, t in texts)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in kept[4][1].collect()) == want


def test_pipeline_run_leaves_only_its_result(spark, sf_dir):
    import os
    from clvforge.session import checkpoint_dir
    root = checkpoint_dir(spark).removeprefix("file:")
    before = {f for f in os.listdir(root) if f.startswith("pipeline-")}
    out = corpus_pipeline.run(spark, sf_dir)
    (new,) = {f for f in os.listdir(root) if f.startswith("pipeline-")} - before
    assert out.count() > 100 and os.listdir(f"{root}/{new}") == [str(len(corpus_pipeline.STAGES) - 1)]


def test_pipeline_stages_on_odd_and_empty_tables(spark, docs, no_docs, tmp_path):
    docs.sparkSession.createDataFrame([(i, i % 2, 0) for i in range(100, 150)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    for df in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns, name
            if name != "quality classifier":  # which may well reject all of these
                assert (out.count() > 0) == (df is docs), name
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == df.count()


def test_every_operator_has_one_query():
    names = [q for q in E.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in E.queries()
