"""Streaming request scoring and the ML value model on the smallest tables."""
import os
import tempfile

from pyspark.sql import functions as F

from clvforge.operators.value import requests_from_customers, score_requests
from clvforge.plans.catalog import clean
from clvforge.plans.composite import customer_table
from clvforge.streaming.scoring import start_scoring


def test_stream_scores_every_request(spark, sf_small):
    cust = customer_table(clean(spark, sf_small))[0]
    req = requests_from_customers(cust)
    root = tempfile.mkdtemp(prefix="clvforge-stream-")
    src = os.path.join(root, "in")
    req.repartition(3).write.json(src)
    q = start_scoring(spark, src, os.path.join(root, "out"), os.path.join(root, "ckpt"), once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(root, "out", "scores")).drop("batch_id")
    assert got.count() == req.count()
    batch = score_requests(req)
    a = sorted(map(tuple, got.collect()), key=repr)
    b = sorted(map(tuple, batch.collect()), key=repr)
    assert a == b
    first = [f for f in os.listdir(os.path.join(root, "ckpt", "commits")) if f.isdigit()]
    last = max(first, key=int)
    for f in (last, f".{last}.crc"):  # as if the driver had been lost before the commit
        os.remove(os.path.join(root, "ckpt", "commits", f))
    start_scoring(spark, src, os.path.join(root, "out"), os.path.join(root, "ckpt"), once=True).awaitTermination(120)
    again = spark.read.parquet(os.path.join(root, "out", "scores")).drop("batch_id")
    assert sorted(map(tuple, again.collect()), key=repr) == b


def test_end_to_end_run_writes_and_reads_outputs(spark, sf_small):
    from clvforge.plans.composite import run_pipeline
    from clvforge.sources.io import current_run, load_params, read_customer_outputs
    from clvforge.sources.star import transactions_from_star
    out_dir = tempfile.mkdtemp(prefix="clvforge-out-")
    res = run_pipeline(transactions_from_star(spark, sf_small), out_dir=out_dir, fit=True,
                       train_model=False)
    back = read_customer_outputs(spark, out_dir)
    assert set(back) >= {"customers", "rfm", "segment_stats"}
    assert back["customers"].count() == res["customers"].count()
    bg = load_params(spark, f"{current_run(spark, out_dir)}/params_bgnbd", "bgnbd")
    assert set(bg) == {"r", "alpha", "a", "b"} and all(v > 0 for v in bg.values())
    seg_total = back["segment_stats"].agg(F.sum("customer_count")).first()[0]
    assert seg_total == back["rfm"].count()
