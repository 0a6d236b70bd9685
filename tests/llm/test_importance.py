import numpy as np
import pyarrow as pa
from helpers import ODD, frame
from pyspark.sql import functions as F

from textloom.llm import importance as I
from textloom.llm import nptext


def test_scores_and_selection(spark):
    good, bad = "red green blue yellow", "alpha beta gamma delta"
    rows = [(i, " ".join([good if i % 2 else bad] * (1 + i % 5))) for i in range(100, 300)] + ODD
    ids = spark.createDataFrame([(i, "z") for i in range(101, 300, 4)] + [(None, "z")], "doc_id long, text string")
    got = I.resample(frame(spark, rows), ids, share=0.25).collect()
    assert len(got) == len(rows)
    scored = [r for r in got if r.n_grams]
    # Both models by hand, from the texts one by one.
    targets = set(range(101, 300, 4))
    raw, target = np.zeros(I.BUCKETS), np.zeros(I.BUCKETS)
    bags = {}
    for i, t in rows:
        b = I.bag(*nptext.utf8(pa.array([t])), I.BUCKETS)[0]
        np.add.at(raw, b, 1)
        if i in targets:
            np.add.at(target, b, 1)
        bags[(i, t)] = b
    ratio = np.log((target + 1) / (target.sum() + I.BUCKETS)) - np.log((raw + 1) / (raw.sum() + I.BUCKETS))
    want = sorted(round(float(ratio[b].sum()), 6) for b in (bags[r] for r in rows))
    assert np.allclose(sorted(r.log_ratio for r in got), want, atol=1e-5)
    k = int(np.ceil(0.25 * len(scored)))
    keys = sorted((r.key for r in scored), reverse=True)
    assert all(r.selected == (r.key >= keys[k - 1]) for r in scored)
    assert not any(r.selected for r in got if not r.n_grams)
    chosen = [r for r in got if r.selected and (r.doc_id or 0) >= 100]
    assert sum(r.doc_id % 2 for r in chosen) > 0.9 * len(chosen)


def test_very_long_text(spark):
    rows = [(1, "red green " * 50_000), (2, "red green"), (3, "alpha beta")]
    ids = spark.createDataFrame([(2,)], "doc_id long")
    got = {r.doc_id: r for r in I.resample(frame(spark, rows), ids, share=1.0).collect()}
    assert got[1].n_grams == 199_999 and got[2].n_grams == 3 and all(r.selected for r in got.values())


def test_threshold_is_exact(spark):
    x = [float(v) for v in np.random.default_rng(0).normal(size=3000)] + [1.5] * 10
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "key double")
    for k in (1, 7, 1500, 3010):
        got = I.top_threshold(df, "key", k, min(x), max(x))
        assert sum(v >= got for v in x) >= k and sum(v > got for v in x) < k


def test_empty(spark):
    docs = frame(spark, [])
    assert I.resample(docs, docs.select("doc_id")).count() == 0
    assert not any(r.selected for r in I.resample(frame(spark, [(1, None)]), docs.select("doc_id")).collect())
    assert I.resample(frame(spark, [(1, "a b")]), docs.select(F.col("doc_id"))).first().selected
