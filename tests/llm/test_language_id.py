import math

from helpers import ODD, frame
from pyspark.sql import functions as F

from textloom.llm import language_id as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = L.train(docs.where(~L.held_out(F.col("doc_id"))))
    got = L.identify(docs.withColumn("held", L.held_out(F.col("doc_id"))), models).where("held").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 150 and right >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_probabilities_sum_to_one():
    import numpy as np

    models = L.kneser_ney({("a", "   xy"): 3, ("a", "  xyx"): 2, ("a", " xyxz"): 1, ("b", "  zzz"): 4}, ["a", "b"])
    for context in ("   x", " xyx", "zzzz", "qqqq"):
        total = sum(np.exp(models.log_probabilities(np.array([ord(c) for c in context + ch], dtype=np.uint32))[-1].astype(float)) for ch in "xyz?")
        assert all(math.isclose(t, 1, rel_tol=1e-4) for t in total)


def by_hand(counts, order):
    """Interpolated Kneser-Ney by the definition, one probability after the other, for one language."""
    tables = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        tables[k] = {}
        for g in tables[k + 1]:
            tables[k][g[1:]] = tables[k].get(g[1:], 0) + 1
    size = max(2, len(tables[1])) + 1

    def p(gram):
        if not gram:
            return 1 / size
        t = tables[len(gram)]
        once, twice = (sum(v == c for v in t.values()) for c in (1, 2))
        off = once / (once + 2 * twice) if once and twice else L.DISCOUNT
        own = [v for g, v in t.items() if g[:-1] == gram[:-1]]
        if not own:
            return p(gram[1:])
        return max(t.get(gram, 0) - off, 0) / sum(own) + off * len(own) / sum(own) * p(gram[1:])

    return p


def test_probabilities_equal_the_definition():
    import random

    import numpy as np

    r = random.Random(5)
    text = "".join(r.choices("abcde ", [5, 4, 3, 2, 1, 3], k=400))
    counts = {}
    for i in range(len(text) - L.ORDER + 1):
        g = text[i : i + L.ORDER]
        counts[g] = counts.get(g, 0) + 1
    models = L.kneser_ney({("a", g): n for g, n in counts.items()}, ["a"])
    p = by_hand(counts, L.ORDER)
    for _ in range(300):
        g = "".join(r.choices("abcdef ", k=L.ORDER))
        got = models.log_probabilities(np.array([ord(c) for c in g], dtype=np.uint32))[-1, 0]
        assert math.isclose(math.exp(float(got)), p(g), rel_tol=1e-4), g


def test_odd_rows(spark):
    docs = frame(spark, [(i, "the cat sat on the mat and the dog") for i in range(30)])
    models = L.train(docs)
    got = L.identify(frame(spark, [*ODD, (9, "the " * 300_000)]), models).collect()
    by_text = {}
    for r in got:
        assert r.source == "s" and r.n_lines == 7
        by_text.setdefault(r.text, set()).add((r.lang_pred, r.score))
    assert all(len(v) == 1 for v in by_text.values())
    for text in (None, "", " \n\t ", "!!! ..."):
        assert by_text[text] == {("und", 0.0)}
    assert {p for p, _ in by_text["word"]} == {"en"}
    none = L.train(docs.where("false"))
    assert {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(docs.where("false"), models).count() == 0


def test_noise_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = L.train(docs)
    got = L.identify(frame(spark, [(1, "qxzvkj wqpzx jvkq xzzq " * 30)]), models).first()
    assert got.rejected
