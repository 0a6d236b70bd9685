import math

import numpy as np

from textloom.llm.whitening import bidiagonalise, whiten

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x", 0.5) for i, v in rows], SCHEMA)


def by_component(spark, rows, k=16):
    got = whiten(frame(spark, rows), k).toPandas()
    return got.sort_values(["component", "vec_id"], na_position="first")


def brute(rows, k=16):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in np.array(v, dtype=np.float32).astype(float)] for _, v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, deviation, (x - s / n) @ vectors[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def check(got, rows, k=16, tolerance=1e-8):
    n, deviation, white, explained = brute(rows, k)
    ids = [i for i, _ in rows]
    for c in range(1, white.shape[1] + 1):
        one = got[got.component == c].set_index("vec_id").loc[ids]
        assert (one.n == n).all() and one.deviation.tolist() == deviation
        sign = np.sign(np.dot(one.whitened, white[:, c - 1]))
        assert np.allclose(sign * one.whitened, white[:, c - 1], atol=tolerance)
        assert np.allclose(one.explained, explained[c - 1], rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-7


def test_flat_and_steep_spectra_match_eigenvectors(spark):
    r = np.random.default_rng(5)
    for scale in (np.ones(24), 2.0 ** -np.arange(24.0), np.r_[100.0, np.ones(23)]):
        rows = [(i, v) for i, v in enumerate((r.standard_normal((700, 24)) * 20 * scale).astype(np.float32).tolist())]
        rows += [(1000 + i, rows[i % 7][1]) for i in range(300)]  # copies count once in the fit
        wanted = 6 if scale[-1] < 1e-3 else 16
        check(by_component(spark, rows, wanted), rows, wanted)


def test_few_vectors_give_few_components(spark):
    r = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate((10 * r.standard_normal((4, 12))).tolist())]
    got = by_component(spark, rows)
    assert got.component.max() == 3
    check(got, rows, 3)
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_rows_without_a_vector_are_dropped_and_copies_kept(spark):
    good = [(i, [float(i % 5), float(i % 3), float(i % 2)]) for i in range(30)]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 1.0, 2.0]), (94, [1.0]), (95, []), (96, [3e38, 0.0, 0.0])]
    got = by_component(spark, good + odd)
    assert set(got.vec_id) == set(range(30))
    check(got, good)
    again = whiten(frame(spark, [*good, good[0], (None, good[1][1])])).toPandas()
    assert len(again) == 32 * 3 and again.vec_id.isna().sum() == 3


def test_empty_table(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None)])).collect() == []


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [float(10**13 * (i % 4)), float(i)]) for i in range(8)]
    got = whiten(frame(spark, rows)).toPandas()
    n, deviation, _, _ = brute(rows)
    assert any(d >= 2**63 for d in deviation)
    for i, d in enumerate(deviation):
        mine = got[got.vec_id == i].deviation
        assert (mine.isna().all() if d >= 2**63 else (mine == d).all())


def test_block_bidiagonal_form():
    x = np.random.default_rng(7).standard_normal((50, 9)) * np.r_[5.0, 5.0, 3.0, np.ones(4), 0.0, 0.0]
    for width in (1, 2, 4, 8, 9):
        V, R = bidiagonalise(lambda p: (x.T @ (x @ p), (x @ p).T @ (x @ p)), 9, 9, width)
        assert np.allclose(V.T @ V, np.eye(V.shape[1]), atol=1e-13)
        assert np.allclose(R.T @ R, V.T @ x.T @ x @ V, atol=1e-9)
        assert np.allclose(np.linalg.svd(R)[1][:7], np.linalg.svd(x)[1][:7], rtol=1e-10)
        assert np.abs(np.triu(R, 2 * width)).max(initial=0) < 1e-9
