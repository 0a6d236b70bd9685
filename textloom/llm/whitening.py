"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred vectors X are bidiagonalised in blocks of a few vectors by passes over the table: one for the products Xv, one
for the transposed products with u, in turn. Left vectors are never stored: u is X p for a p of the vectors' dimension, so a task recomputes its part of u from its
rows, and a lost executor costs nothing but the pass. Both sides are reorthogonalised in full, the left one by
inner products with p. The singular values and vectors of the small bidiagonal matrix give components and deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, stored

SCALE, SHIFT = 64.0, 1_000_000
#: Vectors of a stored block.
BLOCK_ROWS = 4096
#: Right vectors that a step makes at once.
STEP = 8
#: A singular value whose residual is below this part of the largest is settled; a step whose norm is, ends a Krylov space.
SETTLED, VANISHED = 1e-15, 1e-12
_KINDS = (np.int8, np.int16, np.int32, np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row of integers in the least width that holds it, with the width before it: equal rows, equal bytes."""
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), dtype=bool)
    for k, kind in enumerate(_KINDS):
        fits = left & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        rows = x[fits].astype(kind)
        for i, row in zip(np.flatnonzero(fits).tolist(), rows, strict=True):
            out[i] = bytes([k]) + row.tobytes()
        left &= ~fits
    return out


def _unpacked(packed: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(packed), d), dtype=np.int64)
    kinds = np.array([p[0] for p in packed], dtype=np.int64)
    for k, kind in enumerate(_KINDS):
        at = np.flatnonzero(kinds == k)
        if len(at):
            out[at] = np.frombuffer(b"".join(packed[i][1:] for i in at), dtype=kind).reshape(-1, d)
    return out


def _vector_rows(d: int):
    """Vectors as integers, floor(64 c) without the shift; those of another length or with entries that aren't finite are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                flat = part.column("c").flatten()
                c = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, d)
                good = (np.abs(c) < 2.0**62).all(axis=1)
                keep = pa.array(np.flatnonzero(good), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(keep), pa.array(_packed(c[good].astype(np.int64)), pa.binary())], ["vec_id", "x"])

    return run


def _block_rows(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                x = _unpacked(batch.column("x").slice(lo, BLOCK_ROWS).to_pylist(), d)
                kind = next(k for k in _KINDS if np.iinfo(k).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(k).max)
                yield pa.RecordBatch.from_arrays([pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary())], ["width", "block"])

    return run


def _blocks(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    for width, block in zip(batch.column("width").to_pylist(), batch.column("block"), strict=True):
        yield np.frombuffer(block.as_buffer(), dtype=f"i{width}").reshape(-1, d)


def _summed(fit: DataFrame, d: int, size: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all blocks of part(block), ``size`` numbers: summed by blocks in a task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.float64 if kind == "double" else np.int64)
        for batch in batches:
            for block in _blocks(batch, d):
                total = total + part(block)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64() if kind == "double" else pa.int64()))], ["sums"])

    each = fit.mapInArrow(run, f"sums array<{kind}>").select(F.posexplode("sums").alias("place", "part"))
    got = each.groupBy("place").agg(F.sum("part").alias("total")).toArrow()
    out = np.zeros(size, dtype=np.float64 if kind == "double" else np.int64)
    out[got.column("place").to_numpy()] = got.column("total").to_numpy()
    return out


@dataclass(frozen=True)
class Whitening:
    """n different vectors with integer sums (without the shift); components in columns, their eigenvalues and shares."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def _filled(V: np.ndarray, new: np.ndarray, width: int, seed: int) -> np.ndarray:
    """``width`` orthonormal columns beside V's, as far as there is room: those of new, and others made up."""
    width = min(width, V.shape[0] - V.shape[1])
    new = np.column_stack([new[:, :width], np.random.default_rng(seed).standard_normal((V.shape[0], max(0, width - new.shape[1])))])
    for _ in range(3):
        new = np.linalg.qr(new - V @ (V.T @ new))[0]
    return new


def bidiagonalise(product: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], d: int, wanted: int, width: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(right vectors V in columns, upper block bidiagonal R) with X V = U R for an X of d columns and a U of orthonormal
    ones, known by product(P) = (transposed X times X P, inner products of the columns of X P). ``width`` vectors a step
    share the passes. Ends once the ``wanted`` largest singular values are settled, or all d columns are made."""
    V, P, Z, R, largest, step = (*(np.zeros((d, 0)) for _ in range(3)), np.zeros((0, 0)), 0.0, 0)
    new = _filled(V, V, width, 0)
    while new.shape[1]:
        # Left vectors X p: the product with the right ones, made orthogonal to all left ones so far and to each other.
        beside = P.T @ product(new)[0]
        p, own = new - P @ beside, np.eye(new.shape[1])
        for again in range(4):
            z, inner = product(p)
            g, turn = np.linalg.eigh(inner)
            root = np.sqrt(np.maximum(g, 0))
            largest = max(largest, root.max())
            # A first pass can't tell small columns from rounding: it scales them up, and the next one drops what is none.
            keep = root > (1e-3 if again else 0.0) if root.max() > VANISHED * largest else np.zeros(len(root), dtype=bool)
            good = root[keep].min(initial=1) > 0.5 * root.max() or not keep.any()
            root = root[keep] if again else np.maximum(root[keep], 1e-8 * root.max())
            turn = turn[:, keep]
            p, z, own = p @ turn / root, z @ turn / root, (turn * root).T @ own
            slant = P.T @ z
            if not keep.any() or ((good or again == 3) and np.abs(slant).max(initial=0) < 1e-11):
                break
            beside, p = beside + slant @ own, p - P @ slant
        R = np.block([[R, beside], [np.zeros((len(own), R.shape[1])), own]])
        V, P, Z = np.column_stack([V, new]), np.column_stack([P, p]), np.column_stack([Z, z])
        # Right vectors: the transposed product with the left ones, made orthogonal to all right ones so far.
        rest = z
        for _ in range(2):
            rest = rest - V @ (V.T @ rest)
        left, values, _ = np.linalg.svd(R)
        if min(R.shape) >= wanted and len(own) and np.linalg.norm(rest @ left[-len(own) :, :wanted], axis=0).max() <= SETTLED * values[0]:
            break
        directions, sizes, _ = np.linalg.svd(rest, full_matrices=False)
        step += 1
        new = _filled(V, directions[:, sizes > VANISHED * largest], width, step)
    return V, R


def fit_whitening(fit: DataFrame, d: int, wanted: int) -> Whitening | None:
    """Components of a stored table of blocks of different vectors; None if it is empty."""
    first = _summed(fit, d, d + 1, lambda x: np.append(x.sum(axis=0, dtype=np.int64), len(x)), "long")
    if not first[-1]:
        return None
    n, sums = int(first[-1]), first[:-1]
    mean = sums / n

    def product(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = p.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            x = x - mean
            y = x @ p
            return np.append((x.T @ y).ravel(), (y.T @ y).ravel())

        out = _summed(fit, d, d * k + k * k, part)
        return out[: d * k].reshape(d, k), out[d * k :].reshape(k, k)

    trace = _summed(fit, d, 1, lambda x: np.array([((x - mean) ** 2).sum()]))[0] / n
    V, R = bidiagonalise(product, d, min(wanted, d))
    _, values, right = np.linalg.svd(R)
    e = values[:wanted] ** 2 / n
    e = e[e > VANISHED * max(trace, 0) + 0.0]
    components = np.linalg.qr(V @ right.T[:, : len(e)])[0] if len(e) else np.zeros((d, 0))
    k, scaled = len(e), components / np.sqrt(e)

    def spread(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ scaled
        return np.append((z.T @ z).ravel(), z.sum(axis=0))

    got = _summed(fit, d, k * k + k, spread) / n if k else np.zeros(0)
    covariance = got[: k * k].reshape(k, k) - np.outer(got[k * k :], got[k * k :])
    return Whitening(n, sums, components, e, e / trace if trace else e, float(np.abs(covariance - np.eye(k)).max(initial=0)))


def _whitened_rows(model: Whitening):
    d, k = model.components.shape
    scaled = model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.array([int(x) for x in model.sums], dtype=object)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x = _unpacked(part.column("x").to_pylist(), d)
                z = (x - model.sums / model.n) @ scaled
                reach = max((max(abs(int(x[:, j].min(initial=0))), abs(int(x[:, j].max(initial=0)))) * model.n + abs(most[j]) for j in range(d)), default=0)
                if reach * reach * d < 2**63:
                    far = pa.array(((model.n * x - model.sums) ** 2).sum(axis=1))
                else:
                    whole = [sum((model.n * int(a) - s) ** 2 for a, s in zip(row, most, strict=True)) for row in x.tolist()]
                    far = pa.array([w if w < 2**63 else None for w in whole], pa.int64())
                rows = pa.array(np.repeat(np.arange(len(x)), k), pa.int64())
                columns = [part.column("vec_id").take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n)), far.take(rows)]
                columns += [pa.array(z.ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(x) * k, model.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = 16) -> DataFrame:
    """One row per vector of rows (vec_id, embedding) and component: vec_id, component (from 1, by falling eigenvalue), n,
    deviation, whitened, explained, identity_error. Other columns are ignored.

    An entry c counts as floor(64 c) + 1000000. Vectors that are null, hold null or entries that aren't finite (or whose
    64-fold no long holds), or have another length than most (of equally many the longer) are left out; so are empty
    vectors. The model is fitted to each different vector once; repeated rows and null ids are projected like any other.
    deviation is n**2 times the squared distance from the mean, an exact integer; null where no long holds it.
    Components without variance are left out, so one vector alone, or an empty table, gives no rows. Equal eigenvalues
    leave the choice of components within their space open.

    The driver holds matrices of the vectors' dimension squared, nothing that grows with rows.
    """
    c = F.col("embedding").cast("array<double>")
    rows = bounded_batches(rows).select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c"))
    rows = rows.where(F.col("c").isNotNull() & ~F.exists("c", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    lengths = rows.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    none = rows.sparkSession.createDataFrame([], _OUT)
    if lengths is None:
        return none
    d = lengths["d"]
    vectors = rows.where(F.size("c") == d).mapInArrow(_vector_rows(d), "vec_id long, x binary")
    fit = stored(vectors.select("x").distinct().mapInArrow(_block_rows(d), "width int, block binary"))
    model = fit_whitening(fit, d, components)
    if model is None or not len(model.eigenvalues):
        return none
    return vectors.mapInArrow(_whitened_rows(model), _OUT)
