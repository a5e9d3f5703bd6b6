"""Embedding whitening by a bidiagonal qd solver.

1. Blockwise QR: every task centres its rows of the fit list and reduces them to a triangle; triangles are
   stacked and reduced again, a bounded number at a time, until one R is left (dimension x dimension).
2. Householder reflections bring R to bidiagonal form; dqds finds its singular values, the small ones as
   accurately as the large ones. With n rows, eigenvalues of the covariance are their squares over n.
3. The right vector of a singular value comes from the twisted factorisation of B'B minus its square,
   the stationary transform from the top meeting the progressive one from the bottom where the pivot is
   smallest. Vectors of a cluster of values are kept orthogonal by inverse iteration with the same factors.

R is the only thing that reaches the driver, besides sums of a row per dimension; rows stay on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import list_parts, materialise

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
FAN_IN = 16
EPS = np.finfo(float).eps


# ---- bidiagonal solver ------------------------------------------------------------------------


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with ``r = U B V'``; V is the product of the right reflections."""
    a = np.array(r, float)
    n = a.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            return None
        u = x / norm
        u[0] += 1.0 if u[0] >= 0 else -1.0
        return u / np.linalg.norm(u)

    for k in range(n):
        u = reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < n - 2:
            u = reflector(a[k, k + 1 :])
            if u is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential qd transform; None if the shift exceeds the smallest eigenvalue."""
    n = len(q)
    qq, ee = np.empty(n), np.empty(max(0, n - 1))
    d = q[0] - shift
    if d < 0:
        return None
    for i in range(n - 1):
        qq[i] = d + e[i]
        if qq[i] == 0:
            ee[i], ratio = 0.0, 1.0  # d and e vanish: the next row starts anew
        else:
            ratio = q[i + 1] / qq[i]
            ee[i] = e[i] * ratio
        d = d * ratio - shift
        if d < 0 or not np.isfinite(d):
            return None
    qq[n - 1] = d
    return qq, ee


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, largest first, by dqds with deflation."""
    size = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    if not size:
        return np.zeros(len(diagonal))
    found: list[float] = []
    blocks = [((np.asarray(diagonal) / size) ** 2, (np.asarray(upper) / size) ** 2, 0.0)]
    while blocks:
        q, e, total = blocks.pop()
        while len(q):
            n = len(q)
            if n == 1:
                found.append(q[0] + total)
                break
            small = np.flatnonzero(e <= (EPS / 4) ** 2 * (total + np.minimum(q[:-1], q[1:])))
            small = np.union1d(small, np.flatnonzero(e == 0))
            if len(small):
                at = int(small[-1])
                blocks.append((q[: at + 1], e[:at], total))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            # Smallest eigenvalue of the last 2 x 2 rows: an upper bound of that of the block.
            half, off = (q[-2] + e[-1] + q[-1]) / 2, q[-2] * q[-1]
            root = np.sqrt(max(half * half - off, 0.0))
            shift = off / (half + root) if half + root else 0.0
            if e[-1] > 0.1 * q[-1]:
                shift *= 0.25
            step = None
            for s in (shift * (1 - 1e-3) if e[-1] > 1e-12 * q[-1] else max(0.0, q[-1] - 2 * np.sqrt(q[-1] * e[-1])), shift * 0.7, shift * 0.2, 0.0):
                if (step := _dqds(q, e, s)) is not None:
                    total += s
                    break
            q, e = step
            if q[0] < q[-1] * 0.25 and total == 0:  # graded the wrong way: turn the block over
                q, e = _flipped(q, e)
    return np.sort(np.array(found))[::-1] * size * size


def _factors(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, ...]:
    """Stationary (from the top) and progressive (from the bottom) qd transforms of B'B - value, B bidiagonal.

    Row i of the twisted factorisation has pivot gamma[i]; l[i] and u[i] eliminate downwards and upwards.
    """
    n, q, off = len(a), a * a, a[:-1] * b  # B'B = L D L' with D = a^2, L's subdiagonal b / a
    tiny = max(EPS * EPS * float(q.max()), np.finfo(float).tiny)
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n):
        down[i] = q[i] + s[i]
        if abs(down[i]) < tiny:
            down[i] = -tiny
        if i < n - 1:
            # b^2 = e; s' = e * s / (q + s) - value
            s[i + 1] = b[i] * b[i] * (s[i] / down[i]) - value
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        up[i + 1] = b[i] * b[i] + p[i + 1]
        if abs(up[i + 1]) < tiny:
            up[i + 1] = -tiny
        p[i] = p[i + 1] * (q[i] / up[i + 1]) - value
    up[0] = p[0]
    return s, p, down, up, off


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for an eigenvalue: solved outwards from the row with the smallest pivot."""
    n = len(a)
    if n == 1:
        return np.ones(1)
    s, p, down, up, off = _factors(a, b, value)
    gamma = s + p + value
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -off[i] / down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -off[i] / up[i + 1] * z[i]
    big = np.abs(z).max()
    z /= big if np.isfinite(big) and big else 1.0
    return z / np.linalg.norm(z)


def _solved(a: np.ndarray, b: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """Solution of (B'B - value) x = right by the factors from the top."""
    n = len(a)
    _, _, down, _, off = _factors(a, b, value)
    small = EPS * max(np.abs(down).max(), 1e-300)
    d = np.where(np.abs(down) < small, np.copysign(small, down), down)
    y = np.array(right, float)
    for i in range(1, n):
        y[i] -= off[i - 1] / d[i - 1] * y[i - 1]
    x = y / d
    for i in range(n - 2, -1, -1):
        x[i] -= off[i] / d[i] * x[i + 1]
    return x


def _pieces(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Stretches between negligible superdiagonal entries, and after zero diagonal ones."""
    norm = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    cut = np.flatnonzero(np.abs(b) <= 16 * EPS * np.sqrt(np.abs(a[:-1]) * np.abs(a[1:])) + EPS * EPS * norm) + 1
    edges = [0, *cut.tolist(), len(a)]
    return list(zip(edges, edges[1:]))


def right_vectors(a: np.ndarray, b: np.ndarray, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of a bidiagonal matrix, largest first."""
    n = len(a)
    values, vectors = [], []
    rng = np.random.default_rng(0)
    for lo, hi in _pieces(a, b):
        aa, bb = a[lo:hi], b[lo : hi - 1]
        own = squared_singular_values(aa, bb)
        done: list[np.ndarray] = []
        for k, value in enumerate(own):
            near = [done[j] for j in range(k) if own[j] - value <= gap * max(own[j], EPS * own[0])]
            z = twisted_vector(aa, bb, value)
            for _ in range(4):
                if not near:
                    break
                basis = np.stack(near, 1)
                rest = z - basis @ (basis.T @ z)
                rest -= basis @ (basis.T @ rest)
                if np.linalg.norm(rest) > 0.5:
                    z = rest / np.linalg.norm(rest)
                    break
                start = rng.normal(size=hi - lo)
                start -= basis @ (basis.T @ start)
                z = _solved(aa, bb, value, start)
                z -= basis @ (basis.T @ z)
                z /= np.linalg.norm(z)
            done.append(z)
            full = np.zeros(n)
            full[lo:hi] = z
            values.append(value)
            vectors.append(full)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], _polished(a, b, np.stack(vectors, 1)[:, order])


def _polished(a: np.ndarray, b: np.ndarray, z: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """The vectors made orthogonal to rounding; where several equal values left directions mixed, plane rotations
    separate what the images under B still share. Ordinary spectra need no rotation."""
    n = len(a)
    z = np.where(np.isfinite(z).all(0), z, np.random.default_rng(1).normal(size=z.shape))
    if np.abs(z.T @ z - np.eye(n)).max() < 1e-6:
        z = 1.5 * z - 0.5 * z @ (z.T @ z)  # a Newton step towards the nearest orthogonal matrix
    else:
        z = np.linalg.qr(z)[0]
    full = np.diag(a) + np.diag(b, 1)
    turned = False
    for _ in range(sweeps):
        images = full @ z
        shared = images.T @ images
        loose = np.argwhere(np.triu(np.abs(shared), 1) > 8 * EPS * np.sqrt(n) * np.diag(shared).max(initial=0))
        if not len(loose):
            break
        turned = True
        for i, j in loose:
            x, y = full @ z[:, i], full @ z[:, j]
            cross, spread = x @ y, (y @ y - x @ x) / 2
            if cross:
                t = np.copysign(1.0, spread) * cross / (abs(spread) + np.hypot(spread, cross))
                c = 1 / np.hypot(1.0, t)
                z[:, i], z[:, j] = c * z[:, i] - c * t * z[:, j], c * t * z[:, i] + c * z[:, j]
    return z[:, np.argsort(-((full @ z) ** 2).sum(0), kind="stable")] if turned else z


@dataclass(frozen=True)
class Whitening:
    """``sums`` over ``n`` distinct fit rows; ``directions`` (dimension x components) are unit eigenvectors, in the
    columns, of the covariance with eigenvalues ``values``; ``explained`` their shares of the trace."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def solve(r: np.ndarray, n: int, sums: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """Directions from the triangle of the centred rows. Components without variance, to rounding, are left out."""
    square = np.zeros((r.shape[1], r.shape[1]))
    square[: len(r)] = r  # fewer rows than dimensions leave a shorter triangle
    a, b, v = bidiagonalise(square)
    squares, z = right_vectors(a, b)
    trace = float(squares.sum())
    floor = (1000 * EPS * len(a)) ** 2 * squares[0]
    keep = [k for k in range(min(components, len(squares))) if squares[k] > floor]
    return Whitening(n, sums, v @ z[:, keep], squares[keep] / n, squares[keep] / trace if trace else squares[keep])


# ---- rows on the executors --------------------------------------------------------------------


def integers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` of the rows whose vector has only finite entries, and the most frequent length."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", entry))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).select("d").first()
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return rows.where(F.size("v") == (length.d if length else 0)).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    values, offsets = list_parts(column)
    return values[offsets[0] : offsets[-1]].astype(np.int64).reshape(-1, d)


def _part_sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, np.int64), 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            total += (x - OFFSET).sum(0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array(np.append(n, total))], names=["dim", "total"])

    return run


def _deviations(x: np.ndarray, n: int, shifted: np.ndarray) -> np.ndarray:
    """n*x - S in exact integers; ``shifted`` are the sums of x - OFFSET."""
    return n * (x - OFFSET) - shifted


def _triangle(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def _part_triangle(d: int, n: int, shifted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                r = _triangle(r, _deviations(_matrix(batch.column(0), d), n, shifted) / n)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    return run


def _stack(d: int):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        r = None
        for block in part.sort_values("node").r:
            r = _triangle(r, np.frombuffer(block).reshape(-1, d))
        return pd.DataFrame({"node": [int(key[0])], "r": [r.tobytes()]})

    return run


def triangle(fit: DataFrame, d: int, n: int, shifted: np.ndarray) -> np.ndarray:
    """R of all centred rows; at most ``FAN_IN`` triangles meet in a task, or reach the driver."""
    parts = materialise(fit.select("x").mapInArrow(_part_triangle(d, n, shifted), "node long, r binary"), "triangles")
    while parts.count() > FAN_IN:
        above = parts.groupBy(F.floor(F.col("node") / FAN_IN).alias("above")).applyInPandas(_stack(d), "node long, r binary")
        parts = materialise(above, "triangles")
    r = None
    for row in parts.orderBy("node").collect():
        r = _triangle(r, np.frombuffer(row.r).reshape(-1, d))
    return r


def _moments(model: Whitening, d: int, shifted: np.ndarray):
    """Count, mean and centred products of the whitened rows of a task, as a flat row for each number."""
    scale = model.directions / np.sqrt(model.values)
    k = scale.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _deviations(_matrix(batch.column(0), d), model.n, shifted) / model.n @ scale
            own = y.mean(0)
            step = own - mean
            products += (y - own).T @ (y - own) + np.outer(step, step) * (n * len(y) / (n + len(y)))
            mean += step * (len(y) / (n + len(y)))
            n += len(y)
        if n:
            # Rows are centred already: means are rounding errors, so sums of products of whole rows lose nothing.
            flat = np.concatenate([n * mean, (products + n * np.outer(mean, mean)).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

    return run


def identity_error(fit: DataFrame, model: Whitening, shifted: np.ndarray) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, measured on all of its rows."""
    k = model.directions.shape[1]
    if not k:
        return 0.0
    rows = fit.select("x").mapInArrow(_moments(model, len(shifted), shifted), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(k + k * k)
    for row in rows:
        flat[row["at"]] = row["value"]
    mean = flat[:k] / model.n
    return float(np.abs(flat[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, float]:
    """(model, identity error) of the distinct ``x`` of :func:`integers`; None without rows."""
    distinct = materialise(rows.select("x").distinct(), "distinct")
    first = distinct.first()
    if first is None:
        return None, 0.0
    d = len(first.x)
    sums = {r["dim"]: r["total"] for r in distinct.mapInArrow(_part_sums(d), "dim long, total long").groupBy("dim").agg(F.sum("total").alias("total")).collect()}
    n, shifted = sums[-1], np.array([sums[k] for k in range(d)], np.int64)
    model = solve(triangle(distinct, d, n, shifted), n, shifted + n * OFFSET, components)
    return model, identity_error(distinct, model, shifted)


def _apply(model: Whitening, error: float, id_type: str):
    d = len(model.sums)
    shifted = model.sums - model.n * OFFSET
    scale = model.directions / np.sqrt(model.values)
    k = scale.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = _deviations(_matrix(batch.column(1), d), model.n, shifted)
            rows = len(gap)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)), pa.array(np.repeat((gap * gap).sum(1), k)), pa.array(((gap / model.n) @ scale).ravel()),
                    pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened components of every row with a finite vector, in long form.

    Rows without a vector, with an empty one, or with null or non-finite entries are dropped, as are vectors of another length than
    the most frequent one (the longer of two equally frequent). Repeated vectors count once in the fit and each row is returned; null and
    repeated ids are returned as they are. Only the two named columns are read. Where fewer directions than ``components`` have variance, only
    those are returned: none for a single distinct vector or an empty table. ``deviation`` is exact within 64 bits.
    """
    rows = materialise(integers(embeddings, id_col, vector_col), "integers")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, error = fit(rows, components)
    if model is None or not model.directions.shape[1]:
        return embeddings.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_apply(model, error, kind), schema)


def query(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings)
