"""Embedding whitening by QDWH spectral divide and conquer.

Entries c become whole numbers x = floor(1024 c) + 100000. With n vectors and sums S per dimension, the covariance V of x is taken in whole numbers: x less
the rounded mean is small, its products are summed exactly (so the result does not depend on the order of tasks or on a task being run again), and the rest of the
mean is taken out as an integer as well. Where values are too large for that, products of ``x - S/n`` are summed as doubles.

``components`` splits V: the polar factor U of V - s I (QR-based dynamically weighted Halley iterations) has eigenvalues +1 and -1, so
(I + U) / 2 projects on the invariant subspace with eigenvalues above s. An orthonormal basis of both subspaces turns V into two blocks, which are split in turn.
A block whose eigenvalues are equal within rounding needs no split. The vectors are then refined in extended precision.

Spread: sums and products are partial aggregates of tasks. The d x d matrix is all that reaches the driver (d is at most ``MAX_DIM``); components and means are
broadcast, d (k + 1) numbers, and every task whitens its own vectors.

Defined cases: vectors that are null or hold null, NaN or infinite entries are left out; shorter vectors count as filled up with zeros (x = 100000); |1024 c| is held to
2^52 at most; components without variance (below 1e-13 of the largest eigenvalue, as with one vector or equal vectors) are left out; repeated rows count each; a null id stays; an empty
table gives no rows; columns other than the id and the vector are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.session import materialize

MAX_DIM = 2048
SHIFT, SCALE = 100_000, 1024
WHOLE = 1 << 52  # whole numbers that a double holds
EPS = np.finfo(float).eps


# spectral divide and conquer

def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix without an eigenvalue near zero, by QR-based weighted Halley steps."""
    size = np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())
    x, n = a / size, len(a)
    low = EPS / 4  # a bound below on the least singular value; smaller ones only cost steps
    for _ in range(12):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        low = min(low * (wa + wb * low**2) / (1 + wc * low**2), 1.0)
        done = np.linalg.norm(new - x) <= 10 * EPS ** (1 / 3) and 1 - low < 10 * EPS
        x = new
        if done:
            break
    return x


def basis(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement: two rounds of subspace iteration from a fixed start."""
    n = len(projector)
    start = np.random.default_rng(1).standard_normal((n, n))
    first = np.linalg.qr(projector @ start[:, :rank])[0]
    first = np.linalg.qr(projector @ first)[0]
    rest = start[:, rank:] - projector @ start[:, rank:]
    for _ in range(2):
        rest = np.linalg.qr(rest - first @ (first.T @ rest))[0]
    return first, rest


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if all eigenvalues are equal within rounding."""
    n, centre = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - centre * np.eye(n), 2 if n <= 64 else "fro")
    if spread <= 16 * n * EPS * abs(centre):
        return None
    best = None
    # the mean of the eigenvalues always lies between two of them; the others move off an eigenvalue that a shift has hit
    for shift in (np.median(np.diag(a)), centre, *(centre + spread * f for f in (0.013, -0.017, 0.0031, -0.0023, 0.0007))):
        projector = (np.eye(n) + polar(a - shift * np.eye(n))) / 2
        rank = int(np.rint(np.trace(projector)))
        if not 0 < rank < n:
            continue
        first, rest = basis(projector, rank)
        left = np.linalg.norm(rest.T @ a @ first)
        if best is None or left < best[0]:
            best = (left, first, rest)
        if left <= 64 * n * EPS * np.linalg.norm(a):
            break
    return best and best[1:]


def refined(a: np.ndarray, v: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps on each pair whose eigenvalue stands apart, with residuals in extended precision."""
    v, n = v.astype(np.longdouble), len(a)
    for j in np.flatnonzero(gaps):
        x = v[:, j]
        for _ in range(3):
            x = x / np.sqrt(x @ x)
            e = x @ (a @ x)
            left = np.block([[a.astype(float) - float(e) * np.eye(n), x.astype(float)[:, None]], [x.astype(float)[None, :], np.zeros((1, 1))]])
            step = np.linalg.solve(left, np.append((e * x - a @ x).astype(float), 0.0))[:n]
            x = x + step
        v[:, j] = x
    for j in range(v.shape[1]):  # orthonormal to the last digit
        for _ in range(2):
            v[:, j] -= v[:, :j] @ (v[:, :j].T @ v[:, j])
            v[:, j] /= np.sqrt(v[:, j] @ v[:, j])
    return np.einsum("ij,ij->j", v, a @ v).astype(float), v.astype(float)


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    The upper subspace is always split first, and what lies below the k-th component never.
    """
    a, n = v.astype(float), len(v)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    todo, found = [np.eye(n)], []
    while todo and sum(f.shape[1] for f in found) <= k:
        q = todo.pop()
        block = q.T @ a @ q
        parts = split((block + block.T) / 2) if q.shape[1] > 1 else None
        if parts is None:
            found.append(q)
        else:
            todo += [q @ parts[1], q @ parts[0]]
    vectors = np.hstack(found)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:k + 1]
    vectors, values = vectors[:, order], values[order]
    near = np.abs(values[:, None] - values[None, :]) + np.diag(np.full(len(values), np.inf))
    values, vectors = refined(v, vectors, near.min(axis=1) > 1e-7 * max(abs(values[0]), 1e-300))
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], vectors[:, order]


# sums over all vectors

def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, short ones filled up."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(sizes), width), SHIFT, dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, x of the vectors that hold finite entries only."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(SCALE * c, F.lit(-float(WHOLE))), F.lit(float(WHOLE)))) + SHIFT)
    return vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & F.forall("v", finite)).select("id", x.alias("x"))


@dataclass(frozen=True)
class Means:
    """n vectors, the rounded mean of each dimension and what S has over n times it; the largest distance from the rounded mean."""
    n: int
    centre: np.ndarray
    over: list[int]
    reach: int

    @property
    def fraction(self) -> np.ndarray:
        return np.array([o / self.n for o in self.over])


def means(x: DataFrame) -> Means | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, low, high, counts = [], [], [], []
        n = 0
        for batch in batches:
            column = batch.column(0)
            n += len(column)
            sizes = np.diff(column.offsets.to_numpy())
            width = int(sizes.max(initial=0))
            m, there = matrix(column, width), np.arange(width)[None, :] < sizes[:, None]
            for j in range(width - len(sums)):
                for part, value in zip((sums, low, high, counts), (0, 1 << 62, -1 << 62, 0)):
                    part.append(value)
            # in two halves, so that no sum of a batch leaves 64 bits
            upper, lower, c = (np.where(there, m >> 26, 0)).sum(axis=0), (np.where(there, m & ((1 << 26) - 1), 0)).sum(axis=0), there.sum(axis=0)
            least, most = np.where(there, m, 1 << 62).min(axis=0, initial=1 << 62), np.where(there, m, -1 << 62).max(axis=0, initial=-1 << 62)
            for j in range(width):
                sums[j] += (int(upper[j]) << 26) + int(lower[j])
                counts[j] += int(c[j])
                low[j], high[j] = min(low[j], int(least[j])), max(high[j], int(most[j]))
        dims = [-1, *range(len(sums))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(dims, type=pa.int32()), pa.array([0, *sums], type=pa.decimal128(38, 0)), pa.array([0, *low], type=pa.int64()),
             pa.array([0, *high], type=pa.int64()), pa.array([n, *counts], type=pa.int64())], names=["dim", "s", "low", "high", "count"])

    rows = x.select("x").mapInArrow(run, "dim int, s decimal(38,0), low long, high long, count long").groupBy("dim").agg(
        F.sum("s").cast("decimal(38,0)").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("count").alias("count")) \
        .orderBy("dim").limit(MAX_DIM + 2).collect()
    if len(rows) > MAX_DIM + 1:
        raise ValueError(f"vectors of more than {MAX_DIM} entries")
    n = rows[0]["count"] if rows else 0
    if not n:
        return None
    centre, over, reach = [], [], 0
    for r in rows[1:]:
        missing = n - r["count"]
        s = int(r["s"]) + missing * SHIFT
        c = (2 * s + n) // (2 * n)
        low, high = (min(r["low"], SHIFT), max(r["high"], SHIFT)) if missing else (r["low"], r["high"])
        centre.append(c)
        over.append(s - n * c)
        reach = max(reach, high - c, c - low)
    return Means(n, np.array(centre, dtype=np.int64), over, reach)


def covariance(x: DataFrame, m: Means) -> np.ndarray:
    """V with divisor n, in extended precision: from exact whole numbers where products of a few vectors fit a double's whole numbers."""
    d, exact = len(m.centre), m.reach < 1 << 26
    rows_at_once = max(1, (1 << 53) // max(1, m.reach) ** 2) if exact else 1 << 16
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), dtype=object if exact else float)
        held, since = np.zeros((d, d), dtype=np.int64), 0
        for batch in batches:
            y = matrix(batch.column(0), d) - m.centre
            for at in range(0, len(y), min(rows_at_once, 1 << 16)):
                part = y[at:at + min(rows_at_once, 1 << 16)].astype(float)
                if not exact:
                    part -= m.fraction
                    total = total + part.T @ part
                    continue
                since += len(part)
                if since * m.reach**2 >= 1 << 62:
                    total, held, since = total + held, np.zeros((d, d), dtype=np.int64), len(part)
                held += (part.T @ part).astype(np.int64)
        total = total + held
        values = pa.array(total[upper].tolist(), type=pa.decimal128(38, 0)) if exact else pa.array(total[upper], type=pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), type=pa.int32()), values], names=["cell", "v"])

    kind = "decimal(38,0)" if exact else "double"
    sums = x.select("x").mapInArrow(run, f"cell int, v {kind}").groupBy("cell").agg(F.sum("v").cast(kind).alias("v")).toArrow().sort_by("cell")
    v = np.zeros((d, d), dtype=np.longdouble)
    if exact:
        cells = [(m.n * int(s) - m.over[i] * m.over[j]) for s, i, j in zip(sums["v"].to_pylist(), *upper)]
        v[upper] = [np.longdouble(c >> 40) * (1 << 40) + (c & ((1 << 40) - 1)) for c in cells]
        v[upper] /= np.longdouble(m.n) ** 2
    else:
        v[upper] = sums["v"].to_numpy() / m.n
    v.T[upper] = v[upper]
    return v


def project(x: DataFrame, m: Means, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """id, deviation (null beyond 38 digits), whitened."""
    d, k = vectors.shape
    model = x.sparkSession.sparkContext.broadcast((m, vectors / np.sqrt(values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, to = model.value
        over = np.array(m.over, dtype=object)
        fits = d * (m.n * (m.reach + 1)) ** 2 < 1 << 62
        for batch in batches:
            y = matrix(batch.column(1), d) - m.centre
            if fits:
                deviation = pa.array(((m.n * y - over.astype(np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                sums = ((m.n * y.astype(object) - over) ** 2).sum(axis=1).tolist()
                deviation = pa.array([s if s < 10**38 else None for s in sums], type=pa.decimal128(38, 0))
            white = (y - m.fraction) @ to
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, k), type=pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["id", "deviation", "whitened"])

    kind = x.schema["id"].dataType.simpleString()
    return x.select("id", "x").mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy().reshape(-1, k)
            total += w.T @ np.hstack([w, np.ones((len(w), 1))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), type=pa.int32()), pa.array(total.ravel())], names=["cell", "v"])

    sums = white.select("whitened").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow().sort_by("cell")
    total = sums["v"].to_numpy().reshape(k, k + 1) / n
    return float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str, vec_col: str, k: int = 8) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: up to k rows for every vector that is left."""
    x = materialize(whole_numbers(vectors, id_col, vec_col))
    m = means(x)
    values, axes = components(v := covariance(x, m), k) if m else (np.zeros(0), np.zeros((0, 0)))
    keep = values > 1e-13 * values[0] if len(values) and values[0] > 0 else np.zeros(len(values), dtype=bool)
    values, axes = values[keep], axes[:, keep]
    if not len(values):
        return x.limit(0).select("id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
                                 *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    white = materialize(project(x, m, values, axes))
    explained = F.array(*[F.lit(float(e)) for e in (values / float(np.trace(v)))])
    return white.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "id", (F.col("at") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(identity_error(white, m.n, len(values))).alias("identity_error"))
