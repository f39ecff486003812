"""Embedding whitening with eigenvectors by FEAST contour integration.

Spark sums counts, and integer products of centred entries, over all rows: exact, and of a size that
the dimension alone sets. On that covariance the driver finds the largest eigenvalues. Inertia counts
(signs of the pivots of a symmetric factorisation of V - s I) bracket them in intervals of a few
each, with ends in gaps. For each interval, a circle through its ends is integrated by
Gauss-Legendre quadrature: solves with the complex shifted covariance project a block of vectors
onto the eigenspace within, Rayleigh-Ritz extracts components, and both repeat until residuals
are at rounding level. The count of components found must be the interval's inertia count, so none
is missed; else the block grows and the interval is tried anew. Rows are then projected where they
lie, by tasks.

Edge cases: rows whose vector is null or has null or non-finite entries are dropped, as are vectors
of another length than most (the longer one at a tie) and those with an entry of 2**40 or more in
magnitude, which 64-bit numbers can't hold after scaling. Components whose variance is zero within
rounding can't be whitened and are left out, so equal vectors, or one alone, give no row. Repeated
rows and null vec_id count as rows of their own. deviation is null where it exceeds 64 bits
(deviation_exact of the operator is a decimal). An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_ready

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries from here on are dropped; eigenvalues in an interval at most; nodes on a half circle; rounds and growths at most.
LARGEST, SLICE, NODES, ROUNDS = 2.0**40, 8, 12, 12
_DECIMAL = pa.decimal128(38, 0)


def usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(v, lambda x: F.coalesce((x > -LARGEST) & (x < LARGEST), F.lit(False)))


def clean(embeddings: DataFrame, vector: str) -> DataFrame:
    """vec_id, v (array<double>) of the usable rows of the commonest length."""
    rows = embeddings.filter(usable(F.col(vector))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return rows.filter(F.size("v") == F.lit(most or -1))


def scaled(column: pa.Array) -> np.ndarray:
    """Rows of x = floor(1024 c) + 100000."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(column), -1)


def exact_products(y: np.ndarray) -> np.ndarray:
    """yᵀy in whole numbers: in doubles, as far as these are exact, else in Python's integers."""
    top = int(np.abs(y).max(initial=0))
    step = (1 << 53) // max(1, top * top)
    if step < 1:
        wide = y.astype(object)
        return wide.T @ wide
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for i in range(0, len(y), step):
        part = y[i : i + step].astype(np.float64)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def summed(rows: DataFrame, f) -> dict[int, int]:
    """Sums over all batches of f(x), a flat array of whole numbers, by place: one row a place, exact."""

    def parts(batches: Iterator[pa.RecordBatch]):
        total = None
        for b in batches:
            if b.num_rows:
                own = f(scaled(b.column(1)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array([Decimal(int(t)) for t in total], _DECIMAL)], ["at", "part"])

    sums = rows.mapInArrow(parts, "at long, part decimal(38,0)").groupBy("at").agg(F.sum("part").alias("total"))
    return {r["at"]: int(r["total"]) for r in sums.collect()}  # as many as the dimension's square


def covariance(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, sums S by dimension, and the covariance of x (divisor n). Centred on whole numbers first; the rest of the centre is exact too."""
    sums = summed(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]).astype(object))
    if not sums or len(sums) == 1:
        return sums.get(0, 0), [], np.zeros((0, 0))
    n, total = sums[0], [sums[i + 1] for i in range(len(sums) - 1)]
    centre = [round(Fraction(s, n)) for s in total]
    d, middle = len(total), np.array(centre, np.int64)
    prods = summed(rows, lambda x: exact_products(x - middle).ravel())
    rest = [s - n * c for s, c in zip(total, centre, strict=True)]
    v = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = (n * prods[i * d + j] - rest[i] * rest[j]) / (n * n)  # whole numbers until the division
    return n, total, v


def inertia_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of v exceed shift: positive pivots of a symmetric factorisation of v - shift I, with 1 x 1 and 2 x 2 pivots (Bunch and Parlett)."""
    a = v - shift * np.eye(len(v))
    above, tiny = 0, np.finfo(float).tiny
    while len(a):
        on = np.abs(np.diag(a))
        p = int(on.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = divmod(int(off.argmax()), len(a))
        if on[p] >= 0.6404 * off[i, j]:
            if on[p] <= tiny:  # all that is left is zero: none is above
                return above
            above += a[p, p] > 0
            rest = np.arange(len(a)) != p
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, p], a[p, rest]) / a[p, p]
        else:
            pair, rest = [i, j], ~np.isin(np.arange(len(a)), [i, j])
            block = a[np.ix_(pair, pair)]
            above += 1  # such a block has one eigenvalue of either sign
            a = a[np.ix_(rest, rest)] - a[np.ix_(rest, pair)] @ np.linalg.solve(block, a[np.ix_(pair, rest)])
    return int(above)


def cut_above(v: np.ndarray, k: int, low: float, high: float) -> tuple[float, int]:
    """A shift in a gap with at least k eigenvalues above it, as few as can be, and their count. low has at least k above, high none."""
    least = (high - low) * 1e-14
    a, b = low, high  # at a: k or more above; at b: fewer
    while b - a > least:
        m = (a + b) / 2
        a, b = (m, b) if inertia_above(v, m) >= k else (a, m)
    kth = a  # the kth largest is just above
    count = inertia_above(v, kth - 4 * least)
    below, top = low, kth - 4 * least  # the next smaller: fewer above at top than below it
    if inertia_above(v, low) == count:
        return low, count
    while top - below > max(least, 1e-3 * (kth - below)):
        m = (below + top) / 2
        below, top = (m, top) if inertia_above(v, m) > count else (below, m)
    return (top + kth - 4 * least) / 2, count


def slices(v: np.ndarray, k: int, most: int = SLICE) -> list[tuple[float, float, int]]:
    """Intervals (low, high, count) from the top that have the k largest eigenvalues and those that can't be told from the kth."""
    radius = np.abs(v).sum(axis=1).max() * (1 + 1e-9)  # Gershgorin
    out, high, done = [], radius, 0
    while done < min(k, len(v)):
        low, count = cut_above(v, min(done + most, k), -radius * 1e-3 - radius * 1e-9, high)
        out.append((low, high, count - done))
        high, done = low, count
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The count eigenvalues of v within (low, high), falling, and unit eigenvectors as columns."""
    d, scale = len(v), np.abs(v).sum(axis=1).max()
    x, w = np.polynomial.legendre.leggauss(NODES)
    angle, centre, radius = (x + 1) * np.pi / 2, (low + high) / 2, (high - low) / 2
    width = min(d, max(count + 2, (3 * count + 1) // 2))
    while True:
        block = np.random.default_rng(seed).standard_normal((d, width))
        before = np.inf
        for _ in range(ROUNDS):
            projected = np.zeros_like(block)
            for t, weight in zip(angle, w, strict=True):  # the lower half circle is the conjugate
                turn = radius * np.exp(1j * t)
                projected += weight / 2 * (turn * np.linalg.solve((centre + turn) * np.eye(d) - v, block.astype(complex))).real
            basis, _ = np.linalg.qr(projected)
            values, mixed = np.linalg.eigh(basis.T @ v @ basis)  # Rayleigh-Ritz
            block = basis @ mixed
            inside = (values > low) & (values < high)
            own, vectors = values[inside], block[:, inside]
            worst = np.abs(v @ vectors - vectors * own).max(initial=0.0)
            good = len(own) == count and worst <= 1e-13 * scale
            if good or (len(own) == count and worst >= before * 0.9 and worst <= 1e-12 * scale):
                order = np.argsort(-own, kind="stable")
                return own[order], vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
            before = worst
        if width == d:
            raise ArithmeticError(f"{len(own)} of {count} eigenvalues between {low} and {high}")
        width = min(d, 2 * width)


def components(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance, falling, without those that are zero within rounding, and unit eigenvectors as columns."""
    none = np.zeros(0), np.zeros((len(v), 0))
    if not len(v) or np.trace(v) <= 0:
        return none
    scale = np.abs(v).sum(axis=1).max()
    parts = [feast(v / scale, *s) for s in slices(v / scale, min(k, len(v)))]
    values, vectors = np.concatenate([p[0] for p in parts]) * scale, np.concatenate([p[1] for p in parts], axis=1)
    real = (values > len(v) * 1e-14 * scale) & (np.arange(len(values)) < k)
    return values[real], vectors[:, real]


def projected(x: np.ndarray, n: int, total: np.ndarray, centre: np.ndarray, rest: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Rows of x - S / n, projected: centred on whole numbers first, so that nothing cancels."""
    return ((x - centre).astype(np.float64) - rest) @ onto


def whitened(embeddings: DataFrame, k: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact for each usable row of embeddings (vec_id, vector) and component."""
    spark = embeddings.sparkSession
    python_ready(spark)
    rows = clean(embeddings, vector)
    n, total, v = covariance(rows)
    values, vectors = components(v, k)
    middle = [round(Fraction(s, n)) for s in total] if n else []
    centre, rest = np.array(middle, np.int64), np.array([float(Fraction(s, n) - c) for s, c in zip(total, middle, strict=True)])
    onto, m = vectors / np.sqrt(values), len(values)
    explained = (values / np.trace(v)).tolist() if m else []
    sums = np.array(total, np.int64)
    error = identity_error(rows, m, lambda x: projected(x, n, sums, centre, rest, onto)) if m else 0.0
    left = [s - n * c for s, c in zip(total, middle, strict=True)]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]

    def out(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows or not m:
                continue
            x = scaled(b.column(1))
            white = projected(x, n, sums, centre, rest, onto)
            y = x - centre
            room = n * (int(np.abs(y).max(initial=0)) + 1)
            if room * room * y.shape[1] < 1 << 62:
                exact = ((n * y - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                exact = [sum((n * a - r) ** 2 for a, r in zip(own, left, strict=True)) for own in y.tolist()]
            exact = [e for e in exact for _ in range(m)]
            many = len(exact)
            cols = [pa.array(np.repeat(np.arange(b.num_rows), m)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(many, n, np.int64))]
            cols[0] = b.column(0).take(cols[0])
            cols += [pa.array([e if e < 1 << 63 else None for e in exact], pa.int64()), pa.array(white.ravel()), pa.array(explained * b.num_rows, pa.float64()), pa.array(np.full(many, error)), pa.array([Decimal(e) if e < 10**38 else None for e in exact], _DECIMAL)]
            yield pa.RecordBatch.from_arrays(cols, names)

    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    return rows.mapInArrow(out, kinds)


def identity_error(rows: DataFrame, m: int, project) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, summed over all rows."""

    def parts(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(1 + m + m * m)
        for b in batches:
            if b.num_rows:
                w = project(scaled(b.column(1)))
                total += np.concatenate([[len(w)], w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["at", "part"])

    got = {r["at"]: r["total"] for r in rows.mapInArrow(parts, "at long, part double").groupBy("at").agg(F.sum("part").alias("total")).collect()}  # 73 rows
    n, mean = got[0], np.array([got[1 + i] for i in range(m)]) / got[0]
    square = np.array([got[1 + m + i] for i in range(m * m)]).reshape(m, m) / n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(m)).max())
