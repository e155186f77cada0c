"""Whitening of vectors by Chebyshev-filtered subspace iteration over distributed passes.

One pass multiplies the covariance of the distinct vectors with a narrow block Q: every
task centres its rows and sums XᵀXQ, Spark adds those sums, and only a matrix of
dimensions x block reaches the driver. The covariance itself is never built. A three-term
recurrence of such passes applies a Chebyshev polynomial that stays small over the
unwanted spectrum and grows fast above it. QR and a Rayleigh-Ritz step follow, until the
residuals of the wanted pairs certify them.

Inputs: vectors that are missing or hold missing or non-finite entries take no part, in
no result row. Shorter vectors are filled up with zeros to the longest one. Repeated rows
and missing or repeated ids are rows of their own, but count once in the fit. Without
variance (no rows, one distinct vector, empty vectors) there are no components and so no
rows; a component of no variance is left out. With equal eigenvalues any orthonormal
basis may come out. Entries beyond the range of a long are held at its ends, and a
deviation beyond it is missing. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.llm.common import arrow_schema, batches, stored
from quotewright.llm.vectors import matrix

#: Columns of the block beyond the wanted ones; they keep the filter's edge away from those.
GUARD = 20
#: Steps of the first estimate of the spectrum's ends; most steps of one filter; most filters.
PROBE_STEPS, DEGREE, ROUNDS = 12, 12, 60
#: A filter may lift the first wanted direction over the last by so much; more would cost digits.
SPREAD = 1e8
#: Residual over the largest eigenvalue that certifies a pair, and the one still accepted where rounding allows no less.
CERTIFIED, ACCEPTED = 1e-13, 1e-9
#: Components under this share of the largest eigenvalue have no variance.
NO_VARIANCE = 1e-10
LONG_MAX = 2**63 - 1
SUMS = "i int, high long, low long"
PRODUCTS = "i int, value double"


@dataclass(frozen=True)
class Fit:
    """n distinct vectors, their sums, trace of the covariance, and its leading unit eigenvectors (columns)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def quantised(vectors: DataFrame, scale: int = 256, column: str = "embedding") -> DataFrame:
    """vec_id and x, the entries times ``scale`` rounded down; every sound row stays."""
    sound = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def whole(c):
        up = F.floor(F.lit(scale) * c.cast("double"))
        far = F.abs(F.lit(scale) * c.cast("double")) >= 2.0**63
        return F.when(far, F.when(c > 0, F.lit(LONG_MAX)).otherwise(F.lit(-LONG_MAX))).otherwise(up.cast("long"))

    return vectors.where(F.col(column).isNotNull()).where(sound).select(F.col("vec_id").cast("long"), F.transform(column, whole).alias("x"))


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return matrix(pa.chunked_array([batch.column("x")]), width)


def column_sums(fit: DataFrame, width: int) -> list[int]:
    """Exact sums per dimension; high and low halves are added apart, so nothing overflows."""
    schema = arrow_schema(SUMS)

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in stream:
            x = _rows(batch, width)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(high), pa.array(low)], schema=schema)

    sums = fit.select("x").mapInArrow(add, SUMS).groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    by_dimension = {r["i"]: (r["high"] << 32) + r["low"] for r in sums}
    return [by_dimension[i] for i in range(width)]


class Covariance:
    """Products with the covariance of ``fit`` (column x); each is one distributed pass."""

    def __init__(self, fit: DataFrame, n: int, mean: np.ndarray):
        self.fit, self.n, self.mean, self.passes = fit, n, mean, 0

    def _summed(self, part) -> np.ndarray:
        """The sum over all tasks of what ``part`` makes of each batch of centred rows."""
        mean, schema = self.mean, arrow_schema(PRODUCTS)

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in stream:
                if batch.num_rows:
                    product = part(_rows(batch, len(mean)) - mean).ravel()
                    total = product if total is None else total + product
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], schema=schema)

        self.passes += 1
        rows = self.fit.select("x").mapInArrow(run, PRODUCTS).groupBy("i").agg(F.sum("value").alias("value")).collect()
        out = np.empty(len(rows))
        out[[r["i"] for r in rows]] = [r["value"] for r in rows]
        return out / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        return self._summed(lambda x: x.T @ (x @ q)).reshape(q.shape)

    def of_projection(self, w: np.ndarray) -> np.ndarray:
        """Covariance of the rows projected on the columns of ``w``."""
        def part(x: np.ndarray) -> np.ndarray:
            z = x @ w
            return z.T @ z

        return self._summed(part).reshape(w.shape[1], w.shape[1])

    def trace(self) -> float:
        return float(self._summed(lambda x: (x * x).sum(axis=0)).sum())


def spectrum_ends(cov: Covariance, width: int, rng: np.random.Generator) -> tuple[float, float]:
    """Estimates just outside the smallest and largest eigenvalue, by a few Lanczos steps."""
    basis, alpha, beta = [rng.standard_normal(width)], [], []
    basis[0] /= np.linalg.norm(basis[0])
    rest = 0.0
    for _ in range(min(PROBE_STEPS, width)):
        v = cov.times(basis[-1][:, None])[:, 0]
        alpha.append(float(v @ basis[-1]))
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
        rest = float(np.linalg.norm(v))
        if rest <= 1e-12 * max(abs(a) for a in alpha):
            rest = 0.0
            break
        beta.append(rest)
        basis.append(v / rest)
    k = len(alpha)
    ritz = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[: k - 1], 1) + np.diag(beta[: k - 1], -1))
    return max(0.0, float(ritz[0]) - rest), float(ritz[-1]) + rest


def degree_for(first: float, last: float) -> int:
    """Steps that lift the first wanted direction over the last by at most SPREAD; both lie above 1 on the filter's scale."""
    gain = math.acosh(max(first, 1 + 1e-12)) - math.acosh(max(last, 1 + 1e-12))
    return max(2, min(DEGREE, int(math.log(SPREAD) / gain) if gain > 0 else DEGREE))


def chebyshev(cov: Covariance, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """T_degree of the covariance, scaled to [low, high] -> [-1, 1], times ``q``; ``vq`` is its product with ``q``.

    Scaled by its growth at ``top``, so that no entry overflows.
    """
    centre, half = (high + low) / 2, (high - low) / 2
    scale = half / (top - centre)
    first = scale
    before, now = q, (vq - centre * q) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (cov.times(now) - centre * now) * (2 * following / half) - before * (scale * following)
        scale = following
    return now


def leading(cov: Covariance, width: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, with unit eigenvectors; the largest entry of each is positive."""
    rng = np.random.default_rng(7)
    block = min(width, wanted + GUARD)
    q = np.linalg.qr(rng.standard_normal((width, block)))[0]
    low = spectrum_ends(cov, width, rng)[0] if block < width else 0.0
    best = math.inf
    for _ in range(ROUNDS):
        vq = cov.times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn  # Rayleigh-Ritz
        kept = slice(0, wanted)
        residual = float(np.linalg.norm(vq[:, kept] - q[:, kept] * values[kept], axis=0).max()) / max(values[0], 1e-300)
        settled = residual <= CERTIFIED * math.sqrt(width) or (residual <= ACCEPTED and residual > best / 2)
        if block == width or values[0] <= 0 or settled:
            break
        best = min(best, residual)
        high, top = float(values[-1]), float(values[0])
        if high <= low:  # what is left of the spectrum is one point
            low = 0.0
        if high - low <= 1e-12 * top:
            break
        centre, half = (high + low) / 2, (high - low) / 2
        degree = degree_for((top - centre) / half, (float(values[min(wanted, block) - 1]) - centre) / half)
        q = np.linalg.qr(chebyshev(cov, q, vq, low, high, top, degree))[0]
    else:
        raise ArithmeticError(f"no certified components after {ROUNDS} filters: residual {residual:.1e} of the largest eigenvalue")
    values, q = values[:wanted], q[:, :wanted]
    signs = np.sign(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])])
    return values, q * np.where(signs == 0, 1, signs)


def fit_components(rows: DataFrame, components: int = 4) -> tuple[Fit, Covariance] | None:
    """Fit on the distinct vectors of ``rows`` (``quantised``); None if they have no variance."""
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    fit = stored(rows.select(filled.alias("x")).distinct(), "distinct-vectors")
    n = fit.count()
    sums = column_sums(fit, width)
    cov = Covariance(fit, n, np.array([s / n for s in sums]))
    trace = cov.trace()
    if n < 2 or trace <= 0:
        return None
    values, q = leading(cov, width, min(components, width))
    sound = values > NO_VARIANCE * values[0]
    return Fit(n, sums, trace, values[sound], q[:, sound], cov.passes), cov


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2, exact; None beyond a long."""
    reach = n * max(int(np.abs(x.astype(np.float64)).max(initial=0)) + 1, 1) + max(map(abs, sums))
    if reach * reach * len(sums) <= LONG_MAX:
        d = n * x - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [e if e <= LONG_MAX else None for e in exact]


def project(rows: DataFrame, fit: Fit, identity_error: float) -> DataFrame:
    """One row per row of ``rows`` and component: see ``whiten``."""
    n, sums, mean = fit.n, fit.sums, fit.mean
    weights, k = fit.vectors / np.sqrt(fit.values), len(fit.values)
    explained = fit.values / fit.trace

    def run(batch: dict) -> dict:
        x = matrix(pa.chunked_array([batch["x"]]), len(sums))
        m = len(x)
        return {
            "vec_id": batch["vec_id"].take(pa.array(np.repeat(np.arange(m), k))),
            "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, n),
            "deviation": pa.array([d for d in deviations(x, n, sums) for _ in range(k)], pa.int64()),
            "whitened": ((x - mean) @ weights).ravel(), "explained": np.tile(explained, m),
            "identity_error": np.full(m * k, identity_error),
        }

    return batches(rows.select("vec_id", "x"), run, WHITENED)


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """Whitened coordinates of every sound row of ``vectors`` (vec_id, embedding) on the leading components.

    Returns vec_id, component (from 1, by falling variance), n (distinct vectors of the
    fit), deviation (squared distance from the mean, times n², exact), whitened, explained
    (share of the variance) and identity_error (largest absolute entry of the whitened
    covariance minus the identity, measured in a pass of its own).
    """
    rows = stored(quantised(vectors, scale), "quantised")
    found = fit_components(rows, components)
    if found is None:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    fit, cov = found
    whitened = cov.of_projection(fit.vectors / np.sqrt(fit.values))
    return project(rows, fit, float(np.abs(whitened - np.eye(len(fit.values))).max()))
