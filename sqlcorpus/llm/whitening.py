"""Embedding whitening by incremental eigendecomposition.

Each partition keeps the eigenvalues and eigenvectors of the scatter of the vectors it has seen. One more
vector is a centred rank-one update: eigenvalues move to the roots of a secular equation between
the old ones, after entries that the update does not touch, and pairs of equal eigenvalues, have been
deflated. Two spectra are combined by successive rank-one updates, one for each eigenpair of the smaller
and one for the distance of the means. The leading vectors so found span the space in
which a Rayleigh-Ritz refinement, spread over all vectors, finds the components; while the
residual is above rounding, the space is extended by it and the refinement repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from sqlcorpus.llm.tables import quoted, stage, without

SCALE = 256
COMPONENTS = 4
GUARD = 4  # further directions carried through the refinement
FAN_IN = 8  # spectra combined by one task
VECTORS = 4096  # that one task adds to its spectrum, at least
MOST_TASKS = 20_000
TIGHT = 1e-13  # residual, relative to the largest eigenvalue, at which components count as exact
ROUNDS = 20
NEGLIGIBLE = 1e-12  # eigenvalues below this share of the largest count as zero
EPS = float(np.finfo(np.float64).eps)
LONG = 2**63 - 1


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """``out[j, i]``: d[j] less the i-th root of 1 + rho * sum(z2 / (d - x)), to full relative precision.

    ``d`` rises strictly and no ``z2`` is zero, so one root lies above each d, the last within rho * sum(z2).
    Each is sought as the distance from its nearer pole, by a rational model of both
    neighbouring poles, held inside a bracket that every step narrows.
    """
    k = len(d)
    gap = np.append(np.diff(d), rho * z2.sum())
    # the sign half way tells which pole is nearer; the last root knows only one
    half = d + gap / 2
    near_next = 1 + rho * (z2 / (d[:, None] - half).T).sum(1) < 0
    near_next[-1] = False
    origin = np.arange(k) + near_next
    delta = d[:, None] - d[origin][None, :]
    lo = np.where(near_next, -gap / 2, 0.0)
    hi = np.where(near_next, 0.0, gap / 2)
    hi[-1] = gap[-1]
    x = (lo + hi) / 2
    below = np.arange(k)[:, None] <= np.arange(k)[None, :]  # poles at or below each root
    left, right = delta.diagonal().copy(), np.append(delta[np.arange(1, k), np.arange(k - 1)], np.inf)
    live, weights = np.arange(k), rho * z2[:, None]
    with np.errstate(all="ignore"):
        for _ in range(80):
            at = x[live]
            away = delta[:, live] - at
            terms = weights / away
            slopes = terms / away
            lower, all_terms, all_slopes = below[:, live], terms.sum(0), slopes.sum(0)
            psi, dpsi = (terms * lower).sum(0), (slopes * lower).sum(0)
            phi, dphi = all_terms - psi, all_slopes - dpsi
            f = 1 + all_terms
            low, high = np.where(f < 0, at, lo[live]), np.where(f < 0, hi[live], at)
            lo[live], hi[live] = low, high
            p, q = left[live] - at, right[live] - at
            last = np.isinf(q)
            q[last] = 0.0
            a = (p + q) * f - p * q * all_slopes
            b = p * q * f
            c = f - p * dpsi - q * dphi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(last, p + p * p * dpsi / c, step)  # no pole above the last root
            done = (np.abs(f) <= 4 * k * EPS * (1 + np.abs(psi) + np.abs(phi))) | (np.abs(step) <= 2 * EPS * np.abs(at))
            new = at + step
            new = np.where((new > low) & (new < high) & np.isfinite(new), new, (low + high) / 2)
            done |= new == at
            x[live] = np.where(done, at, new)
            live = live[~done]
            if not len(live):
                break
    return delta - x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors (columns) of ``vectors @ diag(values) @ vectors.T + rho * v v^T``, rho >= 0."""
    z = vectors.T @ v
    norm = float(np.sqrt(z @ z))
    if not norm or not rho:
        return values, vectors
    z, rho = z / norm, rho * norm * norm
    tolerance = 8 * EPS * max(float(np.abs(values).max()), rho * float(np.abs(z).max()))
    d, q = values.copy(), vectors.copy()
    touched = np.flatnonzero(rho * np.abs(z) > tolerance).tolist()
    live: list[int] = []
    for j in touched:
        if live:
            i = live[-1]
            size = float(np.hypot(z[i], z[j]))
            c, s = z[j] / size, -z[i] / size
            if abs((d[j] - d[i]) * c * s) <= tolerance:  # equal eigenvalues: a rotation takes the update off one
                z[i], z[j] = 0.0, size
                q[:, i], q[:, j] = c * q[:, i] + s * q[:, j], c * q[:, j] - s * q[:, i]
                d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                live[-1] = j
                continue
        live.append(j)
    if len(live) == 1:
        d[live[0]] += rho
    elif live:
        own = np.array(live)
        old = d[own]
        away = secular_roots(old, z[own] ** 2, rho)
        # the entries for which these roots are exact, so that the new vectors are orthogonal
        spread = old[:, None] - old[None, :]
        np.fill_diagonal(spread, 1.0)
        ratio = away / np.where(spread == 0, 1.0, spread)
        exact = np.sqrt(np.abs(np.prod(ratio, axis=1) / rho)) * np.sign(z[own])
        turn = exact[:, None] / away
        turn /= np.sqrt((turn * turn).sum(0))
        q[:, own] = q[:, own] @ turn
        d[own] = old[np.arange(len(own))] - away.diagonal()
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Spectrum:
    """Number of vectors, their mean, and the eigenpairs of their scatter about it."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        self.values, self.vectors = rank_one(self.values, self.vectors, away, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        both = self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        away = other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / both)
        self.mean = self.mean + away * (other.n / both)
        self.n = both


def entries(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """The vectors of a batch as rows; shorter ones end in zeros."""
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


SPECTRUM = "part long, n long, mean array<double>, value array<double>, vectors array<double>, total array<long>"


def _spectrum_row(part: int, s: Spectrum, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int64()), "n": pa.array([s.n], pa.int64()), "mean": pa.array([s.mean], pa.list_(pa.float64())),
        "value": pa.array([s.values], pa.list_(pa.float64())), "vectors": pa.array([s.vectors.ravel()], pa.list_(pa.float64())),
        "total": pa.array([total.tolist()], pa.list_(pa.int64()))})


def _spectrum(row: dict) -> Spectrum:
    dim = len(row["mean"])
    return Spectrum(row["n"], np.array(row["mean"]), np.array(row["value"]), np.array(row["vectors"]).reshape(dim, dim))


def combined_spectrum(fit: DataFrame, dim: int) -> tuple[Spectrum, np.ndarray]:
    """The spectrum of all vectors, and their exact sums; one row per partition, then a tree of tasks."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, total = Spectrum.empty(dim), np.zeros(dim, np.int64)
        for batch in batches:
            for x in (rows := entries(batch, "x", dim)):
                s.add(x.astype(np.float64))
            total += rows.sum(0)
        if s.n:
            yield _spectrum_row(TaskContext.get().partitionId(), s, total)

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        s, total = _spectrum(rows[0]), np.array(rows[0]["total"], np.int64)
        for row in rows[1:]:
            s.merge(_spectrum(row))
            total = total + np.array(row["total"], np.int64)
        return pa.Table.from_batches([_spectrum_row(rows[0]["part"] // FAN_IN, s, total)])

    tasks = min(fit.count() // VECTORS + 1, MOST_TASKS)
    level = stage(fit.select("x").repartition(tasks, "x").mapInArrow(gather, SPECTRUM))
    parts = level.agg(F.max("part")).first()[0]
    while parts > 0:
        level = stage(level.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(combine, SPECTRUM))
        parts //= FAN_IN
    (row,) = level.collect()  # one spectrum of dim * dim numbers
    return _spectrum(row.asDict()), np.array(row["total"], np.int64)


def _scattered(fit: DataFrame, dim: int, n: int, total: np.ndarray, project: np.ndarray, against_all: bool) -> np.ndarray:
    """Sum over all vectors of y y^T (or, ``against_all``, of the centred vector times y^T) over n, with y its centred projection.

    Without ``against_all`` the projections themselves are centred once more.
    """
    shape = (dim if against_all else project.shape[1], project.shape[1])
    mean = _centre(total, n)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sums = np.zeros(shape), np.zeros(project.shape[1])
        for batch in batches:
            x = entries(batch, "x", dim) - mean
            y = x @ project
            out += (x if against_all else y).T @ y
            sums += y.sum(0)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                          "m": pa.array([np.r_[out.ravel(), sums]], pa.list_(pa.float64()))})

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        return pa.table({"part": pa.array([rows[0]["part"] // FAN_IN], pa.int64()),
                         "m": pa.array([np.sum([r["m"] for r in rows], axis=0)], pa.list_(pa.float64()))})

    schema = "part long, m array<double>"
    level = stage(fit.select("x").mapInArrow(gather, schema))
    parts = level.agg(F.max("part")).first()[0]
    while parts > 0:
        level = stage(level.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(add, schema))
        parts //= FAN_IN
    found = np.array(level.collect()[0]["m"])  # one matrix
    out, sums = found[: shape[0] * shape[1]].reshape(shape) / n, found[shape[0] * shape[1] :] / n
    return out if against_all else out - np.outer(sums, sums)


def _centre(total: np.ndarray, n: int) -> np.ndarray:
    return np.array([int(t) / n for t in total])


def refined(fit: DataFrame, dim: int, n: int, total: np.ndarray, basis: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and eigenvectors of the covariance, by Rayleigh-Ritz in a space that starts as ``basis``."""
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(basis)
        image = _scattered(fit, dim, n, total, basis, True)
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        found, moved = basis @ turn, image @ turn
        lead = values[:wanted] > NEGLIGIBLE * max(values[0], 0.0)
        rest = moved[:, :wanted] - found[:, :wanted] * values[:wanted]
        rest = rest[:, lead]
        if not rest.size or np.sqrt((rest * rest).sum(0)).max() <= TIGHT * values[0] or basis.shape[1] == dim:
            break
        # what the covariance leads to outside the space joins it
        basis = np.concatenate([found[:, : wanted + GUARD], rest], 1)[:, :dim]
    return values[:wanted][lead], found[:, :wanted][:, lead]


RESULT = [
    T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
]


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """All columns but the vector, with ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null or holds a null or non-finite entry go. Entries become x = floor(256 c);
    vectors shorter than the longest end in zeros. The covariance is that of the distinct x,
    divisor ``n``, their number. Each remaining row comes once for each component, at most ``components``, whose eigenvalue is
    above 1e-12 of the largest: none if all x are equal. ``whitened`` is x less the mean, on the component,
    over the root of the eigenvalue; ``explained`` the eigenvalue's share of the trace; ``identity_error``
    the largest entry of the covariance of ``whitened`` less the identity. ``deviation`` is the exact
    sum of (n x - sum of x)^2, null where it does not fit a long. Repeated rows and ids all come back;
    columns of the result's names give way; an empty table gives an empty one.
    """
    vector = F.col(quoted(vector_column))
    others = without(vectors, [vector_column, *(f.name for f in RESULT)])
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = vectors.where(vector.isNotNull() & fine).select(F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), x.alias("x"))
    out = T.StructType([rows.schema["row"], *RESULT])
    fit = stage(rows.groupBy("x").agg(F.count(F.lit(1)).alias("rows")).select("x"))
    dim = fit.agg(F.max(F.size("x"))).first()[0]
    if not dim:
        return rows.limit(0).mapInArrow(_nothing, out).select("row.*", *(f.name for f in RESULT))
    spectrum, total = combined_spectrum(fit, dim)
    n = spectrum.n
    start = spectrum.vectors[:, ::-1][:, : min(dim, components + GUARD)]
    values, found = refined(fit, dim, n, total, start, components)
    trace = float(spectrum.values.sum()) / n
    scaled = found / np.sqrt(values)
    error = float(np.abs(_scattered(fit, dim, n, total, scaled, False) - np.eye(len(values))).max()) if len(values) else 0.0
    mean, sums = _centre(total, n), total

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = entries(batch, "x", dim)
            white = (xs - mean) @ scaled
            far = _deviations(xs, n, sums)
            k = len(values)
            again = np.repeat(np.arange(len(xs)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("row")).take(pa.array(again)),
                pa.array(np.tile(np.arange(1, k + 1), len(xs)), pa.int32()), pa.array(np.full(len(again), n), pa.int64()),
                pa.array([far[i] for i in again], pa.int64()), pa.array(white.ravel()),
                pa.array(np.tile(values / trace, len(xs))), pa.array(np.full(len(again), error)),
            ], names=out.names)

    return rows.mapInArrow(project, out).select("row.*", *(f.name for f in RESULT))


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from ()


def _deviations(xs: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - total)^2: in 64 bits where nothing can overflow, else in whole numbers of any size."""
    most = n * int(np.abs(xs).max(initial=0)) + int(np.abs(total).max())
    if most * most * xs.shape[1] <= LONG:
        away = n * xs - total
        return (away * away).sum(1).tolist()
    sums = [int(t) for t in total]
    exact = [sum((n * int(c) - t) ** 2 for c, t in zip(x, sums)) for x in xs]
    return [e if e <= LONG else None for e in exact]
