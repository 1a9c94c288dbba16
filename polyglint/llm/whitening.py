"""Embedding whitening by incremental eigendecomposition.

Entries become integers x = floor(1024 * c) + 100000, so that sums are exact and
do not depend on how the rows are dealt.  The fit goes over the table three times:

1. counts and sums of each dimension, exact;
2. each partition keeps the eigenvalues and eigenvectors of its scatter and takes
   its centred vectors in as rank-one updates: eigenvalues are the roots of the
   secular equation, found between the old ones from the nearer pole; small and
   equal entries are deflated; eigenvectors come from the weights that the roots
   found belong to exactly (Loewner's formula), which keeps them orthogonal.
   Spectra of partitions combine in a tree, the pairs of one entering the other
   as successive rank-one updates;
3. Rayleigh-Ritz: the scatter inside that basis, summed over all partitions from
   centred vectors, and its eigenvectors turn the basis into the components.

A further pass over the whitened rows measures how far their covariance is from
the identity.  What meets the driver or a broadcast is a few matrices of
dimension x dimension for each vector length, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, fresh, map_arrow, slices

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0 ** 43        # entries from here on have no exact integer; they count as non-finite
COMPONENTS = 8
FAN = 16                   # spectra that one task combines
NO_VARIANCE = 1e-12        # eigenvalues below this share of the largest have no component
EPS = np.finfo(float).eps


def integers(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(vector length, rows, x) of the rows whose vectors count, a length at a time."""
    vectors = batch.column(batch.schema.get_field_index(column))
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)   # null: nan
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        v = values[starts[rows][:, None] + np.arange(dim)]
        with np.errstate(invalid="ignore"):
            good = (np.abs(v) < LARGEST).all(axis=1)
        if good.any():
            yield int(dim), rows[good], np.floor(SCALE * v[good]).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Sums:
    """Count and exact sums of the vectors of one length."""

    n: int
    sums: tuple[int, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S; 64-bit integers, or Python's where those don't suffice."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if reach < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)


# --------------------------------------------------------------------------
# rank-one updates
# --------------------------------------------------------------------------

def secular_roots(d: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pole, offset) of the roots of 1 + sum(w2 / (d - root)) = 0, ascending.

    ``d`` ascends strictly and ``w2`` is positive: root i lies between d[i] and
    d[i + 1], the last one beyond d[-1].  Each is kept as an offset from its
    nearer pole, so that its distance to either pole is exact to rounding.  A
    rational function with the two poles beside the root is fitted to value and
    slope of the sums on either side; bisection keeps a step inside its bracket.
    """
    k = len(d)
    index = np.arange(k)
    gap = np.append(np.diff(d), w2.sum())
    middle = d + gap / 2
    at_middle = 1 + (w2[:, None] / (d[:, None] - middle)).sum(axis=0)
    right = (at_middle < 0) & (index < k - 1)
    pole = index + right
    delta = d[:, None] - d[pole]
    lo = np.where(right, -gap / 2, 0.0)
    hi = np.where(right, 0.0, np.where(index < k - 1, gap / 2, gap))
    left = index[:, None] <= index
    near_left = np.where(right, -gap, 0.0)
    near_right = near_left + gap
    last = index == k - 1
    mu = (lo + hi) / 2
    for _ in range(100):
        t = delta - mu
        g = w2[:, None] / t
        slope = g / t
        psi, dpsi = np.where(left, g, 0).sum(axis=0), np.where(left, slope, 0).sum(axis=0)
        phi, dphi = g.sum(axis=0) - psi, slope.sum(axis=0) - dpsi
        f = 1 + psi + phi
        done = (np.abs(f) <= 2 * EPS * k * (1 + np.abs(psi) + np.abs(phi))) | (hi - lo <= EPS * np.abs(mu))
        if done.all():
            break
        lo, hi = np.where(f < 0, mu, lo), np.where(f < 0, hi, mu)
        a, b = near_left - mu, near_right - mu
        s1, s2 = a * a * dpsi, np.where(last, 0.0, b * b * dphi)
        c = 1 + psi - a * dpsi + np.where(last, 0.0, phi - b * dphi)
        # c (nl - x)(nr - x) + s1 (nr - x) + s2 (nl - x) = 0
        p = c * (near_left + near_right) + s1 + s2
        q = c * near_left * near_right + s1 * near_right + s2 * near_left
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0.0))
            x = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
            x = np.where(last, near_left + s1 / c, x)
            inside = (x > lo) & (x < hi)
        mu = np.where(done, mu, np.where(inside, x, (lo + hi) / 2))
    return pole, mu


@dataclass
class Spectrum:
    """Eigenvalues (ascending) and eigenvectors (columns) of a sum of z z^T."""

    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def zero(cls, dim: int) -> Spectrum:
        return cls(np.zeros(dim), np.eye(dim))

    def add(self, z: np.ndarray) -> None:
        """The rank-one update by z z^T."""
        w = z @ self.vectors
        norm = math.sqrt(w @ w)
        tol = 8 * EPS * max(self.values[-1], norm * norm)
        active = np.flatnonzero(np.abs(w) * norm > tol)           # the others keep their pair
        if not len(active):
            return
        active = self._apart(active, w, tol)
        d, wa = self.values[active], w[active]
        k = len(active)
        pole, mu = secular_roots(d, wa * wa)
        to_root = (d[:, None] - d[pole]) - mu                      # d[j] - root[i]
        j, i = np.arange(k)[:, None], np.arange(k)
        beside = np.where(i < j, d[i], np.append(d[1:], 0.0)[i]) - d[:, None]
        beside[:, -1] = 1.0
        # product over the roots and the other poles that weights with just these roots have
        weights = np.copysign(np.sqrt(np.abs(np.prod(-to_root / beside, axis=1))), wa)
        turn = weights[:, None] / to_root
        turn /= np.sqrt((turn * turn).sum(axis=0))
        self.vectors[:, active] = self.vectors[:, active] @ turn
        self.values[active] = d[pole] + mu
        if (np.diff(self.values) < 0).any():
            order = np.argsort(self.values, kind="stable")
            self.values, self.vectors = self.values[order], self.vectors[:, order]

    def _apart(self, active: np.ndarray, w: np.ndarray, tol: float) -> np.ndarray:
        """Turn eigenvectors of (nearly) equal values so that one of them takes
        the whole weight; the others leave the update."""
        if (np.diff(self.values[active]) > tol).all():
            return active
        stay = []
        for i in active:
            if stay and self.values[i] - self.values[stay[-1]] <= tol:
                h = stay.pop()
                r = math.hypot(w[h], w[i])
                c, s = w[i] / r, w[h] / r
                vh, vi = self.vectors[:, h].copy(), self.vectors[:, i].copy()
                self.vectors[:, h], self.vectors[:, i] = c * vh - s * vi, s * vh + c * vi
                w[h], w[i] = 0.0, r
            stay.append(i)
        return np.array(stay)

    def absorb(self, other: Spectrum) -> None:
        """The other's pairs as successive rank-one updates."""
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.add(math.sqrt(value) * vector)


# --------------------------------------------------------------------------
# passes
# --------------------------------------------------------------------------

_SUMS = "dim int, part int, pos int, n long, s decimal(38,0)"
_PARTIAL = "dim int, part int, a array<double>, b array<double>"


def _doubles(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.list_(pa.float64()))],
        names=["dim", "part", "a", "b"])


def sums(df: DataFrame, column: str) -> tuple[dict[int, Sums], int]:
    """The sums of each vector length, and the number of partitions."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in slices(it):
            for dim, rows, x in integers(batch, column):
                n, s = found.get(dim, (0, [0] * dim))
                # at most SLICE_ROWS entries below 2 ** 53 each
                found[dim] = (n + len(rows), [a + int(b) for a, b in zip(s, x.sum(axis=0))])
        part = TaskContext.get().partitionId()
        for dim, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array([part] * dim, pa.int32()), pa.array(range(dim), pa.int32()),
                 pa.array([n] * dim, pa.int64()), pa.array(s, pa.decimal128(38, 0))], names=["dim", "part", "pos", "n", "s"])

    rows = (map_arrow(df.select(column), task, _SUMS).groupBy("dim", "pos")
            .agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.max("part").alias("part"))
            .orderBy("dim", "pos").collect())     # one row an entry of each vector length
    out = {dim: Sums(next(r["n"] for r in rows if r["dim"] == dim), tuple(int(r["s"]) for r in rows if r["dim"] == dim))
           for dim in sorted({r["dim"] for r in rows})}
    return out, 1 + max((r["part"] for r in rows), default=-1)


def folded(partials: DataFrame, parts: int, combine: Callable) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """One (a, b) for each vector length out of those of ``parts`` partitions:
    ``combine`` takes ``FAN`` of them at a time in a task, and the last ones here."""
    attach(partials.sparkSession)

    def group(key, table):
        items = table.sort_by("part").to_pydict()
        a, b = combine([(np.array(x), np.array(y)) for x, y in zip(items["a"], items["b"])])
        return pa.Table.from_batches([_doubles([(key[0].as_py(), key[1].as_py(), a, b)])])

    while parts > FAN:
        parts = -(-parts // FAN)
        partials = partials.withColumn("part", (F.col("part") % parts).cast("int")).groupBy("dim", "part").applyInArrow(
            group, _PARTIAL)
    rows = sorted(partials.collect(), key=lambda r: (r["dim"], r["part"]))   # at most FAN rows a length
    return {dim: combine([(np.array(r["a"]), np.array(r["b"])) for r in rows if r["dim"] == dim])
            for dim in sorted({r["dim"] for r in rows})}


def _added(items: list) -> tuple[np.ndarray, np.ndarray]:
    return np.sum([a for a, _ in items], axis=0), np.sum([b for _, b in items], axis=0)


def _combined(items: list) -> tuple[np.ndarray, np.ndarray]:
    dim = len(items[0][0])
    spectra = [Spectrum(a.copy(), b.reshape(dim, dim).copy()) for a, b in items]
    for other in spectra[1:]:
        spectra[0].absorb(other)
    return spectra[0].values, spectra[0].vectors.ravel()


def _partials(df: DataFrame, column: str, start: Callable, take: Callable, finish: Callable) -> DataFrame:
    """One (a, b) for each vector length and partition."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in slices(it):
            for dim, _, x in integers(batch, column):
                if dim not in found:
                    found[dim] = start(dim)
                take(found[dim], dim, x)
        part = TaskContext.get().partitionId()
        for dim, state in found.items():
            yield _doubles([(dim, part, *finish(state))])

    return map_arrow(df.select(column), task, _PARTIAL)


def spectra(df: DataFrame, column: str, totals: dict[int, Sums], parts: int) -> dict[int, np.ndarray]:
    """The eigenvectors of each length's scatter, from rank-one updates."""

    def take(state: Spectrum, dim: int, x: np.ndarray) -> None:
        x, copies = np.unique(x, axis=0, return_counts=True)      # copies enter as one update
        for z in totals[dim].centred(x) * np.sqrt(copies)[:, None]:
            state.add(z)

    partials = _partials(df, column, Spectrum.zero, take, lambda s: (s.values, s.vectors.ravel()))
    return {dim: np.linalg.qr(v.reshape(dim, dim)[:, ::-1])[0] for dim, (_, v) in folded(partials, parts, _combined).items()}


@dataclass(frozen=True)
class Model:
    """Whitening of the vectors of one length: components are columns."""

    sums: Sums
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.sums.centred(x) @ self.components / np.sqrt(self.values)


def fit(df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> tuple[dict[int, Model], int]:
    """A model for each vector length, and the number of partitions read.
    Components without variance are left out."""
    totals, parts = sums(df, column)
    bases = spectra(df, column, totals, parts)

    def take(state: list, dim: int, x: np.ndarray) -> None:
        y = totals[dim].centred(x) @ bases[dim]
        state[0] += y.T @ y

    partials = _partials(df, column, lambda dim: [np.zeros((dim, dim))], take, lambda s: (s[0].ravel(), np.zeros(0)))
    models = {}
    for dim, (scatter, _) in folded(partials, parts, _added).items():
        values, turn = np.linalg.eigh(scatter.reshape(dim, dim) / totals[dim].n)
        values, turn = values[::-1], turn[:, ::-1]
        keep = min(components, int((values > max(NO_VARIANCE * values[0], 0.0)).sum()))
        models[dim] = Model(totals[dim], bases[dim] @ turn[:, :keep], values[:keep], float(values.sum()))
    return models, parts


def squares(deviations: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None beyond 64 bits."""
    if deviations.dtype != object and deviations.shape[1] * int(np.abs(deviations).max(initial=0)) ** 2 < 1 << 63:
        return (deviations * deviations).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in deviations]
    return [v if v < 1 << 63 else None for v in exact]


def identity_errors(df: DataFrame, column: str, models: dict[int, Model], parts: int) -> dict[int, float]:
    """The largest entry of the whitened vectors' covariance minus the identity, for each length."""

    def take(state: list, dim: int, x: np.ndarray) -> None:
        w = models[dim].whitened(x)
        state[0] += w.T @ w
        state[1] += w.sum(axis=0)

    def start(dim: int) -> list:
        k = models[dim].components.shape[1]
        return [np.zeros((k, k)), np.zeros(k)]

    partials = _partials(df, column, start, take, lambda s: (s[0].ravel(), s[1]))
    out = {}
    for dim, (products, total) in folded(partials, parts, _added).items():
        n, k = models[dim].sums.n, len(total)
        mean = total / n
        out[dim] = float(np.abs(products.reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return out


def whiten(df: DataFrame, column: str = "embedding", components: int = COMPONENTS,
           models: dict[int, Model] | None = None) -> DataFrame:
    """The rows of ``df`` whose vectors count, with the columns

    n long (vectors of the fit), deviation long (sum over entries of (n * x -
    S) ^ 2, exact; null beyond 64 bits), whitened array<double> (x - S / n on the
    components, each over the root of its eigenvalue) and explained array<double>
    (shares of the variance).

    A vector that is null or empty, or holds null, non-finite or unrepresentable
    entries (from 2 ** 43 on) is dropped.  Vectors of each length have a model of
    their own.  Repeated rows count as often as they occur; the order of tied
    eigenvalues is open.  A single vector or equal vectors have no variance and
    no component: their arrays are empty.  An empty table gives an empty result.
    Columns of these names in ``df`` are replaced, all others kept.
    """
    attach(df.sparkSession)
    made = ["n", "deviation", "whitened", "explained"]
    names = [c for c in df.columns if c.lower() not in made]
    if models is None:
        models, _ = fit(df, column, components)
    vector, = fresh(df, "vector")
    own = df.select(*names, F.col(column).alias(vector))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            for dim, rows, x in integers(batch, vector):
                m = models[dim]
                kept = batch.take(pa.array(rows))
                k, shares = len(m.values), (m.values / m.trace if len(m.values) else np.zeros(0)).tolist()
                flat = m.whitened(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns[:len(names)], pa.array([m.sums.n] * len(rows), pa.int64()),
                     pa.array(squares(m.sums.deviations(x)), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(flat)),
                     pa.array([shares] * len(rows), pa.list_(pa.float64()))], names=names + made)

    schema = T.StructType([df.schema[c] for c in names] + [
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("explained", T.ArrayType(T.DoubleType()))])
    return map_arrow(own, task, schema)


def components(df: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row for each vector that counts and component: vec_id, component (from
    1), n, deviation, whitened, explained, identity_error."""
    slim = spread(df.select(F.col(id_col).alias("vec_id"), F.col(column).alias("embedding")))
    models, parts = fit(slim)
    errors = identity_errors(slim, "embedding", models, parts)
    worst = max(errors.values(), default=0.0)
    rows = whiten(slim, models=models).select(
        "vec_id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("pos", "c"))
    return rows.select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained",
                       F.lit(worst).alias("identity_error"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores, dealt over those:
    every vector is one update of a spectrum."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
