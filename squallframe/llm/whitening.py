"""Embedding whitening: FEAST contour integration over the exact covariance of all vectors."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallframe.llm.common import finite
from squallframe.session import settle

SCALE, SHIFT = 1024, 100_000  # an entry c becomes floor(SCALE * c) + SHIFT
FARTHEST = 2**53  # scaled entries beyond this size count as this
BITS, LIMBS = 40, 3  # exact sums are held in limbs of so many bits
SMALL, CHUNK = 2**20, 2**12  # products of so small numbers, so many rows, add up exactly in doubles
PART = "dim int, row int, n long, limbs binary"


# --- exact sums


def carried(limbs: np.ndarray) -> np.ndarray:
    """Limbs (lowest first) below 2^BITS, the highest takes what is left over."""
    limbs = limbs.copy()
    for i in range(len(limbs) - 1):
        limbs[i + 1] += limbs[i] >> BITS
        limbs[i] &= (1 << BITS) - 1
    return limbs


def limbs_of(values: np.ndarray) -> np.ndarray:
    """Integers, as int64 or Python's, as limbs."""
    out, mask = [], (1 << BITS) - 1
    for _ in range(LIMBS - 1):
        out.append((values & mask).astype(np.int64))
        values = values >> BITS
    return np.stack([*out, values.astype(np.int64)])


def whole(limbs: np.ndarray) -> np.ndarray:
    """Python integers of limbs."""
    return sum(x.astype(object) << (BITS * i) for i, x in enumerate(limbs))


def scaled(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as the rows' integers."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * SCALE), -FARTHEST, FARTHEST).astype(np.int64) + SHIFT


def by_length(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(length, rows) of the vectors that stream by, about ``most`` numbers at a time."""
    for batch in batches:
        sizes = batch.column("vec").value_lengths().to_numpy()
        for dim in np.unique(sizes):
            part = batch.filter(pa.array(sizes == dim))
            step = max(1, most // max(1, int(dim)))
            for at in range(0, len(part), step):
                yield int(dim), part.slice(at, step)


def products(y: np.ndarray) -> np.ndarray:
    """Limbs of the exact sums of y[:, i] * y[:, j] over the rows."""
    total = np.zeros((LIMBS, y.shape[1], y.shape[1]), np.int64)
    near = np.abs(y).max(axis=1, initial=0) < SMALL
    own = y[near].astype(float)
    for at in range(0, len(own), CHUNK):
        part = own[at : at + CHUNK]
        total = carried(total + limbs_of((part.T @ part).astype(np.int64)))
    for row in y[~near].astype(object):
        total = carried(total + limbs_of(np.outer(row, row)))
    return total


def summed(vectors: DataFrame, of) -> dict[int, tuple[int, np.ndarray]]:
    """length -> (number of vectors, exact sums of ``of(dim, x)`` over all tasks), by tables of one row per task and matrix row.

    Rows of one place are added up as they stream by, so neither a task nor the driver holds more than a length's sums.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = {}, {}
        for dim, part in by_length(batches):
            own = of(dim, scaled(part.column("vec")))
            sums[dim] = carried(sums[dim] + own) if dim in sums else own
            n[dim] = n.get(dim, 0) + len(part)
        for dim, total in sums.items():
            for i in range(total.shape[1]):
                yield packed(dim, i, n[dim], total[:, i])

    def packed(dim, row, n, limbs):
        values = [pa.array([dim], pa.int32()), pa.array([row], pa.int32()), pa.array([n]), pa.array([limbs.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(values, names=["dim", "row", "n", "limbs"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count, total = None, 0, None
        for batch in batches:
            for dim, row, n, body in zip(*(c.to_pylist() for c in batch.columns)):
                limbs = np.frombuffer(body, np.int64).reshape(LIMBS, -1)
                if (dim, row) != own:
                    if own:
                        yield packed(*own, count, total)
                    own, count, total = (dim, row), n, limbs
                else:
                    count, total = count + n, carried(total + limbs)
        if own:
            yield packed(*own, count, total)

    parts = vectors.select("vec").mapInArrow(add, PART).repartition("dim", "row").sortWithinPartitions("dim", "row")
    out = {}
    for r in sorted(parts.mapInArrow(merge, PART).collect(), key=lambda r: (r["dim"], r["row"])):
        out.setdefault(r["dim"], (r["n"], []))[1].append(whole(np.frombuffer(r["limbs"], np.int64).reshape(LIMBS, -1)))
    return {dim: (n, np.array(rows, dtype=object)) for dim, (n, rows) in out.items()}


# --- eigenpairs of a symmetric matrix by contour integration


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix."""
    a, d = v.copy(), len(v)
    off = np.zeros(max(0, d - 1))
    for k in range(d - 1):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        off[k] = -np.copysign(size, x[0])
        x[0] -= off[k]
        if size and np.linalg.norm(x):
            u = x / np.linalg.norm(x)
            s = a[k + 1 :, k + 1 :]
            p = s @ u
            w = 2 * (p - (u @ p) * u)
            s -= np.outer(u, w) + np.outer(w, u)
    return np.diagonal(a).copy(), off


class Inertia:
    """How many eigenvalues lie above a shift, by the signs of the pivots of the shifted matrix (Sylvester)."""

    def __init__(self, v: np.ndarray):
        self.diagonal, off = tridiagonal(v)
        self.squares = np.concatenate([[0.0], off**2])
        self.scale = float(np.abs(v).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger

    def above(self, shift: float) -> int:
        count, pivot, least = 0, 1.0, np.finfo(float).tiny
        for a, b in zip(self.diagonal - shift, self.squares):
            pivot = a - b / pivot
            if abs(pivot) < least:
                pivot = -least
            count += pivot > 0
        return count

    def clear(self, shift: float, width: float) -> bool:
        """No eigenvalue lies next to the shift, as seen from an interval of the given width."""
        return self.above(shift - 1e-4 * width) == self.above(shift + 1e-4 * width)


def feast(v: np.ndarray, lo: float, hi: float, count: int, scale: float, points: int = 8, rounds: int = 12) -> tuple[np.ndarray, np.ndarray] | None:
    """The eigenpairs with lo < value <= hi, which are ``count``; None if they don't come out.

    Gauss-Legendre points on the upper half of the circle over (lo, hi) stand for the contour integral of the resolvent, which
    projects a random block onto the wanted space; Rayleigh-Ritz in that space gives the pairs, which start the next round.
    """
    d = len(v)
    size = min(d, 2 * count + 8)
    y = np.random.default_rng(11).standard_normal((d, size))
    centre, radius = (lo + hi) / 2, (hi - lo) / 2
    nodes, weights = np.polynomial.legendre.leggauss(points)
    turns = radius * np.exp(-0.5j * np.pi * (nodes - 1))
    resolvents = [np.linalg.inv((centre + t) * np.eye(d) - v) for t in turns]
    before = np.inf
    for _ in range(rounds):
        projected = sum(w / 2 * (t * (r @ y)).real for w, t, r in zip(weights, turns, resolvents))
        q = np.linalg.qr(projected)[0]
        values, turned = np.linalg.eigh(q.T @ v @ q)
        y = q @ turned
        inside = (values > lo) & (values <= hi)
        if inside.sum() == count:
            own, pairs = values[inside], y[:, inside]
            error = np.linalg.norm(v @ pairs - pairs * own, axis=0).max()
            if error <= 1e-15 * scale or (error <= 1e-12 * scale and error > before / 2):
                return own, pairs
            before = error
    return None


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues that are not zero to double precision, falling, and their unit eigenvectors as columns.

    Bisection over inertia counts finds where the k-th lies; an interval goes to ``feast`` if it holds few values and is halved
    if it holds more or doesn't converge.  That every interval gives as many as its inertia counts say shows that
    none is missed.
    """
    d = len(v)
    inertia = Inertia(v)
    scale = inertia.scale
    floor = 4 * d * np.finfo(float).eps * scale
    wanted = min(k, inertia.above(floor)) if scale > 0 else 0
    if not wanted:
        return np.zeros(0), np.zeros((d, 0))
    lo, hi, top = floor, scale * (1 + 1e-9), scale * (1 + 1e-9)
    for _ in range(100):
        middle = (lo + hi) / 2
        n = inertia.above(middle)
        if n >= wanted:
            lo = middle
        else:
            hi = middle
        if (n == wanted and inertia.clear(lo, top - lo)) or hi - lo <= 1e-13 * scale:
            break
    found = []
    todo = [(lo, top)]
    while todo:
        lo, hi = todo.pop()
        count = inertia.above(lo) - inertia.above(hi)
        narrow = hi - lo <= 1e-10 * scale
        if not count:
            continue
        pairs = feast(v, lo, hi, count, scale) if count <= 8 or narrow else None
        if pairs is not None:
            found.append(pairs)
        elif narrow:
            raise ArithmeticError(f"{count} eigenvalues in ({lo}, {hi}] did not come out")
        else:
            at = next((s for s in (lo + f * (hi - lo) for f in (0.5, 0.4, 0.6, 0.3, 0.7)) if inertia.clear(s, hi - lo)), (lo + hi) / 2)
            todo += [(lo, at), (at, hi)]
    # intervals were solved apart: one more Rayleigh-Ritz step makes all vectors orthogonal
    q = np.linalg.qr(np.hstack([vectors for _, vectors in found]))[0]
    values, turned = np.linalg.eigh(q.T @ v @ q)
    return values[::-1][:wanted], (q @ turned)[:, ::-1][:, :wanted]


# --- whitening


@dataclass(frozen=True)
class Whitening:
    """Of the vectors of one length: their number, the integer part of the mean, n times the rest, and the components."""

    n: int
    floor: np.ndarray
    rest: np.ndarray  # Python integers from 0 to n - 1
    values: np.ndarray
    components: np.ndarray  # columns
    total: float  # the sum of all eigenvalues

    def whitened(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([r / self.n for r in self.rest])
        return ((x - self.floor) - mean) @ (self.components / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n * x - S)^2 of each row."""
        y = x - self.floor
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        kind = np.int64 if most * most * max(1, y.shape[1]) < 2**62 else object
        t = y.astype(kind) * self.n - self.rest.astype(kind)
        return [int(s) for s in (t * t).sum(axis=1)]


def covariance(n: int, rest: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Each entry rounded once: products are exact sums over rows less the mean's integer part, ``rest`` n times what is left."""
    exact = products * n - np.outer(rest, rest)
    return np.array([[int(e) / (n * n) for e in row] for row in exact], float).reshape(exact.shape)


def fit(vectors: DataFrame, k: int) -> dict[int, Whitening]:
    """A whitening for each length, from all vectors, in two passes: sums, then products about the integer part of the mean.

    What comes to the driver are the sums, a number for each pair of dimensions, whatever the rows.
    """
    spark = vectors.sparkSession
    sums = {dim: (n, s[0]) for dim, (n, s) in summed(vectors, lambda _, x: limbs_of(x).sum(axis=1)[:, None, :]).items()}
    floors = spark.sparkContext.broadcast({dim: np.array([int(x) // n for x in s], np.int64) for dim, (n, s) in sums.items()})
    moments = summed(vectors, lambda dim, x: products(x - floors.value[dim])) if sums else {}
    out = {}
    for dim, (n, s) in sums.items():
        floor = floors.value[dim]
        rest = np.array([int(x) - n * int(f) for x, f in zip(s, floor)], dtype=object)
        v = covariance(n, rest, moments[dim][1] if dim in moments else np.zeros((0, 0), dtype=object))  # vectors without entries
        values, components = leading(v, k)
        out[dim] = Whitening(n, floor, rest, values, components, float(np.trace(v)))
    return out


def whiten(rows: DataFrame, key: str, vec: str, k: int = 8) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error): every vector on the first k principal components, each scaled to
    variance 1.

    An entry c counts as the integer x = floor(1024 c) + 100000; scaled entries beyond 2^53 in size count as that.  Rows take no part
    if their vector is null or has a null or non-finite entry.  The fit is over all others, repeated rows each time they occur;
    with an empty table the result is empty.  n is the number of vectors, S their sum, deviation the exact sum of (n x - S)^2 over the
    dimensions (null beyond 38 digits).  ``whitened`` and ``explained`` are arrays by component; a component whose eigenvalue is zero to
    double precision can't be scaled and is left out, so equal vectors alone give empty arrays.  identity_error is
    the largest entry, in size, of the covariance of ``whitened`` as returned, minus the identity (null without components).
    Vectors of another length are a fit of their own, and those without entries have a deviation of 0.  Null keys stay; other columns are not looked at.

    Sums and products are exact integers, so neither the cluster nor a retry changes the components.
    """
    spark = rows.sparkSession
    vectors = rows.where(finite(F.col(vec))).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    shared = spark.sparkContext.broadcast(fit(vectors, k))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in by_length(batches):
            own, x = shared.value[dim], scaled(part.column("vec"))
            w = own.whitened(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            deviation = [v if v < 10**38 else None for v in own.deviations(x)]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([dim] * len(x), pa.int32()), pa.array(deviation, pa.decimal128(38, 0)), flat], names=["key", "dim", "deviation", "whitened"])

    kind = vectors.schema["key"].dataType.simpleString()
    done = settle(vectors.mapInArrow(project, f"key {kind}, dim int, deviation decimal(38,0), whitened array<double>"))
    fits = [(dim, w.n, [float(e / w.total) for e in w.values]) for dim, w in shared.value.items()]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = done.groupBy("dim").agg(*[F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs])
    errors = {r["dim"]: max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None), default=None) for r in moments.collect()}
    facts = spark.createDataFrame([(*f, errors.get(f[0])) for f in fits], "dim int, n long, explained array<double>, identity_error double")
    out = done.join(F.broadcast(facts), "dim")  # a row per length
    return out.select("key", "n", "deviation", "whitened", "explained", "identity_error")
