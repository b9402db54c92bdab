"""Embedding whitening by spectrum slicing.

The covariance of the distinct quantised vectors is summed by Spark: exact counts and sums
first, then products of the centred vectors (centred on whole numbers, so that the sums
are exact for all but extreme values). Its leading eigenvalues are isolated by slicing:
the LDL' factorisation of the covariance shifted by s has as many positive pivots as there
are eigenvalues above s, and intervals are halved until each holds one eigenvalue. From
there Rayleigh quotient iteration converges cubically to its pair, and the counts just
above and below certify its number. Eigenvalues that agree to rounding are taken together
as one cluster, with an orthonormal basis of their space from block inverse iteration.

The driver holds matrices of the vectors' width alone. Whitened values are made where the
rows are; the whitened covariance is then measured over the fit list in one more pass.

Defined cases: vectors that are null, empty or hold null or non-finite components are left
out, as are those of another length than most kept vectors have (ties: the longer);
floor(scale * x) beyond 2^31 counts as 2^31; components whose eigenvalue is below 1e-11 of
the trace, noise of the rounding, are no components (a constant table has none, so no
rows); repeated rows and ids each get their rows, and count once in the fit; a deviation
beyond a long is null; a null id is a value like any other; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.session import scratch_dir

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: largest absolute value of floor(scale * x)
TOP = 1 << 31
#: smallest eigenvalue taken, as a share of the trace
SMALLEST = 1e-11


# ------------------------------------------------------------------ spectrum slicing
def count_above(a: np.ndarray, s: float) -> int:
    """Eigenvalues of the symmetric ``a`` above ``s``: positive eigenvalues of the pivots of LDL' of a - s.

    Pivots are single entries or 2 by 2 blocks, whichever is larger in the rest of the
    matrix (complete pivoting), which keeps the factors bounded.
    """
    m = a - s * np.eye(len(a))
    positive = 0
    growth = (1 + np.sqrt(17)) / 8
    while len(m):
        n = len(m)
        diag = np.abs(np.diag(m))
        p = int(diag.argmax())
        off = np.abs(m - np.diag(np.diag(m)))
        i, j = divmod(int(off.argmax()), n)
        if not diag[p] and not off[i, j]:
            break  # zero eigenvalues are not above
        if n == 1 or diag[p] >= growth * off[i, j]:
            keep = np.delete(np.arange(n), p)
            positive += int(m[p, p] > 0)
            column = m[keep, p]
            m = m[np.ix_(keep, keep)] - np.outer(column, column) / m[p, p]
        else:
            keep = np.delete(np.arange(n), [i, j])
            block = m[np.ix_([i, j], [i, j])]
            det, trace = block[0, 0] * block[1, 1] - block[0, 1] ** 2, block[0, 0] + block[1, 1]
            positive += 1 if det < 0 else 2 * int(trace > 0)
            sides = m[np.ix_(keep, [i, j])]
            m = m[np.ix_(keep, keep)] - sides @ np.linalg.solve(block, sides.T)
        m = (m + m.T) / 2
    return positive


def isolate(a: np.ndarray, k: int, narrow: float) -> list[tuple[float, float, int, int]]:
    """[(low, high, first, last)]: intervals that hold eigenvalues number first..last and no other, by falling value.

    Each holds one eigenvalue, or is narrower than ``narrow``; those after the k-th are left out.
    """
    radius = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    low, high = float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())
    margin = max(high - low, abs(high), 1e-300) * 1e-6
    found, stack = [], [(low - margin, high + margin, len(a), 0)]
    while stack:
        lo, hi, above_lo, above_hi = stack.pop()
        if above_lo == above_hi or above_hi >= k:
            continue
        if above_lo - above_hi == 1 or hi - lo <= narrow:
            found.append((lo, hi, above_hi + 1, above_lo))
            continue
        mid = (lo + hi) / 2
        n = count_above(a, mid)
        stack += [(lo, mid, above_lo, n), (mid, hi, n, above_hi)]
    return sorted(found, key=lambda f: f[2])


def _solve(a: np.ndarray, shift: float, b: np.ndarray, scale: float) -> np.ndarray:
    try:
        return np.linalg.solve(a - shift * np.eye(len(a)), b)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue
        return np.linalg.solve(a - (shift + 4 * np.finfo(float).eps * scale) * np.eye(len(a)), b)


def rayleigh(a: np.ndarray, lo: float, hi: float, number: int, scale: float) -> tuple[float, np.ndarray]:
    """The one eigenpair with its value between lo and hi, the ``number``-th largest.

    Rayleigh quotient iteration from the interval's middle; where it leaves for another
    eigenvalue, the interval is halved by a count and it starts again.
    """
    rng = np.random.default_rng(number)
    while True:
        mid = (lo + hi) / 2
        x = rng.standard_normal(len(a))
        shift = mid
        for step in range(12):
            x = _solve(a, shift, x / np.linalg.norm(x), scale)
            x /= np.linalg.norm(x)
            value = float(x @ a @ x)
            if np.linalg.norm(a @ x - value * x) <= 8 * len(a) * np.finfo(float).eps * scale:
                break
            shift = value if step else mid  # the first two solves lean to the middle's nearest vector
        else:
            value = np.inf
        if lo <= value <= hi:
            return value, x
        if hi - lo <= np.finfo(float).eps * scale:
            raise ArithmeticError(f"eigenvalue {number} was not found in its interval")
        lo, hi = (mid, hi) if count_above(a, mid) >= number else (lo, mid)


def leading_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(the k largest eigenvalues of the symmetric ``a``, falling; their orthonormal vectors as columns)."""
    scale = float(np.abs(a).sum(axis=1).max())
    if not scale or not k:
        return np.zeros(0), np.zeros((len(a), 0))
    slack = 64 * len(a) * np.finfo(float).eps * scale
    values, vectors = [], np.zeros((len(a), 0))
    for lo, hi, first, last in isolate(a, k, slack):
        if first == last:
            value, x = rayleigh(a, lo, hi, first, scale)
            x = x - vectors @ (vectors.T @ x)
            values.append(value)
            vectors = np.column_stack([vectors, x / np.linalg.norm(x)])
            continue
        # a cluster: its space by block inverse iteration, an orthonormal basis by Rayleigh quotients
        block = np.random.default_rng(first).standard_normal((len(a), last - first + 1))
        for _ in range(4):
            block = _solve(a, hi + slack, block, scale)
            block, _ = np.linalg.qr(block - vectors @ (vectors.T @ block))
        inner, turn = np.linalg.eigh(block.T @ a @ block)
        values += inner[::-1].tolist()
        vectors = np.column_stack([vectors, (block @ turn)[:, ::-1]])
    values, vectors = np.array(values[:k]), vectors[:, :k]
    for i, value in enumerate(values):  # the counts certify the numbers
        if not count_above(a, value + slack) <= i < count_above(a, value - slack):
            raise ArithmeticError(f"eigenvalue {i + 1} has another number")
    return values, vectors


# ------------------------------------------------------------------ Spark
@dataclass(frozen=True)
class Whitening:
    """What turns a quantised vector into whitened components."""

    n: int
    sums: tuple[int, ...]  # of floor(scale * x), without the offset
    centre: np.ndarray  # whole numbers near the mean
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        rest = np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre)])
        return ((x - self.centre).astype(np.float64) - rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - sum)^2; None beyond a long."""
        far = np.abs(x).max(initial=0) + max((abs(s) / self.n for s in self.sums), default=0)
        if self.n * float(far) * np.sqrt(x.shape[1]) < 2.0**31:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, dtype=object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def quantised(vectors: DataFrame, id: str, embedding: str, scale: int) -> DataFrame:
    """(vec, dim, x) of each vector that has all its components; x packs floor(scale * c), equal vectors alike."""
    kind = vectors.schema[id].dataType.simpleString()

    def run(batches):
        for b in batches:
            column = b.column(1)
            offsets = column.offsets.to_numpy().astype(np.int64)
            flat = np.asarray(column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)  # null becomes nan
            bad = np.zeros(len(flat) + 1, dtype=np.int64)
            np.cumsum(~np.isfinite(flat), out=bad[1:])
            dim = np.diff(offsets)
            ok = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool) & (dim > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
            rows = np.flatnonzero(ok)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.floor(scale * flat), -TOP, TOP)
            packed = [pack(whole[offsets[i]:offsets[i + 1]]) for i in rows.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(dim[rows].astype(np.int32)), pa.array(packed, pa.binary())],
                                             names=["vec", "dim", "x"])

    return vectors.select(F.col(f"`{id}`"), F.col(f"`{embedding}`")).mapInArrow(run, f"vec {kind}, dim int, x binary")


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in the smallest of 1, 2, 4 or 8 bytes that holds all of a vector."""
    top = np.abs(x).max()
    return x.astype("<i1" if top < 1 << 7 else "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8").tobytes()


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.empty((len(raw), dim), dtype=np.int64)
    size = np.array([len(r) // dim for r in raw], dtype=np.int64)
    for width in np.unique(size).tolist():
        rows = np.flatnonzero(size == width)
        out[rows] = np.frombuffer(b"".join(raw[i] for i in rows), dtype=f"<i{width}").reshape(-1, dim)
    return out


def _sums(fit: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """(number of rows, their exact sums)."""
    def run(batches):
        n, total = 0, np.zeros(dim, dtype=np.int64)
        for b in batches:
            total += unpacked(b.column(0), dim).sum(axis=0)
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[n, *total.tolist()]], pa.list_(pa.int64()))], names=["v"])

    rows = fit.select("x").mapInArrow(run, "v array<long>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(28,0)")).alias("v")).collect()  # dim + 1 rows
    found = {r.i: int(r.v) for r in rows}
    return found.get(0, 0), tuple(found.get(d + 1, 0) for d in range(dim))


def _products(fit: DataFrame, dim: int, width: int, of) -> tuple[np.ndarray, np.ndarray]:
    """(sum, sum of outer products) of the rows that ``of`` makes of vectors, each of ``width`` values."""
    def run(batches):
        total, outer = np.zeros(width), np.zeros((width, width))
        for b in batches:
            y = of(unpacked(b.column(0), dim))
            total += y.sum(axis=0)
            outer += y.T @ y
        rows = np.vstack([total, outer])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1, dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["i", "v"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(v)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["i", "v"])

    # two steps, so that no task reads the rows of all tasks
    parts = fit.select("x").mapInArrow(run, "i int, v binary").withColumn("p", F.expr("pmod(spark_partition_id(), 16)"))
    step = parts.repartition(min(width + 1, 64), "i", "p").select("i", "v").mapInArrow(merge, "i int, v binary")
    out = np.zeros((width + 1, width))
    for r in step.repartition(min(width + 1, 64), "i").mapInArrow(merge, "i int, v binary").collect():  # width + 1 rows
        out[r.i] += np.frombuffer(r.v)
    return out[0], out[1:]


def fit_whitening(fit: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of the table ``fit`` of distinct packed vectors (column x); None without any row."""
    n, sums = _sums(fit, dim)
    if not n:
        return None
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    first, second = _products(fit, dim, dim, lambda x: (x - centre).astype(np.float64))
    mean = first / n
    cov = second / n - np.outer(mean, mean)
    cov = (cov + cov.T) / 2
    values, vectors = leading_pairs(cov, min(components, dim))
    trace = float(np.trace(cov))
    real = values > SMALLEST * trace
    return Whitening(n, sums, centre, values[real], vectors[:, real], trace)


def identity_error(fit: DataFrame, dim: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    first, second = _products(fit, dim, k, model.whitened)
    mean = first / model.n
    return float(np.abs(second / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each kept vector and component."""
    spark, kind = vectors.sparkSession, vectors.schema[id].dataType.simpleString()
    rows = quantised(vectors, id, embedding, scale)
    lengths = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    dim = lengths[0].dim if lengths else 1
    rows = rows.where(F.col("dim") == dim)
    path = scratch_dir(spark, "fit")
    rows.select("x").distinct().write.parquet(path)
    fit = spark.read.parquet(path)
    model = fit_whitening(fit, dim, components)
    error = identity_error(fit, dim, model) if model else 0.0

    def run(batches):
        for b in batches:
            k = len(model.values) if model else 0
            if not k or not b.num_rows:
                continue
            x = unpacked(b.column(1), dim)
            m = len(x)
            deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, model.n)), deviation, pa.array(model.whitened(x).ravel()),
                 pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error))],
                names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec", "x").mapInArrow(
        run, f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
