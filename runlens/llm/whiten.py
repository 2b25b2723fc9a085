"""Embedding whitening from a distributed covariance and an eigensolver of its own.

Each valid entry c becomes the integer x = floor(1024 c) + 100000.

1. One pass adds up n and the per-dimension sums S (exact integers).
2. A second pass adds up the centred covariance: n x - S is taken in integers,
   divided by n, and only then multiplied.  A task folds its vectors into one
   d x d matrix and sends its rows, which are added by row on the executors.
3. The driver holds one d x d matrix (bounded by the vectors' length, whatever
   their number) and solves it: Householder reflections make it tridiagonal,
   Sturm counts bisect the leading eigenvalues, inverse iteration gives their
   vectors, made orthogonal anew inside clusters of near eigenvalues; the
   reflections are then undone.
4. d x 8 numbers are broadcast; a pass merges the centred moments of the
   projections (for the identity error), another one returns the rows.

Rows whose vector is null or holds null or non-finite entries are left out;
zero vectors, repeated rows, repeated and null ids take part.  Shorter vectors
are read as if zeros followed.  Entries beyond +-2^42 count as +-2^42, so that x
fits its type.  Components whose eigenvalue is not above ``RANK`` of the trace have
no scale and are left out, so an empty table, one vector or only copies of one
give no row.  A deviation that does not fit a long is null.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.jobs import prepare

COMPONENTS = 8
RANK = 1e-12
CLUSTER = 1e-3
SLOTS = 32
SCALE, SHIFT, MOST = 1024, 100_000, float(1 << 42)


def _valid() -> Column:
    return F.expr("embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    """The integer vectors of a batch, n x dim."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * np.clip(out, -MOST, MOST)).astype(np.int64) + SHIFT


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit integers where they suffice, Python's where not."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _deviations(y: np.ndarray) -> list[int | None]:
    if y.dtype != object and y.size and y.shape[1] * int(np.abs(y).max()) ** 2 < 1 << 63:
        return (y * y).sum(1).tolist()
    return [s if (s := sum(int(v) * int(v) for v in row)) < 1 << 63 else None for row in y]


def _sums(vectors: DataFrame, dim: int) -> list[int]:
    """Per-dimension sums; a batch's sums fit 64 bits, a task's are Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)
        for b in batches:
            x = _whole(b.column(0), dim)
            for at in range(0, len(x), 1000):
                total = total + x[at : at + 1000].sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))], ["i", "s"])

    rows = vectors.select("embedding").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    got = {r.i: int(r.s) for r in rows.collect()}  # one row a dimension
    return [got[i] for i in range(dim)]


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Centred covariance (divisor n) of the integer vectors; rows of partial matrices are added on the executors."""
    dim = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            y = _centred(_whole(b.column(0), dim), n, sums).astype(np.float64) / n
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim)
        for b in batches:
            for r in b.column("row").to_pylist():
                total += np.frombuffer(r)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(total / n).tobytes()], pa.binary())], ["i", "row"])

    out = np.zeros((dim, dim))
    rows = vectors.select("embedding").mapInArrow(run, "i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary")
    for r in rows.collect():  # d rows of d numbers
        out[r.i] = np.frombuffer(r.row)
    return (out + out.T) / 2


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """(diagonal, off-diagonal, reflection vectors) of a symmetric matrix by Householder reflections."""
    a, n = a.copy(), len(a)
    made: list[np.ndarray | None] = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not np.any(v[1:]):
            made.append(None)
            continue
        alpha = -size if v[0] >= 0 else size
        v[0] -= alpha
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = 2 * (rest @ v)
        w = p - (v @ p) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = alpha
        made.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), made


def count_below(diag: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix lie below each x."""
    tiny = np.finfo(float).tiny ** 0.5
    off2 = off * off
    below = np.zeros(len(x), np.int64)
    q = np.ones(len(x))
    for i in range(len(diag)):
        q = diag[i] - x - (off2[i - 1] / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_eigenvalues(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its interval has no number inside."""
    n = len(diag)
    reach = np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])
    bound = float((np.abs(diag) + reach).max()) * (1 + 1e-12) + np.finfo(float).tiny
    lo, hi = np.full(k, -bound), np.full(k, bound)
    rank = n - 1 - np.arange(k)  # place from below
    for _ in range(1100):
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all() or (hi - lo).max() <= 4e-16 * bound * 1e-3:
            break
        above = count_below(diag, off, mid) <= rank
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return lo + (hi - lo) / 2


def _solve(diag: list[float], off: list[float], shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """x of (T - shift) x = b: elimination with row exchanges, pivots of zero made tiny."""
    n = len(diag)
    d, u, u2, x = [v - shift for v in diag], list(off) + [0.0], [0.0] * n, b.tolist()
    for i in range(n - 1):
        low = off[i]
        if abs(d[i]) >= abs(low):
            m = low / (d[i] if d[i] else tiny)
            d[i + 1] -= m * u[i]
            x[i + 1] -= m * x[i]
        else:
            m = d[i] / low
            d[i], u[i], d[i + 1], u2[i], u[i + 1] = low, d[i + 1], u[i] - m * d[i + 1], u[i + 1], -m * u[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - m * x[i + 1]
    for i in range(n - 1, -1, -1):
        s = x[i] - (u[i] * x[i + 1] if i + 1 < n else 0.0) - (u2[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = s / (d[i] if abs(d[i]) > tiny else (tiny if d[i] >= 0 else -tiny))
    out = np.array(x)
    return out / np.abs(out).max()


def eigenvectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) by inverse iteration; those of a cluster are made orthogonal to each other in every step."""
    n, rng = len(diag), np.random.default_rng(7)
    norm = float((np.abs(diag) + np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])).max())
    step, out = np.finfo(float).eps * norm, np.zeros((len(values), n))
    d, e = diag.tolist(), off.tolist()
    head, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            head = j
        shift = min(float(value), shift - 10 * step) if j > head else float(value)  # equal eigenvalues get different shifts
        x = rng.standard_normal(n)
        for _ in range(6):
            x = _solve(d, e, shift, x, step)
            for _ in range(2):
                x -= out[head:j].T @ (out[head:j] @ x)
            x /= np.linalg.norm(x)
        out[j] = x
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as rows) of a symmetric matrix, up to k of them."""
    k = min(k, len(v))
    scale = float(np.abs(v).max(initial=0))
    if not k or scale == 0:
        return np.zeros(0), np.zeros((0, len(v)))
    diag, off, made = tridiagonal(v / scale)
    found = eigenvectors(diag, off, leading_eigenvalues(diag, off, k))
    values = np.array([x @ (diag * x) + 2 * (x[:-1] * off) @ x[1:] for x in found])  # Rayleigh quotients
    for i in range(len(made) - 1, -1, -1):
        if made[i] is not None:
            found[:, i + 1 :] -= 2 * np.outer(found[:, i + 1 :] @ made[i], made[i])
    order = np.argsort(-values, kind="stable")
    found, values = found[order], values[order]
    found *= np.where(found[np.arange(k), np.abs(found).argmax(1)] < 0, -1, 1)[:, None]
    return values * scale, found


def _merged(a, b):
    """Count, mean and centred products of two groups together."""
    (n, m, c), (n2, m2, c2) = a, b
    if not n2:
        return a
    if not n:
        return b
    step = m2 - m
    return n + n2, m + step * (n2 / (n + n2)), c + c2 + np.outer(step, step) * (n * n2 / (n + n2))


def _identity_error(vectors: DataFrame, n: int, sums: list[int], project: np.ndarray) -> float:
    """Largest absolute entry of the projections' covariance minus the identity."""
    dim, k = project.shape
    empty = (0, np.zeros(k), np.zeros((k, k)))
    names = ["slot", "n", "m", "c"]

    def row(slot: int, got) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([got[0]], pa.int64()), pa.array([got[1].tobytes()]), pa.array([got[2].tobytes()])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = empty
        for b in batches:
            z = (_centred(_whole(b.column(0), dim), n, sums).astype(np.float64) / n) @ project
            if len(z):
                mean = z.mean(0)
                total = _merged(total, (len(z), mean, (z - mean).T @ (z - mean)))
        yield row(TaskContext.get().partitionId() % SLOTS, total)

    def parts(batches):
        for b in batches:
            for r in b.to_pylist():
                yield r["n"], np.frombuffer(r["m"]), np.frombuffer(r["c"]).reshape(k, k)

    def fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = empty
        for part in parts(batches):
            total = _merged(total, part)
        yield row(key[0].as_py(), total)

    kind = "slot int, n long, m binary, c binary"
    total = empty
    for r in vectors.select("embedding").mapInArrow(run, kind).groupBy("slot").applyInArrow(fold, kind).collect():  # SLOTS rows
        total = _merged(total, (r.n, np.frombuffer(r.m), np.frombuffer(r.c).reshape(k, k)))
    return float(np.abs(total[2] / n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each valid row of
    ``vectors`` (vec_id, embedding) and each leading component."""
    spark = vectors.sparkSession
    prepare(spark)
    kind = dict(vectors.dtypes)["vec_id"]
    good = vectors.where(_valid()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    head = good.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n, dim = head.n, head.dim or 0
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not dim:
        return spark.createDataFrame([], schema)
    sums = _sums(good, dim)
    cov = covariance(good, n, sums)
    trace = float(np.trace(cov))
    values, found = leading_components(cov, components)
    kept = values > RANK * trace
    values, found = values[kept], found[kept]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    project = np.ascontiguousarray((found / np.sqrt(values)[:, None]).T)  # dim x k, broadcast with the function
    explained = values / trace
    error = _identity_error(good, n, sums, project)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _centred(_whole(b.column(1), dim), n, sums)
            z = (y.astype(np.float64) / n) @ project
            rows = len(z)
            at = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n), pa.int64()),
                 pa.array(_deviations(y), pa.int64()).take(at), pa.array(z.ravel()), pa.array(np.tile(explained, rows)),
                 pa.array(np.full(rows * k, error))], names)

    return good.mapInArrow(run, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
