"""Whitening of embeddings by their singular values.

Blockwise QR: every task reduces its centred rows to one triangle R (a block of rows is stacked under the R so far and
factored again), and the tasks' triangles are united by a tree of FAN at a time. R'R is n times the covariance, without
the covariance being formed: its condition is not squared. What follows is on one d x d triangle:
  * Householder reflections from both sides make R bidiagonal;
  * dqds (quotient-difference with shifts, only sums of positive terms where no shift is taken) finds the squared
    singular values of the bidiagonal B to high relative accuracy;
  * a twisted factorisation of B'B - e (stationary from the top, progressive from the bottom, met where their
    difference is least) gives each eigenvector without a solve; the right reflections carry it back. Eigenvalues that
    are nearly equal share a space, whose basis comes from inverse iteration and a rotation within the space.

Sums and deviations are exact whole numbers; rows pass the driver never, triangles at most FAN. What has a bound: d x d
numbers per task, d being the vectors' length (some thousands at most).

Defined results: vectors that are null or empty or hold null, non-finite or out-of-range entries (2^42 or more) are
dropped, and so are those of another length than the most frequent one (of two such, the greater); repeated rows count
as often as they occur; null ids are kept. A component without variance (fewer different rows than dimensions) has
whitened null and does not count in identity_error; with no variance at all, explained and identity_error are null. A
deviation over 2^63 - 1 is null. An empty table gives an empty result. Columns other than the id and the vector are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm.common import table, written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LIMIT = 2.0**42

#: Triangles that one task of the tree unites.
FAN = 32
EPS = float(np.finfo(float).eps)


# ---- the solver -----------------------------------------------------------------------------------------------------


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit v and a with (1 - 2 v v') x = a e1."""
    norm = float(np.linalg.norm(x))
    v = x.astype(float).copy()
    if norm == 0:
        return np.zeros_like(v), 0.0
    a = -norm if x[0] >= 0 else norm
    v[0] -= a
    return v / np.linalg.norm(v), a


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and P with U'rP upper bidiagonal; r is square."""
    a, d = r.astype(float).copy(), r.shape[0]
    p = np.eye(d)
    for k in range(d):
        v, _ = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            w, _ = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            p[:, k + 1 :] -= 2 * np.outer(p[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def dqds_step(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float]] | None:
    """One transform with shift tau; None if tau is not below the least eigenvalue."""
    d = q[0] - tau
    new_q, new_e = [], []
    for i in range(len(e)):
        if d < 0:
            return None
        new_q.append(d + e[i])
        ratio = q[i + 1] / new_q[i] if new_q[i] > 0 else 0.0
        new_e.append(e[i] * ratio)
        d = d * ratio - tau
    if d < 0:
        return None
    return [*new_q, d], new_e


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal, falling."""
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above]
    found: list[float] = []
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        for _ in range(200 * len(q) + 50):
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            small = [i for i in range(len(e)) if e[i] <= (EPS / 4) ** 2 * (moved + q[i]) or e[i] <= EPS / 8 * EPS * (moved + q[i + 1])]
            if small:  # parts without a link are solved on their own
                i = small[-1]
                blocks.append((q[: i + 1], e[:i], moved))
                q, e = q[i + 1 :], e[i + 1 :]
                continue
            if q[0] < q[-1]:  # the least at the end: reversed rows and columns have the same values
                q, e = flipped(q, e)
            top, bottom, off = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], (q[-2] * e[-1]) ** 0.5
            half = (top - bottom) / 2
            least = bottom - off * off / (abs(half) + (half * half + off * off) ** 0.5) if half >= 0 else top - off * off / (abs(half) + (half * half + off * off) ** 0.5)
            tau = max(0.0, min(least, q[-1]))
            step = None
            for share in (1.0, 0.75, 0.25):
                if step := dqds_step(q, e, share * tau):
                    tau *= share
                    break
            if step is None:
                tau, step = 0.0, dqds_step(q, e, 0.0)
            q, e = step
            moved += tau
        else:
            raise ArithmeticError("dqds has not settled")
    return np.sort(np.array(found))[::-1]


def flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """Squares of the bidiagonal read from its end: B' with rows and columns reversed has the same singular values."""
    return q[::-1], e[::-1]


def tridiagonal(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """B'B."""
    b = np.diag(diagonal) + np.diag(above, 1)
    return b.T @ b


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for an eigenvalue."""
    n = diagonal.size
    d, l = diagonal**2, above / diagonal[:-1]
    s, p = np.empty(n), np.empty(n)
    low, up = np.empty(n - 1), np.empty(n - 1)
    tiny = EPS * EPS * max(float(d.max()), 1e-300)
    s[0], p[-1] = -value, d[-1] - value
    for i in range(n - 1):
        pivot = d[i] + s[i]
        pivot = pivot if pivot else tiny
        low[i] = l[i] * d[i] / pivot
        s[i + 1] = low[i] * l[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * l[i] * l[i] + p[i + 1]
        pivot = pivot if pivot else tiny
        up[i] = l[i] * d[i] / pivot
        p[i] = p[i + 1] * (d[i] / pivot) - value
    gamma = np.abs(s + p + value)
    r = int(np.argmin(np.where(np.isnan(gamma), np.inf, gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def shared_space(t: np.ndarray, values: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors (columns, by falling value) of nearly equal eigenvalues, across to those outside."""
    n, m = t.shape[0], values.size
    x = np.random.default_rng(1).standard_normal((n, m))
    scale = max(float(np.abs(t).max()), 1e-300)
    moved = t - (values.mean() + 4 * EPS * scale) * np.eye(n)
    for _ in range(4):
        x = np.linalg.solve(moved, x)
        x -= outside @ (outside.T @ x)
        x = np.linalg.qr(x)[0]
    inner, turn = np.linalg.eigh(x.T @ t @ x)
    return x @ turn[:, np.argsort(-inner)]


def right_vectors(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues of r'r, falling (those that are zero to rounding are 0), and eigenvectors (columns) of the first."""
    d = r.shape[1]
    square = np.zeros((d, d))
    square[: min(d, r.shape[0])] = np.linalg.qr(r, mode="r") if r.shape[0] > d else r
    scale = float(np.abs(square).max(initial=0.0))
    if scale == 0:
        return np.zeros(d), np.zeros((d, 0))
    diagonal, above, p = bidiagonal(square / scale)
    norm = float(np.sqrt((diagonal**2).sum() + (above**2).sum()))
    diagonal = np.where(np.abs(diagonal) < EPS * norm, EPS * norm, diagonal)
    values = dqds(diagonal, above)
    kept = int((values > (8 * d * EPS) ** 2 * values[0]).sum())
    t = tridiagonal(diagonal, above)
    vectors, k, last = np.zeros((d, 0)), 0, min(most, kept)
    while k < last:
        end = k + 1
        while end < kept and values[end - 1] - values[end] <= 1e-4 * values[end - 1]:
            end += 1
        new = twisted(diagonal, above, values[k])[:, None] if end == k + 1 else shared_space(t, values[k:end], vectors)
        new -= vectors @ (vectors.T @ new)  # rounding
        vectors, k = np.hstack([vectors, new / np.linalg.norm(new, axis=0)]), end
    values[kept:] = 0
    return values * scale * scale, (p @ vectors)[:, :last]


# ---- rows on Spark --------------------------------------------------------------------------------------------------


def valid(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """id and vector (doubles) of the rows that count."""
    good = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(LIMIT)))
    rows = rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.size("vector") > 0).filter(good)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("vector") == F.lit(sizes.d if sizes else 1))


def whole(column: pa.Array) -> np.ndarray:
    """Rows of x, the whole numbers of the vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(column), -1)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of x in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = whole(batch.column(0))
                high, low = (x >> 26).sum(axis=0).tolist(), (x & (1 << 26) - 1).sum(axis=0).tolist()
                part = [(h << 26) + v for h, v in zip(high, low)]
                n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part)]
        if sums is not None:
            values = pa.array([Decimal(v) for v in [n, *sums]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums) + 1), pa.int32()), values], names=["at", "total"])

    parts = rows.select("vector").mapInArrow(run, "at int, total decimal(38, 0)")
    out = [int(r.total) for r in parts.groupBy("at").agg(F.sum("total").cast("decimal(38, 0)").alias("total")).orderBy("at").collect()]
    return (out[0], out[1:]) if out else (0, [])


def triangle(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows."""

    def packed(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["r"])

    def opened(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw).reshape(-1, mean.size)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                block = whole(batch.column(0)) - mean
                r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
        yield from packed(r)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for raw in batch.column(0):
                block = opened(raw.as_py())
                r = block if r is None else np.linalg.qr(np.vstack([r, block]), mode="r")
        yield from packed(r)

    parts = written(rows.select("vector").mapInArrow(reduce_rows, "r binary"), "triangles")
    left = parts.count()
    while left > FAN:
        left = -(-left // FAN)
        parts = written(parts.repartition(left).mapInArrow(unite, "r binary"), "triangles")
    found = [opened(bytes(row.r)) for row in parts.collect()]  # at most FAN of d x d numbers
    return np.linalg.qr(np.vstack(found), mode="r") if found else np.zeros((0, mean.size))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2 per row, exact; None where a long can't hold it."""
    if not len(x):
        return []
    far = max(max(abs(n * int(v) - s) for v in ends) for ends, s in zip(zip(x.min(axis=0), x.max(axis=0)), sums))
    if max(n * int(np.abs(x).max()), max(map(abs, sums)), len(sums) * far * far) < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    out = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in out]


def whiten(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, n, deviation, whitened (array over the components), explained (array), identity_error."""
    spark = rows.sparkSession
    rows = valid(rows, id_, vector)
    n, sums = exact_sums(rows)
    schema = "id long, n long, deviation long, whitened array<double>"
    if not n:
        return spark.createDataFrame([], f"{schema}, explained array<double>, identity_error double")
    mean = np.array([s / n for s in sums])
    values, vectors = right_vectors(triangle(rows, mean), components)
    total, k = float(values.sum()), min(components, len(sums))
    turn = vectors / np.sqrt(values[: vectors.shape[1]] / n)
    blank = k - vectors.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = whole(part.column(1))
                z = [[*row, *[None] * blank] for row in ((x - mean) @ turn).tolist()]
                columns = [part.column(0), pa.array([n] * len(x), pa.int64()), pa.array(deviations(x, n, sums), pa.int64()), pa.array(z, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "deviation", "whitened"])

    done = written(rows.mapInArrow(project, schema), "whitened")
    pairs = [(i, j) for i in range(vectors.shape[1]) for j in range(i + 1)]
    z = F.col("whitened")
    first = done.agg(*(F.avg(z[i]) for i in range(k))).first()  # centred before multiplying
    moments = done.agg(*(F.avg((z[i] - first[i]) * (z[j] - first[j])) for i, j in pairs)).first() if pairs else ()
    error = max((abs(m - (i == j)) for m, (i, j) in zip(moments, pairs)), default=None)
    explained = F.array(*(F.lit(float(v) / total if total else None).cast("double") for v in values[:k]))
    return done.withColumn("explained", explained).withColumn("identity_error", F.lit(error).cast("double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings"))
    each = out.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x"))
    return each.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", "deviation", F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error")
