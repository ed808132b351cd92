"""Whitening of embeddings: an eigendecomposition that grows by rank-one updates, refined over all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

#: Entries become floor(SCALE * c) + OFFSET. Those of LARGEST or more have no exact double.
SCALE, OFFSET, LARGEST = 64.0, 1_000_000, 2.0**53
#: Spectra that one task combines; rows of a step in a task; rows from which a task of its own is worth it.
FAN_IN, STEP, TASK_ROWS = 16, 4_096, 1_024
EPS = float(np.finfo(np.float64).eps)


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z**2 / (d - x)) = 0, for rising d, no z of 0 and rho > 0.

    Returns (origin, mu): root j is d[origin[j]] + mu[j], with the pole nearest to
    it as origin, so differences from poles keep their digits. Root j lies between
    d[j] and d[j + 1], the last below d[-1] + rho * z.z. Each step fits a rational
    function to the terms left and right of the root and falls back to halving.
    """
    k, zz = len(d), rho * z * z
    upper = np.append(d[1:], d[-1] + zz.sum())
    gap = upper - d
    mid = 1 + (zz / (d[None, :] - (d + gap / 2)[:, None])).sum(1)
    left = mid >= 0  # the root is in the left half
    left[-1] = True
    origin = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta = d[None, :] - d[origin][:, None]
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    if mid[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    mu = (low + high) / 2
    below = np.tril(np.ones((k, k)))
    pole1, pole2 = d - d[origin], upper - d[origin]
    for _ in range(80):
        inverse = 1.0 / (delta - mu[:, None])
        slopes = inverse * inverse
        f = 1 + inverse @ zz
        low, high = np.where(f < 0, np.maximum(low, mu), low), np.where(f > 0, np.minimum(high, mu), high)
        d1, d2 = pole1 - mu, pole2 - mu
        slope1 = (slopes * below) @ zz
        slope2 = slopes @ zz - slope1
        c = f - d1 * slope1 - d2 * slope2
        a = (d1 + d2) * f - d1 * d2 * (slope1 + slope2)
        b = d1 * d2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = mu + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done = (np.abs(f) <= 4 * EPS * (1 + np.abs(inverse) @ zz)) | (np.abs(new - mu) <= 2 * EPS * np.abs(mu))
        mu = np.where(done, mu, new)
        if done.all():
            break
    return origin, mu


def rank_one(lam: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of q diag(lam) q' + rho v v', for rho >= 0.

    Directions in which v has nothing, and one of each two whose eigenvalues are
    equal to rounding (after a rotation that takes v out of it), are deflated: they
    stay as they are. For the others the secular equation is solved, and z is
    made anew from the roots, which keeps the vectors orthogonal.
    """
    z = v @ q
    norm = float(np.sqrt(z @ z))
    if not rho * norm > 0:
        return lam, q
    z, rho = z / norm, rho * norm * norm
    tol = 8 * EPS * max(float(np.abs(lam[-1])), float(np.abs(lam[0])), rho)
    live = np.flatnonzero(rho * np.abs(z) > tol)
    if len(live) > 1 and (np.diff(lam[live]) * np.abs(z[live][1:] * z[live][:-1]) <= tol).any():
        q, lam, kept, last = q.copy(), lam.copy(), [], -1
        for i in live.tolist():
            if last >= 0:
                t = float(np.hypot(z[last], z[i]))
                c, s = z[i] / t, z[last] / t
                if (lam[i] - lam[last]) * abs(c * s) <= tol:
                    z[last], z[i] = 0.0, t
                    q[:, [last, i]] = np.stack((c * q[:, last] - s * q[:, i], s * q[:, last] + c * q[:, i]), 1)
                    low, high = lam[last], lam[i]
                    lam[last], lam[i] = c * c * low + s * s * high, s * s * low + c * c * high
                    kept.pop()
            kept.append(i)
            last = i
        live = np.array(kept)
        live = live[np.argsort(lam[live], kind="stable")]
    if not len(live):
        return lam, q
    d, zl = lam[live], z[live]
    if (np.diff(d) <= 0).any():  # equal to the last digit after rotations: set apart by less than tol
        d = np.maximum.accumulate(d) + np.arange(len(d)) * (tol / (16 * len(d)))
    origin, mu = secular_roots(d, zl, rho)
    away = (d[:, None] - d[origin][None, :]) - mu[None, :]  # d[i] - root[j]
    apart = d[:, None] - d[None, :]
    np.fill_diagonal(apart, 1.0)
    ratio = away / apart
    z2 = np.abs(np.prod(ratio, axis=1)) / rho
    zh = np.sqrt(z2) * np.where(zl < 0, -1.0, 1.0)
    u = zh[:, None] / away
    u /= np.sqrt((u * u).sum(0))
    if len(live) == len(lam):  # roots lie between the old values, so they rise
        return d[origin] + mu, q @ u
    out_lam, out_q = lam.copy(), q.copy()
    out_lam[live] = d[origin] + mu
    out_q[:, live] = q[:, live] @ u
    order = np.argsort(out_lam, kind="stable")
    return out_lam[order], out_q[:, order]


def empty(d: int):
    """(rows, mean, eigenvalues of the scatter, eigenvectors) of no rows."""
    return 0, np.zeros(d), np.zeros(d), np.eye(d)


def with_row(state, x: np.ndarray):
    """The spectrum with one more row: a rank-one update by the row less the mean so far."""
    n, mean, lam, q = state
    off = x - mean
    if n:
        lam, q = rank_one(lam, q, off, n / (n + 1))
    return n + 1, mean + off / (n + 1), lam, q


def combined(one, other):
    """The spectrum of both sets of rows: a rank-one update for each direction of the smaller, one for the means."""
    if one[0] < other[0]:
        one, other = other, one
    (n, mean, lam, q), (m, mean2, lam2, q2) = one, other
    if not m:
        return one
    for k in np.flatnonzero(lam2 > 0):
        lam, q = rank_one(lam, q, q2[:, k], float(lam2[k]))
    off = mean2 - mean
    lam, q = rank_one(lam, q, off, n * m / (n + m))
    return n + m, mean + off * (m / (n + m)), lam, q


def _x(v: Column) -> Column:
    return F.transform(v, lambda c: F.floor(c * F.lit(SCALE)).cast("long") + F.lit(OFFSET))


def quantized(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>): rows whose vector is there, with finite entries only, as floor(64 * c) + 1000000.

    Vectors shorter than the longest count as followed by zeros. Rows with an
    entry of which 64 * c is 2**53 or more in size are left out as well. Null ids
    and repeated rows stay; other columns are ignored.
    """
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * F.lit(SCALE) >= F.lit(LARGEST)))
    out = rows.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & ~bad)
    size = max(1, out.agg(F.max(F.size("v"))).first()[0] or 0)
    whole = F.when(F.size("v") < size, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v")))).otherwise(F.col("v"))
    return out.select("vec_id", _x(whole).alias("x"))


def _summed(rows: DataFrame, of, kind: str) -> np.ndarray:
    """Sums over all rows of the arrays that ``of`` makes of each partition's batches."""
    cells = rows.mapInArrow(of, f"g array<{kind}>").select(F.posexplode("g").alias("i", "g"))
    out = cells.groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")  # a row an entry of the array
    return out["g"].to_numpy()


def _longs(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension of x."""

    def parts(batches):
        for b in batches:
            if b.num_rows:
                x = _longs(b.column("x"))
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([len(x)], (x >> 26).sum(0), (x & (2**26 - 1)).sum(0)))])], ["g"])

    got = [int(t) for t in _summed(rows, parts, "long")]
    if not got:
        return 0, []
    d = (len(got) - 1) // 2
    return got[0], [(high << 26) + low for high, low in zip(got[1 : d + 1], got[d + 1 :], strict=True)]


def spectrum(rows: DataFrame, work: Workspace, d: int, n: int):
    """The spectrum of all rows of x: each partition's own, combined by sixteens until one is left."""
    schema = "part long, n long, mean binary, lam binary, q binary"

    def pack(part, state):
        return part, state[0], *(np.ascontiguousarray(x, np.float64).tobytes() for x in state[1:])

    def unpack(n, mean, lam, q):
        return int(n), np.frombuffer(mean), np.frombuffer(lam), np.frombuffer(q).reshape(d, d)

    def grow(batches):
        state = empty(d)
        for b in batches:
            for row in (_longs(b.column("x")) - OFFSET).astype(np.float64):
                state = with_row(state, row)
        if state[0]:
            packed = pack(TaskContext.get().partitionId(), state)
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in packed], ["part", "n", "mean", "lam", "q"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        state = empty(d)
        for r in frame.itertuples():
            state = combined(unpack(r.n, r.mean, r.lam, r.q), state)
        return pd.DataFrame([pack(int(frame["part"].iloc[0]) // FAN_IN, state)], columns=["part", "n", "mean", "lam", "q"])

    x, tasks = rows.select("x"), min(-(-n // TASK_ROWS), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    if x.rdd.getNumPartitions() < tasks:  # an update costs far more than a row's way to another task
        x = x.repartition(tasks)
    parts = work.written(x.mapInArrow(grow, schema), "spectra-0")
    left, turn = (parts.agg(F.max("part")).first()[0] or 0) + 1, 0
    while left > 1:
        turn += 1
        merged = parts.withColumn("group", F.expr(f"part div {FAN_IN}")).groupBy("group").applyInPandas(merge, schema)
        parts, left = work.written(merged, f"spectra-{turn}"), -(-left // FAN_IN)
    found = parts.drop("part").collect()  # one row of d * d numbers
    state = empty(d)
    for r in found:
        state = combined(unpack(*r), state)
    work.drop(*(f"spectra-{k}" for k in range(turn + 1)))
    return state


def centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S / n, for S = n * whole + rest * n with 0 <= rest < 1: exact but for one rounding."""
    return (x - whole).astype(np.float64) - rest


def _products(rows: DataFrame, of, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows y = of(x) and of the products y y'."""

    def parts(batches):
        total = np.zeros(size + size * size)
        for b in batches:
            for a in range(0, b.num_rows, STEP):
                y = of(_longs(b.column("x").slice(a, STEP)))
                total += np.concatenate((y.sum(0), (y.T @ y).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["g"])

    total = _summed(rows, parts, "double").astype(np.float64)
    return total[:size], total[size:].reshape(size, size)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S)**2 of each row; null where it doesn't fit a long."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s - n * (s // n) for s in sums], np.int64)
    off = x - whole
    if (float(np.abs(off).max(initial=0)) + 1) * n * np.sqrt(max(1, x.shape[1])) < 2.0**31:
        off = n * off - rest
        return (off * off).sum(1).tolist()
    exact = [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in off]
    return [s if s < 2**63 else None for s in exact]


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", work: Workspace | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Vectors become longs (see ``quantized``, which says what is left out). Every
    partition grows a spectrum by centred rank-one updates; spectra are combined,
    a task holding two at a time. The result is a basis of the whole space; the
    exact means then centre all rows once more, their products in that basis are
    summed, and its eigenvectors (a Rayleigh-Ritz step) give the components of the
    covariance (divisor n) to double precision, by falling eigenvalue.

    ``deviation`` is exact (null where it doesn't fit a long). There are as many
    components as dimensions, and no more than asked for. A component of which
    the variance is 0 to rounding has null in ``whitened`` and takes no part in
    ``identity_error`` (the largest entry of the whitened rows' covariance less
    the identity). Without any vector there are no rows. The driver and each task
    hold some matrices of d x d numbers and nothing that grows with the rows.
    """
    work = work or Workspace(rows.sparkSession)
    x = work.written(quantized(rows, id_col, vec_col), "quantized")
    id_type = x.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, {SCHEMA}"
    n, sums = exact_sums(x)
    d = len(sums)
    if not n or not d:
        return rows.sparkSession.createDataFrame([], schema)
    k = min(components, d)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - n * (s // n)) / n for s in sums])
    basis = np.linalg.qr(spectrum(x, work, d, n)[3])[0]
    _, inner = _products(x, lambda a: centred(a, whole, rest) @ basis, d)
    e, turn = np.linalg.eigh(inner / n)
    e, vectors = e[::-1], basis @ turn[:, ::-1]
    trace = float(np.trace(inner)) / n
    alive = e[:k] > d * EPS * max(float(e[0]), 0.0)
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, e[:k], 1.0)), 0.0)
    onto = vectors[:, :k] * scale
    explained = e[:k] / trace if trace > 0 else np.zeros(k)
    total, inner = _products(x, lambda a: centred(a, whole, rest) @ onto, k)
    error = np.abs(inner / n - np.outer(total / n, total / n) - np.diag(alive.astype(np.float64)))
    error = float(error.max(initial=0.0))

    def project(batches):
        for b in batches:
            for a in range(0, b.num_rows, STEP):
                part = b.slice(a, STEP)
                values, m = _longs(part.column("x")), part.num_rows
                y = centred(values, whole, rest) @ onto
                at = pa.array(np.repeat(np.arange(m), k))
                columns = [part.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(deviations(values, n, sums), pa.int64()).take(at)]
                columns += [pa.array(y.ravel(), mask=np.tile(~alive, m)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(project, schema)
