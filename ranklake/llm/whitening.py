"""Whitening of embeddings by a randomised range finder over all centred rows.

An entry c becomes the integer floor(256 * c); the fit list is each distinct vector of integers
once. Its sums are exact, and every product with its covariance V is one pass over the list: a task
centres its rows, multiplies, and sends one row of sums for each dimension; no vector and no
covariance of all dimensions goes to the driver while the range has fewer columns.

Range finder: a random start of COMPONENTS + OVERSAMPLE columns is multiplied by V and made
orthonormal, POWER times over. The same product gives the Ritz pairs (Q'VQ) and their residuals
V q - e q. If after the last pass a residual over the pair's gap still exceeds TOLERANCE, the range
takes random columns up to the full dimension, where Rayleigh-Ritz has no error but rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged

SCALE = 256
COMPONENTS = 4
OVERSAMPLE = 12
POWER = 3
#: The largest residual over gap (a bound of the sine of the angle) of a component that stands.
TOLERANCE = 1e-12
#: Eigenvalues below this share of the trace count as zero: their components have no whitened value.
ZERO = 1e-13
SEED = 42
MOST = 2**63 - 1


def integers(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key as vec_id, x as array<long>, of the rows whose vector is whole: not null, empty, or with a null, NaN or infinite entry.

    Entries beyond the long range stop at its ends. Repeated rows stay.
    """
    c = F.col(f"`{vector}`").cast("array<double>")
    whole = F.col(f"`{vector}`").isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    out = rows.filter(F.coalesce(whole, F.lit(False)))
    edge = float(2**63)
    as_long = lambda v: F.when(v >= edge, F.lit(MOST)).when(v < -edge, F.lit(-MOST - 1)).otherwise(F.floor(v))
    return out.select(F.col(f"`{key}`").alias("vec_id"), F.transform(c, lambda v: as_long(v * SCALE)).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """An array<long> column of vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of rows of the fit list and its exact sum by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(0))
            small = int(np.abs(x.astype(np.float64)).max(initial=0)) < 2**62 // len(x)
            own = x.sum(axis=0).tolist() if small else x.astype(object).sum(axis=0).tolist()
            total = own if total is None else [a + c for a, c in zip(total, own, strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(total)), pa.int32()), pa.array([n, *total], pa.decimal128(38, 0))], ["dim", "v"]
            )

    found = fit.select("x").mapInArrow(run, "dim int, v decimal(38,0)").groupBy("dim").agg(F.sum("v").alias("v")).orderBy("dim").collect()
    if not found:
        return 0, []
    values = [int(r["v"]) for r in found]
    return values[0], values[1:]


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """x - S/n in double, from the exact n*x - S, and the exact sum of its squares times n^2 by row."""
    top = max(int(np.abs(x.astype(np.float64)).max(initial=0)) * n + max(map(abs, sums)) + n, 1)
    if top * top * x.shape[1] < 2**62:
        d = n * x - np.array(sums, np.int64)
        return d / n, (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return (d / n).astype(np.float64), (d * d).sum(axis=1).tolist()


def _product(fit: DataFrame, n: int, sums: list[int], q: np.ndarray) -> np.ndarray:
    """V q over all rows of the fit list, and the trace of V in a last column of the first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(q.shape), 0.0
        for b in batches:
            if b.num_rows:
                c, _ = centred(matrix(b.column(0)), n, sums)
                total += c.T @ (c @ q)
                squares += float(np.einsum("ij,ij->", c, c))
        if total.any() or squares:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(total)), pa.int32()), pa.array([[squares], *total.tolist()], pa.list_(pa.float64()))], ["dim", "v"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = v.values.to_numpy()
                held[dim] = held[dim] + own if dim in held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["dim", "v"])

    schema = "dim int, v array<double>"
    found = {r["dim"]: r["v"] for r in fit.select("x").mapInArrow(run, schema).repartition("dim").mapInArrow(add, schema).collect()}
    out = np.zeros((q.shape[0], q.shape[1] + 1))
    for dim, v in found.items():
        if dim < 0:
            out[0, -1] = v[0] / n
        else:
            out[dim, :-1] = np.array(v) / n
    return out


def _orthonormal(y: np.ndarray) -> np.ndarray:
    q = np.linalg.qr(y)[0]
    return np.linalg.qr(q)[0]


def ritz(q: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest Ritz values of V over the range of q (y = V q), their vectors, and residual over gap of each."""
    t = q.T @ y
    e, w = np.linalg.eigh((t + t.T) / 2)
    order = np.argsort(-e, kind="stable")
    e, w = e[order], w[:, order]
    vectors = q @ w[:, :k]
    residual = np.linalg.norm(y @ w[:, :k] - vectors * e[:k], axis=0)
    gaps = np.array([min([abs(e[i] - e[j]) for j in range(len(e)) if j != i] or [abs(e[i])]) for i in range(k)])
    with np.errstate(divide="ignore", invalid="ignore"):
        return e[:k], vectors, np.where(residual == 0, 0.0, residual / gaps)


def components(fit: DataFrame, n: int, sums: list[int], k: int = COMPONENTS, power: int = POWER, oversample: int = OVERSAMPLE) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The largest eigenvalues of the fit list's covariance, their unit vectors (columns), its trace, and the columns of the last range."""
    d = len(sums)
    k, r = min(k, d), np.random.default_rng(SEED)
    q = _orthonormal(r.standard_normal((d, min(d, k + oversample))))
    for turn in range(power + 2):
        y = _product(fit, n, sums, q)
        trace, y = float(y[0, -1]), y[:, :-1]
        e, v, error = ritz(q, y, k)
        if q.shape[1] == d or (error <= TOLERANCE).all():
            break
        more = r.standard_normal((d, d - q.shape[1])) if turn >= power else np.zeros((d, 0))
        q = _orthonormal(np.hstack([y if turn < power else q, more]))
    v = v / np.linalg.norm(v, axis=0)
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
    return np.maximum(e, 0.0), v * np.where(sign == 0, 1, sign), trace, q.shape[1]


def whitened(rows: DataFrame, k: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every whole vector and component.

    Rows with a null or empty vector, or one with a null, NaN or infinite entry, are left out, and
    so are those of another length than most distinct vectors have (ties: the longer). Repeated
    rows repeat; a null id stays null; fewer dimensions than k give fewer components; no whole row
    gives no rows. A component without variance (one distinct vector, say) has a null whitened
    value, explained 0, and isn't part of identity_error, which is null where no component is left.
    A deviation beyond a long is null. Further columns are not read.
    """
    x = integers(rows, vector, key)
    every = staged(x.select("x").distinct(), "whiten-fit")
    common = every.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"].alias("d")).first()["d"]
    kind = rows.select(F.col(f"`{key}`").alias("vec_id")).schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        drop_staged(every)
        return rows.sparkSession.createDataFrame([], schema)
    fit = every.filter(F.size("x") == common)
    n, sums = _sums(fit)
    e, v, trace, _ = components(fit, n, sums, k)
    stands = e > ZERO * max(trace, np.finfo(float).tiny)
    scaled = np.where(stands, v / np.sqrt(np.where(stands, e, 1.0)), 0.0)
    own = scaled[:, stands]
    error = None
    if own.shape[1]:
        error = float(np.abs(own.T @ _product(fit, n, sums, own)[:, :-1] - np.eye(own.shape[1])).max())
    drop_staged(every)
    share = [float(a / trace) if s else 0.0 for a, s in zip(e, stands, strict=True)]
    count = len(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            c, squares = centred(matrix(b.column("x")), n, sums)
            value = (c @ scaled).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(np.repeat(np.arange(m), count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * count, n, np.int64)),
                    pa.array([s if s <= MOST else None for s in squares], pa.int64()).take(pa.array(np.repeat(np.arange(m), count))),
                    pa.array(value, mask=np.tile(~stands, m)),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * count, error if error is not None else np.nan), mask=np.full(m * count, error is None)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.filter(F.size("x") == common).mapInArrow(run, schema)


def op11(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
