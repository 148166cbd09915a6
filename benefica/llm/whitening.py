"""Whitening of vectors by their exact covariance, put together from variances alone.

Entries become whole numbers and every sum is exact.  For dimension i and every pair i < j the tasks add up the squares
of the centred values y_i and of the sums y_i + y_j; as 2 cov(i, j) = var(i + j) - var(i) - var(j), the differences of
these variances give all cross-covariances, which are divided once and handed to an eigenvalue solver.

To the driver go d (d + 1) / 2 sums and no vectors; each of them is cut into words of 32 bits, which Spark adds up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benefica.llm.common import stage

SCALE = 256
LIMBS = 6  # words of 32 bits of a sum of squares
CELLS = 1 << 18  # entries of a block of vectors that is worked on at a time
SAFE = 1 << 61


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Add ``_x``, the entries times ``scale`` rounded down; rows whose vector is null or has a null or non-finite entry go.

    Shorter vectors end in zeros.  Numbers beyond 64 bits become the largest one.
    """
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return rows.withColumn("_x", F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector))))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column("_x")
        x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
        step = max(1, CELLS // max(1, x.shape[1]))
        for lo in range(0, len(x), step):
            yield batch.slice(lo, step), x[lo:lo + step]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exactly: 64-bit numbers where all fit, Python's otherwise."""
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(v: np.ndarray) -> list[int]:
    """The exact sum of squares of each column; the entries are below 2^62 or Python integers."""
    if v.dtype == object:
        return [int(s) for s in (v * v).sum(axis=0)]
    digits, rest = [], v  # base 2^21, the last one signed
    while True:
        if len(digits) == 2 or not rest.size or max(int(rest.max()), -int(rest.min())) < 1 << 21:
            digits.append(rest)
            break
        digits.append(rest & ((1 << 21) - 1))
        rest = rest >> 21
    out = [0] * v.shape[1]
    for a, da in enumerate(digits):
        for b in range(a, len(digits)):
            part = np.einsum("ij,ij->j", da, digits[b]).tolist()  # below 2^42 times the rows of a block
            out = [o + ((2 if a != b else 1) * p << 21 * (a + b)) for o, p in zip(out, part)]
    return out


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, None, None
        for _, x in _blocks(batches):
            h, lo = (x >> 32).sum(axis=0).astype(object), (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            n, high, low = n + len(x), h if high is None else high + h, lo if low is None else low + lo
        if n:
            total = [int(a) * (1 << 32) + int(b) for a, b in zip(high, low)]
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([n] * (len(total) + 1), pa.int64()), "dim": pa.array(range(-1, len(total)), pa.int32()),
                "high": pa.array([0, *[t >> 32 for t in total]], pa.int64()), "low": pa.array([0, *[t & 0xFFFFFFFF for t in total]], pa.int64())})

    rows = fit.mapInArrow(add, "n long, dim int, high long, low long").groupBy("dim").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).orderBy("dim").collect()
    return (rows[0].n if rows else 0), [int(r.high) * (1 << 32) + int(r.low) for r in rows[1:]]


def polarised_covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of ``_x`` with divisor n, each entry the exact fraction rounded once."""
    d = len(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            y = centred(x, n, sums)
            found = square_sums(y)
            for i in range(d - 1):
                found += square_sums(y[:, i + 1:] + y[:, i:i + 1])
            total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(total)), pa.int32()), **{
                f"w{k}": pa.array([(t >> 32 * k) & 0xFFFFFFFF if k < LIMBS - 1 else t >> 32 * k for t in total], pa.int64()) for k in range(LIMBS)}})

    words = [f"w{k}" for k in range(LIMBS)]
    found = fit.mapInArrow(add, "place int, " + ", ".join(f"{w} long" for w in words)).groupBy("place").agg(*[F.sum(w).alias(w) for w in words])
    total = {r.place: sum(r[w] << 32 * k for k, w in enumerate(words)) for r in found.collect()}
    v, place = np.zeros((d, d)), d
    for i in range(d):
        v[i, i] = total[i] / n**3
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (total[place] - total[i] - total[j]) / (2 * n**3)
            place += 1
    return v


def _whitened(y: np.ndarray, n: int, axes: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (y / n).astype(np.float64) @ axes / np.sqrt(values)


def identity_error(fit: DataFrame, n: int, sums: list[int], axes: np.ndarray, values: np.ndarray) -> float | None:
    """The largest absolute entry of the whitened covariance of ``fit`` minus the identity; None without components."""
    k = len(values)
    if not k:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in _blocks(batches):
            w = _whitened(centred(x, n, sums), n, axes, values)
            total += w.T @ w
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_pydict({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": total.ravel()})

    rows = fit.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return max(abs(r.v / n - (r.i == r.j)) for r in rows)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """One row per kept row and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or has a null or non-finite entry go.  The fit counts each distinct vector of whole numbers
    once.  A component without variance (identical vectors, fewer dimensions) has whitened null and takes no part in
    identity_error; explained is null if nothing varies.  deviation is null where it passes 64 bits.  Repeated rows and
    null ids are rows like others; an empty table, or one of empty vectors only, gives no rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = whole_vectors(vectors.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v")), "_v", scale).select("_id", "_x")
    fit = stage(rows.select("_x").distinct(), "fit")
    n, sums = exact_sums(fit)
    d = len(sums)
    names = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return vectors.sparkSession.createDataFrame([], names).withColumnRenamed("_id", id_col)
    v = polarised_covariance(fit, n, sums)
    values, axes = np.linalg.eigh(v)
    values, axes, trace = values[::-1][:components], np.ascontiguousarray(axes[:, ::-1][:, :components]), float(np.trace(v))
    k = len(values)
    real = int((values > trace * d * np.finfo(np.float64).eps).sum())
    error = identity_error(fit, n, sums, axes[:, :real], values[:real])
    explained = [float(max(e, 0.0)) / trace if trace > 0 else None for e in values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches):
            y = centred(x, n, sums)
            if y.dtype != object and d * max(int(y.max()), -int(y.min())) ** 2 >= 1 << 63:
                y = y.astype(object)
            far = [s if s < 1 << 63 else None for s in (y * y).sum(axis=1).tolist()]
            w = np.full((len(x), k), np.nan)
            w[:, :real] = _whitened(y, n, axes[:, :real], values[:real])
            many = len(x)
            each = np.repeat(np.arange(many), k)
            yield pa.RecordBatch.from_pydict({
                "_id": batch.column("_id").take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                "n": pa.array(np.full(many * k, n, np.int64)), "deviation": pa.array(far, pa.int64()).take(pa.array(each)),
                "whitened": pa.array(w.ravel(), mask=np.isnan(w.ravel())), "explained": pa.array(explained * many, pa.float64()),
                "identity_error": pa.array([error] * (many * k), pa.float64())})

    return rows.mapInArrow(project, names).withColumnRenamed("_id", id_col)
