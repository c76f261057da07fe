"""Operator 12: embedding whitening with covariances found by polarisation.

1. Entries become whole numbers, x = floor(64 c) + 1,000,000, so that every
   sum below is exact. The fit list holds each distinct vector once.
2. One pass takes n and the sums S; a centred entry is y = n x - S, a whole
   number as well.
3. A second pass adds up only squares: of every y_i and of every y_i + y_j.
   Since (y_i + y_j)^2 = y_i^2 + y_j^2 + 2 y_i y_j, half the difference of the
   variances is the covariance. Squares are taken of 26-bit halves and carried
   as whole numbers of any size, so nothing is rounded before the last
   division by n^3.
4. The matrix, whose size depends on the dimensions alone, is solved by eigh on
   the driver; rows are projected where they lie.

What tasks send grows with the squared dimensions, not with the rows: one row
per dimension pair and task, added up by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.store import stored

SCALE, SHIFT = 64, 1_000_000  # x = floor(SCALE * c) + SHIFT
HALF = 26                     # bits of the lower half of a centred entry
ROWS = 512                    # rows whose squares are added in 64 bits: 2^(2 * 26 + 9) at most
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
LOW = 40                      # bits of the lower part of a sum on its way through Spark


def quantised(vec: Column) -> Column:
    """The vector as whole numbers; null if it is null, empty or holds null, NaN or infinite entries."""
    usable = (F.size(vec) > 0) & F.forall(vec, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return F.when(usable, F.transform(vec, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long")))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high, rows = [0] * dims, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, dims)
            rows += len(x)
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if rows:
            yield pa.RecordBatch.from_arrays([
                pa.array(range(dims), pa.int32()), _decimals(total), pa.array([rows] * dims, pa.int64()),
                pa.array(low), pa.array(high)], names=["dim", "total", "n", "low", "high"])
    return run


def _decimals(numbers: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in numbers], pa.decimal128(38, 0))


def _square_sums(z: np.ndarray, wide: bool) -> np.ndarray:
    """Exact sums of squares of each column, as Python whole numbers."""
    out = np.zeros(z.shape[1], object)
    for at in range(0, len(z), ROWS):
        part = z[at:at + ROWS]
        if not wide:
            out += np.einsum("rd,rd->d", part, part).astype(object)
            continue
        high, low = part >> HALF, part & ((1 << HALF) - 1)
        for shift, (a, b) in ((2 * HALF, (high, high)), (HALF + 1, (high, low)), (0, (low, low))):
            out += np.einsum("rd,rd->d", a, b).astype(object) << shift
    return out


def _squares(dims: int, n: int, total: np.ndarray, wide: bool):
    """Sums of squares of every centred dimension and of every sum of two."""
    i, j = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(i), object)
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch, dims) * n - total
                at = 0
                for a in range(dims):
                    z = y[:, a:].copy()
                    z[:, 1:] += y[:, a:a + 1]
                    sums[at:at + dims - a] += _square_sums(z, wide)
                    at += dims - a
        if any(sums):
            yield pa.RecordBatch.from_arrays([
                pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals([v >> LOW for v in sums]),
                pa.array([v & ((1 << LOW) - 1) for v in sums], pa.int64())], names=["i", "j", "high", "low"])
    return run


def covariance(fit: DataFrame, dims: int, n: int, total: list[int], wide: bool) -> list[list[Fraction]]:
    """The exact covariance matrix (divisor n) of the distinct vectors."""
    # a centred entry and a sum of two stay below 2^62 (checked by the caller), whatever n and the sums are
    rows = (fit.select("x").mapInArrow(_squares(dims, n, np.array(total, np.int64), wide), "i int, j int, high decimal(38,0), low long")
            .groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect())
    var = {(r["i"], r["j"]): (int(r["high"]) << LOW) + int(r["low"]) for r in rows}
    cube = n ** 3
    out = [[Fraction(0)] * dims for _ in range(dims)]
    for i in range(dims):
        out[i][i] = Fraction(var.get((i, i), 0), cube)
        for j in range(i + 1, dims):
            twice = var.get((i, j), 0) - var.get((i, i), 0) - var.get((j, j), 0)
            out[i][j] = out[j][i] = Fraction(twice, 2 * cube)
    return out


def _projected(dims: int, n: int, total: np.ndarray, axes: np.ndarray, wide: bool, keep: tuple[str, ...], schema: pa.Schema):
    """Rows with the sum of squared centred entries and the whitened vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch, dims) * n - total
            white = (y / float(n)) @ axes
            deviation = [0] * len(y)
            for at in range(0, dims, ROWS):
                part = _square_sums(np.ascontiguousarray(y[:, at:at + ROWS].T), wide)
                deviation = [a + b for a, b in zip(deviation, part.tolist(), strict=True)]
            values = pa.array(white.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * axes.shape[1]), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _decimals(deviation), lists], schema=schema)
    return run


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, sums of the whitened entries (j = -1) and of their products."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        w = batch.column("white").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        part = np.column_stack([w.sum(axis=0), w.T @ w])
        total = part if total is None else total + part
    if total is not None and total.size:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel() - 1, pa.int32()), pa.array(total.ravel())],
                                         names=["i", "j", "s"])


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``n`` is the number of distinct vectors, ``deviation`` the exact sum of
    (n x - S)^2 over the dimensions as a decimal (null beyond 38 digits can't
    arise below 2^62 per entry and 10,000 dimensions), ``whitened`` the
    centred row on the component over the root of its eigenvalue,
    ``explained`` the eigenvalue's share of the trace, and ``identity_error``
    the largest absolute entry of the whitened covariance minus the identity,
    over the fit list.

    Nulls and edges: rows whose vector is null, empty or holds null or
    non-finite entries are left out; repeated rows count once in the fit and
    give repeated results; rows without an id stay; an eigenvalue that isn't
    above the rounding of the largest one (10^-13 of it times the dimensions,
    as for constant or fewer vectors than dimensions) gives a null whitened
    value and doesn't count in identity_error (0 if all are so); explained is
    0 for equal vectors; an empty table gives an empty result; other columns
    are ignored. Vectors of different lengths raise ValueError, entries so far
    apart that a centred one passes 2^50 raise OverflowError.
    """
    spark = vectors.sparkSession
    src = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vec_col)).alias("x"))
           .filter(F.col("x").isNotNull()))
    fit = stored(src.select("x").distinct(), "whiten-fit")
    sizes = [r[0] for r in fit.select(F.size("x")).distinct().limit(2).collect()]
    if not sizes:
        return spark.createDataFrame([], RESULT)
    if len(sizes) > 1:
        raise ValueError("the vectors have different lengths")
    dims = sizes[0]
    rows = (fit.mapInArrow(_sums(dims), "dim int, total decimal(38,0), n long, low long, high long").groupBy("dim")
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
            .orderBy("dim").collect())
    n, total = rows[0]["n"], [int(r["total"]) for r in rows]
    reach = max(max(n * r["high"] - int(r["total"]), int(r["total"]) - n * r["low"]) for r in rows)
    if reach >> 50 or max(map(abs, total)) >> 62 or n * max(max(abs(r["low"]), abs(r["high"])) for r in rows) >> 62:
        raise OverflowError("the entries are too far apart for exact sums of squares")
    wide = 2 * reach >> HALF > 0

    cov = covariance(fit, dims, n, total, wide)
    matrix = np.array([[float(v) for v in row] for row in cov])
    value, axis = np.linalg.eigh(matrix)
    value, axis = value[::-1], axis[:, ::-1]
    shown = min(components, dims)
    sound = [bool(value[c] > value[0] * dims * 1e-13) for c in range(shown)]
    axes = np.column_stack([axis[:, c] / np.sqrt(value[c]) if ok else np.zeros(dims) for c, ok in enumerate(sound)])
    trace = float(sum(cov[c][c] for c in range(dims)))
    explained = [float(value[c]) / trace if ok else 0.0 for c, ok in enumerate(sound)]

    out = pa.schema([("deviation", pa.decimal128(38, 0)), ("white", pa.list_(pa.float64()))])
    project = _projected(dims, n, np.array(total, np.int64), axes, wide, (), out)
    sums = (fit.mapInArrow(project, "deviation decimal(38,0), white array<double>").select("white")
            .mapInArrow(_products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect())
    first = {r["i"]: r["s"] / n for r in sums if r["j"] < 0}
    error = max([abs(r["s"] / n - first[r["i"]] * first[r["j"]] - (r["i"] == r["j"])) for r in sums
                 if r["j"] >= 0 and sound[r["i"]] and sound[r["j"]]], default=0.0)

    keyed = pa.schema([("vec_id", pa.int64()), *out])
    rows_out = src.mapInArrow(_projected(dims, n, np.array(total, np.int64), axes, wide, ("vec_id",), keyed),
                              "vec_id long, deviation decimal(38,0), white array<double>")
    return (rows_out.select("vec_id", "deviation", F.posexplode("white").alias("c", "w"))
            .select("vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    F.when(F.element_at(F.array(*map(F.lit, sound)), F.col("c") + 1), F.col("w")).alias("whitened"),
                    F.element_at(F.array(*map(F.lit, explained)), F.col("c") + 1).alias("explained"),
                    F.lit(error).alias("identity_error")))
