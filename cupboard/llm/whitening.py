"""Embedding whitening: centred covariance of the distinct vectors, leading components, projection of every row.

The vectors are integers (``floor(scale * c)``), so sums are exact: the table of distinct vectors is written once, one
pass adds its entries, a second multiplies entries centred on the rounded mean (which loses nothing, as the rest of
the mean is at most one half), and the result does not depend on the order of tasks. Tasks add their own rows and
send a ``d x d`` matrix each, row by row; the driver holds that one matrix, whose size depends on ``d`` alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cupboard.session import write_and_reload

from . import eigen
from .vectors import EXACT, matrix, of_usual_length, scaled, usable

RESULT = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
          "identity_error double")
_LARGEST = 10 ** 38 - 1


def _totals(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """Rows, sum of each entry, and its least and greatest value."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        least, most = np.full(d, np.iinfo(np.int64).max), np.full(d, np.iinfo(np.int64).min)
        for batch in batches:
            x = matrix(batch.column(0), d)
            if not len(x):
                continue
            n += len(x)
            high += (x >> 32).sum(axis=0)  # two halves, so that no sum overflows
            low += (x & 0xFFFFFFFF).sum(axis=0)
            least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            columns = [np.arange(d, dtype=np.int32), np.full(d, n), high, low, least, most]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "n", "high", "low", "least", "most"])

    parts = fit.select("x").mapInArrow(add, "i int, n long, high long, low long, least long, most long")
    total = F.sum(F.col("high").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low"))
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), total.alias("s"), F.min("least").alias("least"), F.max("most").alias("most"))
    got = sorted(rows.collect())  # d rows
    return got[0]["n"], [int(r["s"]) for r in got], np.array([r["least"] for r in got]), np.array([r["most"] for r in got])


def _products(fit: DataFrame, centre: np.ndarray, widest: int, n: int) -> np.ndarray:
    """Sum of ``(x - centre)(x - centre)'`` over all rows, in integers where 64 bits hold it, else in doubles."""
    d = len(centre)
    whole = widest * widest * n < 1 << 62
    kind, dtype = ("long", np.int64) if whole else ("double", np.float64)
    block = max(1, min(8192, EXACT // max(1, widest * widest))) if whole else 8192

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), dtype)
        for batch in batches:
            z = (matrix(batch.column(0), d) - centre).astype(np.float64)
            for at in range(0, len(z), block):
                part = z[at:at + block]
                total += (part.T @ part).astype(dtype)
        if total.any():
            yield rows(range(d), total)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for i, row in zip(batch.column(0).to_pylist(), values):
                held[i] = held[i] + row if i in held else row.copy()
        yield rows(sorted(held), np.array([held[i] for i in sorted(held)], dtype).reshape(len(held), d))

    def rows(at: Iterable[int], values: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * d), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), lists], names=["i", "row"])

    schema = f"i int, row array<{kind}>"
    out = np.zeros((d, d))
    for r in fit.select("x").mapInArrow(multiply, schema).repartition("i").mapInArrow(add, schema).collect():
        out[r["i"]] = r["row"]
    return out


def _projection(x: np.ndarray, centre: np.ndarray, rest: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return ((x - centre).astype(np.float64) - rest) @ axes.T


def _identity_error(fit: DataFrame, d: int, centre: np.ndarray, rest: np.ndarray, axes: np.ndarray) -> float:
    """Largest entry of the covariance of all whitened rows of the fit list minus the identity."""
    k = len(axes)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))  # the last row and column hold the sums and the number of rows
        for batch in batches:
            w = _projection(matrix(batch.column(0), d), centre, rest, axes)
            w = np.hstack([w, np.ones((len(w), 1))])
            total += w.T @ w
        at = np.indices(total.shape, np.int32).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["i", "j", "v"])

    parts = fit.select("x").mapInArrow(measure, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((k + 1, k + 1))
    for r in parts.collect():
        total[r["i"], r["j"]] = r["v"]
    mean = total[:k, k] / total[k, k]
    return float(np.abs(total[:k, :k] / total[k, k] - np.outer(mean, mean) - np.eye(k)).max())


def whitened(embeddings: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component.

    A row takes part if its ``embedding`` is neither NULL nor empty, holds finite numbers only, and has the length most
    distinct vectors have; others are left out. Every distinct vector counts once in the covariance, and every row,
    repeated ones and those without an id included, is projected. ``deviation`` is the exact sum of ``(n * x - S)^2``
    over the entries (NULL beyond 38 digits). Components whose eigenvalue is zero up to rounding are left out, so one
    distinct vector, or no rows, give no rows. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    vector = F.col("embedding")
    rows = embeddings.where(usable(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(vector, scale).alias("x"))
    fit, d = of_usual_length(write_and_reload(rows.select("x").distinct()))
    if not d:
        return spark.createDataFrame([], RESULT)
    n, sums, least, most = _totals(fit, d)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([(s - int(c) * n) / n for s, c in zip(sums, centre)])
    widest = max(max(int(b) - int(c), int(c) - int(a)) for a, b, c in zip(least, most, centre))
    covariance = _products(fit, centre, widest, n) / n - np.outer(rest, rest)
    values, axes = eigen.leading(covariance, components)
    if not len(values):
        return spark.createDataFrame([], RESULT)
    axes = axes / np.sqrt(values)[:, None]
    explained = values / np.trace(covariance)
    error = _identity_error(fit, d, centre, rest, axes)
    farthest = max(max(n * int(b) - s, s - n * int(a)) for a, b, s in zip(least, most, sums))
    whole = farthest * farthest * d < 1 << 63
    shift = np.array(sums, np.int64 if whole else object)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            x = matrix(batch.column(1), d)
            w = _projection(x, centre, rest, axes)
            far = ((n * (x if whole else x.astype(object)) - shift) ** 2).sum(axis=1)
            if whole:
                deviation = pa.array(np.repeat(far, k)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([v if v <= _LARGEST else None for v in far.tolist() for _ in range(k)], pa.decimal128(38, 0))
            m = len(x)
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                       pa.array(np.full(m * k, n)), deviation, pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    return rows.where(F.size("x") == d).mapInArrow(project, RESULT)
