"""Principal components and whitening of vectors that are spread over a cluster.

Covariance is a sum over rows: each task adds up centred outer products of its Arrow batches and hands on one
row of the matrix per dimension; the rows of ``FAN`` tasks are added before the rest.  Only the matrix (dimensions squared)
reaches the driver, for a symmetric eigenproblem; the fitted projection is a small table that can be
stored, read and applied to any rows.

Defined results: rows with a null vector, or one that holds a null or NaN, are left out of a fit and project to null; vectors of
another length raise; fewer than two rows have no covariance and raise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks whose partial sums are added first.
FAN = 64
_PART = pa.schema([("i", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.float64()))])


def _matrix(column) -> np.ndarray:
    """Complete vectors of an Arrow list column as rows."""
    rows = [v for v in column.to_pylist() if v is not None and None not in v]
    if len({len(v) for v in rows}) > 1:
        raise ValueError("vectors differ in length")
    x = np.array(rows, dtype=np.float64)
    return x[~np.isnan(x).any(axis=1)] if len(rows) else x.reshape(0, 0)


def _sums(centre: np.ndarray | None):
    """Without a centre the sum of the rows (``i`` = 0), else the rows of the sum of their centred outer products."""

    def run(batches):
        total, n = None, 0
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            n += len(x)
            own = x.sum(axis=0)[None, :] if centre is None else (x - centre).T @ (x - centre)
            total = own if total is None else total + own
        if total is not None:
            part = TaskContext.get().partitionId() // FAN
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([part] * len(total), pa.int64()), pa.array([n] * len(total), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], schema=_PART)

    return run


def _add(table: pa.Table) -> pa.Table:
    rows = table.column("v").to_pylist()
    return pa.table([pa.array([table.column("i")[0].as_py()], pa.int32()), pa.array([table.column("part")[0].as_py()], pa.int64()), pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([np.sum(np.array(rows), axis=0)], pa.list_(pa.float64()))], schema=_PART)


def _total(vectors: DataFrame, centre: np.ndarray | None) -> tuple[int, np.ndarray]:
    kind = "i int, part long, n long, v array<double>"
    parts = vectors.mapInArrow(_sums(centre), kind).groupBy("i", "part").applyInArrow(_add, kind)
    rows = sorted(parts.withColumn("part", F.lit(0).cast("long")).groupBy("i", "part").applyInArrow(_add, kind).collect(), key=lambda r: r.i)
    return (rows[0].n, np.array([r.v for r in rows])) if rows else (0, np.zeros((0, 0)))


def covariance(df: DataFrame, vector: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """``(n, mean, covariance)`` with divisor ``n - 1``."""
    vectors = df.select(F.col(vector).cast("array<double>").alias("v"))
    n, sums = _total(vectors, None)
    if n < 2:
        raise ValueError(f"{n} complete rows have no covariance")
    mean = sums[0] / n
    _, products = _total(vectors, mean)
    return n, mean, products / (n - 1)


def covariance_table(df: DataFrame, vector: str = "features") -> DataFrame:
    """``i, j, cov``: the covariance matrix as rows."""
    _, _, cov = covariance(df, vector)
    rows = [(i, j, float(v)) for i, row in enumerate(cov) for j, v in enumerate(row)]
    return df.sparkSession.createDataFrame(rows, "i int, j int, cov double")


def _turned(vectors: np.ndarray) -> np.ndarray:
    """Components (columns) with the sign that makes their largest entry positive."""
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def fit_projection(df: DataFrame, vector: str = "features", dim: int | None = None, power: float = 0.5, floor: float = 0.0, centre: bool = True) -> DataFrame:
    """``k, variance, mean, weights``: the ``dim`` leading components, the largest first, each divided by ``variance ** power``.

    ``power`` 0.5 whitens, 0 only rotates.  Variances below ``floor`` times the largest count as that much.
    """
    _, mean, cov = covariance(df, vector)
    values, vectors = np.linalg.eigh(cov)
    values = np.maximum(values, max(floor * values.max(), np.finfo(np.float64).tiny))
    order = np.argsort(-values, kind="stable")[:dim]
    values, vectors = values[order], _turned(vectors[:, order])
    weights = vectors / values**power
    shift = mean if centre else np.zeros_like(mean)
    rows = [(k, float(values[k]), shift.tolist(), weights[:, k].tolist()) for k in range(len(values))]
    return df.sparkSession.createDataFrame(rows, "k int, variance double, mean array<double>, weights array<double>")


def project(vector: Column, model: DataFrame) -> Column:
    """The projected vector as a column; ``model`` is a table of ``fit_projection`` (a row per component)."""
    rows = sorted(model.collect(), key=lambda r: r.k)
    mean, weights = np.array(rows[0].mean), np.array([r.weights for r in rows]).T

    @F.pandas_udf("array<double>")
    def apply(vectors: pd.Series) -> pd.Series:
        whole = np.array([v is not None and not pd.isna(v).any() for v in vectors], dtype=bool)
        out: list = [None] * len(vectors)
        if whole.any():
            found = (np.stack(list(vectors[whole])).astype(np.float64) - mean) @ weights
            for k, row in zip(np.flatnonzero(whole).tolist(), found, strict=True):
                out[k] = row
        return pd.Series(out)

    return apply(vector)


def whiten(df: DataFrame, vector: str = "features") -> DataFrame:
    """``df`` with ``vector`` replaced by all its principal components at unit variance."""
    return df.withColumn(vector, project(F.col(vector), fit_projection(df, vector)))
