"""Least squares for many series at once, from sums of products.

Spark forms the products of the design columns and sums them per series, or as
running sums per forecast origin. What is left per row is one k by k solve.
Every model of a grid uses a sub-matrix of the same sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def _products(columns: Sequence[str]) -> Column:
    return F.array(
        *[F.col(a) * F.col(b) for i, a in enumerate(columns) for b in columns[i:]]
    )


def product_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, gram): upper triangle of the column products, summed per series."""
    sums = (
        df.select(*keys, F.posexplode(_products(columns)).alias("_cell", "_p"))
        .groupBy(*keys, "_cell")
        .agg(F.sum("_p").alias("_p"))
    )
    return _collect_cells(sums, keys)


def running_product_sums(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    keep: Column,
    steps: int = 0,
) -> DataFrame:
    """(keys, ts, gram) with the sums over all rows before ``ts``, for the rows to keep.

    ``keep`` marks the last rows of each series: everything before them is
    summed once, only the kept rows go through the window.
    """
    long = df.select(*keys, ts, keep.alias("_keep"), F.posexplode(_products(columns)).alias("_cell", "_p"))
    base = long.where(~F.col("_keep")).groupBy(*keys, "_cell").agg(F.sum("_p").alias("_base"))
    before = Window.partitionBy(*keys, "_cell").orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    late = long.where("_keep").withColumn("_sofar", F.coalesce(F.sum("_p").over(before), F.lit(0.0)))
    total = late.join(base, [*keys, "_cell"], "left").withColumn(
        "_p", F.coalesce("_base", F.lit(0.0)) + F.col("_sofar")
    )
    return _collect_cells(total.select(*keys, ts, "_cell", "_p"), [*keys, ts])


def _collect_cells(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    # One entry per pair of design columns: a fixed number.
    cells = F.array_sort(F.collect_list(F.struct("_cell", "_p")))
    return sums.groupBy(*keys).agg(F.transform(cells, lambda c: c["_p"]).alias("gram"))


def square(grams: pd.Series, size: int) -> np.ndarray:
    """Stack of symmetric matrices out of upper triangles."""
    flat = np.stack(grams.to_numpy()).astype(float)
    out = np.zeros((len(flat), size, size))
    i, j = np.triu_indices(size)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def solve(
    gram: np.ndarray, target: int, used: Sequence[int], minimum_norm: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residual sum of squares and inverse diagonal per matrix.

    Columns are scaled to length one first; a singular system gives nan, or the
    shortest of its solutions.
    """
    yy = gram[:, target, target]
    if not used:
        return np.zeros((len(gram), 0)), yy, np.zeros((len(gram), 0))
    used = list(used)
    a, b = gram[:, used][:, :, used], gram[:, used, target]
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 0))
    safe = np.where(scale > 0, scale, 1.0)
    unit = a / safe[:, :, None] / safe[:, None, :]
    inverses = np.full(unit.shape, np.nan)
    finite = np.isfinite(unit).all(axis=(1, 2))
    full = finite.copy()
    full[finite] = np.linalg.matrix_rank(unit[finite], tol=1e-10) == len(used) if finite.any() else False
    if full.any():
        inverses[full] = np.linalg.inv(unit[full])
    rest = finite & ~full
    if minimum_norm and rest.any():
        inverses[rest] = np.linalg.pinv(unit[rest], rcond=1e-10, hermitian=True)
    beta = np.einsum("nij,nj->ni", inverses, b / safe) / safe
    inverse = np.einsum("nii->ni", inverses) / safe**2
    return beta, yy - np.einsum("ni,ni->n", beta, b), inverse
