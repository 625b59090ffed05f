"""K-means for many numbers of clusters at a time.

All sets of centres are held together, and every round is one scan: a task
finds each row's nearest centre of every set by one matrix product and adds up
its rows per (k, cluster). Only these sums are shuffled. Costs and variance
ratios follow from the sums of the last scan, so no set needs a fit of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from incidentkit.operators.rows import stable_hash

#: Rows whose distances to all centres are held at a time.
ROWS = 512


@dataclass
class Family:
    """Centres by number of clusters, and what the last scan found: per k the rows, spreads and costs."""

    centers: dict[int, np.ndarray]
    scores: list[tuple[int, int, int, float, float, float]]


def _batches(batches, dims: int):
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.iloc[at : at + ROWS]
            yield part, np.stack(part["v"].to_numpy()).astype(np.float64).reshape(len(part), dims)


def _nearest(rows: np.ndarray, centers: dict[int, np.ndarray]):
    """(k, number of each row's nearest centre, squared distance); ties go to the smaller number."""
    every = np.concatenate(list(centers.values()))
    far = (every * every).sum(axis=1) - 2 * rows @ every.T
    own, at = (rows * rows).sum(axis=1), 0
    for k, c in centers.items():
        part = far[:, at : at + len(c)]
        at += len(c)
        number = part.argmin(axis=1)
        yield k, number, np.maximum(part[np.arange(len(rows)), number] + own, 0.0)


def _scan(vectors: DataFrame, centers: dict[int, np.ndarray], dims: int):
    """Rows of (k, cluster, n, sums, squares, cost); at most the sum of all ks."""

    def run(batches):
        held = {k: [np.zeros(len(c)), np.zeros((len(c), dims)), np.zeros(len(c)), np.zeros(len(c))] for k, c in centers.items()}
        for _, rows in _batches(batches, dims):
            squares = (rows * rows).sum(axis=1)
            for k, number, cost in _nearest(rows, centers):
                n, sums, own, costs = held[k]
                order = np.argsort(number, kind="stable")
                first = np.flatnonzero(np.diff(number[order], prepend=-1))
                which = number[order][first]
                n[which] += np.diff(np.append(first, len(number)))
                sums[which] += np.add.reduceat(rows[order], first, axis=0)
                own[which] += np.add.reduceat(squares[order], first)
                costs[which] += np.add.reduceat(cost[order], first)
        for k, (n, sums, own, costs) in held.items():
            used = np.flatnonzero(n)
            if not len(used):
                continue
            yield pd.DataFrame({"k": np.full(len(used), k, "int32"), "cluster": used.astype("int32"), "n": n[used].astype("int64"), "sums": list(sums[used]), "squares": own[used], "cost": costs[used]})

    parts = vectors.mapInPandas(run, "k int, cluster int, n bigint, sums array<double>, squares double, cost double")
    added = parts.groupBy("k", "cluster").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"), F.sum("squares").alias("squares"), F.sum("cost").alias("cost")
    )
    return added.collect()


def fit_many(df: DataFrame, ks: Sequence[int], key: str, vector: str, max_iter: int = 20, tolerance: float = 1e-9) -> Family:
    """K-means for every k of ``ks``.

    The centres of k start as the k rows with the smallest hashes of their key,
    so that the sets are nested and repeat. A centre without rows stays. Sets
    whose centres no longer move are left out of the next scan. The driver
    holds sum(ks) centres.
    """
    vectors = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    starts = df.where(F.col(vector).isNotNull()).orderBy(stable_hash(F.col(key)), key).limit(max(ks)).select(F.col(vector).cast("array<double>").alias("v")).collect()
    if not starts:
        return Family({}, [])
    first = np.array([r.v for r in starts])
    dims = first.shape[1]
    centers = {k: first[:k].copy() for k in sorted(set(ks)) if k <= len(first)}
    moving = dict(centers)
    for _ in range(max_iter):
        if not moving:
            break
        moved = {k: c.copy() for k, c in moving.items()}
        for r in _scan(vectors, moving, dims):
            moved[r.k][r.cluster] = np.array(r.sums) / r.n
        moving = {k: c for k, c in moved.items() if np.abs(c - centers[k]).max() > tolerance}
        centers.update(moved)
    found: dict[int, list] = {}
    for r in _scan(vectors, centers, dims):
        found.setdefault(r.k, []).append(r)
    scores = []
    for k, rows in sorted(found.items()):
        n = sum(r.n for r in rows)
        whole = np.sum([r.sums for r in rows], axis=0)
        spread = sum(r.squares for r in rows) - float(whole @ whole) / n
        within = sum(r.squares - float(np.dot(r.sums, r.sums)) / r.n for r in rows)
        scores.append((k, len(rows), n, spread - within, within, sum(r.cost for r in rows)))
    return Family(centers, scores)


def elbow(df: DataFrame, ks: Sequence[int], key: str, vector: str, max_iter: int = 20) -> DataFrame:
    """(k, cost): squared distances to the nearest centre."""
    family = fit_many(df, ks, key, vector, max_iter)
    return df.sparkSession.createDataFrame([(k, float(cost)) for k, *_, cost in family.scores], "k int, cost double")


def calinski_harabasz(df: DataFrame, ks: Sequence[int], key: str, vector: str, max_iter: int = 20) -> DataFrame:
    """(k, clusters, rows, score): variance ratio of every number of clusters; clusters without rows do not count."""
    family = fit_many(df, ks, key, vector, max_iter)
    ratio = lambda c, n, between, within: float((between / (c - 1)) / (within / (n - c))) if 1 < c < n and within > 0 else None
    rows = [(k, c, n, ratio(c, n, between, within)) for k, c, n, between, within, _ in family.scores]
    return df.sparkSession.createDataFrame(rows, "k int, clusters int, rows long, score double")


def assign(df: DataFrame, centers: np.ndarray, vector: str, out: str = "cluster") -> DataFrame:
    """Rows with the number of their nearest centre; null where there is no vector. The centres travel as one literal."""
    held = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    v = F.col(vector).cast("array<double>")
    far = F.transform(held, lambda c: F.aggregate(F.zip_with(c, v, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return df.withColumn(out, F.when(v.isNotNull(), F.array_position(far, F.array_min(far)) - 1).cast("int"))
