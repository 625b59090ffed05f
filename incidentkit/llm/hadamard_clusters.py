"""Centroid clustering of whole-number vectors by a progressive Walsh-Hadamard search.

Vectors and centroids go through the same exact integer transform. Its rows are
orthogonal and of equal length, so the squared differences of all coefficients
add up to DIM times the squared distance, and those of the first few never add
up to more. The coefficients are taken coarse to fine, by their number of sign
changes: after each level the centroid that is nearest so far is finished, and
every centroid whose sum already exceeds that is strictly worse and leaves. Who
is left is finished over all coefficients, so the nearest centroid and its
distance are exact; ties go to the smaller number.

A round is one scan: tasks add up their vectors per centroid and only those
sums, DIM + 1 amounts per centroid and task, are shuffled. Vectors are
read anew in every round and never moved.

Cases: vectors that are null, hold a null or a component that is not finite, or
do not have DIM components take no part. A row without an id takes part but
starts no centroid; its id stays null. Repeated rows count each. Equal hashes
of starting vectors go by the vector. With fewer vectors than centroids every
vector starts one; an empty table gives no rows. Components of any size are
exact: beyond LARGE whole numbers of any length are used, and a distance or an
inertia that is no longer a long is given as the largest long. Only id and
vector are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from incidentkit.session import checkpoint

DIM = 64
#: Number of coefficients after which centroids are compared.
LEVELS = (4, 12, 28, DIM)
#: Up to this size of a component, all sums are whole numbers that a double holds exactly.
LARGE = 1 << 18
LONG = (1 << 63) - 1
#: Bits of a digit in which sums travel.
BASE = 32
#: Vectors that are compared at a time.
ROWS = 8192


def transform_matrix(dim: int = DIM) -> np.ndarray:
    """Walsh-Hadamard matrix with columns in order of their sign changes; ``dim`` is a power of two."""
    held = np.ones((1, 1))
    while len(held) < dim:
        held = np.block([[held, held], [held, -held]])
    changes = (np.diff(held, axis=0) != 0).sum(axis=0)
    return held[:, np.argsort(changes, kind="stable")]


def whole_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and floor(64 x) of their components."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    fits = np.flatnonzero(sizes == DIM)
    flat = column.take(pa.array(fits)).flatten()
    rows = np.asarray(flat.fill_null(np.nan), dtype=np.float64).reshape(-1, DIM)
    fine = np.isfinite(rows).all(axis=1)
    scaled = rows[fine]
    if scaled.size and np.abs(scaled).max() > LARGE / 64:
        # A double of this size times 64 may be beyond a double; whole numbers of any length are not.
        exact = np.empty(scaled.shape, dtype=object)
        for at, x in np.ndenumerate(scaled):
            above, below = float(x).as_integer_ratio()
            exact[at] = 64 * above // below
        return fits[fine], exact
    return fits[fine], np.floor(64 * scaled)


def nearest(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid and the squared distance."""
    large = rows.dtype == object or any(abs(x) > LARGE for c in centroids for x in c)
    kind, matrix = np.float64, transform_matrix()
    if large:
        kind, matrix = object, matrix.astype(np.int64).astype(object)
        rows = rows if rows.dtype == object else rows.astype(np.int64).astype(object)
    points, centres = rows @ matrix, np.array(centroids, dtype=kind) @ matrix
    sums = np.zeros((len(rows), len(centres)), dtype=kind)
    alive = np.ones(sums.shape, dtype=bool)
    every = np.arange(len(rows))
    done = 0
    for level in LEVELS:
        i, j = np.nonzero(alive)
        apart = points[i, done:level] - centres[j, done:level]
        sums[i, j] += (apart * apart).sum(axis=1)
        done = level
        if level < DIM:
            ahead = _smallest(sums, alive)
            rest = points[:, done:] - centres[ahead, done:]
            bound = sums[every, ahead] + (rest * rest).sum(axis=1)
            alive &= sums <= bound[:, None]
    best = _smallest(sums, alive)
    return best, sums[every, best] // DIM


def _smallest(sums: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Place of the smallest sum among those that are left, the first of equal ones."""
    if sums.dtype != object:
        return np.where(alive, sums, np.inf).argmin(axis=1)
    return np.array([min(np.flatnonzero(a), key=lambda j: s[j]) for s, a in zip(sums, alive, strict=True)], dtype=np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]):
    """(ids, rows, number, distance) of bounded numbers of vectors that take part."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            places, rows = whole_rows(part.column(1))
            if len(places):
                yield part.column(0).take(pa.array(places)), rows, *nearest(rows, centroids)


def _sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sum of components of every centroid that has any."""

    def run(batches):
        counts, sums = [0] * len(centroids), [[0] * DIM for _ in centroids]
        for _, rows, number, _ in _pieces(batches, centroids):
            for j in np.unique(number):
                mine = rows[number == j]
                counts[j] += len(mine)
                sums[j] = [a + int(b) for a, b in zip(sums[j], mine.sum(axis=0), strict=True)]
        # Amounts of any length go as digits of BASE, each of which adds up in a long.
        held = [(j, d, i, x) for j, n in enumerate(counts) if n for d, v in enumerate([*sums[j], n]) for i, x in enumerate(_digits(v))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True) if held else [[]] * 4, kinds, strict=True)], names=["cluster", "place", "digit", "amount"])

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    parts = vectors.mapInArrow(run, "cluster int, place int, digit int, amount long")
    found: dict[int, list[int]] = {}
    # At most DIM + 1 amounts per centroid reach the driver.
    for r in parts.groupBy("cluster", "place", "digit").agg(F.sum("amount").alias("amount")).collect():
        found.setdefault(r.cluster, [0] * (DIM + 1))[r.place] += r.amount << (BASE * r.digit)
    return {j: (v[DIM], v[:DIM]) for j, v in found.items()}


def _digits(value: int) -> Iterator[int]:
    sign, rest = (-1, -value) if value < 0 else (1, value)
    while True:
        yield sign * (rest & ((1 << BASE) - 1))
        rest >>= BASE
        if not rest:
            return


def _starts(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest hash of salt and id, in that order."""
    key, value = vectors.columns
    v = F.col(value)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    order = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    rows = vectors.where((F.size(v) == DIM) & fine & F.col(key).isNotNull()).select(order.alias("h"), v.alias("v")).orderBy("h", "v").limit(k).collect()
    starts = []
    for row in rows:
        whole = (float(x).as_integer_ratio() for x in row.v)
        starts.append([64 * above // below for above, below in whole])
    return starts


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, salt: str = "1:", key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that takes part, in the shared folder, and the centroids.

    ``rounds`` times the vectors are assigned and the centroids replaced by the
    floor of their mean; then the vectors are assigned once more. The driver
    holds k centroids and nothing else.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    centroids = _starts(rows, k, salt)
    if not centroids:
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    for _ in range(rounds):
        for j, (n, sums) in _sums(rows, centroids).items():
            centroids[j] = [s // n for s in sums]

    def run(batches):
        for ids, _, number, distance in _pieces(batches, centroids):
            far = pa.array([min(int(d), LONG) for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), far], names=["vec_id", "cluster", "distance"])

    return checkpoint(rows.mapInArrow(run, "vec_id long, cluster int, distance long")), centroids


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the hash of the centroid's components."""
    spark = found.sparkSession
    fits: Column = F.least(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)"))
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(fits.alias("total")).collect()}  # one row per centroid
    whole = min(sum(sums.values()), LONG)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    held = spark.createDataFrame([(j, n, whole, digest[j]) for j, n in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(held), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
