"""Clustering against plain arithmetic in whole numbers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from incidentkit.llm import hadamard_clusters as hc, queries

LONG = 2**63 - 1


def brute(rows, k=16, rounds=3):
    fine = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in fine if i is not None)
    centres = [v for _, v in order[:k]]
    if not centres:
        return []

    def assigned():
        out = []
        for i, v in fine:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            out.append((i, v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        groups = {}
        for _, v, j, _ in assigned():
            groups.setdefault(j, []).append(v)
        for j, vs in groups.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    last = assigned()
    sums = {}
    for *_, j, d in last:
        sums[j] = sums.get(j, 0) + min(d, LONG)
    sums = {j: min(s, LONG) for j, s in sums.items()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, min(d, LONG), sums[j], min(sum(sums.values()), LONG), digest[j]) for i, _, j, d in last]


def vectors(seed, n, scale=0.4):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, scale) for _ in range(64)] for _ in range(9)]
    rows = [(i, [m + rng.gauss(0, 0.1) for m in rng.choice(middles)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(30)] + [(3, rows[3][1]), (3, rows[5][1]), (None, rows[2][1])]
    return rows + [(9001, None), (9002, [None] * 64), (9003, [float("nan")] * 64), (9004, [float("inf")] * 64), (9005, [0.5] * 63), (9006, []), (9007, [0.0] * 64), (9008, [-0.0] * 64)]


def answer(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    return sorted(map(tuple, hc.with_inertia(*hc.cluster(df)).collect()), key=str)


@pytest.mark.parametrize("rows", [vectors(1, 300), vectors(2, 12)[:9], vectors(4, 60, 4000.0), vectors(5, 30) + [(8001, [1e300] * 64), (8002, [-3e38, *[1e-300] * 63])]])
def test_equals_plain_arithmetic(spark, rows):
    assert answer(spark, rows) == sorted(brute(rows), key=str)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]
    assert answer(spark, rows) == sorted(brute(rows), key=str)
    rows = np.zeros((3, 64))
    assert hc.nearest(rows, [[1] * 64, [-1] * 64, [1] * 64])[0].tolist() == [0, 0, 0]


def test_transform_is_exact_and_coarse_to_fine():
    matrix = hc.transform_matrix()
    assert (matrix.T @ matrix == 64 * np.eye(64)).all()
    assert [int((np.diff(c) != 0).sum()) for c in matrix.T] == list(range(64))
    rng = np.random.default_rng(0)
    rows = rng.integers(-(2**18), 2**18, (500, 64)).astype(float)
    centres = rng.integers(-(2**18), 2**18, (7, 64)).tolist()
    number, distance = hc.nearest(rows, centres)
    plain = ((rows[:, None, :].astype(int) - np.array(centres)[None]) ** 2).sum(axis=2)
    assert (number == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found = hc.with_inertia(*hc.cluster(df))
    assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert hc.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))[1] == []


def test_query_covers_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op11_clusters(spark, "/root/testdata/sf0.001").collect())) == sorted(brute(rows))
