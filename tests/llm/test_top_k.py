"""Top-k search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from incidentkit.llm import kd_topk, queries
from incidentkit.llm.common import table


def brute(rows, is_query, k=20):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in fine:
        if is_query(i):
            asked[i] = min(asked.get(i, v), v, key=lambda w: (len(w), w))
    out = []
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors(seed, n, dim):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(11, rows[3][1]), (20, [0.5] * dim), (None, [1.0] * dim), (5000, None), (5001, [None] * dim), (5020, [float("nan")] * dim), (5040, [float("inf")] * dim), (5060, [0.1, 0.2]), (5061, [0.1, 0.3]), (5080, [])]
    return rows


@pytest.mark.parametrize(("shard", "block", "leaf"), [(8192, 1024, 128), (60, 7, 8)])
def test_equals_brute_force(spark, monkeypatch, shard, block, leaf):
    monkeypatch.setattr(kd_topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(kd_topk, "QUERY_ROWS", block)
    monkeypatch.setattr(kd_topk, "LEAF_ROWS", leaf)
    rows = vectors(5, 400, 6)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = kd_topk.top_k(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0)


def test_large_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**24 for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = kd_topk.top_k(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0)


def test_query_and_empty_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, queries.op3_top_k(spark, "/root/testdata/sf0.001").collect())) == brute(rows, lambda i: i % 20 == 0)
    assert kd_topk.top_k(df.limit(0), F.lit(True)).count() == 0
