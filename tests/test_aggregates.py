import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentkit.operators import aggregates as A, joins as J, rows as R, windows as W
from incidentkit.operators.ranking import exact_quantiles, global_rank


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1291])
def test_quantiles_of_every_size(spark, size):
    rng = np.random.default_rng(size)
    values = np.concatenate([rng.normal(size=size), np.repeat(0.5, size // 3)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = exact_quantiles(df, "v", probs).first().quantiles
    assert np.allclose(got, np.quantile(values, probs))


def test_quantiles_with_tight_brackets_and_a_hot_group(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in rng.lognormal(size=20000)] + [("cold", float(v)) for v in rng.integers(0, 5, 50)]
    df = spark.createDataFrame(rows, "k string, v double")
    for accuracy in (100, 5000):
        got = {r.k: r.quantiles for r in exact_quantiles(df, "v", [0.25, 0.5, 0.99], ["k"], accuracy).collect()}
        for key in ("hot", "cold"):
            assert np.allclose(got[key], np.quantile([v for k, v in rows if k == key], [0.25, 0.5, 0.99]))


def test_global_rank(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    assert global_rank(df, F.col("x").desc()).where("rank <> 5000 - x").count() == 0


def test_sample_sizes(spark):
    df = spark.range(1000)
    assert R.sample_n(df, 100, "id", 1).count() == 100
    assert R.sample_n(df, 5000, "id", 1).count() == 1000
    a, b = R.sample_n(df, 50, "id", 1), R.sample_n(df.repartition(7), 50, "id", 1)
    assert {r.id for r in a.collect()} == {r.id for r in b.collect()}
    train, held = W.split_random(df, 0.25, "id")
    assert train.count() + held.count() == 1000 and 180 < held.count() < 320


def test_backlog_cases(spark):
    rows = [(202001, 202001), (202001, 202003), (202002, 203001), (200001, 202002), (202003, 202001), (202012, 203001)]
    df = spark.createDataFrame(rows, "opened bigint, closed bigint")
    got = {r.month: r.open for r in J.open_backlog(df, "opened", "closed", 202001, 202004).collect()}
    want = {m: sum(o <= m <= c for o, c in rows) for m in (202001, 202002, 202003, 202004)}
    assert got == want


def test_difference_and_back(spark):
    df = spark.createDataFrame([("a", i, float(i * i % 17)) for i in range(40)], "series_id string, ts int, y double")
    back = W.undo_difference(W.difference(df, 12).withColumnRenamed("y", "yhat"), df, 12)
    assert back.join(df, ["series_id", "ts"]).where("yhat <> y").count() == 0 and back.count() == 28


def test_undo_difference_beyond_history(spark):
    history = spark.createDataFrame([("a", i, float(i)) for i in range(12)], "series_id string, ts int, y double")
    ahead = spark.createDataFrame([("a", 12, 1.0), ("a", 13, 2.0)], "series_id string, ts int, yhat double")
    got = {r.ts: r.yhat for r in W.undo_difference(ahead, history, 12).collect()}
    assert got == {12: 1.0, 13: 3.0}


def test_first_claim_prefers_phase_then_order(spark):
    df = spark.createDataFrame([(1, 10, 2, 1), (1, 11, 1, 2), (1, 12, 1, 1), (2, 13, 5, 2)], "child int, parent int, row_no int, phase int")
    got = {r.child: r.parent for r in J.first_claim(df, "child", ["row_no"], "phase").collect()}
    assert got == {1: 12, 2: 13}


def test_keep_repeated_counts_only_marked_rows(spark):
    df = spark.createDataFrame([("p", None), ("p", 1), ("q", None), ("q", None), ("q", 2)], "level2 string, linked int")
    got = A.keep_repeated(df, "level2", 2, F.col("linked").isNull())
    assert {r.level2 for r in got.collect()} == {"q"} and got.count() == 3


def test_histogram_of_one_value(spark):
    assert [tuple(r) for r in A.histogram(spark.range(3).selectExpr("5 AS v"), "v", 4).collect()] == [(0, 5.0, 3)]


def test_quantiles_by_rounds(spark, monkeypatch):
    """With a tiny limit every bracket is narrowed in rounds; constants and heavy values end them."""
    from incidentkit.operators import ranking

    rng = np.random.default_rng(3)
    rows = [("even", float(v)) for v in rng.normal(size=6000)] + [("same", 7.0)] * 500 + [("heavy", float(v)) for v in np.concatenate([np.full(4000, 1.5), rng.normal(1.5, 1e-3, 4000)])]
    df = spark.createDataFrame(rows, "k string, v double")
    monkeypatch.setattr(ranking, "SORTED", 20)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.k: r.quantiles for r in exact_quantiles(df, "v", probs, ["k"], accuracy=40).collect()}
    for key in ("even", "same", "heavy"):
        assert np.allclose(got[key], np.quantile([v for k, v in rows if k == key], probs))
    whole = exact_quantiles(df.select("v"), "v", probs, accuracy=40).first().quantiles
    assert np.allclose(whole, np.quantile([v for _, v in rows], probs))


def test_sample_by_rounds(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 1500).alias("id"), F.col("id").alias("row"))
    want = {r.row for r in R.sample_n(df, 700, "id", 1).collect()}
    monkeypatch.setattr(R, "RANKED", 0)
    got = R.sample_n(df, 700, "id", 1).collect()
    assert len(got) == 700 == len(want) and {r.id for r in got} == {r.id for r in R.sample_n(df.repartition(5), 700, "id", 1).collect()}
    assert R.sample_n(df, 0, "id", 1).count() == 0 and R.sample_n(df.limit(0), 5, "id", 1).count() == 0


def test_chi2_equals_the_whole_grid(spark):
    from incidentkit.operators.features import chi2_terms

    rng = np.random.default_rng(6)
    labels = [(i, "abcd"[min(3, int(rng.integers(0, 5)))]) for i in range(120)] + [(500, "none")]
    weights = [(i, f"w{rng.integers(0, 30)}" + (" x" if rng.random() < 0.4 else ""), float(rng.random())) for i, _ in labels[:-1] for _ in range(3)]
    weights = list({(d, t): (d, t, w) for d, t, w in weights}.values())
    w = spark.createDataFrame(weights, "doc int, term string, weight double")
    l = spark.createDataFrame(labels, "doc int, label string")
    got = {(r.label, r.words, r.rank): (r.term, r.chi2) for r in chi2_terms(w, l, "doc", "label", 4, 3).collect()}
    of, observed, total = dict(labels), {}, {}
    for d, t, x in weights:
        observed[of[d], t] = observed.get((of[d], t), 0) + x
        total[t] = total.get(t, 0) + x
    want = {}
    for c in set(of.values()):
        share = sum(v == c for v in of.values()) / len(of)
        for words, most in ((1, 4), (2, 3)):
            terms = [t for t in total if len(t.split()) == words]
            score = lambda t: (observed.get((c, t), 0) - share * total[t]) ** 2 / (share * (1 - share) * total[t])  # noqa: B023, E731
            for rank, t in enumerate(sorted(terms, key=lambda t: (-round(score(t), 9), t))[:most], 1):
                want[c, words, rank] = score(t)
    assert got.keys() == want.keys() and all(np.isclose(got[k][1], want[k]) for k in want)
