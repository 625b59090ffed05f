"""Text features whose own terms are counted before a shuffle."""

import random
from collections import Counter

import numpy as np
import pytest

from incidentkit.operators import features as FE


def rows(seed=1, n=200):
    """Documents with repeated and null keys, null and empty texts and null words."""
    rng = random.Random(seed)
    out = [(i, [f"w{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(rng.randrange(0, 30))]) for i in range(n)]
    return out + [(3, ["w1", "w1", "w59"]), (3, ["w1", "new"]), (None, ["w2", None]), (None, ["w2", "w7"]), (500, None), (501, []), (502, ["unknown"])]


def merged(docs):
    of = {}
    for k, ws in docs:
        of.setdefault(k, []).extend(w for w in ws or [] if w is not None)
    return of


@pytest.mark.parametrize("sent", [1000, 7])
def test_mean_of_sent_and_other_words(spark, monkeypatch, sent):
    monkeypatch.setattr(FE, "SENT_WORDS", sent)
    monkeypatch.setattr(FE, "SUMMED", 5)
    docs = rows()
    df = spark.createDataFrame(docs, "id int, words array<string>").repartition(5)
    rng = np.random.default_rng(2)
    # A word that is listed twice counts twice; one without a vector does not count.
    listed = [(f"w{i}", [float(x) for x in rng.normal(size=4)]) for i in range(1, 58)] + [("w5", [1.0, 2.0, 3.0, 4.0]), ("w59", None)]
    weights = {f"w{i}": 0.5 + i / 50 for i in range(1, 50)}
    vectors = spark.createDataFrame(listed, "word string, vector array<double>")
    got = FE.mean_embedding(df, "id", "words", vectors, 4, spark.createDataFrame(list(weights.items()), "word string, weight double")).collect()
    assert Counter(r.id for r in got) == Counter(k for k, _ in docs)
    top, of = max(weights.values()), merged(docs)
    for r in got:
        known = [np.array(v) * weights.get(w, top) for t in of[r.id] for w, v in listed if t == w and v is not None] if r.id is not None else []
        assert np.allclose(r.embedding, np.mean(known, axis=0) if known else np.zeros(4), atol=1e-12)


def test_mean_makes_no_row_per_word(spark):
    """What is shuffled are the sums of documents, not their words."""
    df = spark.createDataFrame(rows(), "id int, words array<string>")
    vectors = spark.createDataFrame([("w1", [1.0]), ("w2", [2.0])], "word string, vector array<double>")
    plan = FE.mean_embedding(df, "id", "words", vectors, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_document_frequencies_count_keys_once(spark):
    docs = rows()
    df = spark.createDataFrame(docs, "id int, words array<string>").repartition(4)
    want = Counter(w for ws in merged(docs).values() for w in set(ws))
    assert {r.term: r.df for r in FE.document_frequencies(df, "id", "words").collect()} == want
    assert {r.term: r.df for r in FE.document_frequencies(df.where("id > 3"), "id", "words").collect()} == Counter(w for k, ws in merged(docs).items() if k is not None and k > 3 for w in set(ws))


def top_weights(docs, most, min_df, sublinear):
    of = merged(docs)
    counts = {k: Counter(ws) for k, ws in of.items()}
    df, total = Counter(w for c in counts.values() for w in c), Counter(w for ws in of.values() for w in ws)
    kept = sorted((w for w in df if df[w] >= min_df), key=lambda w: (-total[w], w))[:most]
    out = {}
    for k, c in counts.items():
        w = {t: (1 + np.log(c[t]) if sublinear else c[t]) * (np.log((1 + len(docs)) / (1 + df[t])) + 1) for t in kept if c[t]}
        size = np.sqrt(sum(x * x for x in w.values()))
        out.update({(k, t): x / size for t, x in w.items()})
    return out


@pytest.mark.parametrize("most, min_df, cells", [(10, 1, 1 << 20), (10, 8, 3), (25, 3, 7), (500, 1, 50), (500, 300, 50)])
def test_top_terms_with_few_cells(spark, monkeypatch, most, min_df, cells):
    monkeypatch.setattr(FE, "CELLS", cells)
    # A word that one document repeats has a high total and is in few documents.
    docs = rows(5) + [(900, ["loud"] * 400), (901, ["rare", "rarer"])]
    df = spark.createDataFrame(docs, "id int, words array<string>").repartition(3)
    got = {(r.id, r.term): r.weight for r in FE.tfidf(df, "id", "words", most, min_df, True).collect()}
    want = top_weights(docs, most, min_df, True)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_seldom_terms_are_not_counted_by_document(spark, monkeypatch):
    """Only the terms that can be among the most frequent are counted one by one."""
    seen = []
    plain = FE._totals
    monkeypatch.setattr(FE, "_totals", lambda counts: (seen.append(counts.count()), plain(counts))[1])
    docs = [(i, [f"often{k}" for k in range(80)] + [f"own{i}x{k}" for k in range(20)]) for i in range(300)]
    df = spark.createDataFrame(docs, "id int, words array<string>")
    assert FE.tfidf(df, "id", "words", 20).select("term").distinct().count() == 20
    assert seen == [80 * 300]
