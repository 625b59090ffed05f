"""Models from sums: k-means for all numbers of clusters, counted Bayes, word vectors in rounds."""

import math
import random
import threading
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, OneVsRest
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from incidentkit.operators import counted_bayes as CB, features as FE, many_kmeans as MK, models as M, word_rounds as WR
from incidentkit.operators.rows import stable_hash
from incidentkit.registry.features import labelled


def points(seed=1, n=300, dims=5):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dims)) * 4
    return middles[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * 0.5


def plain_kmeans(starts, rows, rounds):
    centers = starts.copy()
    for _ in range(rounds):
        far = ((rows[:, None] - centers[None]) ** 2).sum(axis=2)
        number = far.argmin(axis=1)
        for j in range(len(centers)):
            if (number == j).any():
                centers[j] = rows[number == j].mean(axis=0)
    far = ((rows[:, None] - centers[None]) ** 2).sum(axis=2)
    return centers, far.argmin(axis=1), far.min(axis=1).sum()


def test_all_numbers_of_clusters_equal_single_fits(spark):
    rows = points()
    df = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in enumerate(rows)] + [(999, None, "y")], "id int, v array<double>, k string").repartition(7)
    order = [r.id for r in df.where("v is not null").orderBy(stable_hash(F.col("id")), "id").collect()]
    ks = [2, 3, 6, 11]
    family = MK.fit_many(df, ks, "id", "v", max_iter=12)
    table = {r.k: r for r in MK.calinski_harabasz(df, ks, "id", "v", max_iter=12).collect()}
    costs = {r.k: r.cost for r in MK.elbow(df, ks, "id", "v", max_iter=12).collect()}
    for k in ks:
        centers, number, cost = plain_kmeans(rows[order[:k]], rows, 12)
        assert np.allclose(family.centers[k], centers) and math.isclose(costs[k], cost, rel_tol=1e-9)
        assigned = spark.createDataFrame([(int(c), [float(x) for x in v]) for c, v in zip(number, rows)], "c int, v array<double>")
        single = FE.calinski_harabasz(assigned, "c", "v").first()
        assert math.isclose(table[k].score, single.score, rel_tol=1e-9) and table[k].clusters == single.clusters and table[k].rows == 300
        got = {r.id: r.cluster for r in MK.assign(df, family.centers[k], "v").collect()}
        assert got.pop(999) is None and [got[i] for i in range(300)] == number.tolist()


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    assert {r.k: (r.clusters, r.score) for r in MK.calinski_harabasz(df, [2, 3, 9], "id", "v").collect()}.keys() == {2, 3}
    assert MK.elbow(df.limit(0), [2, 3], "id", "v").count() == 0


def sentences(seed, n=400, classes=3):
    """Texts whose words lean to a class."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = rng.randrange(classes)
        own = [f"c{y}w{rng.randrange(12)}" for _ in range(rng.randrange(0, 5))]
        out.append((i, y, own + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 12))]))
    return out


def bayes_scores(train, ws, smoothing, vocabulary, fit_prior=True):
    counts, docs = {}, Counter(y for _, y, _ in train)
    for _, y, words in train:
        counts.setdefault(y, Counter()).update(w for w in words if w in vocabulary)
    size = len({w for c in counts.values() for w in c})
    seen = {w for c in counts.values() for w in c}
    out = {}
    for y in docs:
        whole = sum(counts[y].values())
        s = math.log(docs[y] / len(train)) if fit_prior else 0.0
        s += sum(math.log((counts[y][w] + smoothing) / (whole + smoothing * size)) for w in ws if w in seen)
        out[y] = s
    return out


def vocabulary_of(rows, n):
    counts = Counter(w for *_, ws in rows for w in ws)
    return {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]}


def test_counted_bayes_equals_plain_form(spark):
    rows = sentences(3)
    train, valid = rows[:300], rows[300:] + [(900, 0, []), (901, 1, ["never", "seen"])]
    df = spark.createDataFrame(rows + valid[-2:], "id int, y int, words array<string>")
    counts = FE.term_counts(df.select("id", "words"), "id", "words")
    old = counts.where("id < 300")
    terms = CB.top_terms(old, 30)
    labels = df.where("id < 300").select("id", "y")
    gains, classes = CB.fit(CB.statistics(old.join(terms, "term").join(labels, "id"), "y"), labels, "y", 0.5)
    new = df.where("id >= 300").select("id")
    got = {r.id: (r.predicted, r.score) for r in CB.predict(new, counts.where("id >= 300").join(terms, "term"), gains, classes, "id", "y").collect()}
    vocabulary = vocabulary_of(train, 30)
    assert set(got) == {i for i, *_ in valid}
    for i, _, ws in valid:
        scores = bayes_scores(train, ws, 0.5, vocabulary)
        best = min(scores, key=lambda y: (-round(scores[y], 9), y))
        assert got[i][0] == best and math.isclose(got[i][1], scores[best], abs_tol=1e-6)
    assert CB.predict(new.limit(0), counts.limit(0), gains, classes, "id", "y").count() == 0


def test_search_equals_plain_folds(spark):
    rows = sentences(5, 240)
    df = spark.createDataFrame(rows, "id int, y int, words array<string>")
    labels = df.select("id", "y", (F.col("id") % 4).alias("fold"))
    counts = FE.term_counts(df.select("id", "words"), "id", "words")
    smoothings, vocabulary = [0.1, 1.0, 5.0], vocabulary_of(rows, 25)
    got = {(r.smoothing, r.fit_prior): r.accuracy for r in CB.search(counts, labels, "id", "y", smoothings, 4, (True, False), 25).collect()}
    assert len(got) == 6
    for (a, prior), accuracy in got.items():
        want = 0.0
        for fold in range(4):
            train, held = [r for r in rows if r[0] % 4 != fold], [r for r in rows if r[0] % 4 == fold]
            hits = 0
            for _, y, ws in held:
                s = bayes_scores(train, ws, a, vocabulary, prior)
                hits += min(s, key=lambda c: (-round(s[c], 9), c)) == y
            want += hits / len(held) / 4
        assert math.isclose(accuracy, want, abs_tol=1e-12)


def synonym_texts(seed=4, n=1500):
    """Planted words that occur among the same neighbours: each pair belongs to one subject."""
    rng = random.Random(seed)
    subjects = [[f"s{k}n{i}" for i in range(8)] for k in range(6)]
    texts = []
    for _ in range(n):
        k = rng.randrange(6)
        words = [w for _ in range(4) for w in (rng.choice(subjects[k]), rng.choice(subjects[k]), rng.choice([f"twin{k}a", f"twin{k}b"]), f"common{rng.randrange(5)}")]
        texts.append((words,))
    return texts


@pytest.mark.parametrize("bag", [True, False])
def test_planted_synonyms_are_neighbours(spark, monkeypatch, bag):
    monkeypatch.setattr(WR, "PART_TOKENS", 8000)
    texts = synonym_texts() + [([],), (None,), (["alone"],)]
    df = spark.createDataFrame(texts, "words array<string>")
    vectors = WR.word_vectors(df, "words", size=24, window=4, rounds=8, bag=bag).cache()
    assert vectors.where("word = 'alone'").count() == 0 and vectors.count() == 48 + 12 + 5
    near = [WR.most_similar(vectors, f"twin{k}a", 9).collect() for k in range(6)]
    # Nine nearest words hold the subject's own words, the other twin among them.
    assert sum(f"twin{k}b" in {r.word for r in found} for k, found in enumerate(near)) >= 5
    assert all(sum(r.word.startswith((f"s{k}n", f"twin{k}")) for r in found) >= 7 for k, found in enumerate(near))
    vectors.unpersist()


def test_no_words_no_vectors(spark):
    assert WR.word_vectors(spark.createDataFrame([([],), (["once"],)], "words array<string>"), "words").count() == 0


def test_word_vectors_need_no_arrow_setting_and_few_parts(spark, monkeypatch):
    monkeypatch.setattr(WR, "PART_TOKENS", 500)
    monkeypatch.setattr(WR, "TOGETHER_SENT", 16)
    parts = []
    repartition = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, n, *by: (parts.append(n), repartition(df, n, *by))[1])
    name = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        df = spark.createDataFrame(synonym_texts(n=800), "words array<string>")
        rows = WR.word_vectors(df, "words", size=8, window=3, rounds=2).collect()
    finally:
        spark.conf.set(name, before)
    assert len(rows) == 65 and all(len(r.vector) == 8 and any(r.vector) for r in rows)
    # 12,800 tokens would be 26 parts of 500.
    assert parts == [WR.MOST_PARTS]


def weighted_rows(spark, n=3000):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=n) > 0.4).astype(float)
    return M.as_vector(spark.createDataFrame([(float(k), [float(a) for a in row]) for k, row in zip(y, x)], "label double, v array<double>").coalesce(1), "v")


def test_rows_of_a_fit_are_dealt_to_bounded_parts(spark, monkeypatch):
    df = weighted_rows(spark).select("features", "label")
    assert M.dealt(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "TASK_ROWS", 1024)
    assert M.dealt(df).rdd.getNumPartitions() == 2
    monkeypatch.setattr(M, "TASK_NUMBERS", 1000)
    kept = M.dealt(df)
    sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 251 and sum(sizes) == 3000


def test_one_model_for_two_classes_predicts_as_two(spark):
    df = M.dealt(weighted_rows(spark).select("features", "label"))
    ours, both = M.boosted_trees(max_iter=3, depth=3), OneVsRest(classifier=GBTClassifier(maxIter=3, maxDepth=3, seed=1))
    one, two = ours.fit(df), both.fit(df)
    assert isinstance(one, GBTClassificationModel) and len(two.models) == 2
    assert [r.prediction for r in one.transform(df).collect()] == [r.prediction for r in two.transform(df).collect()]
    three = df.unionByName(df.limit(50).withColumn("label", F.lit(2.0)))
    assert len(ours.fit(three).models) == 3


def test_kept_weights_equal_the_stages(spark):
    # No two terms are met equally often, as Spark's CountVectorizer leaves the order of such terms open.
    docs = spark.createDataFrame([(i, [f"d{k}" for k in range(1, 8) if i % k == 0]) for i in range(1, 61)], "id int, tokens array<string>")
    stages, kept = FE.tfidf_fitted(docs, "tokens", 10, 2.0)
    plain = FE.tfidf_model(docs, "tokens", 10, 2.0)
    of = lambda df: {r.id: r.features for r in df.collect()}
    assert of(kept) == of(plain.transform(docs)) == of(stages.transform(docs)) and "tokens" not in kept.columns
    assert "regexp" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_fits_run_side_by_side():
    meet = threading.Barrier(2, timeout=30)
    assert M.side_by_side([lambda k=k: (meet.wait(), k)[1] for k in range(2)]) == [0, 1]


class Meeting:
    """An estimator whose fits wait for each other."""

    def __init__(self, meet, inner):
        self.meet, self.inner = meet, inner

    def fit(self, df):
        self.meet.wait()
        return self.inner.fit(df)


def test_models_of_the_grid_are_fitted_side_by_side(spark):
    df = weighted_rows(spark, 200).select("features", "label")
    models, meet = {"logistic": M.logistic(reg=0.1), "random_forest": M.random_forest(trees=3)}, threading.Barrier(4, timeout=60)
    sets = {name: SQLTransformer(statement="SELECT * FROM __THIS__") for name in ("one", "two")}
    got = {(r.model, r.features): (r.train_accuracy, r.accuracy) for r in M.model_grid(df, df.limit(50), {k: Meeting(meet, v) for k, v in models.items()}, sets).collect()}
    for name, est in models.items():
        model = est.fit(df)
        want = tuple(M.accuracy(model.transform(x)).first().accuracy for x in (df, df.limit(50)))
        assert got.pop((name, "one")) == want and got.pop((name, "two")) == want
    assert not got


def test_few_rows_of_trees_come_in_one_part(spark):
    df = weighted_rows(spark).select("features", "label").repartition(4)
    assert M.dealt(df).rdd.getNumPartitions() == 4
    kept = M.dealt(df, together=True)
    assert kept.rdd.getNumPartitions() == 1 and kept.exceptAll(df).isEmpty() and kept.count() == 3000


def test_rows_of_a_linear_fit_come_in_more_parts(spark, monkeypatch):
    df = weighted_rows(spark).select("features", "label")
    assert M.for_rounds(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "ROUND_ROWS", 512)
    more = M.for_rounds(df)
    assert more.rdd.getNumPartitions() == 4 and more.exceptAll(df).isEmpty() and more.count() == 3000
    assert M.for_rounds(df.repartition(6)).rdd.getNumPartitions() == 6


def test_tokens_in_one_part_are_spread(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"w{i}"] * 5 if i % 7 else None) for i in range(200)], "id int, tokens array<string>").coalesce(1)
    assert FE.spread(docs, "tokens").rdd.getNumPartitions() == 1
    monkeypatch.setattr(FE, "TASK_TOKENS", 100)
    kept = FE.spread(docs, "tokens")
    assert kept.rdd.getNumPartitions() == 8 and sorted(kept.collect(), key=lambda r: r.id) == docs.collect()
    assert FE.spread(docs.where("tokens is null"), "tokens").count() == 29 and FE.spread(docs.limit(0), "tokens").isEmpty()


def test_weights_from_ready_counts_equal_those_from_tokens(spark):
    docs = spark.createDataFrame([(i, [f"d{k}" for k in range(1, 8) if i % k == 0]) for i in range(1, 61)], "id int, tokens array<string>")
    counts = FE.count_vectorizer(docs, "tokens", 10, 2.0, "counted").transform(docs).drop("tokens")
    of = lambda df: {r.id: r.features for r in df.collect()}
    assert of(FE.tfidf_model(counts, "tokens", 10, 2.0, counted="counted").transform(counts)) == of(FE.tfidf_model(docs, "tokens", 10, 2.0).transform(docs))


def test_only_labelled_texts_are_cut_into_words(spark, tmp_path):
    spark.createDataFrame([(i, "en", "s", f"een tekst {i}") for i in range(6)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    train, valid = labelled(spark, str(tmp_path))
    assert {r.doc_id: r.label for r in train.unionByName(valid).collect()} == {1: 1.0, 4: 0.0}
    plan = train._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") < plan.index("Join")


def plain_bag(t, tokens, begins, ends, wide, noise, rate):
    """One batch of a continuous bag of words, word by word."""
    inner, outer = t.inner.astype(float), t.outer.astype(float)
    steps, often = {}, Counter()

    def add(kind, word, step):
        steps[kind, word] = steps.get((kind, word), 0) + step
        often[kind, word] += 1

    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for i, word in enumerate(tokens):
        around = [j for j in range(max(begins[i], i - wide[i]), min(ends[i], i + wide[i] + 1)) if j != i]
        hidden = inner[tokens[around]].mean(axis=0)
        near = rate * (1 - sigmoid(hidden @ outer[word]))
        far = {k: rate * t.negative / WR.SHARED * sigmoid(hidden @ outer[w]) for k, w in enumerate(noise) if w != word}
        back = near * outer[word] - sum(x * outer[noise[k]] for k, x in far.items())
        add(1, word, near * hidden)
        for k, w in enumerate(noise):
            add(1, w, -far.get(k, 0) * hidden)
        for j in around:
            add(0, tokens[j], back)
    for w in noise:  # a noise word counts once a batch
        often[1, w] -= len(tokens) - 1
    for (kind, word), step in steps.items():
        (inner, outer)[kind][word] += step * min(1, WR.REPEATS / often[kind, word])
    return inner, outer, often


@pytest.mark.parametrize("sizes", [[2, 5, 70], [3], [40, 2, 2, 33]])
def test_word_vector_steps_equal_plain_ones(sizes):
    rng = np.random.default_rng(3)
    counts = np.array([900, 500, 300] + [40] * 30)
    documents = [rng.integers(0, len(counts), n) ** 2 // len(counts) for n in sizes]
    inner, outer = rng.normal(size=(2, len(counts), 6)).astype("float32")
    t = WR._Trainer(inner, outer, counts, 4, 5, True, 1)
    t.stays[:] = 1
    draws = np.random.default_rng(1)
    tokens = np.concatenate(documents)
    draws.random(len(tokens))
    wide = draws.integers(1, 5, len(tokens))
    noise = np.searchsorted(t.noise, draws.random(WR.SHARED))
    ends = np.repeat(np.cumsum(sizes), sizes)
    expected = plain_bag(t, tokens, ends - np.repeat(sizes, sizes), ends, wide, noise, 0.05)
    t.run(documents, 0.05)
    assert np.allclose(t.inner, expected[0], atol=1e-5) and np.allclose(t.outer, expected[1], atol=1e-5)
    assert all(t.times[kind, word] == n for (kind, word), n in expected[2].items()) and t.times.sum() == sum(expected[2].values())


def test_word_vector_steps_need_no_table_of_words_by_positions():
    n = 5000
    t = WR._Trainer(np.zeros((n, 4), "float32"), np.zeros((n, 4), "float32"), np.ones(n, np.int64), 10, 5, True, 1)
    documents = [np.random.default_rng(1).permutation(n)[: WR.TOGETHER]]
    t.run(documents, 0.05)
    tracemalloc.start()
    t.run(documents, 0.05)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < WR.TOGETHER**2 * 8


def test_logistic_on_correlated_features_ends_in_few_rounds(spark):
    rng = np.random.default_rng(5)
    hidden = rng.normal(size=(600, 6))
    label = (hidden[:, 0] - hidden[:, 5] + rng.logistic(size=600) > 0).astype(float)
    together = hidden @ (rng.normal(size=(6, 6)) * [1, 0.3, 0.1, 0.03, 0.01, 0.003]).T
    vectors = np.hstack([together, np.ones((600, 1)), together[:, :1]])
    df = spark.createDataFrame([(Vectors.dense(v.tolist()), float(y)) for v, y in zip(vectors, label)], ["features", "label"]).repartition(3).cache()
    model = M.decorrelated_logistic(df)
    even = spark.createDataFrame([(Vectors.dense(v.tolist()), float(y)) for v, y in zip(hidden, label)], ["features", "label"])
    best, plain = M.logistic().fit(even).summary, M.logistic(max_iter=100).fit(df).summary
    found = model.stages[-1].summary
    assert found.totalIterations < 40 and math.isclose(found.objectiveHistory[-1], best.objectiveHistory[-1], rel_tol=1e-4)
    assert found.objectiveHistory[-1] <= plain.objectiveHistory[-1] + 1e-6 and model.stages[-1].numFeatures == 6
    assert M.accuracy(model.transform(df)).first().accuracy == pytest.approx(best.accuracy, abs=0.005)


def test_logistic_on_rows_that_do_not_vary(spark):
    for rows in ([(1.0, 1.0)], [(1.0, 1.0), (1.0, 1.0), (1.0, 0.0)]):
        df = spark.createDataFrame([(Vectors.dense([x, 0.0]), y) for x, y in rows], ["features", "label"])
        assert M.accuracy(M.decorrelated_logistic(df).transform(df)).first().accuracy == pytest.approx(1 if len(rows) == 1 else 2 / 3)
