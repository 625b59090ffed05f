"""Multinomial naive Bayes from counts that are taken once.

One aggregate by (fold, class, term) is all that training needs: the counts of
a training set are the sums over the other folds, and a smoothing only enters
the logarithm. So every smoothing of every fold is judged without a refit, in
one scan of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from incidentkit.operators.beside import beside
from incidentkit.session import checkpoint


def top_terms(counts: DataFrame, n: int = 5000, min_docs: int = 1) -> DataFrame:
    """The n terms of highest total count, out of (doc, term, n)."""
    terms = counts.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    return terms.orderBy(F.desc("total"), "term").limit(n).select("term")


def statistics(counts: DataFrame, label: str, fold: str | None = None) -> DataFrame:
    """(fold, label, term, n) out of (doc, term, n, label[, fold]); reduced before the shuffle."""
    keys = [*([fold] if fold else []), label, "term"]
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"))


def fit(stats: DataFrame, labels: DataFrame, label: str, smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The model as two tables: (label, term, gain) and (label, prior, base).

    Only the (class, term) that occur are kept: their gain is what the logarithm
    has above that of a term the class never had, which is the class's base.
    ``labels`` has a row per training document; ``smoothing`` is above zero.
    """
    docs = labels.groupBy(label).agg(F.count(F.lit(1)).alias("docs"))
    whole = docs.agg(F.sum("docs")).scalar()
    size = stats.agg(F.count_distinct("term").cast("double")).scalar()
    totals = stats.groupBy(label).agg(F.sum("n").cast("double").alias("all"))
    base = F.log(F.lit(float(smoothing))) - F.log(F.coalesce("all", F.lit(0.0)) + smoothing * size)
    classes = docs.join(totals, label, "left").select(label, F.log(F.col("docs") / whole).alias("prior"), base.alias("base"))
    gains = stats.select(label, "term", (F.log(F.col("n") + smoothing) - F.log(F.lit(float(smoothing)))).alias("gain"))
    return checkpoint(gains), checkpoint(classes)


def predict(docs: DataFrame, counts: DataFrame, gains: DataFrame, classes: DataFrame, doc: str, label: str) -> DataFrame:
    """(doc, predicted, score): the class with the highest sum of logarithms, the smaller one at a tie of nine digits.

    A document without known terms gets the class with the highest prior. Every
    class of a document is scored from one array of the classes, which is as
    long as there are classes.
    """
    by_term = gains.groupBy("term").agg(F.collect_list(F.struct(label, "gain")).alias("of"))  # one entry per class
    met = beside(counts.select(doc, "term", "n"), by_term, ["term"])
    lengths = met.groupBy(doc).agg(F.sum("n").alias("length"))
    sums = met.select(doc, "n", F.inline("of")).groupBy(doc, label).agg(F.sum(F.col("n") * F.col("gain")).alias("s"))
    gained = sums.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct(label, "s"))).alias("gained"))
    held = classes.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "prior", "base")))).scalar()
    rows = docs.select(doc).join(lengths, doc, "left").join(gained, doc, "left").withColumn("classes", held)
    score = lambda c: c["prior"] + F.coalesce("length", F.lit(0)) * c["base"] + F.coalesce(F.try_element_at("gained", c["label"]), F.lit(0.0))
    scored = F.transform("classes", lambda c: F.struct((-F.round(score(c), 9)).alias("s"), c["label"].alias("label")))
    best = rows.select(doc, F.array_min(scored).alias("b"))
    return best.select(doc, F.col("b.label").alias("predicted"), (-F.col("b.s")).alias("score"))


def search(
    counts: DataFrame, labels: DataFrame, doc: str, label: str, smoothings: Sequence[float], folds: int = 3, priors: Sequence[bool] = (True,), vocabulary: int = 5000, weight: str | None = None
) -> DataFrame:
    """(smoothing, fit_prior, accuracy): mean accuracy over the folds of every setting.

    ``counts`` is (doc, term, n); ``labels`` (doc, label, fold). The statistics,
    folds x classes x vocabulary numbers, are sent to every task, which scores
    its documents for all settings by one product per fold.
    """
    terms = checkpoint(top_terms(counts, vocabulary).orderBy("term"))
    names = [r.term for r in terms.collect()]  # at most ``vocabulary``
    place = {t: i for i, t in enumerate(names)}
    kept = checkpoint(counts.join(F.broadcast(terms), "term").join(labels.select(doc, label, "fold"), doc))
    stats = kept.groupBy("fold", label, "term").agg(F.sum("n").alias("n")).collect()
    docs_of = labels.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n")).collect()
    classes = sorted({r[label] for r in docs_of})
    class_at = {c: i for i, c in enumerate(classes)}
    table = np.zeros((folds, len(classes), len(names)))
    rows = np.zeros((folds, len(classes)))
    for r in stats:
        table[r.fold, class_at[r[label]], place[r.term]] = r.n
    for r in docs_of:
        rows[r.fold, class_at[r[label]]] = r.n
    settings = [(float(s), bool(p)) for s in smoothings for p in priors]
    train, train_rows = table.sum(axis=0) - table, rows.sum(axis=0) - rows
    with np.errstate(divide="ignore"):
        own = np.where(train_rows > 0, np.log(train_rows / train_rows.sum(axis=1, keepdims=True)), -np.inf)
    flat = np.where(train_rows > 0, 0.0, -np.inf)

    def run(batches):
        # Per fold one row per term, and per term the classes of all smoothings side by side.
        logs: dict[int, np.ndarray] = {}
        for batch in batches:
            hits = np.zeros((len(settings), folds))
            seen = np.zeros(folds)
            for fold, group in batch.groupby("fold"):
                if fold not in logs:
                    n = train[fold]
                    seen_terms = n.sum(axis=0) > 0
                    per = [np.where(seen_terms, np.log(n + s) - np.log(n.sum(axis=1, keepdims=True) + s * seen_terms.sum()), 0.0) for s in smoothings]
                    logs[fold] = np.concatenate(per).T
                for at in range(0, len(group), 256):
                    part = group.iloc[at : at + 256]
                    x = np.zeros((len(part), len(names)))
                    for i, (where, n) in enumerate(zip(part["where"], part["n"], strict=True)):
                        x[i, where] = n
                    scores = (x @ logs[fold]).reshape(len(part), len(smoothings), len(classes))
                    truth = part["truth"].to_numpy()
                    k = 0
                    for s in range(len(smoothings)):
                        for p in priors:
                            found = np.round(scores[:, s] + (own if p else flat)[fold], 9).argmax(axis=1)
                            hits[k, fold] += (found == truth).sum()
                            k += 1
                    seen[fold] += len(part)
            k, f = np.indices(hits.shape)
            yield pd.DataFrame({"setting": k.ravel().astype("int32"), "fold": f.ravel().astype("int32"), "hits": hits.ravel(), "seen": np.tile(seen, len(settings))})

    numbered = terms.sparkSession.createDataFrame(list(place.items()), "term string, at int")
    codes = terms.sparkSession.createDataFrame(list(class_at.items()), labels.select(label).schema.add("truth", "integer"))
    vectors = kept.join(F.broadcast(numbered), "term").groupBy(doc).agg(F.collect_list("at").alias("where"), F.collect_list("n").alias("n"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    every = labels.join(vectors, doc, "left").join(F.broadcast(codes), label).select(F.col("fold").cast("int").alias("fold"), "truth", empty("where", "int"), empty("n", "bigint"))
    judged = every.mapInPandas(run, "setting int, fold int, hits double, seen double").groupBy("setting", "fold").agg((F.sum("hits") / F.sum("seen")).alias("accuracy"))
    held = terms.sparkSession.createDataFrame([(i, s, p) for i, (s, p) in enumerate(settings)], "setting int, smoothing double, fit_prior boolean")
    return judged.groupBy("setting").agg(F.avg("accuracy").alias("accuracy")).join(F.broadcast(held), "setting").select("smoothing", "fit_prior", "accuracy")
