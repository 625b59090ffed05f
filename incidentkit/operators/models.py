"""Topics, word vectors, clustering and classification with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import partial
from itertools import chain
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import LDA, KMeans, KMeansModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexer, StringIndexerModel, VectorSlicer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, TrainValidationSplit
from pyspark.sql import Column, DataFrame, Window, functions as F

from incidentkit.session import checkpoint


def label_index(train: DataFrame, column: str, out: str = "label") -> StringIndexerModel:
    """Codes fitted on the training rows; an unseen label gets one code of its own."""
    return StringIndexer(inputCol=column, outputCol=out, handleInvalid="keep").fit(train)


# --- unsupervised -----------------------------------------------------------


def topics(
    df: DataFrame, vocabulary: Sequence[str], k: int = 20, iterations: int = 20, words: int = 10,
    features: str = "features", seed: int = 1,
):
    """Online LDA: (model, table of topic, rank, term, weight)."""
    model = LDA(
        k=k, maxIter=iterations, optimizer="online", seed=seed, featuresCol=features
    ).fit(df)
    names = F.array(*[F.lit(v) for v in vocabulary])
    found = model.describeTopics(words)
    table = found.select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("_i", "_t")
    ).select(
        "topic",
        (F.col("_i") + 1).alias("rank"),
        F.get(names, F.col("_t.termIndices")).alias("term"),
        F.col("_t.termWeights").alias("weight"),
    )
    return model, table


def word_vectors(
    df: DataFrame, tokens: str, size: int = 150, window: int = 10, min_count: int = 2, seed: int = 1,
    partitions: int = 1, iterations: int = 1,
):
    """Skip-gram vectors: (model, table of word and vector array)."""
    model = Word2Vec(
        vectorSize=size, windowSize=window, minCount=min_count, seed=seed, numPartitions=partitions,
        maxIter=iterations, inputCol=tokens, outputCol="_mean",
    ).fit(df)
    return model, model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def pca(df: DataFrame, vector: str, k: int = 50, out: str = "reduced") -> PipelineModel:
    """Centred principal components of an array or vector column."""
    centre = StandardScaler(inputCol=vector, outputCol=f"{out}_centred", withMean=True, withStd=False)
    return Pipeline(stages=[centre, PCA(k=k, inputCol=f"{out}_centred", outputCol=out)]).fit(df)


def as_vector(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def kmeans(df: DataFrame, k: int = 20, max_iter: int = 50, seed: int = 1, features: str = "features") -> KMeansModel:
    return KMeans(
        k=k, maxIter=max_iter, seed=seed, initMode="k-means||", featuresCol=features, predictionCol="cluster"
    ).fit(df)


def elbow(df: DataFrame, ks: Sequence[int] = range(2, 51, 4), features: str = "features", seed: int = 1) -> DataFrame:
    """Within-cluster sum of squares per number of clusters."""
    cached = df.select(features).persist()
    try:
        rows = [(k, float(kmeans(cached, k, 20, seed, features).summary.trainingCost)) for k in ks]
    finally:
        cached.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, cost double")


def cluster_terms(df: DataFrame, model: KMeansModel, vocabulary: Sequence[str], n: int = 10) -> DataFrame:
    """Highest centroid weights per cluster; centroids are part of the model and small."""
    rows = []
    for c, center in enumerate(model.clusterCenters()):
        best = sorted(range(len(vocabulary)), key=lambda i: (-center[i], vocabulary[i]))[:n]
        rows += [(c, r + 1, vocabulary[i], float(center[i])) for r, i in enumerate(best)]
    return df.sparkSession.createDataFrame(rows, "cluster int, rank int, term string, weight double")


def assign_cluster(df: DataFrame, model: Transformer) -> DataFrame:
    """Cluster of new rows with fitted stages."""
    return model.transform(df)


# --- supervised -------------------------------------------------------------


#: Classes of a one-against-the-rest model that are fitted at the same time.
CLASSES_AT_ONCE = 4
#: Fits on the same rows that run at the same time.
FITS_AT_ONCE = 4
#: Rows of a task that are worth a task of their own, as long as cores are free.
TASK_ROWS = 8192
#: Rows of a task of a linear fit, whose every round is a job, and parts that such a job sums in one step.
ROUND_ROWS, ROUND_PARTS = 2048, 4
#: Numbers, features times rows, that a task of a fit holds: trees keep one of four bytes for every feature of a row.
TASK_NUMBERS = 1 << 26
#: Share of all variance up to which a principal component is taken for rounding.
ROUNDING = 1e-12


def dealt(df: DataFrame, features: str = "features", together: bool = False) -> DataFrame:
    """The rows of a fit as a checkpoint, in as many parts as cores, or more where a part would hold over TASK_NUMBERS.

    With ``together`` rows that are worth one part come in one, even if they
    were in more: trees hand on all their statistics once per part and level.
    """
    rows, one = df.count(), df.select(features).first()
    width = one[features].size if one and one[features] is not None else 1
    parts = max(-(-rows * width // TASK_NUMBERS), min(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS))
    if parts > 1:
        return checkpoint(df.repartition(parts))
    return checkpoint(df).coalesce(1) if together else checkpoint(df)


def for_rounds(df: DataFrame) -> DataFrame:
    """The rows of a linear fit, in more parts if they are many for the parts they are in."""
    parts = min(ROUND_PARTS, df.count() // ROUND_ROWS)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


def side_by_side(fits: Sequence, at_once: int = FITS_AT_ONCE) -> list:
    """Results of independent fits, some of which run at the same time; a fit alone leaves cores idle between its many short jobs."""
    with ThreadPool(at_once) as pool:
        return pool.map(lambda fit: fit(), fits, chunksize=1)


class OneVsRestOrOther(OneVsRest):
    """One model per class; of the classes 0 and 1 alone one model, as the two would mirror each other."""

    def _fit(self, dataset: DataFrame):
        label = F.col(self.getLabelCol())
        found = dataset.agg(F.max(label).alias("most"), F.count_if(label.isNull() | ~label.isin(0.0, 1.0)).alias("others")).first()
        return self.getClassifier().fit(dataset) if found.most == 1 and not found.others else super()._fit(dataset)


def naive_bayes(features: str = "features", label: str = "label") -> NaiveBayes:
    return NaiveBayes(modelType="multinomial", featuresCol=features, labelCol=label)


def logistic(features: str = "features", label: str = "label", max_iter: int = 4000, reg: float = 0.0, weight: str | None = None) -> LogisticRegression:
    est = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg, featuresCol=features, labelCol=label)
    return est.setWeightCol(weight) if weight else est


def decorrelated_logistic(train: DataFrame, features: str = "features", label: str = "label") -> PipelineModel:
    """The logistic model without a penalty, fitted on the principal components of dense features.

    Turned and scaled features have the same best fit. Where features go
    together, as the numbers of mean vectors do, rounds on the features
    themselves are thousands of jobs and may end before it. Rows that do not
    vary are fitted as they are.
    """
    kept = []
    if len(some := train.select(features).take(2)) == 2:
        turned = pca(train, features, some[0][features].size, "components")
        kept = [i for i, share in enumerate(turned.stages[1].explainedVariance.toArray()) if share > ROUNDING]
    if not kept:
        return Pipeline(stages=[logistic(features, label)]).fit(train)
    stages = [*turned.stages, VectorSlicer(inputCol="components", outputCol="varying", indices=kept)]
    rows = checkpoint(PipelineModel(stages).transform(train).select("varying", label))
    return PipelineModel([*stages, logistic("varying", label).fit(rows)])


def linear_svm(features: str = "features", label: str = "label", max_iter: int = 100, reg: float = 0.0) -> OneVsRest:
    """Linear margin per class against the rest; no kernel."""
    inner = LinearSVC(maxIter=max_iter, regParam=reg, featuresCol=features, labelCol=label)
    return OneVsRest(classifier=inner, featuresCol=features, labelCol=label, parallelism=CLASSES_AT_ONCE)


def random_forest(features: str = "features", label: str = "label", trees: int = 100, depth: int = 5, seed: int = 1) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol=features, labelCol=label)


def extra_trees(features: str = "features", label: str = "label", trees: int = 200, depth: int = 5, seed: int = 1) -> RandomForestClassifier:
    """Forest on all rows per tree; thresholds are searched, not drawn at random."""
    return RandomForestClassifier(bootstrap=False, numTrees=trees, maxDepth=depth, seed=seed, featuresCol=features, labelCol=label)


def boosted_trees(features: str = "features", label: str = "label", max_iter: int = 20, depth: int = 5, seed: int = 1) -> OneVsRest:
    inner = GBTClassifier(maxIter=max_iter, maxDepth=depth, seed=seed, featuresCol=features, labelCol=label)
    return OneVsRestOrOther(classifier=inner, featuresCol=features, labelCol=label, parallelism=CLASSES_AT_ONCE)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """rows / (classes * rows of the class), for class-weighted training."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = per.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    weights = per.withColumn("_w", whole).select(label, (F.col("_w.n") / (F.col("_w.k") * F.col("_n"))).alias(out))
    return df.join(weights, label)


# --- evaluation -------------------------------------------------------------


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)).alias("accuracy"),
    )


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, out of the confusion counts."""
    sides = F.inline(
        F.array(
            F.struct(F.col(label).alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col(prediction).alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
        )
    )
    totals = confusion(df, label, prediction).select(sides).groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    precision = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return totals.select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def model_grid(
    train: DataFrame,
    valid: DataFrame,
    estimators: Mapping[str, Estimator],
    feature_sets: Mapping[str, Transformer],
    label: str = "label",
) -> DataFrame:
    """Accuracy on training and validation rows of every model on every feature set.

    Feature transformers are fitted beforehand and put their result in
    ``features``. As many fits run at the same time as their parts fill the
    cores twice, as a fit waits a good part of its time; two at least. The
    models given first are fitted first.
    """
    of = lambda df, transformer: transformer.transform(df).select("features", label).persist()
    kept = {name: (of(train, transformer), of(valid, transformer)) for name, transformer in feature_sets.items()}

    def fit(name, feature_name):
        rows = kept[feature_name][0]
        model = estimators[name].fit(for_rounds(rows) if isinstance(estimators[name], LogisticRegression) else rows)
        return name, feature_name, *[float(accuracy(model.transform(df), label).first().accuracy or 0.0) for df in kept[feature_name]]

    at_once = max(2, 2 * train.sparkSession.sparkContext.defaultParallelism // max(1, train.rdd.getNumPartitions()))
    try:
        rows = side_by_side([partial(fit, name, feature_name) for name in estimators for feature_name in kept], at_once)
    finally:
        for df in chain(*kept.values()):
            df.unpersist()
    return train.sparkSession.createDataFrame(
        rows, "model string, features string, train_accuracy double, accuracy double"
    )


def random_search(
    train: DataFrame,
    estimator: Estimator,
    grid: Mapping[str, Sequence],
    n_iter: int = 50,
    folds: int = 3,
    seed: int = 8,
    label: str = "label",
    parallelism: int = 4,
):
    """Cross-validated accuracy of randomly drawn settings: (best model, table)."""
    every = _settings(grid)
    drawn = random.Random(seed).sample(every, min(n_iter, len(every)))
    maps = [{estimator.getParam(k): v for k, v in s.items()} for s in drawn]
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    fitted = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, seed=seed, parallelism=parallelism
    ).fit(train)
    return fitted.bestModel, _search_table(train, drawn, fitted.avgMetrics)


def grid_search(
    train: DataFrame,
    estimator: Estimator,
    grid: Mapping[str, Sequence],
    train_ratio: float = 0.67,
    seeds: Sequence[int] = (8, 9, 10),
    label: str = "label",
    parallelism: int = 4,
) -> DataFrame:
    """Mean accuracy of every setting over shuffled train/validation splits."""
    every = _settings(grid)
    maps = [{estimator.getParam(k): v for k, v in s.items()} for s in every]
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    totals = [0.0] * len(every)
    for seed in seeds:
        metrics = TrainValidationSplit(
            estimator=estimator, estimatorParamMaps=maps, evaluator=judge, trainRatio=train_ratio, seed=seed, parallelism=parallelism
        ).fit(train).validationMetrics
        totals = [a + b / len(seeds) for a, b in zip(totals, metrics)]
    return _search_table(train, every, totals)


def _settings(grid: Mapping[str, Sequence]) -> list[dict]:
    out: list[dict] = [{}]
    for name, values in grid.items():
        out = [{**s, name: v} for s in out for v in values]
    return out


def _search_table(df: DataFrame, settings: Sequence[dict], metrics: Sequence[float]) -> DataFrame:
    rows = [
        (", ".join(f"{k}={v}" for k, v in sorted(s.items())), float(m)) for s, m in zip(settings, metrics)
    ]
    return df.sparkSession.createDataFrame(rows, "setting string, accuracy double")


def prediction_table(
    scored: DataFrame, labels: Sequence[str], keep: Sequence[str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Actual and predicted code and label, the texts to keep, and class probabilities if there are any."""
    back = IndexToString(inputCol=prediction, outputCol="predicted_label", labels=[*labels, "__unknown__"])
    named = back.transform(scored)
    columns: list[Column | str] = [*keep, label, prediction, "predicted_label"]
    if "probability" in scored.columns:
        columns.append(vector_to_array("probability").alias("probabilities"))
    return named.select(*columns)
