"""Text features, clustering and classification over documents and embeddings."""


from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from incidentkit.functions import text as T
from incidentkit.operators import counted_bayes as CB, features as FE, many_kmeans as MK, models as M, similarity as S, word_rounds as WR
from incidentkit.operators.aggregates import word_counts
from incidentkit.operators.rows import stable_hash, unfold
from incidentkit.operators.windows import split_random
from incidentkit.registry.common import WORDS, documents, query, r, rounded, split_words, table, words
from incidentkit.registry.joins import NAMES, names
from incidentkit.session import checkpoint


@query("g1_count_vectors", f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS term FROM ({WORDS})) GROUP BY 1, 2")
def _(spark, d):
    return FE.term_counts(words(spark, d), "doc_id", "tokens")


def tfidf_sql(source, doc, cap=None, min_df=1, sublinear=False):
    limit = f"ORDER BY sum(n) DESC, term LIMIT {cap}" if cap else ""
    tf = "1 + ln(n)" if sublinear else "n"
    return f"""WITH d AS ({source}), tf AS (SELECT {doc}, term, count(*) AS n FROM (SELECT {doc}, unnest(grams) AS term FROM d) GROUP BY 1, 2),
      v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1 HAVING count(*) >= {min_df} {limit}),
      w AS (SELECT {doc}, tf.term, ({tf}) * idf AS w FROM tf JOIN v ON tf.term = v.term)
      SELECT {doc}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {doc})) AS weight FROM w"""


_WORD_GRAMS = f"SELECT doc_id, tokens AS grams FROM ({WORDS})"


@query("g2_tfidf", f"SELECT doc_id, term, round(weight, 6) AS weight FROM ({tfidf_sql(_WORD_GRAMS, 'doc_id', 5000)})")
def _(spark, d):
    return rounded(FE.tfidf(words(spark, d), "doc_id", "tokens", 5000), "weight")


_PAIR = "list_transform(generate_series(1, len(tokens) - {m}), lambda i: array_to_string(tokens[i:i + {m}], ' '))"
_ONE_TWO = f"SELECT doc_id, list_concat(tokens, {_PAIR.format(m=1)}) AS grams FROM ({WORDS})"
_TWO_THREE = f"SELECT doc_id, list_concat({_PAIR.format(m=1)}, {_PAIR.format(m=2)}) AS grams FROM ({WORDS})"


def _sublinear(spark, d):
    return FE.tfidf(words(spark, d), "doc_id", T.word_ngrams(F.col("tokens"), 1, 2), 300, 10, True)


@query("g2_tfidf_sublinear", f"SELECT doc_id, term, round(weight, 6) AS weight FROM ({tfidf_sql(_ONE_TWO, 'doc_id', 300, 10, True)})")
def _(spark, d):
    return rounded(_sublinear(spark, d), "weight")


@query("g3_tfidf_ngrams", f"SELECT doc_id, term, round(weight, 6) AS weight FROM ({tfidf_sql(_TWO_THREE, 'doc_id', 5000)})")
def _(spark, d):
    return rounded(FE.tfidf_ngrams(words(spark, d), "doc_id", "tokens"), "weight")


_CHARS = f"SELECT name, list_concat(list_transform(generate_series(1, length(name) - 1), lambda i: substr(name, i, 2)), list_transform(generate_series(1, length(name) - 2), lambda i: substr(name, i, 3))) AS grams FROM ({NAMES})"


@query("g3_tfidf_chars", f"SELECT name, term, round(weight, 6) AS weight FROM ({tfidf_sql(_CHARS, 'name', 5000)})")
def _(spark, d):
    return rounded(FE.tfidf_chars(names(spark, d).distinct(), "name", "name"), "weight")


@query(
    "g4_chi2_terms",
    f"""WITH u AS ({tfidf_sql(_ONE_TWO, 'doc_id', 300, 10, True)}), c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1),
         p AS (SELECT quality, n / (SELECT count(*) FROM labels) AS share FROM c),
         o AS (SELECT quality, term, sum(weight) AS o FROM u JOIN labels ON labels.doc_id = u.doc_id GROUP BY 1, 2),
         t AS (SELECT term, sum(o) AS total FROM o GROUP BY 1),
         x AS (SELECT p.quality, t.term, len(string_split(t.term, ' ')) AS words, pow(coalesce(o, 0) - share * total, 2) / (share * total) + pow(coalesce(o, 0) - share * total, 2) / ((1 - share) * total) AS chi2
               FROM p CROSS JOIN t LEFT JOIN o ON o.quality = p.quality AND o.term = t.term)
        SELECT quality, CAST(words AS INTEGER) AS words, round(chi2, 4) AS chi2, CAST(row_number() OVER (PARTITION BY quality, words ORDER BY chi2 DESC, term) AS INTEGER) AS rank FROM x
        WHERE words <= 2 QUALIFY rank <= CASE words WHEN 1 THEN 5 ELSE 2 END""",
)
def _(spark, d):
    # With two classes both see the same scores, so tied terms are left out of the comparison.
    found = FE.chi2_terms(_sublinear(spark, d), table(spark, d, "labels"), "doc_id", "quality")
    return found.select("quality", "words", r("chi2", 4).alias("chi2"), "rank")


def _held(key: str, fraction: float = 0.25, seed: int = 8) -> str:
    """SQL of the random hold-out: the first eight digits of the digest of key and seed."""
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT) < {int(fraction * 2**32)}"


@query(
    "g5_label_index",
    f"""WITH c AS (SELECT source, count(*) AS n FROM documents WHERE NOT {_held('doc_id')} GROUP BY 1),
          i AS (SELECT source, CAST(row_number() OVER (ORDER BY n DESC, source) - 1 AS DOUBLE) AS label FROM c)
        SELECT d.source, coalesce(i.label, CAST((SELECT count(*) FROM c) AS DOUBLE)) AS label, count(*) AS count
        FROM documents d LEFT JOIN i ON i.source = d.source WHERE {_held('doc_id')} GROUP BY 1, 2""",
)
def _(spark, d):
    train, held = split_random(table(spark, d, "documents").select("doc_id", "source"), 0.25, "doc_id")
    return M.label_index(train, "source").transform(held).groupBy("source", "label").count()


#: Terms of every text feature.
TERMS = 5000


def _counted(spark, d, vocab=TERMS):
    docs = words(spark, d).withColumn("tokens", T.remove_stopwords(F.col("tokens"), []))
    model = FE.count_vectorizer(docs, "tokens", vocab, 2.0)
    return model, model.transform(docs)


@query("g6_topics")
def _(spark, d):
    model, docs = _counted(spark, d)
    return M.topics(docs, model.vocabulary, k=20, iterations=20, words=10)[1]


@query("g7_word_vectors")
def _(spark, d):
    vectors = WR.word_vectors(words(spark, d), "tokens", size=150, window=10, min_count=2, rounds=10)
    probe = word_counts(words(spark, d), "tokens", 1).first().word
    return WR.most_similar(vectors, probe, 10)


_VECTOR_SQL = "SELECT DISTINCT word, length(word) AS a, unicode(word) AS b, length(word) - length(replace(word, 'e', '')) AS c FROM (SELECT unnest(tokens) AS word FROM w) WHERE length(word) > 2"


def _toy_vectors(docs):
    listed = unfold(docs, "tokens", "word").where(F.length("word") > 2).distinct()
    vector = F.array(F.length("word"), F.ascii("word"), F.length("word") - F.length(F.replace("word", F.lit("e"), F.lit("")))).cast("array<double>")
    return listed.select("word", vector.alias("vector"))


@query(
    "g8_mean_embedding",
    f"""WITH w AS ({WORDS}), v AS ({_VECTOR_SQL}), m AS (SELECT doc_id, avg(a) AS a, avg(b) AS b, avg(c) AS c
           FROM (SELECT doc_id, unnest(tokens) AS word FROM w) t JOIN v ON v.word = t.word GROUP BY 1)
        SELECT w.doc_id, round(coalesce(a, 0), 9) AS x1, round(coalesce(b, 0), 9) AS x2, round(coalesce(c, 0), 9) AS x3 FROM w LEFT JOIN m ON m.doc_id = w.doc_id""",
)
def _(spark, d):
    docs = words(spark, d)
    means = FE.mean_embedding(docs, "doc_id", "tokens", _toy_vectors(docs), 3)
    return means.select("doc_id", *[r(F.get("embedding", F.lit(i)), 9).alias(f"x{i + 1}") for i in range(3)])


@query(
    "g8_mean_embedding_idf",
    f"""WITH w AS ({WORDS}), t AS (SELECT doc_id, unnest(tokens) AS word FROM w), v AS ({_VECTOR_SQL}),
          i AS (SELECT word, ln((1.0 + (SELECT count(*) FROM w)) / (1.0 + count(DISTINCT doc_id))) + 1 AS idf FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
          s AS (SELECT v.word, a * coalesce(idf, top) AS a, b * coalesce(idf, top) AS b, c * coalesce(idf, top) AS c FROM v LEFT JOIN i ON i.word = v.word, (SELECT max(idf) AS top FROM i)),
          m AS (SELECT doc_id, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM t JOIN s ON s.word = t.word GROUP BY 1)
        SELECT w.doc_id, round(coalesce(a, 0), 5) AS x1, round(coalesce(b, 0), 5) AS x2, round(coalesce(c, 0), 5) AS x3 FROM w LEFT JOIN m ON m.doc_id = w.doc_id""",
)
def _(spark, d):
    docs = words(spark, d)
    total = docs.agg(F.count(F.lit(1)).cast("double")).scalar()
    df = FE.document_frequencies(docs, "doc_id", "tokens").where("df >= 3")
    idf = df.select(F.col("term").alias("word"), (F.log((total + 1) / (F.col("df") + 1)) + 1).alias("weight"))
    means = FE.mean_embedding(docs, "doc_id", "tokens", _toy_vectors(docs), 3, idf)
    return means.select("doc_id", *[r(F.get("embedding", F.lit(i)), 5).alias(f"x{i + 1}") for i in range(3)])


@query(
    "g9_doc_similarity",
    """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, d):
    e = table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    both = e.select("vec_id", "embedding").join(after, "vec_id")
    score = S.cosine(F.col("embedding").cast("array<double>"), F.col("next").cast("array<double>"))
    return both.select("vec_id", r(score).alias("score"))


def _vectors(spark, d):
    return M.as_vector(table(spark, d, "embeddings"), "embedding")


@query("g10_pca")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    df = _vectors(spark, d)
    return M.pca(df, "features", 5).transform(df).select("vec_id", vector_to_array("reduced").alias("reduced"))


@query("g11_kmeans")
def _(spark, d):
    df = _vectors(spark, d)
    return M.kmeans(df, 20, 50).transform(df).groupBy("cluster", "label").count()


def _lloyd_sql(ks, rounds=20):
    """Assignments a<r> and centres m<r> of all numbers of clusters; the first rows by digest start."""
    steps = [
        "x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
        f"""m0 AS (SELECT k, CAST(place - 1 AS INTEGER) AS cluster, v FROM (SELECT v, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':0'), vec_id) AS place FROM x) s,
            (SELECT unnest({list(ks)}) AS k) WHERE place <= k)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, k, v, min_by(cluster, (d, cluster)) AS cluster, min(d) AS d
            FROM (SELECT x.vec_id, x.v, m.k, m.cluster, list_distance(x.v, m.v) AS d FROM x, m{r} m) GROUP BY vec_id, k, v)""")
        if r < rounds:
            steps.append(f"""m{r + 1} AS (SELECT m.k, m.cluster, coalesce(g.v, m.v) AS v FROM m{r} m LEFT JOIN (SELECT k, cluster, list(x ORDER BY i) AS v FROM (
                SELECT k, cluster, i, avg(x) AS x FROM (SELECT k, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY k, cluster) g ON g.k = m.k AND g.cluster = m.cluster)""")
    return "WITH " + ", ".join(steps), f"a{rounds}"


_ELBOW = list(range(2, 51, 4))
_WITH, _LAST = _lloyd_sql(_ELBOW)


@query("g12_elbow", f"{_WITH} SELECT CAST(k AS INTEGER) AS k, round(sum(d * d), 4) AS cost FROM {_LAST} GROUP BY 1")
def _(spark, d):
    return rounded(MK.elbow(table(spark, d, "embeddings"), _ELBOW, "vec_id", "embedding"), "cost", digits=4)


_EVERY_K = list(range(2, 51))
_WITH, _LAST = _lloyd_sql(_EVERY_K)


@query(
    "g13_calinski_harabasz_over_k",
    f"""{_WITH}, e AS (SELECT k, cluster, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM {_LAST}),
          c AS (SELECT k, cluster, i, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS w FROM e GROUP BY ALL), g AS (SELECT k, i, avg(x) AS mean FROM e GROUP BY ALL)
        SELECT CAST(c.k AS INTEGER) AS k, CAST(count(DISTINCT cluster) AS INTEGER) AS clusters, CAST(sum(n) FILTER (c.i = 1) AS BIGINT) AS rows,
          round((sum(n * pow(c.mean - g.mean, 2)) / (count(DISTINCT cluster) - 1)) / (sum(w) / (sum(n) FILTER (c.i = 1) - count(DISTINCT cluster))), 4) AS score
        FROM c JOIN g ON g.k = c.k AND g.i = c.i GROUP BY 1""",
)
def _(spark, d):
    return rounded(MK.calinski_harabasz(table(spark, d, "embeddings"), _EVERY_K, "vec_id", "embedding"), "score", digits=4)


@query(
    "g13_calinski_harabasz",
    """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
          c AS (SELECT label, dim, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM x GROUP BY 1, 2),
          g AS (SELECT dim, avg(x) AS gm FROM x GROUP BY 1)
       SELECT count(DISTINCT label) AS clusters, CAST(sum(n) FILTER (c.dim = 1) AS BIGINT) AS rows,
              round((sum(n * pow(m - gm, 2)) / (count(DISTINCT label) - 1)) / (sum(w) / (sum(n) FILTER (c.dim = 1) - count(DISTINCT label))), 5) AS score
       FROM c JOIN g ON g.dim = c.dim""",
)
def _(spark, d):
    return rounded(FE.calinski_harabasz(table(spark, d, "embeddings"), "label", "embedding"), "score", digits=5)


@query("g14_cluster_terms")
def _(spark, d):
    docs = words(spark, d)
    stages, df = FE.tfidf_fitted(docs, "tokens", TERMS, 10.0)
    return M.cluster_terms(df, M.kmeans(df, 12, 50), stages.stages[0].vocabulary, 10)


@query("g15_assign_cluster")
def _(spark, d):
    docs = words(spark, d)
    stages, df = FE.tfidf_fitted(docs, "tokens", TERMS, 10.0)
    model = M.kmeans(df, 14, 50)
    turns = table(spark, d, "conversations").select("conv_id", "turn", T.tokenize(F.lower("text"), r"\p{L}+").alias("tokens"))
    return M.assign_cluster(stages.transform(turns), model).groupBy("cluster").count()


@query(
    "g15_assign_nearest",
    f"""{_WITH.split(", a0 AS")[0]}, c AS (SELECT cluster, v FROM m0 WHERE k = 14)
        SELECT vec_id, min_by(cluster, (list_distance(x.v, c.v), cluster)) AS cluster FROM x, c GROUP BY vec_id""",
)
def _(spark, d):
    # New rows meet centres that were fitted before: here the ones that fourteen clusters start with.
    e = table(spark, d, "embeddings")
    fitted = MK.fit_many(e, [14], "vec_id", "embedding", max_iter=0)
    return MK.assign(e, fitted.centers[14], "embedding").select("vec_id", "cluster")


def labelled(spark, d):
    """(training, validation) documents with a quality label. Only labelled texts are cut into words."""
    docs = documents(spark, d, "lang", "source", "text").join(table(spark, d, "labels"), "doc_id")
    return split_random(split_words(docs, "quality", "toxic", F.col("quality").cast("double").alias("label")), 0.25, "doc_id")


def _weighed(spark, d):
    """Weights of the terms of the training documents, the validation documents, and the stages that weigh them."""
    train, valid = labelled(spark, d)
    stages, weighed = FE.tfidf_fitted(train, "tokens", TERMS, 5.0, keep=lambda df: M.dealt(df, "features_count"))
    return weighed, valid, stages


def _scored(estimator):
    def run(spark, d):
        train, valid, stages = _weighed(spark, d)
        model = estimator.fit(train)
        return M.accuracy(model.transform(stages.transform(valid)))

    return run


# Training counts of the terms with the highest totals; gains above the base of a class, see the operator.
_BAYES = f"""
  WITH w AS ({WORDS}), l AS (SELECT w.doc_id, w.tokens, quality AS label, {_held('w.doc_id')} AS held FROM w JOIN labels ON labels.doc_id = w.doc_id),
    n AS (SELECT doc_id, label, held, term, count(*) AS n FROM (SELECT doc_id, label, held, unnest(tokens) AS term FROM l) GROUP BY ALL),
    t AS (SELECT term FROM n WHERE NOT held GROUP BY 1 ORDER BY sum(n) DESC, term LIMIT 5000),
    s AS (SELECT label, n.term, sum(n) AS n FROM n JOIN t ON t.term = n.term WHERE NOT held GROUP BY 1, 2),
    c AS (SELECT label, ln(count(*) / (SELECT count(*) FROM l WHERE NOT held)) AS prior, -ln((SELECT coalesce(sum(n), 0) FROM s WHERE s.label = l.label) + (SELECT count(*) FROM t)) AS base FROM l WHERE NOT held GROUP BY 1),
    g AS (SELECT v.doc_id, c.label, any_value(prior) + any_value(base) * coalesce(sum(n.n), 0) + coalesce(sum(n.n * ln(coalesce(s.n, 0) + 1)), 0) AS score
          FROM (SELECT doc_id FROM l WHERE held) v CROSS JOIN c LEFT JOIN (SELECT n.* FROM n JOIN t ON t.term = n.term) n ON n.doc_id = v.doc_id LEFT JOIN s ON s.label = c.label AND s.term = n.term GROUP BY 1, 2),
    b AS (SELECT doc_id, min_by(label, (-round(score, 9), label)) AS predicted, max(round(score, 9)) AS score FROM g GROUP BY 1)
"""


def _bayes(spark, d):
    """Held-out documents with the class that the counted model gives them."""
    train, valid = labelled(spark, d)
    counts = FE.term_counts(train.select("doc_id", "tokens"), "doc_id", "tokens")
    terms = CB.top_terms(counts, TERMS)
    labels = train.select("doc_id", "quality")
    stats = CB.statistics(counts.join(terms, "term").join(labels, "doc_id"), "quality")
    gains, classes = CB.fit(stats, labels, "quality")
    known = FE.term_counts(valid.select("doc_id", "tokens"), "doc_id", "tokens").join(terms, "term")
    return CB.predict(valid.select("doc_id"), known, gains, classes, "doc_id", "quality"), valid


@query("g16_naive_bayes", f"{_BAYES} SELECT count(*) AS n, round(avg(CASE WHEN quality = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM b JOIN labels ON labels.doc_id = b.doc_id")
def _(spark, d):
    found, valid = _bayes(spark, d)
    return rounded(M.accuracy(found.join(valid.select("doc_id", "quality"), "doc_id"), "quality", "predicted"), "accuracy")


@query("g16_naive_bayes_classes", f"{_BAYES} SELECT doc_id, predicted, round(score, 4) AS score FROM b")
def _(spark, d):
    return rounded(_bayes(spark, d)[0], "score", digits=4)


query("g17_logistic")(lambda s, d: _scored(M.logistic())(s, d))
query("g18_linear_svm")(lambda s, d: _scored(M.linear_svm())(s, d))
query("g19_random_forest")(lambda s, d: _scored(M.random_forest())(s, d))
query("g20_extra_trees")(lambda s, d: _scored(M.extra_trees())(s, d))
query("g21_boosted_trees")(lambda s, d: _scored(M.boosted_trees())(s, d))

# A rule to compare with the labels: the longer half of the usual length is good.
_RULE = "CASE WHEN n_chars > 600 THEN 1 ELSE 0 END"
_RULED = f"SELECT quality AS label, {_RULE} AS prediction FROM documents JOIN labels ON labels.doc_id = documents.doc_id"


def _ruled(spark, d):
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return both.selectExpr("quality AS label", f"{_RULE} AS prediction")


@query("g22_accuracy", f"SELECT count(*) AS n, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_RULED})")
def _(spark, d):
    return rounded(M.accuracy(_ruled(spark, d)), "accuracy")


@query("g22_confusion", f"SELECT label, prediction, count(*) AS n FROM ({_RULED}) GROUP BY 1, 2")
def _(spark, d):
    return M.confusion(_ruled(spark, d))


@query(
    "g22_class_report",
    f"""WITH x AS ({_RULED}), k AS (SELECT DISTINCT label AS class FROM x UNION SELECT DISTINCT prediction FROM x),
          s AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (prediction = class) AS predicted, count(*) FILTER (label = class AND prediction = class) AS hit FROM k, x GROUP BY 1)
        SELECT class, round(hit / predicted, 6) AS precision, round(hit / support, 6) AS recall, round(2 * hit / (support + predicted), 6) AS f1, support FROM s""",
)
def _(spark, d):
    return rounded(M.class_report(_ruled(spark, d)), "precision", "recall", "f1")


@query("g23_model_grid")
def _(spark, d):
    train, valid = M.side_by_side([partial(FE.spread, df, "tokens") for df in labelled(spark, d)])
    grams = {"tokens": F.col("tokens"), "pairs": T.word_ngrams(F.col("tokens"), 2, 3), "chars": T.char_ngrams(F.array_join("tokens", " "), 2, 3)}
    counters = M.side_by_side([partial(FE.count_vectorizer, train.select(c.alias(name)), name, TERMS, 5.0, f"{name}_count") for name, c in grams.items()])
    # Only the counts are kept; the n-grams are made twice, as their strings take many times the room of the texts.
    counts = lambda df: PipelineModel(counters).transform(df.withColumns(grams)).select("label", *[f"{name}_count" for name in grams])
    train, valid = M.dealt(counts(train), "tokens_count", together=True), checkpoint(counts(valid))
    features = {
        "count": SQLTransformer(statement="SELECT *, tokens_count AS features FROM __THIS__"),
        "word": FE.tfidf_model(train, "tokens", TERMS, 5.0, counted="tokens_count"),
        "word_pairs": FE.tfidf_model(train, "pairs", TERMS, 5.0, counted="pairs_count"),
        "characters": FE.tfidf_model(train, "chars", TERMS, 5.0, counted="chars_count"),
    }
    # The slowest first: the short ones fill what cores they leave.
    estimators = {"logistic": M.logistic(), "boosted_trees": M.boosted_trees(), "random_forest": M.random_forest(), "naive_bayes": M.naive_bayes()}
    return M.model_grid(train, valid, estimators, features)


# Ten smoothings per decade; a fold is the digest of the document's number.
_SMOOTHINGS = [round(10 ** (i / 10 - 2), 6) for i in range(25)]


def _folds(spark, d, folds, seed=8):
    train, _ = labelled(spark, d)
    fold = F.conv(F.substring(stable_hash(F.col("doc_id"), seed), 1, 8), 16, 10).cast("bigint") % folds
    counts = FE.term_counts(train.select("doc_id", "tokens"), "doc_id", "tokens")
    return counts, train.select("doc_id", "quality", fold.cast("int").alias("fold"))


def _search_sql(folds, smoothings, seed=8, priors=(True, False)):
    return f"""WITH w AS ({WORDS}),
      l AS (SELECT w.doc_id, w.tokens, quality AS label, CAST('0x' || substr(md5(CAST(w.doc_id AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT) % {folds} AS fold FROM w JOIN labels ON labels.doc_id = w.doc_id WHERE NOT {_held('w.doc_id')}),
      n0 AS (SELECT doc_id, label, fold, term, count(*) AS n FROM (SELECT doc_id, label, fold, unnest(tokens) AS term FROM l) GROUP BY ALL),
      t AS (SELECT term FROM n0 GROUP BY 1 ORDER BY sum(n) DESC, term LIMIT 5000), n AS (SELECT n0.* FROM n0 JOIN t ON t.term = n0.term),
      f AS (SELECT unnest(range(0, {folds})) AS fold), a AS (SELECT unnest({list(smoothings)}::DOUBLE[]) AS a), p AS (SELECT unnest({list(priors)}) AS fit_prior),
      s AS (SELECT f.fold, label, term, sum(n) AS n FROM f JOIN n ON n.fold <> f.fold GROUP BY ALL),
      v AS (SELECT fold, count(DISTINCT term) AS v FROM s GROUP BY 1), tot AS (SELECT fold, label, sum(n) AS n FROM s GROUP BY ALL),
      c AS (SELECT f.fold, label, ln(count(*) / sum(count(*)) OVER (PARTITION BY f.fold)) AS prior FROM f JOIN l ON l.fold <> f.fold GROUP BY f.fold, label),
      seen AS (SELECT n.doc_id, n.fold, n.term, n.n FROM n JOIN (SELECT DISTINCT fold, term FROM s) u ON u.fold = n.fold AND u.term = n.term),
      g AS (SELECT l.doc_id, l.fold, a.a, c.label, any_value(prior) AS prior, coalesce(sum(seen.n * (ln(coalesce(s.n, 0) + a.a) - ln(tot.n + a.a * v.v))), 0) AS logs
            FROM l CROSS JOIN a JOIN c ON c.fold = l.fold LEFT JOIN seen ON seen.doc_id = l.doc_id LEFT JOIN s ON s.fold = l.fold AND s.label = c.label AND s.term = seen.term
              JOIN v ON v.fold = l.fold JOIN tot ON tot.fold = l.fold AND tot.label = c.label GROUP BY 1, 2, 3, 4),
      b AS (SELECT doc_id, fold, a, fit_prior, min_by(label, (-round(logs + CASE WHEN fit_prior THEN prior ELSE 0 END, 9), label)) AS predicted FROM g CROSS JOIN p GROUP BY 1, 2, 3, 4),
      h AS (SELECT a, fit_prior, b.fold, avg(CASE WHEN predicted = l.label THEN 1.0 ELSE 0.0 END) AS accuracy FROM b JOIN l ON l.doc_id = b.doc_id GROUP BY 1, 2, 3)
      SELECT a AS smoothing, fit_prior, round(avg(accuracy), 6) AS accuracy FROM h GROUP BY 1, 2"""


@query("g24_random_search", _search_sql(3, _SMOOTHINGS))
def _(spark, d):
    # Fifty settings in three folds: 25 smoothings, with and without the share of a class.
    counts, labels = _folds(spark, d, 3)
    return rounded(CB.search(counts, labels, "doc_id", "quality", _SMOOTHINGS, 3, (True, False), TERMS), "accuracy")


@query("g24_grid_search", _search_sql(5, [0.01, 0.1, 0.5, 1.0], 9, [True]))
def _(spark, d):
    counts, labels = _folds(spark, d, 5, 9)
    return rounded(CB.search(counts, labels, "doc_id", "quality", [0.01, 0.1, 0.5, 1.0], 5, (True,), TERMS), "accuracy")


@query("g24_forest_search")
def _(spark, d):
    train, _, _ = _weighed(spark, d)
    return M.random_search(train.select("features", "label"), M.random_forest(trees=20), {"maxDepth": [3, 5, 8, 12], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2"]}, n_iter=10, folds=3)[1]


@query(
    "g25_prediction_table",
    f"""{_BAYES}, x AS (SELECT label, CAST(row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS DOUBLE) AS code FROM l WHERE NOT held GROUP BY 1)
        SELECT b.doc_id, lang, CAST(quality AS VARCHAR) AS actual, a.code AS label, p.code AS prediction, CAST(predicted AS VARCHAR) AS predicted_label
        FROM b JOIN w ON w.doc_id = b.doc_id JOIN labels ON labels.doc_id = b.doc_id JOIN x a ON a.label = quality JOIN x p ON p.label = predicted""",
)
def _(spark, d):
    found, valid = _bayes(spark, d)
    train, _ = labelled(spark, d)
    index = M.label_index(train.select(F.col("quality").cast("string").alias("actual")), "actual")
    rows = found.join(valid.select("doc_id", "lang", F.col("quality").cast("string").alias("actual")), "doc_id")
    coded = index.transform(rows)
    back = M.label_index(train.select(F.col("quality").cast("string").alias("predicted")), "predicted", "prediction")
    scored = back.transform(coded.withColumn("predicted", F.col("predicted").cast("string")))
    return M.prediction_table(scored, index.labels, ["doc_id", "lang", "actual"])


@query("g25_class_probabilities")
def _(spark, d):
    train, valid, stages = _weighed(spark, d)
    index = M.label_index(train, "lang", "lang_code")
    model = Pipeline(stages=[M.naive_bayes(label="lang_code")]).fit(index.transform(train))
    scored = model.transform(index.transform(stages.transform(valid)))
    return M.prediction_table(scored, index.labels, ["doc_id", "lang"], "lang_code")


@query("g8_classify_mean_vectors")
def _(spark, d):
    """Logistic regression on the mean of trained word vectors."""
    train, valid = labelled(spark, d)
    vectors = checkpoint(WR.word_vectors(train.select("tokens"), "tokens", size=150, window=10, min_count=2, rounds=10))

    def means(df):
        found = FE.mean_embedding(df.select("doc_id", "tokens"), "doc_id", "tokens", vectors, 150)
        return M.as_vector(found.join(df.select("doc_id", "label"), "doc_id"), "embedding")

    return M.accuracy(M.decorrelated_logistic(checkpoint(means(train))).transform(means(valid)))


@query("g17_logistic_class_weights")
def _(spark, d):
    """Accuracy of the multinomial model without and with class weights, over the penalties of the grid."""
    train, valid, stages = _weighed(spark, d)
    weighed = M.dealt(M.balanced_weights(train.select("features", "label"), "label"))
    judged = checkpoint(stages.transform(valid).select("features", "label"))

    def fit(weight, reg):
        model = M.logistic(reg=reg, weight=weight).fit(weighed)
        return weight or "none", reg, float(M.accuracy(model.transform(judged)).first().accuracy or 0.0)

    rows = M.side_by_side([partial(fit, weight, reg) for weight in (None, "weight") for reg in (0.0, 0.001, 0.01, 0.1)])
    return spark.createDataFrame(rows, "class_weight string, penalty double, accuracy double")
