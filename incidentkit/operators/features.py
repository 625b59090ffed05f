"""Text features as long tables (doc, term, weight) and as sparse ML vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from incidentkit.functions import text as T
from incidentkit.operators.beside import beside
from incidentkit.operators.ranking import global_rank
from incidentkit.operators.rows import unfold
from incidentkit.session import checkpoint

#: Words whose vectors every executor gets at most, and numbers in these vectors.
SENT_WORDS, SENT_NUMBERS = 100_000, 16_000_000
#: One document in so many shows which words are frequent.
SHOWN = 16
#: Words of a document that are summed together.
SUMMED = 65_536
#: Tokens that are worth a task of their own, as long as cores are free.
TASK_TOKENS = 1 << 16
#: Numbers by which terms are counted together to show which of them can be among the most frequent.
CELLS = 1 << 20


def term_counts(df: DataFrame, doc: str, tokens: str | Column) -> DataFrame:
    """Bag of words: (doc, term, n)."""
    return (
        unfold(df, tokens, "term", doc)
        .groupBy(doc, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def by_repeats(df: DataFrame, doc: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key is met once, and those of repeated keys or None; null is a key like others.

    Documents are rows nearly always, so their own terms need no shuffle.
    """
    repeated = checkpoint(df.groupBy(doc).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(doc).alias("_key")))
    if repeated.isEmpty():
        return df, None
    same = F.col(doc).eqNullSafe(F.col("_key"))
    return df.join(repeated, same, "left_anti"), df.join(repeated, same, "left_semi")


def document_frequencies(df: DataFrame, doc: str, tokens: str) -> DataFrame:
    """(term, df): in how many documents a term is met. Counted before the shuffle."""
    once, more = by_repeats(df.select(doc, tokens), doc)
    found = unfold(once, F.array_distinct(tokens), "term")
    if more is not None:
        found = found.unionByName(unfold(more, tokens, "term", doc).distinct().select("term"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf(
    df: DataFrame,
    doc: str,
    tokens: str | Column,
    max_features: int | None = None,
    min_df: int = 1,
    sublinear: bool = False,
) -> DataFrame:
    """L2-normalised weights (doc, term, weight).

    idf = ln((1 + docs) / (1 + docs with term)) + 1; tf is the count or 1 + ln count;
    ``max_features`` keeps the terms with the highest total count.
    """
    if max_features:
        terms, counts = _top_counts(df, doc, tokens, max_features, min_df)
    else:
        counts = term_counts(df, doc, tokens)
        terms = _totals(counts).where(F.col("df") >= min_df)
    docs = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    idf = terms.select("term", (F.log((docs + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    tf = 1 + F.log("n") if sublinear else F.col("n").cast("double")
    # The counts are read twice out of one shuffle. A capped vocabulary is small by its limit.
    weighed = counts.join(F.broadcast(idf), "term") if max_features else beside(counts, idf, ["term"])
    raw = weighed.select(doc, "term", (tf * F.col("idf")).alias("w"))
    # The distinct terms of one document: bounded by its length.
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", (F.col("w") / length).alias("weight"))


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"))


def _top_counts(df: DataFrame, doc: str, tokens: str | Column, most: int, min_df: int) -> tuple[DataFrame, DataFrame]:
    """(term, df, total) of the ``most`` terms with the highest totals, and their (doc, term, n).

    Terms that one document in SHOWN names are counted one by one, all others by
    cell, which holds the terms of one hash. So totals come from rows reduced
    before the shuffle, and a cell bounds the total of each of its terms. Only
    terms that reach a floor, looked for in the cells that reach it too, are
    counted by document; the floor falls until no term below it can be among the best.
    """
    every = unfold(df, tokens, "term", doc)
    shown = every.where(F.pmod(F.xxhash64(doc), F.lit(SHOWN)) == 0).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    shown = checkpoint(shown.orderBy(F.desc("n"), "term").limit(4 * most).select("term", F.lit(True).alias("shown")))
    cell = F.when(F.col("shown").isNull(), F.pmod(F.xxhash64("term"), F.lit(CELLS)))
    known = every.select("term").join(F.broadcast(shown), "term", "left")
    totals = known.select(F.when(F.col("shown"), F.col("term")).alias("term"), cell.alias("cell"))
    totals = checkpoint(totals.groupBy("term", "cell").agg(F.count(F.lit(1)).alias("total")))
    named = totals.where("cell IS NULL").select("term", "total")
    wanted = most if min_df <= 1 else most + max(most // 4, 50)
    while True:
        row = named.orderBy(F.desc("total")).limit(wanted).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least")).first()
        floor = row.least if row.n == wanted else 0
        above = totals.where((F.col("cell") >= 0) & (F.col("total") >= floor)).select("cell")
        high = named.where(F.col("total") >= floor)
        if not above.isEmpty():
            others = every.select("term").withColumn("cell", F.pmod(F.xxhash64("term"), F.lit(CELLS))).join(F.broadcast(above), "cell", "left_semi")  # CELLS at most
            others = others.join(F.broadcast(shown), "term", "left_anti").groupBy("term").agg(F.count(F.lit(1)).alias("total"))
            high = high.unionByName(others.where((F.col("total") >= floor) & (F.col("total") >= min_df)))
        high = checkpoint(high)
        listed = F.broadcast(high) if high.count() <= SENT_WORDS else high
        counts = checkpoint(every.join(listed.select("term"), "term", "left_semi").groupBy(doc, "term").agg(F.count(F.lit(1)).alias("n")))
        terms = checkpoint(_totals(counts).where(F.col("df") >= min_df).orderBy(F.col("total").desc(), "term").limit(most))
        last = terms.agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least")).first()
        if floor <= min_df or (last.n == most and last.least >= floor):
            break
        wanted *= 4
    return terms, counts.join(F.broadcast(terms.select("term")), "term", "left_semi")


def tfidf_ngrams(df: DataFrame, doc: str, tokens: str, low=2, high=3, max_features=5000) -> DataFrame:
    return tfidf(df, doc, T.word_ngrams(F.col(tokens), low, high), max_features)


def tfidf_chars(df: DataFrame, doc: str, text: str, low=2, high=3, max_features=5000) -> DataFrame:
    return tfidf(df, doc, T.char_ngrams(F.col(text), low, high), max_features)


def spread(df: DataFrame, tokens: str) -> DataFrame:
    """The rows as a checkpoint; where a few of its parts hold most tokens they are dealt anew, so that all cores share the work on them."""
    kept = checkpoint(df)
    held = F.sum(F.greatest(F.size(tokens), F.lit(0)).cast("bigint")).alias("n")
    each = kept.groupBy(F.spark_partition_id()).agg(held).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    parts = min(df.sparkSession.sparkContext.defaultParallelism, (each["all"] or 0) // TASK_TOKENS)
    return checkpoint(kept.repartition(parts)) if parts > 1 and each.most * parts > 2 * each["all"] else kept


def count_vectorizer(df: DataFrame, tokens: str, max_features: int, min_df: float = 1.0, out="features"):
    """Fitted bag-of-words model with sparse output."""
    return CountVectorizer(
        inputCol=tokens, outputCol=out, vocabSize=max_features, minDF=min_df
    ).fit(df)


def tfidf_model(
    df: DataFrame, tokens: str, max_features: int = 5000, min_df: float = 1.0, out: str = "features", counted: str | None = None
) -> PipelineModel:
    """Fitted sparse tf-idf stages with the same weights as :func:`tfidf`.

    The fitted idf values are ln((1 + docs) / (1 + df)); one is added before
    they become the scaling vector, so vectors stay sparse all the way.
    Where ``df`` holds the counts of the tokens already, in ``counted``, the
    stages begin there and the tokens are not needed.
    """
    if counted is not None:
        return _weighing(None, df, out, counted)
    counter = count_vectorizer(df, tokens, max_features, min_df, f"{out}_count")
    return _weighing(counter, counter.transform(df), out)


def tfidf_fitted(
    df: DataFrame, tokens: str, max_features: int = 5000, min_df: float = 1.0, out: str = "features", keep: Callable = checkpoint
) -> tuple[PipelineModel, DataFrame]:
    """The stages of :func:`tfidf_model` and the rows they were fitted on with their weights, without the tokens.

    The counts are kept by ``keep``, so whatever reads the weights, however
    often, does not make the tokens again.
    """
    counter = count_vectorizer(df, tokens, max_features, min_df, f"{out}_count")
    counts = keep(counter.transform(df).drop(tokens))
    stages = _weighing(counter, counts, out)
    return stages, PipelineModel(stages.stages[1:]).transform(counts)


def _weighing(counter: Transformer | None, counts: DataFrame, out: str, counted: str | None = None) -> PipelineModel:
    counted = counted or f"{out}_count"
    idf = IDF(inputCol=counted, outputCol=f"{out}_idf").fit(counts).idf
    scale = ElementwiseProduct(
        inputCol=counted, outputCol=f"{out}_raw", scalingVec=Vectors.dense(idf.toArray() + 1.0)
    )
    unit = Normalizer(inputCol=f"{out}_raw", outputCol=out, p=2.0)
    return PipelineModel([*([counter] if counter else []), scale, unit])


def token_sequences(df: DataFrame, doc: str, tokens: str, maxlen: int = 300) -> DataFrame:
    """Words as frequency ranks (1 = most frequent), last ``maxlen`` kept, zeros in front."""
    words = unfold(df, tokens, "word", doc)
    vocabulary = global_rank(
        words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), F.col("n").desc(), F.col("word")
    ).select("word", "rank")
    tail = F.slice(tokens, F.greatest(F.size(tokens) - maxlen + 1, F.lit(1)), maxlen)
    kept = df.select(doc, F.posexplode_outer(tail).alias("pos", "word")).where(F.col("word").isNotNull())
    ranked = (
        kept.join(vocabulary, "word")
        .groupBy(doc)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("_s"))
        .select(doc, F.transform("_s", lambda s: s["rank"]).alias("_seq"))
    )
    sequence = F.coalesce("_seq", F.array().cast("array<bigint>"))
    padding = F.array_repeat(F.lit(0).cast("bigint"), F.lit(maxlen) - F.size(sequence))
    return df.select(doc).join(ranked, doc, "left").select(
        doc, F.concat(padding, sequence).alias("sequence")
    )


def chi2_terms(
    weights: DataFrame, labels: DataFrame, doc: str, label: str, singles: int = 5, pairs: int = 2
) -> DataFrame:
    """Per class the terms with the highest chi-square of one class against the rest.

    Observed is the summed weight in the class, expected the class share of the
    term's total. Every class scores every term, also terms it never uses; what
    those score grows with the term's total alone. So a class needs its own
    terms, and beside them the first few of the list of all terms by total that
    it does not have; these lie in the gaps between the ranks of its own terms.
    """
    joined = weights.join(labels.select(doc, label), doc)
    observed = checkpoint(joined.groupBy(label, "term").agg(F.sum("weight").alias("observed")))
    terms = observed.groupBy("term").agg(F.sum("observed").alias("total")).withColumn("words", F.size(F.split("term", " ")))
    ranked = None
    limits = {1: singles, 2: pairs}
    for words in limits:
        one = global_rank(terms.where(F.col("words") == words), F.desc("total"), F.col("term"), name="place")
        ranked = one if ranked is None else ranked.unionByName(one)
    ranked = checkpoint(ranked)
    classes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = checkpoint(classes.withColumn("share", F.col("n") / classes.agg(F.sum("n")).scalar()).select(label, "share"))
    own = checkpoint(beside(observed, ranked, ["term"]))

    # Place 0 and a place behind the last stand for the ends of the list, so every class has gaps.
    sides = F.explode(F.array(*[F.struct(F.lit(w).alias("words"), F.lit(most).alias("most")) for w, most in limits.items()]))
    starts = classes.select(label, sides.alias("side")).select(label, "side.words", "side.most", F.lit(0).cast("bigint").alias("place"))
    most = F.when(F.col("words") == 1, F.lit(singles)).otherwise(F.lit(pairs))
    places = starts.unionByName(own.select(label, "words", most.alias("most"), F.col("place").cast("bigint").alias("place")))
    along = Window.partitionBy(label, "words").orderBy("place")
    gaps = places.withColumns({"next": F.lead("place").over(along), "before": F.col("place") - F.row_number().over(along) + 1})
    gaps = gaps.where((F.col("before") < F.col("most")) & (F.col("next").isNull() | (F.col("next") > F.col("place") + 1)))
    last = F.least(F.coalesce(F.col("next") - 1, F.col("place") + F.col("most")), F.col("place") + F.col("most"))
    absent = gaps.select(label, "words", F.explode(F.sequence(F.col("place") + 1, last)).alias("place"))
    absent = absent.join(ranked, ["words", "place"]).select(label, "term", "words", "total", F.lit(0.0).alias("observed"))

    every = own.select(label, "term", "words", "total", "observed").unionByName(absent).join(classes, label)
    expected = F.col("share") * F.col("total")
    gap = F.col("observed") - expected
    scored = every.select(
        label, "term", "words", (gap * gap / expected + gap * gap / ((1 - F.col("share")) * F.col("total"))).alias("chi2")
    )
    # A literal rank limit lets every map task drop all but its own best terms.
    best = Window.partitionBy(label, "words").orderBy(F.col("chi2").desc(), "term")
    single = scored.where(F.col("words") == 1).withColumn("rank", F.row_number().over(best))
    double = scored.where(F.col("words") == 2).withColumn("rank", F.row_number().over(best))
    return single.where(F.col("rank") <= singles).unionByName(double.where(F.col("rank") <= pairs))


def mean_embedding(
    df: DataFrame,
    doc: str,
    tokens: str | Column,
    vectors: DataFrame,
    size: int,
    weights: DataFrame | None = None,
    out: str = "embedding",
) -> DataFrame:
    """Mean vector of the known words of a document, zeros if none is known.

    ``vectors`` is (word, vector array). ``weights`` (word, weight) scales each
    vector first; a word without weight takes the highest weight.
    """
    scaled = vectors.select("word", F.col("vector").cast("array<double>").alias("vector"))
    if weights is not None:
        top = weights.agg(F.max("weight")).scalar()
        scaled = scaled.join(weights, "word", "left").select(
            "word",
            F.coalesce("weight", top).alias("weight"),
            "vector",
        ).select("word", F.transform("vector", lambda x: x * F.col("weight")).alias("vector"))
    given = df.select(doc, (F.col(tokens) if isinstance(tokens, str) else tokens).alias("_tokens"))
    scaled = checkpoint(scaled.where(F.col("word").isNotNull() & F.col("vector").isNotNull()))
    most = max(1, min(SENT_WORDS, SENT_NUMBERS // max(1, size)))
    sent, rest = scaled, None
    if scaled.count() > most:
        shown = unfold(given.where(F.pmod(F.xxhash64(doc), F.lit(SHOWN)) == 0), "_tokens", "word")
        often = shown.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).join(scaled.select("word").distinct(), "word", "left_semi")
        often = checkpoint(often.orderBy(F.desc("_n"), "word").limit(most).select("word"))
        sent, rest = scaled.join(F.broadcast(often), "word", "left_semi"), scaled.join(F.broadcast(often), "word", "left_anti")
    found = given.mapInArrow(_known_sums(df, sent, size, rest is not None), _sums_schema(given, doc))
    total = lambda rows: rows.groupBy(doc).agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("sums")).alias("sums"))
    sums = found.select(doc, "n", "sums")
    if rest is not None:
        found = checkpoint(found)
        seldom = beside(term_counts(found, doc, "rest").withColumnRenamed("term", "word"), rest, ["word"])
        scaled_sums = F.transform("vector", lambda x: x * F.col("n"))
        sums = found.select(doc, "n", "sums").unionByName(seldom.select(doc, "n", scaled_sums.alias("sums")))
    means = total(sums.where("n > 0")).select(doc, F.transform(vector_to_array("sums"), lambda x: x / F.col("n")).alias(out))
    zeros = F.array_repeat(F.lit(0.0), size)
    return df.select(doc).join(means, doc, "left").select(doc, F.coalesce(out, zeros).alias(out))


def _sums_schema(given: DataFrame, doc: str):
    return given.select(doc, F.lit(0).cast("bigint").alias("n"), F.array().cast("array<double>").alias("sums"), F.array().cast("array<string>").alias("rest")).schema


def _known_sums(df: DataFrame, vectors: DataFrame, size: int, keep: bool):
    """Per document the number of words with a sent vector, the sum of these vectors and, if kept, all other words."""
    sent = vectors.select("word", "vector").orderBy("word").toArrow().combine_chunks()  # SENT_WORDS at most, but for repeated ones
    words = pc.unique(sent["word"].combine_chunks() if sent.num_rows else pa.array([], pa.string()))
    table, times = np.zeros((len(words) + 1, size)), np.zeros(len(words) + 1, np.int64)  # the last one stands for all other words
    if sent.num_rows:
        at = pc.index_in(sent["word"].combine_chunks(), value_set=words).to_numpy()
        np.add.at(table, at, sent["vector"].combine_chunks().flatten().to_numpy().reshape(-1, size))
        np.add.at(times, at, 1)
    held = df.sparkSession.sparkContext.broadcast((words, table, times))

    def run(batches):
        words, table, times = held.value
        for batch in batches:
            lists = batch.column(1)
            tokens, ends = lists.flatten().cast(pa.string()), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            at = pc.fill_null(pc.index_in(tokens, value_set=words), len(words)).to_numpy(zero_copy_only=False) if len(words) else np.zeros(len(tokens), np.int64)
            begins = ends - np.diff(ends, prepend=0)
            sums = np.zeros((len(lists), size))
            n = np.zeros(len(lists), np.int64)
            for i, (low, high) in enumerate(zip(begins, ends, strict=True)):
                for a in range(low, high, SUMMED):
                    some = at[a : min(high, a + SUMMED)]
                    sums[i] += table[some].sum(axis=0)
                    n[i] += times[some].sum()
            rest = [[]] * len(lists)
            if keep:
                others = at == len(words)
                upto = np.concatenate([[0], np.cumsum(others)])[np.concatenate([[0], ends])]
                rest = pa.ListArray.from_arrays(pa.array(upto.astype("int32")), tokens.filter(pa.array(others)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype="int32") * size), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), flat, pa.array(rest, pa.list_(pa.string()))], names=[batch.schema.names[0], "n", "sums", "rest"])

    return run


def calinski_harabasz(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Variance ratio: between-cluster over within-cluster spread, each per degree of freedom.

    One aggregate per cluster and dimension, reduced before the shuffle.
    """
    cells = (
        df.select(cluster, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
        .groupBy(cluster, "dim")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    )
    dims = cells.groupBy("dim").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.pow(F.sum("s"), F.lit(2)) / F.sum("n")).alias("between"),
        F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
    )
    return dims.agg(
        F.max("k").alias("clusters"),
        F.max("n").alias("rows"),
        (
            (F.sum("between") / (F.max("k") - 1)) / (F.sum("within") / (F.max("n") - F.max("k")))
        ).alias("score"),
    )
