"""Streams that read the test tables as they lie on disk and stop when all is read."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString, RegexTokenizer
from pyspark.sql import functions as F

from incidentkit.operators import features as FE, models as M
from incidentkit.registry.common import query, table
from incidentkit.session import scratch
from incidentkit.streaming import streams as S


@query("s1_score_stream")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("text").alias("features_text"), "lang")
    split = RegexTokenizer(inputCol="features_text", outputCol="tokens", pattern=r"\P{L}+", minTokenLength=2)
    train = split.transform(docs)
    weights = FE.tfidf_model(train, "tokens", 5000, 5.0, "vector")
    index = M.label_index(train, "lang")
    bayes = Pipeline(stages=[M.naive_bayes("vector")]).fit(index.transform(weights.transform(train)))
    named = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=[*index.labels, "__unknown__"])
    # Requests carry their text in ``features``.
    rename = RegexTokenizer(inputCol="features", outputCol="tokens", pattern=r"\P{L}+", minTokenLength=2)
    model = PipelineModel([rename, weights, *bayes.stages, named])

    inbox, sink = scratch(spark, "requests"), scratch(spark, "answers")
    table(spark, d, "conversations").select(F.col("text").alias("features")).write.json(inbox)
    S.score_stream(S.read_requests(spark, inbox), model, sink, scratch(spark, "state")).awaitTermination()
    answers = spark.read.schema("features string, prediction string").json(sink)
    return answers.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s2_backlog_stream",
    """SELECT period, opened, closed, CAST(sum(opened) OVER (ORDER BY period) - coalesce(sum(closed) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open
       FROM (SELECT CAST(ts AS DATE) AS period, count(*) FILTER (event_type = 'signup') AS opened, count(*) FILTER (event_type = 'purchase') AS closed FROM events GROUP BY 1)""",
)
def _(spark, d):
    # Files by user, so every batch spans all days and is late for the one before it.
    events = table(spark, d, "events")
    inbox = scratch(spark, "events")
    events.repartition(4, "user_id").write.parquet(inbox)
    stream = (
        spark.readStream.schema(events.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(inbox)
        .select(
            F.col("ts").cast("timestamp").alias("ts"),
            (F.col("event_type") == "signup").alias("opened"),
            (F.col("event_type") == "purchase").alias("closed"),
        )
    )
    sink = scratch(spark, "backlog")
    S.backlog_stream(stream, sink, scratch(spark, "state")).awaitTermination()
    return S.finished_backlog(spark, sink).withColumn("period", F.col("period").cast("date"))
