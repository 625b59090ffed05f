"""Text exports in and out. Schemas are stated; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as t


def read_csv(
    spark: SparkSession, path: str, schema: str | t.StructType, sep: str = ",", encoding: str = "UTF-8",
    header: bool = True, multiline: bool = False,
) -> DataFrame:
    """Delimited export with a heading; ``multiline`` for texts with line ends inside quotes."""
    return (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("header", header)
        .option("multiLine", multiline)
        .option("escape", '"')
        .csv(path)
    )


def read_series(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Two columns, period and value."""
    return spark.read.schema("ts date, y double").option("header", header).csv(path)


def read_many(
    spark: SparkSession, glob: str, schema: str | t.StructType, sep: str = ","
) -> DataFrame:
    """Numbered chunk files of one export, with the file each row came from."""
    return read_csv(spark, glob, schema, sep).withColumn("source_file", F.input_file_name())


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, without repeats; ``line`` orders them by first appearance, file by file in order of their names."""
    lines = spark.read.text(path).select(F.col("value").alias("word"), _place().alias("line"))
    return lines.groupBy("word").agg(F.min("line").alias("line"))


def _place() -> Column:
    """Where a line stands: its file, the part of the file that its task reads, and the row of that task."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_wordmap(spark: SparkSession, path: str) -> DataFrame:
    """``from=to`` lines, both sides trimmed; the first line of a word wins, files in order of their names."""
    pair = F.split("value", "=")
    lines = spark.read.text(path).where(F.contains("value", F.lit("="))).select(
        F.trim(F.get(pair, F.lit(0))).alias("word"),
        F.trim(F.get(pair, F.lit(1))).alias("replacement"),
        _place().alias("line"),
    )
    return lines.groupBy("word").agg(F.min_by("replacement", "line").alias("replacement"))


def dutch_decimal(c: Column, to: str = "double") -> Column:
    """``1,5`` and ``2,9E-02`` as a number, null where it is none."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double").cast(to)


def dutch_date(c: Column) -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit("d-M-yyyy")).cast("date")


# Columns of the leave export, by position.
LEAVE_COLUMNS = (
    "employer_id", "leave_person_no", "person_no", "name", "start", "end", "kind", "factor", "units",
)


def read_dutch_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = LEAVE_COLUMNS,
    integers: Sequence[str] = ("employer_id", "leave_person_no", "person_no", "kind", "factor"),
    decimals: Sequence[str] = ("units",),
    dates: Sequence[str] = ("start", "end"),
) -> DataFrame:
    """``;`` export with decimal commas and d-M-yyyy dates; a trailing ``;`` and empty rows are dropped.

    Headings vary in case, so columns go by position.
    """
    names = [*columns, "_trailing"]
    raw = (
        spark.read.schema(", ".join(f"`{c}` string" for c in names))
        .option("sep", ";")
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .csv(path)
        .select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in columns])
    )
    typed = {
        **{c: F.col(c).try_cast("int") for c in integers},
        **{c: dutch_decimal(F.col(c)) for c in decimals},
        **{c: dutch_date(F.col(c)) for c in dates},
    }
    return raw.where(F.coalesce(*columns).isNotNull()).withColumns(typed)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """Folder of delimited part files, written by the tasks that hold the rows."""
    df.write.mode("overwrite").option("sep", sep).option("header", header).option("escape", '"').csv(path)


# Headings of the match report, in order.
MATCH_REPORT = (
    "problem_id", "problem_short", "problem_request", "incident_id", "incident_short", "incident_request",
    "score_short", "score_request", "link_kind", "level1", "level2", "level3",
    "problem_short_clean", "problem_request_clean", "incident_short_clean", "incident_request_clean",
)


def write_match_report(df: DataFrame, path: str) -> None:
    """The 16-column report, ``~`` between columns, ASCII only."""
    ascii_only = [
        F.regexp_replace(F.col(c).cast("string"), r"[^\x00-\x7F]", "").alias(c) for c in MATCH_REPORT
    ]
    write_csv(df.select(*ascii_only), path, sep="~")


def cluster_lines(terms: DataFrame, cluster: str = "cluster", term: str = "term", rank: str = "rank") -> DataFrame:
    """One line per cluster: its number and its top words in order."""
    words = F.transform(F.array_sort(F.collect_list(F.struct(rank, term))), lambda s: s[term])
    return terms.groupBy(cluster).agg(F.array_join(words, ",").alias("words")).select(
        F.concat_ws(",", F.col(cluster).cast("string"), "words").alias("value")
    )


def write_cluster_terms(terms: DataFrame, path: str) -> None:
    cluster_lines(terms).write.mode("overwrite").text(path)
