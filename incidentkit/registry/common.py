"""Registration of queries and small shared inputs derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from incidentkit.functions import dates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Letters of any script: both engines read this class the same way.
WORD = r"\p{L}+"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as tickets: opened at the order date, closed at the last shipment, open without one."""
    closed = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("ticket")).agg(
        F.max("l_shipdate").alias("closed_at")
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("ticket"),
        F.col("o_orderstatus").alias("kind"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("opened_at"),
    )
    joined = orders.join(closed, "ticket", "left")
    return joined.withColumns(
        {
            "opened": dates.month_key(F.col("opened_at")),
            "closed": F.coalesce(dates.month_key(F.col("closed_at")), F.lit(dates.CLOSED_DEFAULT)),
        }
    )


TICKETS = """
    SELECT o_orderkey AS ticket, o_orderstatus AS kind, o_orderpriority AS priority, o_orderdate AS opened_at, closed_at,
           CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS opened,
           CAST(coalesce(year(closed_at) * 100 + month(closed_at), 203001) AS BIGINT) AS closed
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS closed_at FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
"""


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour and type as a series table, empty hours as zero."""
    from incidentkit.operators.aggregates import resample

    counted = resample(table(spark, folder, "events"), "ts", "event_id", "hour", "count", ["event_type"])
    return counted.select(
        F.col("event_type").alias("series_id"), "ts", F.coalesce("y", F.lit(0)).cast("double").alias("y")
    )


HOURLY = """
    SELECT s.event_type AS series_id, s.ts, CAST(coalesce(n, 0) AS DOUBLE) AS y
    FROM (SELECT event_type, unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS ts
          FROM events GROUP BY 1) s
    LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2) c
      ON c.event_type = s.event_type AND c.ts = s.ts
"""


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Open orders per month and status as a series table."""
    from incidentkit.plans.tickets import backlog_series

    return backlog_series(tickets(spark, folder), "opened", "closed", 199506, 200112, "kind")


MONTHLY = f"""
    SELECT k.kind AS series_id, m.ts,
           CAST((SELECT count(*) FROM ({TICKETS}) t WHERE t.kind = k.kind AND opened <= m.month AND closed >= m.month) AS DOUBLE) AS y
    FROM (SELECT DISTINCT o_orderstatus AS kind FROM orders) k,
         (SELECT CAST(ts AS DATE) AS ts, year(ts) * 100 + month(ts) AS month
          FROM (SELECT unnest(generate_series(DATE '1995-06-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS ts)) m
"""


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", *columns)


def split_words(docs: DataFrame, *keep: str) -> DataFrame:
    """Documents with their lower-cased words, and the columns to keep."""
    from incidentkit.functions import text as T

    return docs.select("doc_id", "lang", "source", T.tokenize(F.lower("text"), WORD).alias("tokens"), *keep)


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their lower-cased words."""
    return split_words(documents(spark, folder, "lang", "source", "text"))


WORDS = rf"SELECT doc_id, lang, source, regexp_extract_all(lower(text), '{WORD}') AS tokens FROM documents"
