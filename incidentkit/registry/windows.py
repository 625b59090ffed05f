"""Spines, splits and operators along the time axis."""

from pyspark.sql import functions as F

from incidentkit.operators import windows as W
from incidentkit.operators.aggregates import resample
from incidentkit.registry.common import HOURLY, MONTHLY, hourly, money, monthly, query, r, rounded, table


@query(
    "e1_month_spine",
    """SELECT CAST(m AS DATE) AS month_start, CAST(year(m) * 100 + month(m) AS BIGINT) AS month, count(o_orderkey) AS n
       FROM (SELECT unnest(generate_series(DATE '1994-06-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS m)
       LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY m""",
)
def _(spark, d):
    orders = table(spark, d, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month_start")).agg(F.count(F.lit(1)).alias("n"))
    return W.month_spine(spark, "1994-06-15", "2001-12-31").join(orders, "month_start", "left").na.fill(0, ["n"])


@query(
    "e2_difference",
    f"""SELECT series_id, ts, y FROM (SELECT series_id, ts, y - lag(y, 24) OVER (PARTITION BY series_id ORDER BY ts) AS y,
        row_number() OVER (PARTITION BY series_id ORDER BY ts) AS k FROM ({HOURLY})) WHERE k > 24""",
)
def _(spark, d):
    return W.difference(hourly(spark, d), 24)


@query(
    "e3_undo_difference",
    f"SELECT series_id, ts, y AS yhat FROM ({MONTHLY}) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts) > 12",
)
def _(spark, d):
    series = monthly(spark, d)
    changes = W.difference(series, 12).withColumnRenamed("y", "yhat")
    return W.undo_difference(changes, series, 12)


def _both(halves):
    """Both halves of a split in one table."""
    train, held = halves
    return train.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))


@query("e4_split_last", f"SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 12 AS held FROM ({MONTHLY})")
def _(spark, d):
    return _both(W.split_last(monthly(spark, d), 12))


@query(
    "e4_split_ratio",
    f"""SELECT series_id, ts, y, k > floor(n * 0.66) AS held
        FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY series_id) AS n FROM ({HOURLY}))""",
)
def _(spark, d):
    return _both(W.split_ratio(hourly(spark, d), 0.66))


@query("e5_split_date", "SELECT o_orderkey, o_orderdate >= DATE '1998-05-23' AS held FROM orders")
def _(spark, d):
    return _both(W.split_date(table(spark, d, "orders"), "o_orderdate", "1998-05-23")).select("o_orderkey", "held")


@query(
    "e5_split_random",
    "SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':8'), 1, 8) AS BIGINT) < 644245094 AS held FROM documents",
)
def _(spark, d):
    return _both(W.split_random(table(spark, d, "documents").select("doc_id"), 0.15, "doc_id", 8))


@query("e6_persistence_forecast", f"SELECT series_id, ts, y, lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS yhat FROM ({HOURLY})")
def _(spark, d):
    return W.persistence_forecast(hourly(spark, d))


_SPARSE = """SELECT s.series_id, s.ts, y FROM
    (SELECT event_type AS series_id, unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS ts FROM events GROUP BY 1) s
    LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS ts, max(value) AS y FROM events GROUP BY 1, 2) c ON c.event_type = s.series_id AND c.ts = s.ts"""


@query(
    "e7_backfill",
    f"SELECT series_id, ts, first_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM ({_SPARSE})",
)
def _(spark, d):
    sparse = resample(table(spark, d, "events"), "ts", "value", "hour", "max", ["event_type"])
    return W.backfill(sparse.withColumnRenamed("event_type", "series_id"))


@query(
    "e8_running_total",
    """SELECT o_orderpriority, week, sales, CAST(sum(sales) OVER (PARTITION BY o_orderpriority ORDER BY week) AS DECIMAL(38,2)) AS running
       FROM (SELECT o_orderpriority, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sales FROM orders GROUP BY 1, 2)""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderpriority", F.trunc(F.col("o_orderdate").cast("date"), "week").alias("week"), money("o_totalprice").alias("sales")
    )
    return W.running_total(orders, ["o_orderpriority"], "week", "sales")


@query(
    "e9_rank_by_length",
    "SELECT doc_id, CAST(length(text) AS INTEGER) AS size, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents",
)
def _(spark, d):
    return W.rank_by_length(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query(
    "e9_rank_by_lines",
    r"""SELECT doc_id, size, row_number() OVER (ORDER BY size DESC, doc_id) AS rank FROM
        (SELECT doc_id, CAST(len(regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r')) AS INTEGER) AS size FROM documents)""",
)
def _(spark, d):
    return W.rank_by_length(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id", lines=True)


@query(
    "e10_actual_vs_forecast",
    f"""SELECT series_id, ts, y, yhat, y - yhat AS error, round(y * 0.85, 6) AS lower, round(y * 1.15, 6) AS upper, (yhat BETWEEN y * (1 - 0.15) AND y * (1 + 0.15)) AS within_band
        FROM (SELECT series_id, ts, y, lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS yhat FROM ({MONTHLY}))""",
)
def _(spark, d):
    series = monthly(spark, d)
    forecast = W.persistence_forecast(series).select("series_id", "ts", "yhat")
    return rounded(W.actual_vs_forecast(series, forecast), "lower", "upper")
