"""Aggregations over the test tables."""

from pyspark.sql import functions as F

from incidentkit.operators import aggregates as A
from incidentkit.registry.common import HOURLY, WORD, WORDS, hourly, money, query, r, rounded, table, words


@query("d1_top_counts", "SELECT user_id, count(event_id) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def _(spark, d):
    return A.top_counts(table(spark, d, "events"), "user_id", 20, "event_id")


_DESCRIBE = """count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
  round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max"""


@query("d2_describe_numeric", f"SELECT {_DESCRIBE.format(c='l_extendedprice')} FROM lineitem")
def _(spark, d):
    return rounded(A.describe_numeric(table(spark, d, "lineitem"), "l_extendedprice"), "mean", "std", "q25", "q50", "q75", digits=4)


@query("d2_describe_by_flag", f"SELECT l_returnflag, {_DESCRIBE.format(c='l_extendedprice')} FROM lineitem GROUP BY 1")
def _(spark, d):
    df = A.describe_numeric(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return rounded(df, "mean", "std", "q25", "q50", "q75", digits=4)


@query(
    "d3_below_quantile",
    "SELECT doc_id, n_chars FROM documents WHERE n_chars < (SELECT quantile_cont(n_chars, 0.95) FROM documents)",
)
def _(spark, d):
    return A.below_quantile(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars")


@query("d3_below_quantile_approx")
def _(spark, d):
    return A.below_quantile(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", exact=False)


@query(
    "d4_majority_baseline",
    """SELECT quality AS label, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
       ORDER BY n DESC, label LIMIT 1""",
)
def _(spark, d):
    return rounded(A.majority_baseline(table(spark, d, "labels"), "quality"), "share")


@query("d5_crosstab_counts", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return A.crosstab_counts(table(spark, d, "events"), "user_id", "event_type")


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "d5_crosstab_pivot",
    "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _KINDS) + " FROM events GROUP BY 1",
)
def _(spark, d):
    return A.crosstab_counts(table(spark, d, "events"), "user_id", "event_type", pivot=True, values=_KINDS)


@query(
    "d6_keep_repeated",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
       (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) >= 4)""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return A.keep_repeated(orders, "o_custkey", 4, F.col("o_orderstatus") == "P").select("o_orderkey", "o_custkey")


@query(
    "d7_best_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return A.best_per_group(orders, "o_custkey", "o_totalprice", ["o_orderkey"])


@query(
    "d8_word_counts",
    f"SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM ({WORDS})) GROUP BY 1 ORDER BY n DESC, word LIMIT 100",
)
def _(spark, d):
    return A.word_counts(words(spark, d), "tokens", 100)


_YEARS = list(range(1995, 2002))
_YM = "SELECT month(o_orderdate) AS month, year(o_orderdate) AS year, CAST(o_totalprice AS DECIMAL(18,2)) AS y FROM orders"


@query(
    "d9_year_matrix",
    "SELECT CAST(month AS INTEGER) AS month, "
    + ", ".join(f'CAST(sum(y) FILTER (year = {y}) AS DECIMAL(38,2)) AS "{y}"' for y in _YEARS)
    + f" FROM ({_YM}) GROUP BY 1",
)
def _(spark, d):
    orders = table(spark, d, "orders").withColumn("y", money("o_totalprice"))
    return A.year_matrix(orders, "o_orderdate", "y", _YEARS)


@query(
    "d9_year_matrix_transposed",
    "SELECT CAST(year AS INTEGER) AS year, "
    + ", ".join(f'CAST(sum(y) FILTER (month = {m}) AS DECIMAL(38,2)) AS "{m}"' for m in range(1, 13))
    + f" FROM ({_YM}) GROUP BY 1",
)
def _(spark, d):
    orders = table(spark, d, "orders").withColumn("y", money("o_totalprice"))
    return A.year_matrix(orders, "o_orderdate", "y", transpose=True)


@query(
    "d10_box_stats",
    """WITH q AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS month, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
                         quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
       SELECT q.month, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, count(*) AS n,
              min(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
              max(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
              count(*) FILTER (NOT o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
       FROM orders JOIN q ON month(o_orderdate) = q.month GROUP BY q.month, q1, median, q3""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select(F.month("o_orderdate").alias("month"), "o_totalprice")
    return rounded(A.box_stats(orders, ["month"], "o_totalprice"), "q1", "median", "q3", digits=4)


@query(
    "d11_histogram",
    """WITH s AS (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM documents),
       b AS (SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, (hi - lo) / 20 AS w FROM documents, s)
       SELECT bin, round(min(lo) + bin * min(w), 6) AS lower, count(*) AS n FROM b GROUP BY bin""",
)
def _(spark, d):
    return rounded(A.histogram(table(spark, d, "documents"), "n_chars", 20), "lower")


@query(
    "d12_kde",
    """WITH s AS (SELECT l_returnflag, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h FROM lineitem GROUP BY 1),
       c AS (SELECT l_returnflag, l_quantity AS v, count(*) AS k FROM lineitem GROUP BY 1, 2),
       g AS (SELECT s.*, CAST(p AS INTEGER) AS point, lo + p * (hi - lo) / 29 AS x FROM s, range(30) t(p))
       SELECT g.l_returnflag, point, round(x, 6) AS x, round(sum(k * exp(-0.5 * pow((x - v) / h, 2)) / (n * h * sqrt(2 * pi()))), 8) AS density
       FROM g JOIN c ON c.l_returnflag = g.l_returnflag GROUP BY g.l_returnflag, point, x""",
)
def _(spark, d):
    df = A.kde(table(spark, d, "lineitem"), "l_quantity", 30, ["l_returnflag"])
    return df.withColumns({"x": r("x"), "density": r("density", 8)})


@query(
    "d13_resample_day",
    """WITH f AS (SELECT event_type, CAST(ts AS DATE) AS ts, round(avg(value), 8) AS y FROM events GROUP BY 1, 2),
       s AS (SELECT event_type, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM f GROUP BY 1)
       SELECT s.event_type, s.ts, CAST(y AS DOUBLE) AS y FROM s LEFT JOIN f ON f.event_type = s.event_type AND f.ts = s.ts""",
)
def _(spark, d):
    events = table(spark, d, "events")
    return rounded(A.resample(events, "ts", "value", "day", "avg", ["event_type"]), "y", digits=8)


@query("d13_resample_hour", f"SELECT series_id, ts, y FROM ({HOURLY})")
def _(spark, d):
    return hourly(spark, d)


@query("d14_period", "SELECT min(ts) AS first, max(ts) AS last FROM events")
def _(spark, d):
    return A.period(table(spark, d, "events"), "ts")


@query(
    "d15_error_metrics",
    f"""SELECT series_id, count(*) AS n, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias
        FROM (SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS e FROM ({HOURLY})) WHERE e IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    from incidentkit.operators.windows import persistence_forecast

    return rounded(A.error_metrics(persistence_forecast(hourly(spark, d))), "mse", "rmse", "bias")


@query(
    "d16_rollup_totals",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sales,
              CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS hours,
              CAST(grouping(l_returnflag) + grouping(l_linestatus) AS INTEGER) AS level
       FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
def _(spark, d):
    lines = table(spark, d, "lineitem").withColumns({"sales": money("l_extendedprice"), "hours": money("l_quantity")})
    return A.rollup_totals(lines, ["l_returnflag", "l_linestatus"], ["sales", "hours"])
