"""Series analysis over hourly events and monthly open orders."""

from pyspark.sql import functions as F

from incidentkit.operators import arima as A, series as S
from incidentkit.plans import tickets as P
from incidentkit.registry.common import HOURLY, MONTHLY, hourly, monthly, query, r, rounded, table
from incidentkit.session import scratch
from incidentkit.sources.tables import checkpoint_table

_W = "PARTITION BY series_id ORDER BY ts"


def _parts(model):
    op, inverse = ("-", "-") if model == "additive" else ("/", "/")
    return f"""WITH h AS ({HOURLY.replace("coalesce(n, 0)", "coalesce(n, 0) + 1")}),
      t AS (SELECT *, (row_number() OVER ({_W}) - 1) % 24 AS phase, CASE WHEN count(*) OVER ({_W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25 THEN
              (sum(y) OVER ({_W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) - 0.5 * (lag(y, 12) OVER ({_W}) + lead(y, 12) OVER ({_W}))) / 24 END AS trend FROM h),
      m AS (SELECT series_id, phase, avg(y {op} trend) AS m FROM t GROUP BY 1, 2),
      s AS (SELECT series_id, phase, m {op} avg(m) OVER (PARTITION BY series_id) AS seasonal FROM m)
      SELECT t.series_id, ts, y, trend, seasonal, y {op} trend {inverse} seasonal AS residual FROM t JOIN s ON s.series_id = t.series_id AND s.phase = t.phase"""


def _plus_one(spark, d):
    return hourly(spark, d).withColumn("y", F.col("y") + 1)


# Nine digits: shares of hourly counts may lie exactly between two six-digit values.
_ROUND = "SELECT series_id, ts, y, round(trend, 9) AS trend, round(seasonal, 9) AS seasonal, round(residual, 9) AS residual FROM"


@query("i1_decompose_additive", f"{_ROUND} ({_parts('additive')})")
def _(spark, d):
    return rounded(S.decompose(_plus_one(spark, d), 24), "trend", "seasonal", "residual", digits=9)


@query("i1_decompose_multiplicative", f"{_ROUND} ({_parts('multiplicative')})")
def _(spark, d):
    return rounded(S.decompose(_plus_one(spark, d), 24, "multiplicative"), "trend", "seasonal", "residual", digits=9)


@query("i2_deseasonalise", f"SELECT series_id, ts, round(residual, 9) AS y FROM ({_parts('additive')}) WHERE trend IS NOT NULL")
def _(spark, d):
    return rounded(S.deseasonalise(_plus_one(spark, d), 24), "y", digits=9)


def acf_sql(source, lags, y="y"):
    return f"""WITH h AS ({source}), c AS (SELECT series_id, row_number() OVER ({_W}) AS t, {y} - avg({y}) OVER (PARTITION BY series_id) AS e FROM h),
      v AS (SELECT series_id, sum(e * e) AS v, count(*) AS n FROM c GROUP BY 1)
      SELECT v.series_id, n, CAST(k AS INTEGER) AS lag, round(coalesce(sum(a.e * b.e), 0) / v, 6) AS acf, round(1.96 / sqrt(n), 6) AS band
      FROM v CROSS JOIN range({lags + 1}) g(k) JOIN c a ON a.series_id = v.series_id JOIN c b ON b.series_id = a.series_id AND b.t = a.t - k GROUP BY v.series_id, n, v, k"""


@query("i3_acf", acf_sql(HOURLY, 20))
def _(spark, d):
    return rounded(S.acf(hourly(spark, d), 20), "acf", "band")


@query("i4_pacf")
def _(spark, d):
    return S.pacf(hourly(spark, d), 7)


@query(
    "i5_dickey_fuller",
    f"""SELECT series_id, round(slope / sqrt((syy - slope * sxy) / (n - 2) / sxx), 5) AS stat, 0 AS used_lag, n AS nobs FROM
        (SELECT series_id, count(*) AS n, regr_slope(dy, x) AS slope, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy, regr_sxy(dy, x) AS sxy FROM
          (SELECT series_id, lag(y) OVER ({_W}) AS x, y - lag(y) OVER ({_W}) AS dy FROM ({HOURLY})) WHERE x IS NOT NULL GROUP BY 1)""",
)
def _(spark, d):
    tested = S.adf_test(hourly(spark, d), 0, "c", "fixed")
    return tested.select("series_id", r("stat", 5).alias("stat"), "used_lag", "nobs")


@query("i5_adf_test")
def _(spark, d):
    return S.adf_test(monthly(spark, d))


@query("i6_difference_order")
def _(spark, d):
    return S.difference_order(monthly(spark, d))


@query("i6_level_or_seasonal")
def _(spark, d):
    return S.level_or_seasonal(monthly(spark, d), 12)


_AR1 = f"""SELECT series_id, ts, y, x * sxy / sxx AS yhat, back FROM (SELECT series_id, ts, y, x, back,
      sum(x * y) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sxy, sum(x * x) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sxx
      FROM (SELECT series_id, ts, y, lag(y) OVER ({_W}) AS x, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back FROM ({{source}})) WHERE x IS NOT NULL) WHERE back <= {{n}}"""


@query("i7_ar_walk_forward", f"SELECT series_id, ts, '(1,0,0)' AS \"order\", y, round(yhat, 6) AS yhat FROM ({_AR1.format(source=HOURLY, n=48)})")
def _(spark, d):
    return rounded(A.walk_forward(hourly(spark, d), A.Order(1, 0, 0), 48), "yhat").drop("status")


@query(
    "i7_ar_fit",
    f"""SELECT series_id, round(sum(x * y) / sum(x * x), 6) AS phi, count(*) AS nobs FROM (SELECT series_id, y, lag(y) OVER ({_W}) AS x FROM ({HOURLY})) WHERE x IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    return A.ar_fit(hourly(spark, d), 1).select("series_id", r(F.get("coef", F.lit(0))).alias("phi"), "nobs")


@query("i8_arima_fit")
def _(spark, d):
    return A.arima_fit(monthly(spark, d), A.Order(1, 1, 1)).select("series_id", "order", "coef", "sigma2", "nobs")


@query("i8_arima_fit_long")
def _(spark, d):
    # The orders that the monthly scenarios settle on: after one difference, and after a yearly one.
    series = monthly(spark, d)
    long, yearly = A.arima_fit(series, A.Order(6, 1, 2)), A.arima_fit(series, A.Order(6, 0, 6, 0, 1, 0, 12))
    return long.unionByName(yearly).select("series_id", "order", "coef", "sigma2", "nobs", "status")


@query("i8_arima_seasonal_forecast")
def _(spark, d):
    order = A.Order(1, 1, 1, 1, 1, 0, 12)
    return A.arima_forecast(A.arima_fit(monthly(spark, d), order), order, 12)


@query("i9_walk_forward")
def _(spark, d):
    return A.walk_forward(monthly(spark, d), A.Order(0, 1, 1), 12)


@query("i9_walk_forward_long")
def _(spark, d):
    return A.walk_forward(monthly(spark, d), A.Order(6, 1, 2), 12).unionByName(A.walk_forward(monthly(spark, d), A.Order(6, 0, 6, 0, 1, 0, 12), 12))


@query(
    "i9_walk_forward_ar",
    f"""WITH s AS (SELECT series_id, ts, y, y - lag(y) OVER ({_W}) AS w, lag(y) OVER ({_W}) AS base, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back FROM ({MONTHLY})),
          p AS (SELECT *, lag(w) OVER ({_W}) AS x FROM s),
          g AS (SELECT *, sum(w * x) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(x * x) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS phi FROM p WHERE x IS NOT NULL)
        SELECT series_id, ts, '(1,1,0)' AS "order", y, round(base + phi * x, 6) AS yhat, 'ok' AS status FROM g WHERE back <= 12""",
)
def _(spark, d):
    return rounded(A.walk_forward(monthly(spark, d), A.Order(1, 1, 0), 12), "yhat")


@query("i10_order_grid")
def _(spark, d):
    return A.order_grid(monthly(spark, d), range(7), range(3), range(7))


@query("i11_seasonal_grid_aic")
def _(spark, d):
    return A.seasonal_grid_aic(monthly(spark, d), A.seasonal_orders([0, 1, 2], 12))


@query(
    "i12_bias_correct",
    f"""WITH f AS (SELECT series_id, ts, y, lag(y) OVER ({_W}) AS yhat FROM ({MONTHLY})), b AS (SELECT series_id, avg(y - yhat) AS bias FROM f WHERE ts < DATE '2000-01-01' GROUP BY 1)
        SELECT f.series_id, ts, y, round(yhat + bias, 6) AS yhat_corrected, round(bias, 6) AS bias FROM f JOIN b ON b.series_id = f.series_id WHERE yhat IS NOT NULL""",
)
def _(spark, d):
    from incidentkit.operators.windows import persistence_forecast

    walked = persistence_forecast(monthly(spark, d)).where(F.col("yhat").isNotNull())
    fixed = A.bias_correct(walked, F.col("ts") < F.lit("2000-01-01").cast("date"))
    return rounded(fixed.drop("yhat"), "yhat_corrected", "bias")


@query("i13_forecast_interval")
def _(spark, d):
    order = A.Order(2, 1, 1)
    return A.arima_forecast(A.arima_fit(monthly(spark, d), order), order, 12, alpha=0.05)


@query("i14_forecast_horizon")
def _(spark, d):
    order = A.Order(2, 0, 0, constant=True)
    return A.arima_forecast(A.arima_fit(hourly(spark, d), order), order, 100, period="hour")


@query("i15_saved_fit")
def _(spark, d):
    from incidentkit.operators.windows import split_last

    order, series = A.Order(1, 1, 1), monthly(spark, d)
    train, _ = split_last(series, 12)
    fit = checkpoint_table(A.arima_fit(train, order), scratch(spark, "fit"))
    return A.apply_fit(series, fit, order).where(F.col("ts") >= F.lit("2001-01-01").cast("date"))


_RESIDUALS = f"SELECT series_id, ts, y - lag(y) OVER ({_W}) AS residual FROM ({MONTHLY})"


def _residuals(spark, d):
    from incidentkit.operators.windows import persistence_forecast

    return persistence_forecast(monthly(spark, d)).select("series_id", "ts", (F.col("y") - F.col("yhat")).alias("residual")).where("residual IS NOT NULL")


@query(
    "i16_residual_describe",
    f"""SELECT series_id, count(residual) AS count, round(avg(residual), 6) AS mean, round(stddev_samp(residual), 6) AS std, min(residual) AS min, quantile_cont(residual, 0.25) AS q25,
        quantile_cont(residual, 0.5) AS q50, quantile_cont(residual, 0.75) AS q75, max(residual) AS max FROM ({_RESIDUALS}) WHERE residual IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    return rounded(S.residual_report(_residuals(spark, d))["describe"], "mean", "std")


@query("i16_residual_acf", acf_sql(f"SELECT * FROM ({_RESIDUALS}) WHERE residual IS NOT NULL", 10, "residual"))
def _(spark, d):
    return rounded(S.residual_report(_residuals(spark, d), lags=10)["acf"], "acf", "band")


@query(
    "i16_residual_histogram",
    f"""WITH x AS (SELECT * FROM ({_RESIDUALS}) WHERE residual IS NOT NULL), s AS (SELECT series_id, min(residual) AS lo, max(residual) AS hi FROM x GROUP BY 1)
        SELECT x.series_id, CAST(least(floor((residual - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM x JOIN s ON s.series_id = x.series_id GROUP BY 1, 2""",
)
def _(spark, d):
    return S.residual_report(_residuals(spark, d))["histogram"].drop("lower")


@query("i_monthly_forecast")
def _(spark, d):
    return P.monthly_forecast(monthly(spark, d), [A.Order(0, 1, 1), A.Order(1, 1, 1), A.Order(6, 0, 0), A.Order(6, 1, 2), A.Order(6, 0, 6)])


@query("i_forecast_scores")
def _(spark, d):
    return P.forecast_scores(P.monthly_forecast(monthly(spark, d), [A.Order(0, 1, 1), A.Order(6, 1, 2), A.Order(6, 0, 6)]))
