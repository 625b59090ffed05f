import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentkit.operators import arima as A, innovations as inn, series as S
from incidentkit.plans.tickets import forecast_scores, monthly_forecast


def month(i):
    return dt.date(1980 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    n = 480
    e = rng.normal(size=n)
    ar, ma = np.zeros(n), np.zeros(n)
    for t in range(1, n):
        ar[t] = 0.6 * ar[t - 1] + e[t]
        ma[t] = e[t] + 0.5 * e[t - 1]
    data = {
        "ar": ar, "ma": ma, "walk": np.cumsum(e), "noise": e,
        "season": 100 + 10 * np.sin(np.arange(n) * 2 * np.pi / 12) + e, "sine": np.sin(np.arange(n) * 2 * np.pi / 20),
    }
    rows = [(k, month(i), float(v)) for k, y in data.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id string, ts date, y double").repartition(5).cache()
    return df, data


def by_series(df, *cols):
    return {r.series_id: tuple(r[c] for c in cols) for r in df.collect()}


def test_coefficients_are_recovered(made):
    df, _ = made
    ar = by_series(A.arima_fit(df, A.Order(1, 0, 0)), "coef")["ar"][0]
    ma = by_series(A.arima_fit(df, A.Order(0, 0, 1)), "coef")["ma"][0]
    assert abs(ar[0] - 0.6) < 0.1 and abs(ma[0] - 0.5) < 0.12


def test_unit_root(made):
    got = by_series(S.adf_test(made[0]), "stationary")
    assert got["noise"][0] and got["ar"][0] and not got["walk"][0]


def test_adf_equals_plain_regression(made):
    df, data = made
    y = data["walk"]
    lag = 3
    dy = np.diff(y)
    rows = range(lag, len(dy))
    x = np.array([[y[t], 1.0, t + 2.0, *[dy[t - k] for k in range(1, lag + 1)]] for t in rows])
    target = dy[lag:]
    beta, rss, *_ = np.linalg.lstsq(x, target, rcond=None)
    s2 = rss[0] / (len(target) - x.shape[1])
    stat = beta[0] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[0, 0])
    got = by_series(S.adf_test(df, lag, "ct", "fixed"), "stat", "nobs")["walk"]
    assert abs(got[0] - stat) < 1e-6 and got[1] == len(target)


def test_difference_order_and_choice(made):
    got = by_series(S.difference_order(made[0]), "lag")
    assert got["walk"] == (1,)
    kept = {r.series_id: r.lag for r in S.level_or_seasonal(made[0]).select("series_id", "lag").distinct().collect()}
    assert kept["noise"] == 0 and kept["walk"] == 12


def test_pacf_of_ar1(made):
    got = {(r.series_id, r.lag): r.pacf for r in S.pacf(made[0], 5).collect()}
    assert abs(got["ar", 1] - 0.6) < 0.1 and all(abs(got["ar", k]) < 0.12 for k in (2, 3, 4, 5))


def test_parts_add_up(made):
    for model, put in (("additive", lambda r: r.trend + r.seasonal + r.residual), ("multiplicative", lambda r: r.trend * r.seasonal * r.residual)):
        rows = S.decompose(made[0].where("series_id = 'season'"), 12, model).where("trend IS NOT NULL").collect()
        assert len(rows) == 468 and all(abs(put(r) - r.y) < 1e-6 for r in rows)


def test_walk_forward_equals_refit_at_every_origin(made):
    df, data = made
    got = {(r.series_id, r.ts): r.yhat for r in A.walk_forward(df, A.Order(2, 1, 0), 12).collect()}
    y = data["walk"]
    w = np.diff(y)
    for step in range(12):
        t = len(y) - 12 + step
        past = w[: t - 1]
        x = np.column_stack([past[1:-1], past[:-2]])
        beta = np.linalg.lstsq(x, past[2:], rcond=None)[0]
        assert abs(got["walk", month(t)] - (y[t - 1] + beta @ [past[-1], past[-2]])) < 1e-8


def test_shuffled_input_gives_the_same(made):
    df, _ = made
    a = A.walk_forward(df, A.Order(1, 0, 1), 6).collect()
    b = A.walk_forward(df.repartition(3, "y"), A.Order(1, 0, 1), 6).collect()
    left, right = ({(r.series_id, r.ts): r.yhat for r in x} for x in (a, b))
    assert left.keys() == right.keys() and all(abs(left[k] - right[k]) < 1e-9 for k in left)


def test_sine_is_forecast(made):
    order = A.Order(2, 0, 0)
    out = A.arima_forecast(A.arima_fit(made[0], order), order, 24).where("series_id = 'sine'").orderBy("step").collect()
    want = np.sin((480 + np.arange(24)) * 2 * np.pi / 20)
    assert np.allclose([r.yhat for r in out], want, atol=1e-6) and out[0].ts == month(480)


def test_interval_widths(made):
    order = A.Order(0, 1, 0)
    fit = A.arima_fit(made[0], order)
    out = A.arima_forecast(fit, order, 4).where("series_id = 'walk'").orderBy("step").collect()
    sigma = by_series(fit, "sigma2")["walk"][0] ** 0.5
    for r in out:
        assert abs((r.upper - r.yhat) - 1.959964 * sigma * r.step**0.5) < 1e-4


def test_grids_choose_sensible_orders(made):
    df, _ = made
    best = by_series(A.order_grid(df, range(3), range(2), range(2)).where("is_best"), "order", "rmse")
    assert best["season"][1] < 6 and set(best) == {"ar", "ma", "walk", "noise", "season", "sine"}
    aic = by_series(A.seasonal_grid_aic(df.where("series_id IN ('ar', 'noise')"), A.seasonal_orders([0, 1], 12)).where("is_best"), "order")
    assert aic["ar"][0].startswith("(1,0,")


def test_short_series_is_skipped(spark):
    df = spark.createDataFrame([("s", month(i), float(i % 3)) for i in range(8)], "series_id string, ts date, y double")
    walked = A.walk_forward(df, A.Order(3, 0, 0), 2).collect()
    assert walked and all(r.yhat is None and r.status == "short" for r in walked)
    fits = A.arima_fit(df, A.Order(3, 0, 0)).collect()
    assert fits and all(r.coef is None and r.status == "short" for r in fits)
    grid = A.order_grid(df, [0, 3], [0], [0], 2).where("order = '(3,0,0)'").collect()
    assert grid and all(r.rmse is None and r.status == "short" and not r.is_best for r in grid)
    assert A.arima_forecast(A.arima_fit(df, A.Order(3, 0, 0)), A.Order(3, 0, 0), 2).where("yhat IS NULL").count() == 2 * len(fits)


def test_saved_fit_predicts(spark, made, tmp_path):
    from incidentkit.sources.tables import checkpoint_table

    order = A.Order(1, 0, 1)
    fit = checkpoint_table(A.arima_fit(made[0], order), str(tmp_path / "fit"))
    out = A.apply_fit(made[0], fit, order).groupBy("series_id").agg(F.stddev("residual").alias("s"))
    assert abs(by_series(out, "s")["ar"][0] - 1) < 0.1


def test_monthly_forecast(made):
    out = monthly_forecast(made[0].where("series_id IN ('season', 'walk')"), [A.Order(0, 1, 1), A.Order(1, 0, 0, 0, 1, 0, 12)], 12)
    assert out.count() == 48
    scores = {(r.series_id, r.order): r.rmse for r in forecast_scores(out).collect()}
    assert scores["season", "(1,0,0)(0,1,0,12)"] < scores["season", "(0,1,1)"]


def test_lag_bound_follows_each_series(spark):
    rng = np.random.default_rng(12)
    rows = [(name, dt.date(1900, 1, 1) + dt.timedelta(days=i), float(v)) for name, n in (("short", 40), ("long", 1000)) for i, v in enumerate(rng.normal(size=n).cumsum())]
    df = spark.createDataFrame(rows, "series_id string, ts date, y double")
    got = {r.series_id: r for r in S.adf_test(df).collect()}
    assert got["long"].used_lag <= 22 and got["short"].used_lag <= 10
    # The fit of the chosen lag uses all rows that it leaves.
    assert all(got[k].nobs == n - 1 - got[k].used_lag for k, n in (("short", 40), ("long", 1000)))
    alone = S.adf_test(df.where("series_id = 'short'")).first()
    assert alone.used_lag == got["short"].used_lag and abs(alone.stat - got["short"].stat) < 1e-9


def test_p_values_match_the_critical_values(spark):
    for trend, points in S.CRITICAL.items():
        for name, share in (("crit_1", 0.01), ("crit_5", 0.05), ("crit_10", 0.10)):
            p = spark.range(1).select(S.p_value(F.lit(points[name][0]), trend)).first()[0]
            assert abs(p - share) < 0.002
    ends = spark.range(1).select(S.p_value(F.lit(-30.0)), S.p_value(F.lit(5.0)), S.p_value(F.lit(None).cast("double")))
    assert tuple(ends.first()) == (0.0, 1.0, None)


def simulated(seed, n, ar=(), ma=()):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 200)
    w = np.zeros(n + 200)
    for t in range(len(w)):
        w[t] = e[t] + sum(f * w[t - i] for i, f in ar if t >= i) + sum(f * e[t - j] for j, f in ma if t >= j)
    return w[200:]


def test_refined_estimates_are_near_the_truth():
    """1,500 values a series: coefficients within 0.1, and no series ends with a larger sum of squares than it started."""
    cases = [(((1, 0.6),), ((1, 0.5),)), ((), ((1, -0.8),)), (((1, 0.5), (2, -0.3)), ((1, 0.4),)), ((), ((1, 0.4), (12, 0.5)))]
    for ar, ma in cases:
        lags, shocks = [i for i, _ in ar], [j for j, _ in ma]
        series = [simulated(s, 1500, ar, ma) for s in range(5)]
        w, size = A._stacked(series)
        start = np.zeros((5, len(ar) + len(ma)))
        before = (inn._recursion(w, size, lags, shocks, False, start, False)[0] ** 2).sum(axis=1)
        beta, sums, _ = inn.refined(w, size, lags, shocks, False, start)
        truth = np.array([f for _, f in (*ar, *ma)])
        assert np.abs(beta - truth).max() < 0.1 and (sums <= before).all()


def test_long_orders_and_awkward_series():
    """(6,1,2) and (6,0,6) end, and never worse than their regression; constants, short and explosive starts do no harm."""
    rng = np.random.default_rng(0)
    for ar, ma in (([1, 2, 3, 4, 5, 6], [1, 2]), ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6])):
        series = [simulated(s, n, ((1, 0.5),), ((1, 0.3),)) for s, n in ((1, 72), (2, 400))] + [np.zeros(60), np.sin(np.arange(90.0)), rng.normal(size=3)]
        order = A.Order(len(ar), 0, len(ma))
        beta, sums, shocks, n, enough = A._fit_stacked(series, order)
        assert np.isfinite(beta[:2]).all() and np.isfinite(sums[:2]).all() and not enough[4]
        w, size = A._stacked(series[:2])
        start = np.full((2, len(ar) + len(ma)), 3.0)
        again, cost, _ = inn.refined(w, size, ar, ma, False, start)
        assert np.isfinite(again).all()


def test_saved_fit_forecasts_like_its_own_innovations(spark):
    y = np.cumsum(simulated(5, 300, ((1, 0.4),), ((1, 0.5),)))
    df = spark.createDataFrame([("s", month(t), float(v)) for t, v in enumerate(y)], "series_id string, ts date, y double")
    order = A.Order(1, 1, 1)
    fit = A.arima_fit(df, order)
    row = fit.first()
    rows = A.apply_fit(df, fit, order).orderBy("ts").collect()
    assert abs(row.coef[0] - 0.4) < 0.2 and abs(row.coef[1] - 0.5) < 0.2 and len(rows) == 298
    # The innovation that the fit keeps is the residual of the last row, and the next forecast follows from both.
    assert abs(row.last_e[0] - rows[-1].residual) < 1e-9
    ahead = A.arima_forecast(fit, order, 1).first().yhat
    w = np.diff(y)
    assert abs(ahead - (y[-1] + row.coef[0] * w[-1] + row.coef[1] * rows[-1].residual)) < 1e-9
