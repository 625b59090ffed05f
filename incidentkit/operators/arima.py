"""ARIMA models for many series by two-stage least squares.

A long autoregression gives the innovations; the model is then a regression on
its lags and on lagged innovations (Hannan and Rissanen, 1982). Seasonal orders
add the seasonal lags to the regression. A single model with a moving-average
part is then refined by Gauss-Newton steps on its own innovations, which is the
conditional least-squares fit. Grids stop at the regression. Estimates differ
from a likelihood fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from incidentkit.operators import innovations as inn, least_squares as ls
from incidentkit.operators.aggregates import error_metrics
from incidentkit.operators.windows import along
from incidentkit.session import checkpoint

KEYS = ("series_id",)
ROWS_PER_COEFFICIENT = 3


@dataclass(frozen=True)
class Order:
    p: int = 0
    d: int = 0
    q: int = 0
    P: int = 0
    D: int = 0
    Q: int = 0
    s: int = 0
    constant: bool = False

    @property
    def ar(self) -> list[int]:
        return sorted({*range(1, self.p + 1), *[self.s * i for i in range(1, self.P + 1)]})

    @property
    def ma(self) -> list[int]:
        return sorted({*range(1, self.q + 1), *[self.s * i for i in range(1, self.Q + 1)]})

    @property
    def name(self) -> str:
        base = f"({self.p},{self.d},{self.q})"
        return base + (f"({self.P},{self.D},{self.Q},{self.s})" if self.s else "")

    def polynomial(self) -> np.ndarray:
        """Coefficients of (1-B)^d (1-B^s)^D, index = lag."""
        out = np.array([1.0])
        for _ in range(self.d):
            out = np.convolve(out, [1.0, -1.0])
        for _ in range(self.D):
            out = np.convolve(out, np.concatenate(([1.0], np.zeros(self.s - 1), [-1.0])))
        return out


def _differenced(df: DataFrame, order: Order, keys, ts, y) -> DataFrame:
    """(keys, ts, y, _w, _base): differenced value and the part of y its past gives."""
    w = along(keys, ts)
    poly = order.polynomial()
    past = F.lit(0.0)
    for lag, c in enumerate(poly):
        if lag and c:
            past = past - float(c) * F.lag(y, lag).over(w)
    level = F.col(y).cast("double")
    return (
        df.select(*keys, ts, level.alias("y"), past.alias("_base"), F.row_number().over(w).alias("_rank"))
        .where(F.col("_rank") >= len(poly))
        .select(*keys, ts, "y", "_base", (F.col("y") - F.col("_base")).alias("_w"))
    )


def _with_lags(df: DataFrame, column: str, lags: Sequence[int], prefix: str, keys, ts) -> DataFrame:
    w = along(keys, ts)
    return df.withColumns({f"{prefix}{k}": F.lag(column, k).over(w) for k in lags})


def _complete(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def _linear(coefficients: str, columns: Sequence[str]) -> Column:
    out = F.lit(0.0)
    for i, c in enumerate(columns):
        out = out + F.get(coefficients, F.lit(i)) * F.col(c)
    return out


def _solver(columns: Sequence[str]):
    used = list(range(1, len(columns)))

    @F.pandas_udf("array<double>")
    def coefficients(grams: pd.Series) -> pd.Series:
        # A long autoregression may have more lags than the series has modes.
        beta, _, _ = ls.solve(ls.square(grams, len(columns)), 0, used, minimum_norm=True)
        return pd.Series([None if not np.isfinite(b).all() else b for b in beta])

    return coefficients


def _long_lags(order_ma: Sequence[int]) -> int:
    return max(order_ma) + 4


def _innovations(df: DataFrame, long_ar: int, training: Column, keys, ts) -> DataFrame:
    """Add ``_e``: what a long autoregression, fitted on the training rows, leaves of ``_w``."""
    names = [f"_a{k}" for k in range(1, long_ar + 1)]
    lagged = _with_lags(df, "_w", range(1, long_ar + 1), "_a", keys, ts)
    rows = lagged.where(_complete(names) & training)
    columns = ["_w", *names]
    fit = ls.product_sums(rows, keys, columns).select(*keys, _solver(columns)("gram").alias("_phi"))
    joined = lagged.join(fit, list(keys), "left")
    return joined.withColumn("_e", F.col("_w") - _linear("_phi", names)).drop(*names, "_phi")


def _design(
    df: DataFrame, ar: Sequence[int], ma: Sequence[int], order: Order, keys, ts, y, hold_out: int
) -> tuple[DataFrame, list[str]]:
    """Differenced rows with all regressors; ``_late`` marks the last ``hold_out`` rows."""
    base = _differenced(df, order, keys, ts, y)
    back = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    base = base.withColumn("_late", F.row_number().over(back) <= hold_out)
    if ma:
        base = _innovations(base, _long_lags(ma), ~F.col("_late"), keys, ts)
        base = _with_lags(base, "_e", ma, "_m", keys, ts)
    if ar:
        base = _with_lags(base, "_w", ar, "_l", keys, ts)
    columns = ["_one", *[f"_l{k}" for k in ar], *[f"_m{k}" for k in ma]]
    return base.withColumn("_one", F.lit(1.0)), columns


def _used(order: Order, columns: Sequence[str]) -> list[int]:
    """Positions of an order's regressors in [target, *columns]."""
    names = [*(["_one"] if order.constant else []), *[f"_l{k}" for k in order.ar], *[f"_m{k}" for k in order.ma]]
    return [1 + columns.index(n) for n in names]


def _forecaster(size: int, choices: Sequence[Sequence[int]]):
    """Gram and regressors at an origin to one forecast per choice of regressors."""

    @F.pandas_udf("array<double>")
    def forecasts(gram: pd.Series, x: pd.Series) -> pd.Series:
        g = ls.square(gram, size)
        regressors = np.stack(x.to_numpy()).astype(float)
        out = []
        for used in choices:
            beta, _, _ = ls.solve(g, 0, used)
            yhat = np.einsum("ni,ni->n", beta, regressors[:, [u - 1 for u in used]])
            enough = g[:, 1, 1] >= ROWS_PER_COEFFICIENT * max(1, len(used))
            out.append(np.where(enough, yhat, -np.inf))
        return pd.Series(list(np.stack(out, axis=1)))

    return forecasts


def _aic(g: np.ndarray, used: Sequence[int]) -> np.ndarray:
    """n ln(rss / n) + 2k per series; minus infinity where rows are too few."""
    n = g[:, 1, 1]
    _, rss, _ = ls.solve(g, 0, used)
    with np.errstate(all="ignore"):
        score = n * np.log(np.maximum(rss, 1e-300) / n) + 2 * len(used)
    return np.where(n >= ROWS_PER_COEFFICIENT * max(1, len(used)), score, -np.inf)


def _stacked(series: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Series side by side, left-aligned, and their lengths."""
    sizes = np.array([len(w) for w in series])
    out = np.zeros((len(series), int(sizes.max(initial=0))))
    for i, w in enumerate(series):
        out[i, : len(w)] = w
    return out, sizes


def _fit_stacked(series: Sequence[np.ndarray], order: Order):
    """(coefficients, sum of squares, innovations, rows, enough) of one order for differenced series."""
    ar, ma = order.ar, order.ma
    columns = ["_one", *[f"_l{k}" for k in ar], *[f"_m{k}" for k in ma]]
    used = _used(order, columns)
    g = np.stack([inn.gram(w, ar, ma, _long_lags(ma) if ma else 0) for w in series])
    n = g[:, 1, 1]
    enough = n >= ROWS_PER_COEFFICIENT * max(1, len(used))
    beta, rss, _ = ls.solve(g, 0, used)
    w, sizes = _stacked(series)
    if not ma:
        return beta, rss, np.zeros_like(w), n, enough
    start = beta.copy()
    start[~enough] = np.nan
    beta, rss, shocks = inn.refined(w, sizes, ar, ma, order.constant, start)
    return beta, rss, shocks, np.maximum(sizes - max([0, *ar]), 0), enough


def walk_forward_orders(
    df: DataFrame, orders: Sequence[Order], n: int = 12, keys: Sequence[str] = KEYS, ts: str = "ts", y: str = "y"
) -> DataFrame:
    """One-step forecasts of the last n periods by every order, refitted at every origin.

    (keys, ts, order, y, yhat, status), one row per period and order. Orders
    with the same differencing share one table of running sums. ``status`` is
    ``ok``, ``short`` where fewer than three rows per coefficient are left, or
    ``singular``; without ``ok`` the forecast is null.
    """
    parts = []
    groups = sorted({(o.d, o.D, o.s) for o in orders})
    # Every differencing reads the series; what lies behind it runs once.
    df = checkpoint(df.select(*keys, ts, y))
    for d, D, s in groups:
        group = [o for o in orders if (o.d, o.D, o.s) == (d, D, s)]
        ar = sorted({k for o in group for k in o.ar})
        ma = sorted({k for o in group for k in o.ma})
        design, columns = _design(df, ar, ma, group[0], keys, ts, y, n)
        rows = design.where(_complete(columns))
        grams = ls.running_product_sums(rows, keys, ts, ["_w", *columns], F.col("_late"))
        size = 1 + len(columns)
        choices = [_used(o, columns) for o in group]

        forecasts = _forecaster(size, choices)
        origins = rows.where("_late").select(*keys, ts, "y", "_base", F.array(*columns).alias("_x"))
        names = F.array(*[F.lit(o.name) for o in group])
        part = (
            origins.join(grams, [*keys, ts])
            .select(*keys, ts, "_base", F.posexplode(forecasts("gram", "_x")).alias("_o", "_what"))
            .select(*keys, ts, F.get(names, F.col("_o")).alias("order"), "_what", (F.col("_what") + F.col("_base")).alias("yhat"))
        )
        parts.append(part)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    back = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    last = df.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= n)
    asked = last.select(*keys, ts, F.explode(F.array(*[F.lit(o.name) for o in orders])).alias("order"), F.col(y).alias("y"))
    return asked.join(found, [*keys, ts, "order"], "left").select(*keys, ts, "order", "y", _estimate("yhat"), _status("_what"))


def _estimate(column: str, of: str = "_what") -> Column:
    return F.when(_status(of) == "ok", F.col(column)).alias(column)


def _status(column: str) -> Column:
    c = F.col(column)
    short = c.isNull() | (c == float("-inf"))
    return F.when(short, "short").when(F.isnan(c), "singular").otherwise("ok").alias("status")


def walk_forward(
    df: DataFrame, order: Order, n: int = 12, keys: Sequence[str] = KEYS, ts: str = "ts", y: str = "y"
) -> DataFrame:
    """Like :func:`walk_forward_orders` for one order; a moving-average part is refined at every origin."""
    if not order.ma:
        return walk_forward_orders(df, [order], n, keys, ts, y)
    poly = order.polynomial()
    base = np.concatenate([[0.0], -poly[1:]])

    @F.pandas_udf("array<struct<yhat: double, status: string>>")
    def ahead(values: pd.Series) -> pd.Series:
        """Forecast of each of the last n values from the ones before it, oldest first."""
        out = []
        for v in values:
            level = np.array([np.nan if x is None else x for x in v], dtype=float)
            origins = range(max(0, len(level) - n), len(level))
            series = [inn.differenced(level[:t], poly) for t in origins]
            beta, rss, shocks, _, enough = _fit_stacked(series, order)
            rows = []
            for t, w, b, r, e, ok in zip(origins, series, beta, rss, shocks, enough, strict=True):
                fits = ok and np.isfinite(r) and np.isfinite(b).all() and len(w) >= max([0, *order.ar, *order.ma])
                if not fits:
                    rows.append({"yhat": None, "status": "singular" if ok else "short"})
                    continue
                c0, phi, theta = (b[0], b[1 : 1 + len(order.ar)], b[1 + len(order.ar) :]) if order.constant else (0.0, b[: len(order.ar)], b[len(order.ar) :])
                step = c0 + sum(f * w[len(w) - lag] for f, lag in zip(phi, order.ar, strict=True)) + sum(f * e[len(w) - lag] for f, lag in zip(theta, order.ma, strict=True))
                past = sum(c * level[t - lag] for lag, c in enumerate(base) if lag and c)
                rows.append({"yhat": float(step + past), "status": "ok"})
            out.append(rows)
        return pd.Series(out)

    times = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(y).cast("double").alias("y"))))
    held = df.groupBy(*keys).agg(times.alias("_h")).withColumn("_f", ahead(F.transform("_h", lambda h: h["y"])))
    late = F.slice("_h", F.greatest(F.size("_h") - n + 1, F.lit(1)), n)
    each = held.select(*keys, F.inline(F.arrays_zip(late.alias("h"), F.col("_f").alias("f"))))
    return each.select(*keys, F.col("h.t").alias(ts), F.lit(order.name).alias("order"), F.col("h.y").alias("y"), "f.yhat", "f.status")


def order_grid(
    df: DataFrame,
    ps: Sequence[int],
    ds: Sequence[int],
    qs: Sequence[int],
    n: int = 12,
    metric: str = "rmse",
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    y: str = "y",
) -> DataFrame:
    """Walk-forward error of every (p, d, q) and whether it is the best of its series.

    An order without a forecast has null errors, the reason in ``status``, and is never the best.
    """
    orders = [Order(p, d, q) for d in ds for p in ps for q in qs]
    walked = checkpoint(walk_forward_orders(df, orders, n, keys, ts, y))
    reason = F.coalesce(F.max(F.when(F.col("status") != "ok", F.col("status"))), F.lit("ok")).alias("status")
    scored = error_metrics(walked, by=[*keys, "order"])
    return _mark_best(walked.groupBy(*keys, "order").agg(reason).join(scored, [*keys, "order"], "left"), metric, keys)


def _mark_best(scored: DataFrame, metric: str, keys) -> DataFrame:
    rank = F.when(F.col(metric).isNotNull(), F.struct(metric, "order"))
    best = F.min_by("order", rank).over(Window.partitionBy(*keys))
    return scored.withColumn("is_best", F.coalesce(F.col("order") == best, F.lit(False)))


def seasonal_grid_aic(
    df: DataFrame,
    orders: Sequence[Order],
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    y: str = "y",
) -> DataFrame:
    """AIC = n ln(rss / n) + 2k of every order on the whole series, its status, and the best one."""
    groups: dict[tuple[int, int, int], list[int]] = {}
    for i, o in enumerate(orders):
        groups.setdefault((o.d, o.D, o.s), []).append(i)

    @F.pandas_udf("array<double>")
    def every(values: pd.Series) -> pd.Series:
        """All orders of all series; a differencing's lags and sums are made once per series."""
        series = [np.array([np.nan if x is None else x for x in v], dtype=float) for v in values]
        out = np.full((len(series), len(orders)), -np.inf)
        for places in groups.values():
            group = [orders[i] for i in places]
            ar, ma = sorted({k for o in group for k in o.ar}), sorted({k for o in group for k in o.ma})
            columns = ["_one", *[f"_l{k}" for k in ar], *[f"_m{k}" for k in ma]]
            poly = group[0].polynomial()
            grams = np.stack([inn.gram(inn.differenced(v, poly), ar, ma, _long_lags(ma) if ma else 0) for v in series])
            for i, o in zip(places, group, strict=True):
                out[:, i] = _aic(grams, _used(o, columns))
        return pd.Series(list(out))

    found = _arrays(df, keys, ts, y).select(*keys, F.posexplode(every("_values")).alias("_o", "aic"))
    names = F.array(*[F.lit(o.name) for o in orders])
    named = found.select(*keys, F.get(names, F.col("_o")).alias("order"), "aic")
    return _mark_best(checkpoint(named.select(*keys, "order", _estimate("aic", "aic"), _status("aic"))), "aic", keys)


def _arrays(df: DataFrame, keys, ts, y) -> DataFrame:
    """(keys, _values, _last): the values of every series in order; as many as the calendar has periods."""
    held = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(y).cast("double").alias("y"))))
    return df.groupBy(*keys).agg(held.alias("_h")).select(*keys, F.transform("_h", lambda h: h["y"]).alias("_values"), F.element_at("_h", -1)["t"].alias("_last"))


def seasonal_orders(values: Sequence[int], s: int, constant: bool = False) -> list[Order]:
    """Every (p, d, q)(P, D, Q, s) over the given values."""
    r = list(values)
    return [Order(p, d, q, P, D, Q, s, constant) for p in r for d in r for q in r for P in r for D in r for Q in r]


def arima_fit(
    df: DataFrame, order: Order, keys: Sequence[str] = KEYS, ts: str = "ts", y: str = "y"
) -> DataFrame:
    """Coefficient table: one row per series with all that forecasting needs.

    (keys, order, coef, sigma2, nobs, last_ts, last_y, last_e), arrays newest
    first. Plain columns, so Parquet keeps a fit.
    """
    memory = max([1, *[len(order.polynomial()) - 1 + k for k in [0, *order.ar]]])
    depth = max(memory, *[1, *order.ma])
    k = len(order.ar) + len(order.ma) + order.constant
    poly = order.polynomial()

    @F.pandas_udf("coef array<double>, sigma2 double, nobs bigint, last_y array<double>, last_e array<double>, status string")
    def fitted(values: pd.Series) -> pd.DataFrame:
        levels = [np.array([np.nan if x is None else x for x in v], dtype=float) for v in values]
        series = [inn.differenced(v, poly) for v in levels]
        beta, rss, shocks, n, enough = _fit_stacked(series, order)
        good = enough & np.isfinite(rss) & np.isfinite(beta).all(axis=1)
        ends = [np.concatenate([np.zeros(depth), e[: len(w)]])[::-1][:depth] for e, w in zip(shocks, series, strict=True)]
        return pd.DataFrame(
            {
                "coef": [list(b) if ok else None for b, ok in zip(beta, good, strict=True)],
                "sigma2": [max(r, 0.0) / max(m - k, 1) if ok else None for r, m, ok in zip(rss, n, good, strict=True)],
                "nobs": n.astype("int64"),
                "last_y": [list(v[::-1][:depth]) for v in levels],
                "last_e": [list(np.where(np.isfinite(e), e, 0.0)) for e in ends],
                "status": np.where(good, "ok", np.where(enough, "singular", "short")),
            }
        )

    # Every series has a row; without an estimate its coefficients are null and ``status`` says why.
    found = _arrays(df, keys, ts, y).select(*keys, "_last", fitted("_values").alias("f"))
    return found.select(*keys, F.lit(order.name).alias("order"), "f.coef", "f.sigma2", "f.nobs", F.col("_last").alias("last_ts"), "f.last_y", "f.last_e", "f.status")


def arima_forecast(
    fit: DataFrame,
    order: Order,
    steps: int = 12,
    alpha: float = 0.05,
    period: str = "month",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """(keys, step, ts, yhat, lower, upper) with limits from the psi weights."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    poly, ar, ma, constant = order.polynomial(), order.ar, order.ma, order.constant

    @F.pandas_udf("array<struct<yhat: double, lower: double, upper: double>>")
    def ahead(coef: pd.Series, sigma2: pd.Series, last_y: pd.Series, last_e: pd.Series) -> pd.Series:
        out = []
        for c, s2, ys, es in zip(coef, sigma2, last_y, last_e):
            if c is None:
                out.append([{"yhat": None, "lower": None, "upper": None}] * steps)
                continue
            c = np.asarray(c, float)
            c0, c = (c[0], c[1:]) if constant else (0.0, c)
            phi = np.zeros(max([0, *ar]) + 1)
            phi[0] = 1.0
            phi[ar] = -c[: len(ar)]
            theta = np.zeros(max([0, *ma, steps]) + 1)
            theta[0] = 1.0
            theta[ma] = c[len(ar) :]
            full = -np.convolve(phi, poly)[1:]
            level, shock = list(ys), list(es)
            psi, points = [1.0], []
            for h in range(1, steps + 1):
                moving = sum(theta[h + j] * shock[j] for j in range(min(len(shock), len(theta) - h)))
                value = c0 + sum(f * v for f, v in zip(full, level)) + moving
                level.insert(0, value)
                spread = z * np.sqrt(s2 * sum(w * w for w in psi))
                points.append({"yhat": value, "lower": value - spread, "upper": value + spread})
                psi.append(theta[h] + sum(f * psi[h - 1 - i] for i, f in enumerate(full[:h])))
            out.append(points)
        return pd.Series(out)

    step = F.col("step")
    moved = {
        "hour": lambda: F.timestamp_add("HOUR", step, F.col("last_ts")),
        "day": lambda: F.date_add("last_ts", step),
        "month": lambda: F.add_months("last_ts", step),
    }[period]()
    return (
        fit.select(*keys, "last_ts", F.posexplode(ahead("coef", "sigma2", "last_y", "last_e")).alias("_i", "_p"))
        .withColumn("step", F.col("_i") + 1)
        .select(*keys, "step", moved.alias("ts"), "_p.yhat", "_p.lower", "_p.upper")
    )


def apply_fit(
    df: DataFrame, fit: DataFrame, order: Order, keys: Sequence[str] = KEYS, ts: str = "ts", y: str = "y"
) -> DataFrame:
    """One-step forecasts of every period with saved coefficients: (keys, ts, y, yhat, residual).

    ``df`` is the history with new observations appended. The innovations of a
    moving-average part follow from the coefficients, from the start of the
    history on.
    """
    known = fit.select(*keys, "coef")
    if not order.ma:
        base = _with_lags(_differenced(df, order, keys, ts, y).join(known, list(keys)), "_w", order.ar, "_l", keys, ts).withColumn("_one", F.lit(1.0))
        names = [*(["_one"] if order.constant else []), *[f"_l{k}" for k in order.ar]]
        yhat = _linear("coef", names) + F.col("_base")
        return base.where(_complete(names)).select(*keys, ts, "y", yhat.alias("yhat"), (F.col("y") - yhat).alias("residual"))
    poly, start = order.polynomial(), max([0, *order.ar])

    @F.pandas_udf("array<double>")
    def shocks(values: pd.Series, coef: pd.Series) -> pd.Series:
        """Innovation of every period; none before the model has its lags, or without coefficients."""
        out = []
        for v, c in zip(values, coef, strict=True):
            level = np.array([np.nan if x is None else x for x in v], dtype=float)
            w = inn.differenced(level, poly)
            held = np.full(len(level), np.nan)
            if c is not None and len(w) > start:
                e, _ = inn._recursion(np.nan_to_num(w)[None], np.array([len(w)]), order.ar, order.ma, order.constant, np.asarray(c, float)[None], False)
                held[len(level) - len(w) + start :] = e[0, start:]
            out.append([None if np.isnan(x) else float(x) for x in held])
        return pd.Series(out)

    times = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(y).cast("double").alias("y"))))
    rows = df.groupBy(*keys).agg(times.alias("_h")).join(known, list(keys))
    found = rows.withColumn("_e", shocks(F.transform("_h", lambda h: h["y"]), "coef"))
    each = found.select(*keys, F.inline(F.arrays_zip(F.transform("_h", lambda h: h["t"]).alias(ts), F.transform("_h", lambda h: h["y"]).alias("y"), F.col("_e").alias("residual"))))
    return each.where("residual IS NOT NULL").select(*keys, ts, "y", (F.col("y") - F.col("residual")).alias("yhat"), "residual")


def ar_fit(df: DataFrame, p: int, d: int = 0, D: int = 0, s: int = 0, **names) -> DataFrame:
    return arima_fit(df, Order(p, d, 0, 0, D, 0, s), **names)


def ar_forecast(fit: DataFrame, p: int, d: int = 0, D: int = 0, s: int = 0, steps: int = 12, **names) -> DataFrame:
    return arima_forecast(fit, Order(p, d, 0, 0, D, 0, s), steps, **names)


def bias_correct(
    df: DataFrame, calibration: Column, keys: Sequence[str] = KEYS, y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """Add the mean residual of the calibration rows to every forecast."""
    bias = df.where(calibration).groupBy(*keys).agg(F.avg(F.col(y) - F.col(yhat)).alias("bias"))
    return df.join(bias, list(keys), "left").withColumn(
        "yhat_corrected", F.col(yhat) + F.coalesce("bias", F.lit(0.0))
    )
