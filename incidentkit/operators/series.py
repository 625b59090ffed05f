"""Decomposition, correlation and stationarity of many series.

Series tables hold one row per series and period, see
:mod:`incidentkit.operators.windows`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from incidentkit.operators import least_squares as ls
from incidentkit.operators.aggregates import describe_numeric, histogram, kde
from incidentkit.operators.windows import along
from incidentkit.session import checkpoint

KEYS = ("series_id",)


def decompose(
    df: DataFrame,
    season: int,
    model: str = "additive",
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    y: str = "y",
) -> DataFrame:
    """Add trend, seasonal and residual columns; trend and residual are null at the edges.

    Trend is a centred moving average (half weight on both ends for an even
    season), seasonal the mean of the detrended values per phase, normalised.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError(model)
    w = along(keys, ts)
    half = season // 2
    span = w.rowsBetween(-half, half)
    total = F.sum(y).over(span)
    if season % 2 == 0:
        total = total - 0.5 * (F.lag(y, half).over(w) + F.lead(y, half).over(w))
    full = F.count(y).over(span) == 2 * half + 1
    additive = model == "additive"
    trended = df.withColumns(
        {
            "_phase": (F.row_number().over(w) - 1) % season,
            "trend": F.when(full, total / season),
        }
    )
    rest = F.col(y) - F.col("trend") if additive else F.col(y) / F.col("trend")
    phases = trended.groupBy(*keys, "_phase").agg(F.avg(rest).alias("_mean"))
    level = F.avg("_mean").over(Window.partitionBy(*keys))
    phases = phases.select(
        *keys,
        "_phase",
        (F.col("_mean") - level if additive else F.col("_mean") / level).alias("seasonal"),
    )
    joined = trended.join(phases, [*keys, "_phase"]).drop("_phase")
    if additive:
        return joined.withColumn("residual", F.col(y) - F.col("trend") - F.col("seasonal"))
    return joined.withColumn("residual", F.col(y) / F.col("trend") / F.col("seasonal"))


def deseasonalise(df: DataFrame, season: int, keys: Sequence[str] = KEYS, ts: str = "ts", y: str = "y") -> DataFrame:
    """Observed minus seasonal minus trend, without the edges."""
    parts = decompose(df, season, "additive", keys, ts, y).where(F.col("trend").isNotNull())
    return parts.select(*keys, ts, F.col("residual").alias(y))


def _autocovariances(df: DataFrame, lags: int, keys, ts, y) -> DataFrame:
    centred = df.withColumn("_d", F.col(y) - F.avg(y).over(Window.partitionBy(*keys)))
    w = along(keys, ts)
    shifted = centred.select(
        *keys, "_d", *[F.lag("_d", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)]
    )
    return shifted.groupBy(*keys).agg(
        F.count("_d").alias("n"),
        F.array(
            F.sum(F.col("_d") * F.col("_d")),
            *[F.sum(F.col("_d") * F.col(f"_l{k}")) for k in range(1, lags + 1)],
        ).alias("cov"),
    )


def acf(df: DataFrame, lags: int = 20, keys: Sequence[str] = KEYS, ts: str = "ts", y: str = "y") -> DataFrame:
    """Autocorrelation per lag 0..lags with the 95 % band around zero."""
    cov = _autocovariances(df, lags, keys, ts, y)
    r = F.transform("cov", lambda c: c / F.get("cov", F.lit(0)))
    return cov.select(*keys, "n", F.posexplode(r).alias("lag", "acf")).withColumn(
        "band", 1.96 / F.sqrt("n")
    )


def pacf(
    df: DataFrame,
    lags: int = 7,
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    y: str = "y",
    adjusted: bool = True,
) -> DataFrame:
    """Partial autocorrelation per lag 0..lags by the Levinson-Durbin recursion.

    ``adjusted`` divides each autocovariance by the number of its products.
    """

    @F.pandas_udf("array<double>")
    def partial(covs: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for cov, n in zip(covs, sizes):
            g = np.asarray(cov, float) / ((n - np.arange(len(cov))) if adjusted else n)
            phi, err, result = np.zeros(0), g[0], [1.0]
            for k in range(1, len(g)):
                last = (g[k] - phi @ g[k - 1 : 0 : -1]) / err if err > 0 else np.nan
                phi = np.append(phi - last * phi[::-1], last)
                err *= 1 - last * last
                result.append(last)
            out.append(result)
        return pd.Series(out)

    cov = _autocovariances(df, lags, keys, ts, y)
    return cov.select(*keys, "n", F.posexplode(partial("cov", "n")).alias("lag", "pacf")).withColumn(
        "band", 1.96 / F.sqrt("n")
    )


# MacKinnon (2010) response surface for one variable,
# level -> (b0, b1, b2, b3) of b0 + b1/n + b2/n^2 + b3/n^3.
CRITICAL = {
    "n": {
        "crit_1": (-2.56574, -2.2358, -3.627, 0.0),
        "crit_5": (-1.94100, -0.2686, -3.365, 31.223),
        "crit_10": (-1.61682, 0.2656, -2.714, 25.364),
    },
    "c": {
        "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
        "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
        "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
    },
    "ct": {
        "crit_1": (-3.95877, -9.0531, -28.428, -134.155),
        "crit_5": (-3.41049, -4.3904, -9.036, -45.374),
        "crit_10": (-3.12705, -2.5856, -3.925, -22.380),
    },
}


# MacKinnon (1994) approximation of the p value for one variable. The normal quantile is a polynomial
# of the statistic, with one set of coefficients up to "turn" and another beyond; outside low..high it is 0 or 1.
P_SURFACE = {
    "n": {"low": -19.04, "turn": -1.04, "high": float("inf"), "left": (0.6344, 1.2378, 0.032496), "right": (0.4797, 0.93557, -0.06999, 0.033066)},
    "c": {"low": -18.83, "turn": -1.61, "high": 2.74, "left": (2.1659, 1.4412, 0.038269), "right": (1.7339, 0.93202, -0.12745, -0.010368)},
    "ct": {"low": -16.18, "turn": -2.89, "high": 0.7, "left": (3.2512, 1.6047, 0.049588), "right": (2.5261, 0.61654, -0.37956, -0.060285)},
}


def _normal_share(z: Column) -> Column:
    """Share of a standard normal below z, to seven places (published rational approximation)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * tail
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def p_value(stat: Column, trend: str = "c") -> Column:
    """Approximate p value of a unit-root statistic."""
    s = P_SURFACE[trend]

    def polynomial(c: Sequence[float]) -> Column:
        out = F.lit(0.0)
        for x in reversed(c):
            out = out * stat + x
        return out

    z = F.when(stat <= s["turn"], polynomial(s["left"])).otherwise(polynomial(s["right"]))
    return F.when(stat > s["high"], 1.0).when(stat < s["low"], 0.0).when(stat.isNotNull(), _normal_share(z))


def adf_test(
    df: DataFrame,
    max_lag: int | None = None,
    trend: str = "c",
    choose: str = "aic",
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    y: str = "y",
    most: float = 0.05,
) -> DataFrame:
    """Augmented Dickey-Fuller test: (keys, stat, used_lag, nobs, crit_1, crit_5, crit_10, p_value, stationary).

    ``choose='fixed'`` uses ``max_lag`` itself; ``'aic'`` picks the best lag up
    to it on a common sample and then fits that lag on all its rows. Without
    ``max_lag`` every series has its own bound, 12 * (rows / 100)^(1/4) rounded
    up, and at most rows / 2 less the deterministic terms and one. A series is
    stationary up to a p value of ``most``.
    """
    if trend not in CRITICAL:
        raise ValueError(trend)
    terms = {"n": 0, "c": 1, "ct": 2}[trend]
    # Read for the bound, the choice and again for the fit.
    df = checkpoint(df.select(*keys, ts, y)) if choose == "aic" or max_lag is None else df
    if max_lag is None:
        rule = F.least(F.ceil(12 * F.pow(F.col("_rows") / 100, 0.25)), F.floor(F.col("_rows") / 2) - terms - 1)
        bounds = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).select(*keys, F.greatest(rule, F.lit(0)).cast("int").alias("_bound"))
        bounds = checkpoint(bounds)
        max_lag = bounds.agg(F.max("_bound")).first()[0] or 0
        df = df.join(bounds, list(keys))
    else:
        df = df.withColumn("_bound", F.lit(max_lag))
    w = along(keys, ts)
    diffs = df.withColumns(
        {
            "_rank": F.row_number().over(w),
            "_level": F.lag(y, 1).over(w),
            "_dy": F.col(y) - F.lag(y, 1).over(w),
        }
    )
    deterministic = {"n": [], "c": ["_one"], "ct": ["_one", "_trend"]}[trend]
    design = diffs.withColumns(
        {
            "_one": F.lit(1.0),
            "_trend": F.col("_rank").cast("double"),
            **{f"_x{k}": F.lag("_dy", k).over(w) for k in range(1, max_lag + 1)},
        }
    ).where(F.col("_rank") > 1)
    lags = [f"_x{k}" for k in range(1, max_lag + 1)]
    columns = ["_dy", "_level", *deterministic, *lags, "_count"]
    size, fixed = len(columns), 1 + len(deterministic)
    design = design.withColumn("_count", F.lit(1.0))

    def used(lag: int) -> list[int]:
        return list(range(1, 1 + fixed + lag))

    @F.pandas_udf("int")
    def best_lag(grams: pd.Series, bound: pd.Series) -> pd.Series:
        g = ls.square(grams, size)
        n = g[:, -1, -1]
        aic = []
        for lag in range(max_lag + 1):
            _, rss, _ = ls.solve(g, 0, used(lag))
            score = n * np.log(np.maximum(rss, 1e-300) / n) + 2 * (fixed + lag)
            aic.append(np.where(np.isfinite(score) & (n > fixed + lag + 1) & (lag <= bound.to_numpy()), score, np.inf))
        return pd.Series(np.argmin(np.stack(aic), axis=0).astype("int32"))

    if choose == "aic":
        whole = design.where(F.col("_rank") > F.col("_bound") + 1).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in lags})
        common = ls.product_sums(whole, [*keys, "_bound"], columns)
        chosen = common.select(*keys, best_lag("gram", "_bound").alias("used_lag"))
        sample = design.join(chosen, list(keys))
    else:
        sample = design.withColumn("used_lag", F.col("_bound"))
    # Lags beyond the chosen one are not used; zero keeps their rows in the sums.
    sample = sample.where(F.col("_rank") > F.col("used_lag") + 1).withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in lags}
    )
    grams = ls.product_sums(sample, [*keys, "used_lag"], columns)

    @F.pandas_udf("double")
    def statistic(grams: pd.Series, lag: pd.Series) -> pd.Series:
        g = ls.square(grams, size)
        out = np.full(len(g), np.nan)
        for value in lag.unique():
            at = (lag == value).to_numpy()
            beta, rss, inverse = ls.solve(g[at], 0, used(int(value)))
            free = g[at][:, -1, -1] - (fixed + value)
            with np.errstate(all="ignore"):
                t = beta[:, 0] / np.sqrt(rss / free * inverse[:, 0])
            out[at] = np.where(free > 0, t, np.nan)
        return pd.Series(out)

    nobs = F.element_at("gram", -1)

    def surface(b: tuple[float, ...]) -> Column:
        n = F.col("nobs")
        return F.lit(b[0]) + b[1] / n + b[2] / (n * n) + b[3] / (n * n * n)

    tested = grams.select(
        *keys, F.nanvl(statistic("gram", "used_lag"), F.lit(None)).alias("stat"), "used_lag", nobs.cast("bigint").alias("nobs")
    ).withColumns({name: surface(b) for name, b in CRITICAL[trend].items()})
    tested = tested.withColumn("p_value", p_value(F.col("stat"), trend))
    return tested.withColumn("stationary", F.coalesce(F.col("p_value") <= most, F.lit(False)))


def difference_order(
    df: DataFrame,
    max_lag: int = 12,
    adf_lag: int = 15,
    trend: str = "ct",
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    y: str = "y",
) -> DataFrame:
    """(keys, lag): first difference lag below ``max_lag`` whose series is stationary, else null."""
    w = along(keys, ts)
    lagged = F.array(
        *[
            F.struct(F.lit(k).alias("diff_lag"), (F.col(y) - F.lag(y, k).over(w)).alias("diff"))
            for k in range(1, max_lag)
        ]
    )
    # Two steps: a window expression may not sit inside the generator.
    wide = df.select(*keys, ts, lagged.alias("_all"))
    long = wide.select(*keys, ts, F.inline("_all")).where(F.col("diff").isNotNull())
    tested = adf_test(long, adf_lag, trend, "fixed", [*keys, "diff_lag"], ts, "diff")
    return tested.groupBy(*keys).agg(F.min(F.when(F.col("stationary"), F.col("diff_lag"))).alias("lag"))


def level_or_seasonal(
    df: DataFrame, season: int = 12, most: float = 0.01, keys: Sequence[str] = KEYS, ts: str = "ts", y: str = "y"
) -> DataFrame:
    """The series as it is where the test's p value is at most ``most``, else its seasonal difference; ``lag`` says which."""
    tested = adf_test(df, None, "c", "aic", keys, ts, y, most)
    choice = tested.select(*keys, F.col("stationary").alias("_keep"))
    w = along(keys, ts)
    both = df.withColumn("_diff", F.col(y) - F.lag(y, season).over(w)).join(choice, list(keys))
    return both.select(
        *keys,
        ts,
        F.when(F.col("_keep"), F.col(y)).otherwise(F.col("_diff")).alias(y),
        F.when(F.col("_keep"), 0).otherwise(season).alias("lag"),
    ).where(F.col(y).isNotNull())


def residual_report(
    df: DataFrame, residual: str = "residual", keys: Sequence[str] = KEYS, ts: str = "ts", bins: int = 10, points: int = 50, lags: int = 20
) -> dict[str, DataFrame]:
    """Description, histogram, density and autocorrelation of residuals."""
    return {
        "describe": describe_numeric(df, residual, keys),
        "histogram": histogram(df, residual, bins, keys),
        "density": kde(df, residual, points, keys),
        "acf": acf(df.where(F.col(residual).isNotNull()), lags, keys, ts, residual),
    }
