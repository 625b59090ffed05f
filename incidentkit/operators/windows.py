"""Calendar spines and operators along the time axis of a series.

A series table has one row per series and period (:func:`resample` makes it
so). The rows of one series are therefore bounded by the calendar, not by the
number of tickets behind it, and may share one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from incidentkit.operators.ranking import global_rank
from incidentkit.operators.rows import in_fraction


def along(keys: Sequence[str], ts: str):
    return Window.partitionBy(*keys).orderBy(ts)


def month_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every month from start to end, both included, as date and ``yyyymm``."""
    months = F.sequence(
        F.trunc(F.lit(start).cast("date"), "month"),
        F.trunc(F.lit(end).cast("date"), "month"),
        F.make_ym_interval(F.lit(0), F.lit(1)),
    )
    one = spark.range(1).select(F.explode(months).alias("month_start"))
    return one.withColumn(
        "month", (F.year("month_start") * 100 + F.month("month_start")).cast("bigint")
    )


def difference(
    df: DataFrame, lag: int = 1, keys: Sequence[str] = ("series_id",), ts: str = "ts", y: str = "y"
) -> DataFrame:
    """y minus y of ``lag`` rows before; the first rows of a series fall away."""
    w = along(keys, ts)
    rank = F.row_number().over(w)
    return (
        df.withColumn("_before", F.lag(y, lag).over(w))
        .withColumn("_rank", rank)
        .where(F.col("_rank") > lag)
        .withColumn(y, F.col(y) - F.col("_before"))
        .drop("_before", "_rank")
    )


def undo_difference(
    forecast: DataFrame,
    history: DataFrame,
    lag: int = 1,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    y: str = "y",
    values: Sequence[str] = ("yhat",),
) -> DataFrame:
    """Add the level of ``lag`` periods before to forecasts (and their limits).

    ``history`` holds the levels on the same calendar; each level is carried to
    the period it belongs to with one window, then joined on series and period.
    """
    w = along(keys, ts)
    both = history.select(*keys, ts, F.col(y).alias("_level")).unionByName(
        forecast.join(history.select(*keys, ts), [*keys, ts], "left_anti").select(
            *keys, ts, F.lit(None).cast("double").alias("_level")
        )
    )
    base = both.withColumn("_base", F.lag("_level", lag).over(w)).select(*keys, ts, "_base")
    joined = forecast.join(base, [*keys, ts])
    return joined.withColumns({c: F.col(c) + F.col("_base") for c in values}).drop("_base")


def _numbered(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.withColumns(
        {
            "_rank": F.row_number().over(along(keys, ts)),
            "_rows": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    )


def split_last(
    df: DataFrame, n: int = 12, keys: Sequence[str] = ("series_id",), ts: str = "ts"
) -> tuple[DataFrame, DataFrame]:
    """(training, hold-out) with the last n periods of every series held out."""
    numbered = _numbered(df, keys, ts)
    late = F.col("_rank") > F.col("_rows") - n
    return (
        numbered.where(~late).drop("_rank", "_rows"),
        numbered.where(late).drop("_rank", "_rows"),
    )


def split_ratio(
    df: DataFrame, ratio: float, keys: Sequence[str] = ("series_id",), ts: str = "ts"
) -> tuple[DataFrame, DataFrame]:
    """(training, hold-out) with the first ``int(rows * ratio)`` periods for training."""
    numbered = _numbered(df, keys, ts)
    early = F.col("_rank") <= F.floor(F.col("_rows") * F.lit(ratio))
    return (
        numbered.where(early).drop("_rank", "_rows"),
        numbered.where(~early).drop("_rank", "_rows"),
    )


def split_date(df: DataFrame, ts: str, cut: str) -> tuple[DataFrame, DataFrame]:
    """(before, on or after) a date."""
    day = F.lit(cut).cast("date")
    return df.where(F.col(ts) < day), df.where(F.col(ts) >= day)


def split_random(
    df: DataFrame, fraction: float, key: str, seed: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(training, hold-out) by the hash of a key, the same on every run."""
    held = in_fraction(F.col(key), fraction, seed)
    return df.where(~held), df.where(held)


def persistence_forecast(
    df: DataFrame, keys: Sequence[str] = ("series_id",), ts: str = "ts", y: str = "y"
) -> DataFrame:
    """Walk-forward forecast that repeats the previous value."""
    return df.withColumn("yhat", F.lag(y, 1).over(along(keys, ts)))


def backfill(
    df: DataFrame, keys: Sequence[str] = ("series_id",), ts: str = "ts", y: str = "y"
) -> DataFrame:
    """Empty values take the next filled value of the series."""
    ahead = along(keys, ts).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(y, F.first(y, ignorenulls=True).over(ahead))


def running_total(df: DataFrame, by: Sequence[str], order: str, measure: str) -> DataFrame:
    """Measure summed per group and period, and accumulated over the periods.

    Summing first leaves one row per group and period, so no group sends its
    raw rows through one window.
    """
    per_period = df.groupBy(*by, order).agg(F.sum(measure).alias(measure))
    w = along(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return per_period.withColumn("running", F.sum(measure).over(w))


def rank_by_length(df: DataFrame, column: str, tie: str, lines: bool = False) -> DataFrame:
    """(tie, size, rank): rows numbered from longest to shortest text, or from most to fewest lines.

    Only keys and sizes are ranked; join the texts by key where they are wanted.
    """
    ended = F.regexp_replace(column, r"(\r\n|\n|\r)\z", "")
    size = F.size(F.split(ended, r"\r\n|\n|\r")) if lines else F.length(column)
    return global_rank(df.select(tie, size.alias("size")), F.col("size").desc(), F.col(tie))


def actual_vs_forecast(
    actual: DataFrame,
    forecast: DataFrame,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    band: float = 0.15,
) -> DataFrame:
    """Actual and forecast side by side with a tolerance band around the actual value."""
    y, yhat = F.col("y"), F.col("yhat")
    return actual.join(forecast, [*keys, ts], "inner").withColumns(
        {
            "error": y - yhat,
            "lower": y * (1 - band),
            "upper": y * (1 + band),
            "within_band": yhat.between(
                F.least(y * (1 - band), y * (1 + band)), F.greatest(y * (1 - band), y * (1 + band))
            ),
        }
    )
