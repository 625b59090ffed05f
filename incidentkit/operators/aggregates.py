"""Counts, summaries and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from incidentkit.functions import dates
from incidentkit.operators.beside import beside
from incidentkit.operators.ranking import exact_quantiles
from incidentkit.operators.rows import unfold


def top_counts(df: DataFrame, key: str, n: int, count: str = "*") -> DataFrame:
    """The n most frequent keys, counting the filled values of ``count``."""
    counted = F.count(F.lit(1)) if count == "*" else F.count(count)
    return (
        df.groupBy(key)
        .agg(counted.alias("n"))
        .orderBy(F.col("n").desc(), F.col(key).asc_nulls_last())
        .limit(n)
    )


def describe_numeric(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max."""
    c = F.col(column).cast("double")
    basics = df.groupBy(*by).agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )
    quartiles = exact_quantiles(df, column, [0.25, 0.5, 0.75], by)
    joined = (
        basics.join(quartiles, list(by), "left")
        if by
        else basics.withColumn("quantiles", quartiles.scalar())
    )
    return joined.select(
        *by,
        "count",
        "mean",
        "std",
        "min",
        *[F.get("quantiles", F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))],
        "max",
    )


def below_quantile(df: DataFrame, column: str, q: float = 0.95, exact: bool = True) -> DataFrame:
    """Rows strictly below a quantile of the column."""
    if exact:
        limit = exact_quantiles(df, column, [q]).select(F.get("quantiles", F.lit(0)))
    else:
        limit = df.agg(F.percentile_approx(column, q))
    return df.where(F.col(column) < limit.scalar())


def majority_baseline(df: DataFrame, label: str) -> DataFrame:
    """Largest class and its share: the accuracy any classifier has to beat."""
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return per_class.agg(
        F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label))).alias("label"),
        F.max("n").alias("n"),
        (F.max("n") / F.sum("n")).alias("share"),
    )


def crosstab_counts(
    df: DataFrame, a: str, b: str, pivot: bool = False, values: Sequence | None = None
) -> DataFrame:
    """Rows per pair of values, long or with one column per value of ``b``."""
    if not pivot:
        return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    if values is None:
        raise ValueError("name the values that become columns, or stay long")
    # Two steps: the pivot then only sees one row per pair.
    pairs = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(a).pivot(b, list(values)).agg(F.sum("n")).na.fill(0)


def keep_repeated(
    df: DataFrame, key: str, min_count: int = 2, counted: Column | None = None
) -> DataFrame:
    """All rows of the keys that have at least ``min_count`` rows meeting ``counted``."""
    pool = df if counted is None else df.where(counted)
    frequent = pool.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count)
    return beside(df, frequent.select(key), [key], "left_semi")


def best_per_group(df: DataFrame, key: str, score: str, tie: Sequence[str]) -> DataFrame:
    """The row with the highest score per key; ties go to the lowest tie key.

    One aggregate with map-side combine, so a hot key is reduced before it moves.
    """
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(-F.col(score), *tie))
    return df.groupBy(key).agg(best.alias("_best")).select(key, *[F.col(f"_best.{c}") for c in rest])


def word_counts(df: DataFrame, tokens: str, n: int) -> DataFrame:
    """The n most frequent lower-cased words over all documents."""
    words = unfold(df, tokens, "word").select(F.lower("word").alias("word"))
    return top_counts(words, "word", n)


def year_matrix(
    df: DataFrame, ts: str, y: str, years: Sequence[int] | None = None, transpose: bool = False
) -> DataFrame:
    """Months by years table of sums; transposed, years by months."""
    cells = df.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month")).agg(F.sum(y).alias("y"))
    if transpose:
        return cells.groupBy("year").pivot("month", list(range(1, 13))).agg(F.sum("y"))
    if years is None:
        raise ValueError("name the years that become columns")
    return cells.groupBy("month").pivot("year", list(years)).agg(F.sum("y"))


def box_stats(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """What a box plot shows: quartiles, whiskers at 1.5 box lengths, number outside."""
    by = list(by)
    q = exact_quantiles(df, y, [0.25, 0.5, 0.75], by).select(
        *by,
        *[F.get("quantiles", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median", "q3"))],
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    limits = q.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})
    v = F.col(y)
    inside = v.between(F.col("_low"), F.col("_high"))
    return (
        beside(df.where(v.isNotNull()), limits, by)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows per equal-width bin between minimum and maximum; the last bin is closed."""
    by = list(by)
    v = F.col(column).cast("double")
    filled = df.where(v.isNotNull())
    span = filled.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    counts = filled.groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        placed = beside(counts, span, by)
    else:
        placed = counts.withColumn("_s", span.select(F.struct("lo", "hi")).scalar()).select(
            "_v", "_n", "_s.lo", "_s.hi"
        )
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("lo")) / width), F.lit(bins - 1)))
    return (
        placed.withColumn("bin", F.coalesce(place, F.lit(0)).cast("int"))
        .groupBy(*by, "bin")
        .agg(F.sum("_n").alias("n"), F.first("lo").alias("_lo"), F.first(width).alias("_w"))
        .select(*by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lower"), "n")
    )


def kde(df: DataFrame, column: str, points: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth n^(-1/5) deviations.

    Equal values are collapsed first and the grid is a literal list of
    positions, so each distinct value is unfolded ``points`` times and summed
    per group and grid point before anything moves.
    """
    by = list(by)
    v = F.col(column).cast("double")
    filled = df.where(v.isNotNull())
    shape = filled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        (F.stddev_samp(v) * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h"),
    )
    counts = filled.groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    if by:
        placed = beside(counts, shape, by)
    else:
        placed = counts.withColumn(
            "_s", shape.select(F.struct("n", "lo", "hi", "h")).scalar()
        ).select("_v", "_k", "_s.*")
    steps = F.explode(F.array(*[F.lit(i) for i in range(points)]))
    x = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / F.lit(points - 1)
    u = (F.col("x") - F.col("_v")) / F.col("h")
    mass = F.col("_k") * F.exp(-0.5 * u * u) / (F.col("n") * F.col("h") * F.sqrt(F.lit(2) * F.pi()))
    return (
        placed.withColumn("point", steps)
        .withColumn("x", x)
        .groupBy(*by, "point", "x")
        .agg(F.sum(mass).alias("density"))
    )


def resample(
    df: DataFrame,
    ts: str,
    y: str,
    period: str = "month",
    how: str = "avg",
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per series and period; periods without data appear with null.

    ``how`` is avg, sum, count, min or max. The spine runs from the first to the
    last period of each series.
    """
    keys = list(keys)
    start = dates.period_start(F.col(ts), period)
    step = {
        "hour": F.make_dt_interval(F.lit(0), F.lit(1)),
        "day": F.make_dt_interval(F.lit(1)),
        "week": F.make_dt_interval(F.lit(7)),
        "month": F.make_ym_interval(F.lit(0), F.lit(1)),
        "year": F.make_ym_interval(F.lit(1)),
    }[period]
    measure = getattr(F, how)(F.col(y))
    filled = df.where(F.col(ts).isNotNull()).groupBy(*keys, start.alias("ts")).agg(measure.alias("y"))
    ends = filled.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    spine = ends.select(*keys, F.explode(F.sequence("_a", "_b", step)).alias("ts"))
    return spine.join(filled, [*keys, "ts"], "left")


def period(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


def error_metrics(
    df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ("series_id",)
) -> DataFrame:
    """MSE, RMSE and mean residual over the rows that have both values."""
    error = F.col(y) - F.col(yhat)
    return df.where(error.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"),
    )


def rollup_totals(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums per dimension prefix with a grand total; ``level`` counts the rolled-up columns."""
    return df.rollup(*dims).agg(
        *[F.sum(m).alias(m) for m in measures],
        sum(F.grouping(d) for d in dims).cast("int").alias("level"),
    )
