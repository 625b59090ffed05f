"""Projection, filtering and cleaning of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from incidentkit.functions import dates


def select_rename(df: DataFrame, mapping: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Keep and rename columns, by ``{old: new}`` or by position with a name list.

    Positional renaming serves exports whose headings change between years.
    """
    if isinstance(mapping, Mapping):
        return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items()])
    if len(mapping) != len(df.columns):
        raise ValueError(f"{len(mapping)} names for {len(df.columns)} columns")
    return df.toDF(*mapping)


def drop_events(df: DataFrame, kind: str = "kind", event: str = "Event") -> DataFrame:
    """Drop monitoring events; rows without a kind stay."""
    return df.where(~F.col(kind).eqNullSafe(event))


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    """Rows equal to ``value``; ``None`` keeps the rows where the column is empty."""
    return df.where(F.col(column).isNull() if value is None else F.col(column) == F.lit(value))


def filter_filled(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


#: Rows of one hash prefix that are ranked next to each other at most.
RANKED = 100_000


def stable_hash(key: Column, seed: int = 0) -> Column:
    """Hex digest of key and seed: the same on every engine and every run."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``min(n, rows)`` rows without replacement, repeatable for one seed.

    The rows with the n smallest hashes. A histogram over four hex digits finds
    the hash prefix that holds rank n; while that prefix has more than RANKED
    rows, four more digits of it are counted. Prefixes below it are kept whole,
    and only the rows of the last one are ranked.
    """
    hashed = df.withColumn("_hash", stable_hash(F.col(key), seed))
    prefix, take, digits = "", n, 0
    while digits < 32:
        digits += 4
        found = hashed.where(F.col("_hash").startswith(prefix)).groupBy(F.substring("_hash", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("rows"))
        in_order = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)  # 16 ** 4 rows at most
        edge = found.withColumn("upto", F.sum("rows").over(in_order)).where(F.col("upto") - F.col("rows") < take).orderBy(F.desc("p")).first()
        if edge is None:
            return df.limit(0)
        prefix, take = edge.p, take - (edge.upto - edge.rows)
        if edge.rows <= RANKED:
            break
    whole = hashed.where(F.substring("_hash", 1, digits) < prefix)
    rank = F.row_number().over(Window.partitionBy(F.substring("_hash", 1, digits)).orderBy("_hash", key))
    rest = hashed.where(F.col("_hash").startswith(prefix)).withColumn("_rank", rank).where(F.col("_rank") <= take)
    return whole.select(*df.columns).unionByName(rest.select(*df.columns))


def in_fraction(key: Column, fraction: float, seed: int = 0) -> Column:
    """True for about ``fraction`` of the keys, decided by the key alone."""
    bucket = F.conv(F.substring(stable_hash(key, seed), 1, 8), 16, 10).cast("bigint")
    return bucket < F.lit(int(fraction * 2**32))


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    return df.where(in_fraction(F.col(key), fraction, seed))


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of nulls and of filled values, in one scan."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                (F.col("_rows") - F.col(f"`{c}`")).alias("nulls"),
                F.col(f"`{c}`").alias("filled"),
            )
            for c in df.columns
        ]
    )
    return counted.select(F.inline(entries))


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values of the given columns, or of whole rows."""
    return (df.select(*columns) if columns else df).distinct()


def month_keys(df: DataFrame, ts: str) -> DataFrame:
    """Add ``yyyymm``, year, short month name and date of a timestamp column."""
    c = F.col(ts)
    return df.withColumns(
        {
            "month": dates.month_key(c),
            "year": F.year(c),
            "month_name": F.date_format(c, "MMM"),
            "day": c.cast("date"),
        }
    )


def any_contains(df: DataFrame, columns: Sequence[str], word: str) -> DataFrame:
    """Rows where any of the columns holds the word, whatever its case."""
    tests = [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(word.lower())), F.lit(False)) for c in columns]
    return df.where(reduce(lambda a, b: a | b, tests))


def unpivot_variants(
    df: DataFrame, ids: Sequence[str], variants: Sequence[str], value: str = "request"
) -> DataFrame:
    """One row per filled variant column, without repeats."""
    long = df.unpivot(list(ids), list(variants), "_variant", value)
    return long.drop("_variant").dropna(subset=[value]).distinct()


def union_series(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), others, first)


def unfold(df: DataFrame, tokens: Column | str, name: str, *keep: str) -> DataFrame:
    """One row per token, with the kept columns.

    The outer form with a filter behind it gives the same rows as a plain
    explode, but the optimiser does not derive a second evaluation of the
    tokens, ``size(tokens) > 0``, to run below the last shuffle.
    """
    return df.select(*keep, F.explode_outer(tokens).alias(name)).where(F.col(name).isNotNull())
