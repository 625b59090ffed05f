"""Joins between tickets, templates, catalogues and snapshots.

Adaptive execution broadcasts a side once its measured size allows it, and splits
a hot key where both sides are plain shuffles; where one side is aggregated on the
join key, :func:`incidentkit.operators.beside.beside` does it instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from incidentkit.functions import dates, text as T
from incidentkit.operators.aggregates import top_counts
from incidentkit.operators.template_index import Index, candidates, ordered
from incidentkit.session import checkpoint


def keep_top_categories(df: DataFrame, key: str, n: int = 50) -> DataFrame:
    """Rows whose key is among the n most frequent ones; ties go to the lower key."""
    filled = df.where(F.col(key).isNotNull())
    return df.join(top_counts(filled, key, n).select(key), key, "left_semi")


def open_backlog(
    tickets: DataFrame,
    opened: str,
    closed: str,
    first: int,
    last: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """Tickets open in each month from ``first`` to ``last`` (``yyyymm`` both).

    A ticket counts in month m if opened <= m <= closed. Instead of joining
    tickets with months it adds one at the opening month and takes one off in
    the month after closing; the months are then accumulated. Only one row per
    month and group leaves the map side.
    """
    by = list(by)
    lo, hi = dates.month_index(F.lit(first)), dates.month_index(F.lit(last))
    ranged = tickets.select(
        *by,
        F.greatest(dates.month_index(F.col(opened)), lo).alias("_from"),
        (F.least(dates.month_index(F.col(closed)), hi) + 1).alias("_to"),
    ).where(F.col("_from") < F.col("_to"))
    steps = (
        ranged.select(
            *by,
            F.inline(
                F.array(
                    F.struct(F.col("_from").alias("_m"), F.lit(1).alias("_step")),
                    F.struct(F.col("_to").alias("_m"), F.lit(-1).alias("_step")),
                )
            ),
        )
        .groupBy(*by, "_m")
        .agg(F.sum("_step").alias("_step"))
    )
    if by:
        spine = tickets.select(*by).distinct().withColumn("_m", F.explode(F.sequence(lo, hi)))
    else:
        spine = tickets.sparkSession.range(1).select(F.explode(F.sequence(lo, hi)).alias("_m"))
    so_far = Window.partitionBy(*by).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spine.join(steps, [*by, "_m"], "left")
        .withColumn("open", F.coalesce(F.sum("_step").over(so_far), F.lit(0)))
        .select(*by, dates.key_of_index(F.col("_m")).alias("month"), "open")
    )


def match_templates(tickets: DataFrame, templates: DataFrame, keys: Sequence[str], request: str = "request") -> DataFrame:
    """Description captured by the first matching template of the ticket's kind and category.

    ``templates`` has the keys, ``template_id`` and ``regex``. Longest pattern
    first, then lowest id. Without a match the capture is null. Which templates
    can match is found by their fixed parts, see
    :mod:`incidentkit.operators.template_index`, so the time of a text hardly
    grows with the number of templates.
    """
    listed = checkpoint(ordered(templates, keys))
    index = Index([t.regex for t in listed.first().all])
    lowered = F.lower(F.col(request))
    found = tickets.withColumn("_text", lowered).withColumn("_may", candidates(F.col("_text"), index)).withColumn("_all", listed.scalar())
    same = lambda t: reduce(lambda x, y: x & y, [t[k] == F.col(k) for k in keys], F.lit(True))
    return _first_template(found, same).drop("_all", "_may", "_text")


def match_any_template(tickets: DataFrame, templates: DataFrame, request: str = "request") -> DataFrame:
    """Like :func:`match_templates` without keys: every template may match every ticket."""
    return match_templates(tickets, templates, [], request)


def _first_template(df: DataFrame, fits) -> DataFrame:
    """template_id and capture of the first pattern that fits the row and matches its text; no pattern is tested after a hit."""
    pattern = lambda t: F.concat(F.lit("(?d)"), t["regex"])
    text, listed = F.col("_text"), F.col("_all")
    test = lambda t: fits(t) & F.regexp_like(text, pattern(t))
    hit = F.aggregate("_may", F.lit(-1), lambda held, i: F.when(held >= 0, held).when(test(F.get(listed, i)), i).otherwise(held))
    found = df.withColumn("_at", hit).withColumn("_hit", F.when(F.col("_at") >= 0, F.get(listed, F.col("_at"))))
    description = F.when(F.col("_hit").isNotNull(), T.strip(T.capture(text, pattern(F.col("_hit")))))
    return found.withColumn("template_id", F.col("_hit.template_id")).withColumn("description", description).drop("_at", "_hit")


def map_or_keep(df: DataFrame, lookup: DataFrame, column: str, name: str, to: str) -> DataFrame:
    """Replace a value by ``lookup[name -> to]`` where listed, else keep it.

    ``lookup`` has one row per name.
    """
    pairs = lookup.select(F.col(name).alias(column), F.col(to).alias("_to"))
    joined = df.join(pairs, column, "left")
    return joined.withColumn(column, F.coalesce("_to", column)).select(*df.columns)


def normal_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def anti_new_names(names: DataFrame, catalog: DataFrame, column: str) -> DataFrame:
    """Names that the catalogue does not hold in any group, compared without case and extra blanks."""
    known = catalog.select(normal_name(F.col(column)).alias("_name")).distinct()
    return names.withColumn("_name", normal_name(F.col(column))).join(known, "_name", "left_anti").drop("_name")


def _keyed(df: DataFrame, key: str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(key).cast("string"))), F.lit(""))


def outer_merge(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per key over all tables, columns prefixed, and the list of tables that hold it.

    One aggregation instead of a chain of full outer joins. Keys are compared
    trimmed and in lower case. Of repeated keys in a table one whole row stays,
    the smallest by its columns in order, and ``<table>_rows`` counts them. Rows
    without a key are in :func:`without_key`.
    """
    stacked = None
    for name, df in tables.items():
        own = [c for c in df.columns if c != key]
        row = F.struct(*[F.col(c).alias(c) for c in own], F.lit(name).alias("_source"))
        part = df.where(_keyed(df, key).isNotNull()).select(_keyed(df, key).alias(key), row.alias(name))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    merged = stacked.groupBy(key).agg(
        *[F.min(name).alias(f"_{name}") for name in tables],
        *[F.count(name).alias(f"{name}_rows") for name in tables],
    )
    held = [F.when(F.col(f"{name}_rows") > 0, F.lit(name)) for name in sorted(tables)]
    return merged.select(
        key,
        *[F.col(f"_{name}.{c}").alias(f"{name}_{c}") for name, df in tables.items() for c in df.columns if c != key],
        *[f"{name}_rows" for name in tables],
        F.concat_ws(",", *held).alias("sources"),
    )


def without_key(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Rows with a null or blank key, each with the table it is from, columns prefixed."""
    out = None
    for name, df in tables.items():
        own = [F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key]
        part = df.where(_keyed(df, key).isNull()).select(F.lit(name).alias("source"), *own)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def snapshot_diff(
    new: DataFrame, old: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """New minus old per key; a key missing on one side counts as zero there.

    Signed union and one sum, so a hot key is reduced before the shuffle.
    """
    signed = new.select(*keys, *columns).unionByName(
        old.select(*keys, *[(-F.col(c)).alias(c) for c in columns])
    )
    return signed.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]
    )


def first_claim(
    pairs: DataFrame, child: str, order: Sequence[str], phase: str | None = None
) -> DataFrame:
    """Each child goes to the first parent that claims it, earlier phases first."""
    rest = [c for c in pairs.columns if c != child]
    rank = F.struct(*([phase] if phase else []), *order)
    first = F.min_by(F.struct(*rest), rank)
    return (
        pairs.groupBy(child).agg(first.alias("_first")).select(child, *[F.col(f"_first.{c}") for c in rest])
    )
