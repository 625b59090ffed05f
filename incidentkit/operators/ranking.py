"""Ranks and exact quantiles over tables of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from incidentkit.operators.beside import beside
from incidentkit.session import checkpoint

#: Distinct values of a bracket that are sorted next to each other at most, and steps by which a wider one is narrowed.
SORTED, CELLS = 200_000, 64


def global_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Number all rows 1..n in a total order without a single-task window.

    Rows are range-partitioned and sorted where they land. The partitioning is
    fixed with a checkpoint, because range bounds come from a sample; then each
    partition only needs the number of rows ahead of it.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    fixed = checkpoint(placed)
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"))
    return (
        fixed.join(offsets, "_part")
        .withColumn(name, F.col("_ahead") + F.col("_row") + 1)
        .drop("_part", "_row", "_ahead")
    )


def exact_quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 50_000,
) -> DataFrame:
    """Exact quantiles with linear interpolation: (by, quantiles array).

    A mergeable sketch brackets every wanted quantile; its rank error is at most
    1 / accuracy of the rows, and the bracket is taken four times as wide. Rows
    below and inside the brackets are counted; a bracket of more than SORTED
    distinct values is narrowed by a sketch of what lies inside it, again and
    again. Only what is left is sorted, with equal values collapsed. No group is
    ever sorted or held as a whole.
    """
    by = list(by)
    margin = 4 / accuracy
    ends = [min(1.0, max(0.0, p + side * margin)) for p in probs for side in (-1, 1)]
    values = df.select(*by, F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    sketch = values.groupBy(*by).agg(
        F.struct(
            F.count("_v").alias("n"), F.percentile_approx("_v", ends, accuracy).alias("cuts")
        ).alias("_s")
    )
    v = F.col("_v")
    low = [F.get("_s.cuts", F.lit(2 * i)) for i in range(len(probs))]
    high = [F.get("_s.cuts", F.lit(2 * i + 1)) for i in range(len(probs))]
    # Per probability the two neighbouring zero-based ranks, counted from the bracket's start.
    # In small groups a rank may be the direct neighbour of its bracket, so those values come along.
    sides = [(F.count_if(v < lo), F.max(F.when(v < lo, v)), F.min(F.when(v > hi, v))) for lo, hi in zip(low, high)]
    within = [v.between(lo, hi) for lo, hi in zip(low, high)]
    exact = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    while True:
        bracketed = _attach(values, sketch, by, "_s")
        below = bracketed.groupBy(*by).agg(
            F.first("_s.n").alias("_n"),
            F.first("_s.cuts").alias("_cuts"),
            *[c.alias(f"{name}{i}") for i, three in enumerate(sides) for c, name in zip(three, ("_b", "_prev", "_next"))],
            *[F.count_if(w).alias(f"_in{i}") for i, w in enumerate(within)],
            *[F.approx_count_distinct(F.when(w, v)).alias(f"_d{i}") for i, w in enumerate(within)],
        )
        below = checkpoint(below)
        wide = below.where(reduce(lambda a, b: a | b, [F.col(f"_d{i}") > SORTED for i in range(len(probs))]))
        if wide.isEmpty():
            break
        narrow = checkpoint(_narrowed(bracketed, wide, by, within, exact))
        kept = below.select(*by, F.struct(F.col("_n").alias("n"), F.col("_cuts").alias("cuts")).alias("_s"))
        kept = kept.join(narrow.select(*by), by, "left_anti") if by else kept.limit(0)
        sketch = checkpoint(kept.unionByName(narrow))
    wanted = below.select(
        *by,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("q"),
                        (h - F.floor(h)).alias("part"),
                        (F.floor(h) - F.col(f"_b{i}")).alias("lower_rank"),
                        (F.ceil(h) - F.col(f"_b{i}")).alias("upper_rank"),
                        F.col(f"_prev{i}").alias("prev"),
                        F.col(f"_next{i}").alias("next"),
                    )
                    for i, h in enumerate(exact)
                ]
            )
        ),
    )
    which = F.array_compact(F.array(*[F.when(w, F.lit(i)) for i, w in enumerate(within)]))
    inside = (
        bracketed.select(*by, "_v", F.explode(which).alias("q"))
        .groupBy(*by, "q", "_v")
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    running = F.sum("_k").over(
        Window.partitionBy(*by, "q").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = inside.withColumn("_upto", running).join(wanted, [*by, "q"])

    def at(rank: str) -> Column:
        holds = (F.col(rank) < F.col("_upto")) & (F.col(rank) >= F.col("_upto") - F.col("_k"))
        return F.max(F.when(holds, v))

    pairs = placed.groupBy(*by, "q", "part").agg(
        F.coalesce(at("lower_rank"), F.first("prev")).alias("low"),
        F.coalesce(at("upper_rank"), F.first("next")).alias("high"),
    )
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    in_order = F.array_sort(F.collect_list(F.struct("q", value.alias("value"))))
    return pairs.groupBy(*by).agg(F.transform(in_order, lambda s: s["value"]).alias("quantiles"))


def _narrowed(bracketed: DataFrame, wide: DataFrame, by: Sequence[str], within: Sequence[Column], exact: Sequence[Column]) -> DataFrame:
    """(by, _s) with narrower cuts around the wanted ranks, from CELLS sketched steps inside each bracket."""
    by = list(by)
    steps = [c / CELLS for c in range(CELLS + 1)]
    grids = [F.percentile_approx(F.when(w, F.col("_v")), steps, 10 * CELLS * CELLS).alias(f"_g{i}") for i, w in enumerate(within)]
    inside = bracketed.join(wide.select(*by), by, "left_semi") if by else bracketed
    grid = inside.groupBy(*by).agg(*grids)
    both = wide.join(grid, by) if by else wide.withColumn("_grid", grid.agg(F.first(F.struct(*grid.columns))).scalar()).select("*", "_grid.*")
    cuts = []
    for i, h in enumerate(exact):
        at = F.floor((F.floor(h) - F.col(f"_b{i}")) / F.col(f"_in{i}") * CELLS).cast("int")
        inner = (F.get(f"_g{i}", F.greatest(at - 1, F.lit(0))), F.get(f"_g{i}", F.least(at + 2, F.lit(CELLS))))
        # A rank next to the bracket, and a bracket that is small already, keep their cuts.
        fine = (F.col(f"_d{i}") <= SORTED) | (at < 0) | (at > CELLS)
        cuts += [F.when(fine, F.get("_cuts", F.lit(2 * i + side))).otherwise(c) for side, c in enumerate(inner)]
    return both.select(*by, F.struct(F.col("_n").alias("n"), F.array(*cuts).alias("cuts")).alias("_s"))


def _attach(df: DataFrame, one_per_group: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """Bring a per-group value next to the rows; without groups, as a scalar subquery."""
    if group:
        return beside(df, one_per_group, group)
    return df.withColumn(column, one_per_group.scalar())
