"""Groups of near-identical names and post-processing of hidden tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from incidentkit.operators.beside import beside
from incidentkit.operators.aggregates import best_per_group, keep_repeated
from incidentkit.operators.joins import map_or_keep
from incidentkit.operators.similarity import cosine_links
from incidentkit.session import checkpoint


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s"),
    ).first()
    return row.n, int(row.s)


def connected_groups(pairs: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """(name, group) for every name in a pair; the group is its smallest member.

    Alternates large-star and small-star steps, which turn every component into
    a star in about log(n) rounds whatever its shape. Per round a node only
    needs the minimum of its neighbours, which is combined before the shuffle
    and brought back to its rows by :func:`beside`, so a node with very many
    neighbours is no single task. Each round is cut with a reliable checkpoint.
    """
    edges = (
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    edges = checkpoint(edges)
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            beside(both.where(F.col("v") > F.col("u")), lowest, ["u"])
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = beside(large, lowest, ["u"]).select(
            F.inline(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            )
        )
        edges = checkpoint(small.where(F.col("u") != F.col("v")).distinct())
        new_mark = _mark(edges)
        if new_mark == mark:
            break
        mark = new_mark
    roots = edges.select(F.col("v").alias("name"), F.col("v").alias("group")).distinct()
    return edges.select(F.col("u").alias("name"), F.col("v").alias("group")).unionByName(roots)


def group_names(df: DataFrame, column: str, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Add ``group``: the smallest of the similar names, or the name itself."""
    names = df.select(F.col(column).alias("name")).where(F.col("name").isNotNull()).distinct()
    groups = connected_groups(cosine_links(names, "name", "name", n, threshold))
    return map_or_keep(df.withColumn("group", F.col(column)), groups, "group", "name", "group")


def hidden_incidents(
    pairs: DataFrame,
    parent: str = "level2",
    child: str = "level3",
    score: str = "score",
    linked_to: str = "linked_to",
    tie: str = "pair_id",
    workaround: Column | None = None,
) -> DataFrame:
    """Unlinked tickets that belong to a known problem.

    Parents need more than one unlinked child; each child keeps its best
    scoring row; of those only the unlinked remain. ``workaround`` names rows
    that no longer count as hidden.
    """
    unlinked = F.col(linked_to).isNull()
    repeated = keep_repeated(pairs, parent, 2, unlinked)
    best = best_per_group(repeated, child, score, [tie]).where(unlinked)
    return best if workaround is None else best.where(~workaround)
