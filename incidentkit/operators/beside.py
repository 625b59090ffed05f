"""Rows next to a value per key that was aggregated from many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from incidentkit.session import checkpoint

#: Keys of the aggregated side that are sent to every executor at most.
BROADCAST_KEYS = 50_000
#: Parts that the rows of a key are dealt into beyond that.
SALTS = 16


def beside(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to a table with one narrow row per key, however many rows a key has.

    A join on the grouping key keeps the partitioning of the aggregate, which
    adaptive execution does not split. So the aggregate is cut and counted: a
    small one is broadcast; beyond BROADCAST_KEYS keys the rows of each key are
    dealt into SALTS parts and the aggregate is copied to all of them. Both ways
    give the same rows. ``how`` is inner, left, left_semi or left_anti.
    """
    keys = list(keys)
    cut = checkpoint(per_key)
    if cut.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(cut), keys, how)
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copied = cut.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
