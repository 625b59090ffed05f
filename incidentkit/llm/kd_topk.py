"""Exact top-k by inner product with one KD-tree per shard of the vectors.

Vectors are dealt into shards of about SHARD_ROWS rows. A shard's tree splits
at the median of the widest side and keeps tight boxes. The largest inner
product of a query with a box bounds all vectors in it, so the boxes are
taken best first, and a query is done when its best open box cannot reach its
k-th score. Blocks of queries search one shard first; the k-th scores found
there are propagated to the searches of all other shards.

Cases: vectors that are null, hold a null or a component that is not finite,
or have no id, take no part. Only vectors of equal length are compared. A
repeated query row counts once, with its smallest vector; repeated candidate
rows count each. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from incidentkit.session import checkpoint

SHARD_ROWS = 8192
QUERY_ROWS = 1024
LEAF_ROWS = 128


class Tree:
    """Boxes of a shard: lower and upper corner, children, and the rows of each leaf."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]  # the place of a row is also its rank in the ties
        self.low, self.high, self.children, self.leaves = [], [], [], []
        open_nodes = [(np.arange(len(ids)), self._node(np.arange(len(ids))))]
        while open_nodes:
            members, node = open_nodes.pop()
            spread = self.high[node] - self.low[node] if rows.shape[1] else np.zeros(1, np.int64)
            if len(members) <= LEAF_ROWS or not spread.any():
                self.leaves[node] = members
                continue
            side = self.rows[members, int(spread.argmax())]
            halves = np.argsort(side, kind="stable")
            cut = len(members) // 2
            pair = []
            for half in (members[np.sort(halves[:cut])], members[np.sort(halves[cut:])]):
                pair.append(self._node(half))
                open_nodes.append((half, pair[-1]))
            self.children[node] = pair
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _node(self, members: np.ndarray) -> int:
        self.low.append(self.rows[members].min(axis=0))
        self.high.append(self.rows[members].max(axis=0))
        self.children.append(None)
        self.leaves.append(None)
        return len(self.low) - 1

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query place, row place, score) of the k best rows per query with a score of at least ``least``, and the k-th scores.

        All queries of the block go forward together: in each turn every open
        query takes its best box; those that took the same one are scored by
        one product.
        """
        exact = max(1.0, float(np.abs(queries).max(initial=0))) * max(1.0, float(np.abs(self.rows).max(initial=0))) * max(1, queries.shape[1])
        shift = max(1, len(self.ids)).bit_length()
        kind, whole = (np.float64, np.int64) if exact < 2.0 ** min(52, 61 - shift) else (object, object)
        q, rows = queries.astype(kind), self.rows.astype(kind)
        bounds = np.maximum(q, 0) @ np.maximum(self.high, self.low).astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        n = len(q)
        nothing = -(2**62)
        best = np.full((n, k), nothing, whole)  # score and rank of the tie in one number
        kth = np.array([nothing if x is None else x for x in least], dtype=object if whole is object else np.float64)
        frontier = np.full(bounds.shape, -np.inf)
        near = bounds.astype(np.float64) if kind is object else bounds
        slack = np.abs(near) * 1e-9 if kind is object else 0  # bounds that are rounded may not cut
        near = near + slack
        frontier[:, 0] = near[:, 0]
        active = np.arange(n)
        while len(active):
            picked = frontier[active].argmax(axis=1)
            value = frontier[active, picked]
            going = (value > -np.inf) & (value >= kth[active].astype(np.float64) - (np.abs(kth[active].astype(np.float64)) * 1e-9 if kind is object else 0))
            active, picked = active[going], picked[going]
            for node in np.unique(picked):
                who = active[picked == node]
                frontier[who, node] = -np.inf
                if self.leaves[node] is None:
                    for child in self.children[node]:
                        frontier[who, child] = near[who, child]
                    continue
                members = self.leaves[node]
                scores = (q[who] @ rows[members].T).astype(whole)
                keys = scores * (1 << shift) + ((1 << shift) - 1 - members)
                keys[self.ids[members][None, :] == query_ids[who][:, None]] = nothing
                both = np.concatenate([best[who], keys], axis=1)
                top = -np.partition(-both, k - 1, axis=1)[:, :k] if both.shape[1] > k else both
                best[who] = top
                lowest = top.min(axis=1)
                found = lowest > nothing
                kth[who[found]] = np.maximum(kth[who[found]], lowest[found] >> shift if whole is not object else np.array([x >> shift for x in lowest[found]], dtype=object))
        i, j = np.nonzero(best > nothing)
        held = best[i, j]
        score = held >> shift if whole is not object else np.array([x >> shift for x in held], dtype=object)
        place = (1 << shift) - 1 - (held - score * (1 << shift))
        good = score >= np.array([nothing if x is None else x for x in least], dtype=object)[i] if len(i) else np.zeros(0, bool)
        good = good.astype(bool)
        return i[good], place[good].astype(np.int64), score[good], kth


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def _search(pdf_iter, k: int, final: bool):
    for pdf in pdf_iter:
        for row in pdf.itertuples(index=False):
            tree: Tree = pickle.loads(row.tree)
            ids, queries, least = pickle.loads(row.queries)
            i, place, score, kth = tree.search(ids, queries, k, least)
            if final:
                yield pd.DataFrame({"query_id": ids[i], "vec_id": tree.ids[place], "score": np.asarray(score, dtype=np.int64)})
            else:
                limits = [None if x <= -(2**62) else int(x) for x in kth]
                yield pd.DataFrame({"dim": [row.dim], "block": [row.block], "home": [row.shard], "queries": [pickle.dumps((ids, queries, limits))]})


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = Tree(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"]))
    return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "tree": [pickle.dumps(tree)]})


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id")
    held = (pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"]), [None] * len(pdf))
    return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "block": pdf["block"].iloc[:1], "queries": [pickle.dumps(held)]})


def whole_numbers(vector: Column) -> Column:
    """floor(64 x) of every component; null if the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * 64)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows.

    Every block of queries meets every shard once; both are packed into one row
    of bounded size before they are joined.
    """
    v = vectors.where(is_query.isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col(column)).alias("v"), is_query.alias("asks"))
    v = v.where("v is not null and vec_id is not null").withColumn("dim", F.size("v"))
    v = checkpoint(v)
    shards = max(1, -(-v.count() // SHARD_ROWS))
    asks = v.where("asks").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("m")).select("vec_id", "m.dim", "m.v")
    blocks = max(1, -(-asks.count() // QUERY_ROWS))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)).cast("int")
    trees = v.withColumn("shard", dealt(shards)).groupBy("dim", "shard").applyInPandas(_build, "dim int, shard int, tree binary")
    trees = checkpoint(trees)
    packed = asks.withColumn("block", dealt(blocks)).groupBy("dim", "block").applyInPandas(_pack, "dim int, block int, queries binary")
    packed = packed.withColumn("shard", F.pmod(F.col("block"), F.lit(shards)).cast("int"))
    seen = packed.join(trees, ["dim", "shard"], "left")
    # A home shard without vectors of this length gives no bound.
    first = seen.where("tree is not null").mapInPandas(lambda it: _search(it, k, False), "dim int, block int, home int, queries binary")
    bare = seen.where("tree is null").select("dim", "block", F.lit(-1).alias("home"), "queries")
    bounded = checkpoint(first.union(bare))
    pairs = bounded.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees, ["dim", "shard"])
    found = pairs.mapInPandas(lambda it: _search(it, k, True), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
