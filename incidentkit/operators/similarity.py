"""Exact threshold joins on cosine similarity, dense and sparse."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from incidentkit.functions import text as T
from incidentkit.operators.beside import beside
from incidentkit.operators.features import tfidf
from incidentkit.operators.ranking import global_rank
from incidentkit.operators.rows import stable_hash
from incidentkit.session import checkpoint


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, zero where either is missing or all zeros."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


#: Pivots at most: with vectors of 150 numbers they are 2.5 MB in every task.
MOST_PIVOTS = 2048
#: Steps into which angles from 0 to a half turn are counted.
BANDS = 256
#: A reach from which on pivots leave out hardly a pair but multiply the rows that are sent to them.
WIDE = math.pi / 3
#: Rows of a block at most where all blocks meet, block pairs that are enough for many cores, and left rows that are compared at a time.
MOST_ROWS, ENOUGH, STRIPE = 4096, 64, 512


def _unit(df: DataFrame, key: str, vector: str, order: str | None = None) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    size = F.sqrt(dot(v, v))
    if order and df.schema[order].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{order} is no column of whole numbers")
    rank = F.col(order).cast("bigint") if order else F.lit(0).cast("bigint")
    return (
        df.select(F.col(key).alias("id"), v.alias("v"), size.alias("size"), rank.alias("o"))
        .where(F.col("size") > 0)
        .select("id", F.transform("v", lambda x: x / F.col("size")).alias("v"), "o")
    )


class _Cells:
    """Pivots with the reach of the threshold; places vectors by their angles to the pivots."""

    def __init__(self, centers: np.ndarray, reach: float):
        self.centers, self.reach = centers, reach
        #: By cell and band: may a right vector of that angle have a partner in the cell?
        self.open = np.zeros((len(centers), BANDS), bool)

    def angles(self, vectors: pd.Series) -> np.ndarray:
        if not len(vectors):
            return np.empty((0, len(self.centers)))
        return np.arccos(np.clip(np.stack(vectors.to_numpy()) @ self.centers.T, -1.0, 1.0))

    def nearest(self, batch: pd.DataFrame) -> pd.DataFrame:
        """Left vectors in the cell of their nearest pivot."""
        a = self.angles(batch["v"])
        cell, angle = (a.argmin(axis=1), a.min(axis=1)) if len(batch) else (np.empty(0), np.empty(0))
        return batch.assign(cell=cell.astype("int32"), band=_band(angle))

    def reachable(self, batch: pd.DataFrame) -> pd.DataFrame:
        """Right vectors in every cell that may hold a partner.

        A partner is within reach, so its angle to the pivot differs by no more
        than that; and the pivot is the nearest of the partner, so it is not
        further from the right vector than any other pivot by twice the reach.
        """
        a = self.angles(batch["v"])
        near = self.open[np.arange(len(self.centers))[None, :], _band(a)]
        if len(batch):
            near &= a <= a.min(axis=1, keepdims=True) + 2 * self.reach
        row, cell = np.nonzero(near)
        return batch.iloc[row].assign(cell=cell.astype("int32"), band=_band(a[row, cell]))


def _chunks(batches, rows: int = 1024):
    """Batches of a size at which the angles to all pivots take little room."""
    for batch in batches:
        for at in range(0, max(1, len(batch)), rows):
            yield batch.iloc[at : at + rows]


def _spread(rows: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the one that is furthest from those before it, so that every group of a few drawn rows gets one."""
    chosen, closest = [0], rows @ rows[0]
    while len(chosen) < min(n, len(rows)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, rows @ rows[chosen[-1]])
    return rows[chosen]


def _band(angle: np.ndarray) -> np.ndarray:
    return np.minimum(angle * (BANDS / math.pi), BANDS - 1).astype("int32")


def _parts(counts: DataFrame, block: int, wide: int) -> DataFrame:
    """(cell, band, part, subs, low, high): neighbouring bands of a cell together hold about a block.

    Bands further apart than ``wide`` are never in one part. A cell has BANDS rows at most. A part of more rows than a block, which then
    is one band, is dealt into ``subs`` by a hash.
    """
    along = Window.partitionBy("cell").orderBy("band")
    before = F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    gap = (F.col("band") - F.lag("band").over(along) > wide).cast("int")
    held = counts.select("cell", "band", "n", F.floor(before / block).alias("full"), F.coalesce(gap, F.lit(0)).alias("gap"))
    gaps = F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0))
    # Numbered by both, so that a part ends at a gap and after about a block.
    parted = held.select("cell", "band", "n", (F.col("full") * (BANDS + 1) + gaps).cast("int").alias("part"))
    each = Window.partitionBy("cell", "part")
    return parted.select(
        "cell", "band", "part",
        F.ceil(F.sum("n").over(each) / block).cast("int").alias("subs"),
        F.min("band").over(each).alias("low"), F.max("band").over(each).alias("high"),
    )


def block_pairs(left_parts: DataFrame, right_parts: DataFrame, reach: float) -> DataFrame:
    """(cell, lp, ls, rp, rs): the blocks of a cell whose angles to the pivot are within reach of each other."""
    step = math.pi / BANDS
    one = left_parts.select("cell", F.col("part").alias("lp"), F.col("subs").alias("ln"), F.col("low").alias("l0"), F.col("high").alias("l1")).distinct()
    two = right_parts.select("cell", F.col("part").alias("rp"), F.col("subs").alias("rn"), F.col("low").alias("r0"), F.col("high").alias("r1")).distinct()
    wide = reach / step + 1
    met = one.join(two, "cell").where((F.col("l0") - F.col("r1") <= wide) & (F.col("r0") - F.col("l1") <= wide))
    zero = F.lit(0)
    return met.select("cell", "lp", "rp", F.explode(F.sequence(zero, F.col("ln") - 1)).alias("ls"), "rn").select(
        "cell", "lp", "ls", "rp", F.explode(F.sequence(zero, F.col("rn") - 1)).alias("rs")
    )


def _prepared(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str, threshold: float, pivots: int | None, block: int, first: str | None):
    """Placed left rows, sent right rows and pairs of blocks; None without left vectors."""
    lefts, rights = checkpoint(_unit(left, left_id, vector, first)), checkpoint(_unit(right, right_id, vector))
    if pivots is None:
        # So many that a cell holds as many rows of the smaller side as there are cells; a single block needs none.
        smaller = min(lefts.count(), rights.count())
        pivots = min(MOST_PIVOTS, math.isqrt(smaller)) if smaller > block else 1
    # Four rows per pivot at most come to the driver, to choose those that lie far from each other.
    drawn = lefts.orderBy(stable_hash(F.col("id")), "id").limit(4 * pivots if pivots > 1 else 1).select("v").collect()
    if not drawn:
        return None
    cells = _Cells(_spread(np.array([r.v for r in drawn]), pivots), math.acos(max(-1.0, min(1.0, threshold))) + 1e-6)
    left_type, right_type = (df.schema["id"].dataType.simpleString() for df in (lefts, rights))
    placed = lefts.mapInPandas(lambda batches: map(cells.nearest, _chunks(batches)), f"id {left_type}, v array<double>, o bigint, cell int, band int")
    counts = checkpoint(placed.groupBy("cell", "band").agg(F.count(F.lit(1)).alias("n")))
    wide = int(cells.reach * BANDS / math.pi) + 2
    for c in counts.groupBy("cell").agg(F.collect_list("band").alias("bands")).collect():  # a row per pivot
        for band in c.bands:
            cells.open[c.cell, max(0, band - wide) : band + wide + 1] = True
    sent = rights.mapInPandas(lambda batches: map(cells.reachable, _chunks(batches)), f"id {right_type}, v array<double>, o bigint, cell int, band int")
    left_parts = checkpoint(_parts(counts, block, wide))
    right_parts = checkpoint(_parts(sent.groupBy("cell", "band").agg(F.count(F.lit(1)).alias("n")), block, wide))
    return placed, sent, left_parts, right_parts, checkpoint(block_pairs(left_parts, right_parts, cells.reach))


def cosine_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    vector: str,
    threshold: float,
    pivots: int | None = None,
    block: int = 2048,
    first: str | None = None,
) -> DataFrame:
    """All pairs (left_id, right_id, score) with cosine above the threshold, exactly.

    ``first`` names a column of whole numbers of the left side for callers that
    only want the first left row (then lowest id) per right row: a block pair
    then yields at most one pair per right vector, however many copies a group
    has.

    Angles obey the triangle inequality. Every left vector belongs to the cell
    of its nearest pivot; a right vector is sent to the cells it can reach. Both
    sides of a cell are cut into blocks by their angle to the pivot, and only
    blocks meet whose angles are within reach of each other. No pair above the
    threshold is missed and none is seen twice. A block pair is one bounded
    matrix product that yields only the pairs above the threshold.
    """
    left_type = left.schema[left_id].dataType.simpleString()
    right_type = right.schema[right_id].dataType.simpleString()
    out = f"{left_id} {left_type}, {right_id} {right_type}, score double"
    ready = _prepared(left, right, left_id, right_id, vector, threshold, pivots, block, first)
    if ready is None:
        return left.sparkSession.createDataFrame([], out)
    placed, sent, left_parts, right_parts, pairs = ready

    def blocks(rows: DataFrame, parts: DataFrame, part: str, sub: str) -> DataFrame:
        # Parts are a row per cell and band: MOST_PIVOTS * BANDS at most, and no more than there are rows.
        dealt = rows.join(F.broadcast(parts.select("cell", "band", "part", "subs")), ["cell", "band"])
        dealt = dealt.select("cell", F.col("part").alias(part), F.pmod(F.xxhash64("id"), F.col("subs")).cast("int").alias(sub), "id", "v", "o")
        others = [c for c in ("lp", "ls", "rp", "rs") if c not in (part, sub)]
        met = pairs.groupBy("cell", part, sub).agg(F.collect_list(F.struct(*others)).alias("met"))
        return dealt.join(met, ["cell", part, sub]).select("cell", part, sub, F.inline("met"), "id", "v", "o")

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({left_id: a["id"][:0], right_id: b["id"][:0], "score": np.empty(0)})
        if first:
            a = a.sort_values(["o", "id"])
        scores = np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T
        above = scores > threshold
        if first:
            j = np.nonzero(above.any(axis=0))[0]
            i = above.argmax(axis=0)[j]
        else:
            i, j = np.nonzero(above)
        return pd.DataFrame(
            {left_id: a["id"].to_numpy()[i], right_id: b["id"].to_numpy()[j], "score": scores[i, j]}
        )

    keys = ["cell", "lp", "ls", "rp", "rs"]
    l_blocks, r_blocks = blocks(placed, left_parts, "lp", "ls"), blocks(sent, right_parts, "rp", "rs")
    return l_blocks.groupBy(*keys).cogroup(r_blocks.groupBy(*keys)).applyInPandas(product, out)


def _two_units(df: DataFrame, key: str, one: str, two: str, order: str | None) -> DataFrame:
    """(id, o, v, w): both vectors at length one, null where a vector is missing or all zeros."""
    rank = F.col(order) if order else F.lit(0)
    vectors = [F.col(c).cast("array<double>").alias(name) for c, name in ((one, "v"), (two, "w"))]
    given = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), rank.cast("bigint").alias("o"), *vectors)
    sized = given.withColumns({"lv": F.sqrt(dot(F.col("v"), F.col("v"))), "lw": F.sqrt(dot(F.col("w"), F.col("w")))})
    unit = lambda c: F.when(F.col(f"l{c}") > 0, F.transform(c, lambda x: x / F.col(f"l{c}"))).alias(c)
    return sized.select("id", "o", unit("v"), unit("w")).where("v IS NOT NULL OR w IS NOT NULL")


def _stacked(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, zeros for missing ones, and which are there."""
    there = vectors.notna().to_numpy()
    out = np.zeros((len(vectors), len(vectors.iloc[there.argmax()]) if there.any() else 0))
    if there.any():
        out[there] = np.stack(vectors[there].to_numpy())
    return out, there


def _all_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, short: str, request: str, threshold: float, first: str | None) -> DataFrame:
    """What :func:`score_pairs` gives, from one meeting of every left block with every right block.

    At a low threshold the share of pairs above it does not fall with the rows,
    so the work is the product of both sides. Blocks are dealt by a hash. A
    block pair gives both scores of its pairs at once, so pairs are neither
    shuffled nor joined back to their vectors, and its memory is bounded.
    """
    lefts, rights = checkpoint(_two_units(left, left_id, short, request, first)), checkpoint(_two_units(right, right_id, short, request, None))
    n, m, rows = lefts.count(), rights.count(), MOST_ROWS
    while rows > STRIPE and -(-n // rows) * -(-m // rows) < ENOUGH:
        rows //= 2
    lb, rb = max(1, -(-n // rows)), max(1, -(-m // rows))

    def blocks(df: DataFrame, own: str, k: int, other: str, others: int) -> DataFrame:
        number = F.pmod(F.xxhash64("id", "v", "w"), F.lit(k)).cast("int")
        return df.select(number.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), "id", "o", "v", "w")

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values(["o", "id"]) if first else a
        found, left_ids, right_ids = [(np.empty(0), np.empty(0))], [a["id"].to_numpy()[:0]], [b["id"].to_numpy()[:0]]
        if len(a) and len(b):
            (bv, b1), (bw, b2), free = _stacked(b["v"]), _stacked(b["w"]), np.ones(len(b), bool)
            for at in range(0, len(a), STRIPE):
                some = a.iloc[at : at + STRIPE]
                (av, a1), (aw, a2) = _stacked(some["v"]), _stacked(some["w"])
                scores = [x @ y.T if x.shape[1] and y.shape[1] else np.zeros((len(x), len(y))) for x, y in ((av, bv), (aw, bw))]
                above = ((scores[0] > threshold) & a1[:, None] & b1) | ((scores[1] > threshold) & a2[:, None] & b2)
                if first:
                    j = np.nonzero(above.any(axis=0) & free)[0]
                    i = above.argmax(axis=0)[j]
                    free[j] = False
                else:
                    i, j = np.nonzero(above)
                found.append((scores[0][i, j], scores[1][i, j]))
                left_ids.append(some["id"].to_numpy()[i])
                right_ids.append(b["id"].to_numpy()[j])
        one, two = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({left_id: np.concatenate(left_ids), right_id: np.concatenate(right_ids), "score_short": one, "score_request": two})

    kinds = (df.schema["id"].dataType.simpleString() for df in (lefts, rights))
    out = "{} {}, {} {}, score_short double, score_request double".format(*sum(zip((left_id, right_id), kinds, strict=True), ()))
    l_blocks, r_blocks = blocks(lefts, "lb", lb, "rb", rb), blocks(rights, "rb", rb, "lb", lb)
    return l_blocks.groupBy("lb", "rb").cogroup(r_blocks.groupBy("lb", "rb")).applyInPandas(product, out)


def score_pairs(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    short: str = "short_vector",
    request: str = "request_vector",
    threshold: float = 0.75,
    first: str | None = None,
) -> DataFrame:
    """Pairs whose short text or request text scores above the threshold, with both scores.

    Both tables carry the two vector columns; an all-zero vector scores zero.
    With ``first`` the pairs hold, for every right row, its first left row by
    that column, see :func:`cosine_join`. Below a threshold of a half all blocks
    meet, see :func:`_all_pairs`.
    """
    if math.acos(max(-1.0, min(1.0, threshold))) > WIDE:
        return _all_pairs(left, right, left_id, right_id, short, request, threshold, first)
    by_short, by_request = (
        cosine_join(left, right, left_id, right_id, c, threshold, first=first).drop("score") for c in (short, request)
    )
    hits = by_short.unionByName(by_request).distinct()
    l = left.select(left_id, F.col(short).alias("_ls"), F.col(request).alias("_lr"))
    r = right.select(right_id, F.col(short).alias("_rs"), F.col(request).alias("_rr"))
    as_double = lambda c: F.col(c).cast("array<double>")
    return (
        hits.join(l, left_id)
        .join(r, right_id)
        .select(
            left_id,
            right_id,
            cosine(as_double("_ls"), as_double("_rs")).alias("score_short"),
            cosine(as_double("_lr"), as_double("_rr")).alias("score_request"),
        )
    )


#: Postings of a gram that meet in one group.
POSTINGS = 512
#: Room for rounding in comparisons with the threshold.
SLACK = 1e-9


def _gram_vectors(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(id, s): per text its grams as (number, weight), rare ones first; numbers follow the frequency."""
    clean = F.translate(F.col(text), ",-./", "")
    vectors = checkpoint(tfidf(df, key, T.char_ngrams(clean, n, n)))
    frequency = vectors.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    numbers = global_rank(frequency, "df", "term", name="number").select("term", "number")
    numbered = beside(vectors.select(F.col(key).alias("id"), "term", "weight"), numbers, ["term"])
    return checkpoint(numbered.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("number", "weight"))).alias("s")))


def _postings(vectors: DataFrame, threshold: float) -> DataFrame:
    """(number, id, weight, rest) of the grams of each text's prefix; rest is the length of what follows."""
    kind = vectors.schema["id"].dataType.simpleString()

    def prefixes(batches):
        for batch in batches:
            numbers, ids, weights, rests = [], [], [], []
            for key, entries in zip(batch["id"], batch["s"], strict=True):
                w = np.array([e["weight"] for e in entries])
                left = np.sqrt(np.maximum(np.cumsum((w * w)[::-1])[::-1], 0.0))
                k = int((left >= threshold - SLACK).sum())
                numbers += [e["number"] for e in entries[:k]]
                ids += [key] * k
                weights.append(w[:k])
                rests.append(np.append(left[1:], 0.0)[:k])
            yield pd.DataFrame({"number": numbers, "id": ids, "weight": np.concatenate([*weights, []]), "rest": np.concatenate([*rests, []])})

    return vectors.mapInPandas(prefixes, f"number bigint, id {kind}, weight double, rest double")


def _scored(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(id1, id2, score) of the pairs that reach the threshold; one expression over both texts' arrays."""
    one, two = vectors.select(F.col("id").alias("id1"), F.col("s").alias("s1")), vectors.select(F.col("id").alias("id2"), F.map_from_entries("s").alias("s2"))
    met = pairs.join(one, "id1").join(two, "id2")
    score = F.aggregate("s1", F.lit(0.0), lambda acc, e: acc + F.coalesce(e["weight"] * F.try_element_at("s2", e["number"]), F.lit(0.0)))
    return met.select("id1", "id2", score.alias("score")).where(F.col("score") >= threshold - SLACK)


def _met(postings: DataFrame, threshold: float, apart: Column | None = None) -> DataFrame:
    """Distinct pairs (id1 < id2) that share a gram of their prefixes at which they can still reach the threshold.

    A gram's postings are dealt into lists of about POSTINGS rows, and every
    two lists of a gram meet under a key of their own, so no gram is one task.
    """
    counts = postings.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > POSTINGS)
    lists = F.coalesce(F.ceil(F.col("n") / POSTINGS), F.lit(1)).cast("int")
    dealt = beside(postings, counts, ["number"], "left").withColumns({"lists": lists, "own": F.pmod(F.xxhash64("id"), lists).cast("int")}).drop("n")
    every = F.explode(F.sequence(F.lit(0), F.col("lists") - 1))
    a = dealt.select("*", F.col("own").alias("i"), every.alias("j")).alias("a")
    b = dealt.select("*", every.alias("i"), F.col("own").alias("j")).alias("b")
    bound = F.col("a.weight") * F.col("b.weight") + F.col("a.rest") * F.col("b.rest")
    fits = (F.col("a.id") < F.col("b.id")) & (bound >= threshold - SLACK)
    met = a.join(b, ["number", "i", "j"]).where(fits if apart is None else fits & apart)
    return met.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2")).distinct()


def cosine_self_join(
    df: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8
) -> DataFrame:
    """Pairs of distinct texts with character n-gram tf-idf cosine of at least the threshold.

    Prefix filtering keeps the join exact. In a global order (rare grams first)
    the rest of a vector after its prefix is shorter than the threshold, so any
    pair that reaches it shares a gram inside both prefixes. At the first shared
    gram the pair must also satisfy w1*w2 + rest1*rest2 >= threshold, which
    drops most pairs of a common gram before they leave the join. The survivors
    are verified with the full vectors.
    """
    vectors = _gram_vectors(df, key, text, n)
    return _scored(_met(_postings(vectors, threshold), threshold), vectors, threshold)


def cosine_links(df: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Enough of the pairs of :func:`cosine_self_join` to connect what they connect: (id1, id2).

    Every gram's smallest text is compared with all others of the gram, which
    is as many pairs as postings. Texts then carry the smallest text that they
    were linked to, and only texts that carry different ones meet in pairs.
    """
    vectors = _gram_vectors(df, key, text, n)
    postings = checkpoint(_postings(vectors, threshold))
    smallest = postings.groupBy("number").agg(F.min("id").alias("id1"), F.count(F.lit(1)).alias("n")).where("n > 1").select("number", "id1")
    stars = beside(postings.select("number", F.col("id").alias("id2")), smallest, ["number"]).where("id1 < id2").select("id1", "id2").distinct()
    links = checkpoint(_scored(stars, vectors, threshold).select("id1", "id2"))
    marks = links.groupBy(F.col("id2").alias("id")).agg(F.min("id1").alias("mark"))
    marked = beside(postings, marks, ["id"], "left").withColumn("mark", F.coalesce("mark", "id"))
    # Grams all of whose texts carry one mark connect nothing new.
    mixed = marked.groupBy("number").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("number")
    rest = beside(marked, mixed, ["number"], "left_semi")
    more = _met(checkpoint(rest), threshold, F.col("a.mark") != F.col("b.mark"))
    return links.unionByName(_scored(more, vectors, threshold).select("id1", "id2"))
