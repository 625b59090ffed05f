"""Near-duplicates by 64-bit SimHash with deletion-variant signatures.

A fingerprint is cut into three segments. Two fingerprints that differ in at
most four bits differ in at most one bit of some segment, so they share the
variant of that segment in which the differing bit is a wildcard. Variants
meet by equality and every hit is verified.

Cases: a null or empty text has fingerprint zero and links like any other. A
null id takes part, but never names a component; a component of such rows
alone has a null id. Repeated rows come back once each; an empty table gives no
rows. Texts of any length are hashed in bounded parts. Other columns of any
name do not clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from incidentkit.llm.common import per_text, texts
from incidentkit.session import checkpoint

WORDS_PER_SHINGLE = 4
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
TAG_SHIFT = 22  # a segment's value lies below, the number of the wildcard bit above
SMALL_BUCKET = 64  # members of a bucket that are compared where they are sorted
BLOCK = 2048  # members of a larger bucket that are compared at once
BROADCAST_KEYS = 50_000  # keys of large buckets that are sent to every executor at most


def fingerprint(text: bytes | None) -> int:
    """SimHash of a text's bytes as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = starts + lengths
    last = max(len(words) - WORDS_PER_SHINGLE + 1, 1)
    starts, ends = starts[:last], ends[min(WORDS_PER_SHINGLE, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 8192):
        hashes = np.array(
            [xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[at : at + 8192].tolist(), ends[at : at + 8192].tolist(), strict=True)],
            "<u8",
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (long) of every row."""
    return per_text(texts(docs), "doc_id long, fp long", lambda: lambda t: (fingerprint(t),))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node that has an edge.

    Every round maps a node to its first neighbour in an order that is drawn
    anew, and on to that one's first neighbour, which removes a constant share
    of the nodes of any graph, also of a chain; edges inside a merged node
    vanish. It ends when no edge is left; the rounds' maps are then chained.
    """
    left = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while left.count():
        turn = F.lit(len(steps))
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(turn, F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        best = ends.groupBy("node").agg(F.min(rank("other")).alias("m")).select("node", F.least(rank("node"), "m")["id"].alias("root"))
        onward = best.select(F.col("node").alias("root"), F.col("root").alias("next"))
        # Cut here: the joins below then see plain inputs, which can be split where a node has very many edges.
        step = checkpoint(best.join(onward, "root").select("node", F.col("next").alias("root")))
        steps.append(step)
        a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        merged = left.join(a, "a").join(b, "b").where("ra <> rb")
        left = checkpoint(merged.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    roots = steps[0]
    for step in steps[1:]:
        moved = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return checkpoint(roots)


def _variants(points: DataFrame) -> DataFrame:
    """One row per fingerprint and wildcard bit, keyed by the segment without that bit."""
    keys = []
    for low, width in SEGMENTS:
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        for bit in range(width):
            keys.append(part.bitwiseAND(F.lit(~(1 << bit) & ((1 << width) - 1))).bitwiseOR(F.lit((low + bit) << TAG_SHIFT)))
    return points.select("fp", F.explode(F.array(*keys)).alias("key"))


def _first_shared(key: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Is this the first of the keys that two fingerprints share? So a pair is named once."""
    tag = key >> TAG_SHIFT
    first = np.zeros(len(key), bool)
    before = np.ones(len(key), bool)
    for low, width in SEGMENTS:
        own = differing & np.uint64(((1 << width) - 1) << low)
        near = np.bitwise_count(own) <= 1
        place = np.where(own == 0, low, np.bitwise_count(own - np.uint64(1)).astype(np.int64))
        first |= before & near & (tag == place)
        before &= ~near
    return first


def _pairs_in_runs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one bucket at most MAX_BITS apart; rows are sorted by key."""
    left, right = [fp[:0]], [fp[:0]]
    gap = 1
    while gap < len(key):
        at = np.flatnonzero(key[gap:] == key[:-gap])
        if not len(at):
            break
        differing = fp[at] ^ fp[at + gap]
        keep = np.bitwise_count(differing) <= MAX_BITS
        at, differing = at[keep], differing[keep]
        at = at[_first_shared(key[at], differing)]
        left.append(fp[at])
        right.append(fp[at + gap])
        gap += 1
    return np.concatenate(left), np.concatenate(right)


def _link_runs(batches):
    """Links of all buckets of a sorted partition; the last bucket of a batch waits for the next batch."""
    key, fp = np.zeros(0, np.int32), np.zeros(0, np.uint64)

    def linked(n):
        a, b = _pairs_in_runs(key[:n], fp[:n])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(key):
            n = int(np.searchsorted(key, key[-1]))
            yield linked(n)
            key, fp = key[n:], fp[n:]
    yield linked(len(key))


def _link_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links within one pair of blocks of a large bucket."""
    fp = pdf["fp"].to_numpy().view(np.uint64)
    parent = list(range(len(fp)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for at in range(0, len(fp), 256):
        i, j = np.nonzero(np.bitwise_count(fp[at : at + 256, None] ^ fp[None, :]) <= MAX_BITS)
        for x, y in zip((i + at).tolist(), j.tolist(), strict=True):
            if x < y and (a := find(x)) != (b := find(y)):
                parent[b] = a
                out.append((x, y))
    held = fp.view(np.int64)
    return pd.DataFrame({"a": held[[x for x, _ in out]], "b": held[[y for _, y in out]]})


def _links(points: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints at most MAX_BITS apart, enough of them to join their components.

    Buckets of up to SMALL_BUCKET members are sorted next to each other and
    compared where they land, and each pair is named under its first key.
    Larger buckets are cut into blocks; a pair of blocks is one group of
    bounded size and yields a spanning forest instead of all its pairs. Both
    ways find the same components.
    """
    variants = _variants(points)
    large = checkpoint(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL_BUCKET))
    held = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
    rest = variants.join(held, "key", "left_anti").select("key", "fp")
    links = rest.repartition("key").sortWithinPartitions("key").mapInArrow(_link_runs, "a long, b long")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    hot = variants.join(held, "key").withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    hot = hot.select("key", "fp", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    hot = hot.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return links.union(hot.applyInPandas(_link_block, "a long, b long"))


def _named(rows: DataFrame) -> DataFrame:
    """fp, comp (a fingerprint that stands for the component) and component_id of every fingerprint."""
    points = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(_links(points))
    points = points.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("comp", F.coalesce("root", "fp"))
    # Cut on both sides of the group: a component of very many fingerprints, or a fingerprint of very many rows, can then be split.
    points = checkpoint(points)
    names = checkpoint(points.groupBy("comp").agg(F.min("first").alias("component_id")))
    return checkpoint(points.join(names, "comp").select("fp", "comp", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest id of the row's component."""
    rows = checkpoint(fingerprints(docs))
    return rows.join(_named(rows), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component: the smallest id, at a tie the smallest hash of the text; ids that are null come last.

    Rows of equal id and text are copies of each other; which of them stays is
    decided by a hash of all columns. Texts are shuffled once, next to the keys
    of the rows that stay.
    """
    marked = lambda t: (fingerprint(t), hashlib.md5(t or b"").digest())
    rows = checkpoint(per_text(texts(docs), "doc_id long, fp long, mark binary", lambda: marked))
    keys = rows.join(_named(rows).select("fp", "comp"), "fp").groupBy("comp", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "mark", "n"))
    kept = checkpoint(keys.groupBy("comp").agg(first.alias("m")).select("m.doc_id", "m.mark", "m.n"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("mark"))

    def next_to(wanted: DataFrame) -> DataFrame:
        w = wanted.select(F.col("doc_id").alias("id"), F.col("mark").alias("of"))
        return whole.join(w, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")))

    alone = next_to(kept.where("n = 1")).select("row.*")
    copies = kept.where("n > 1")
    count = copies.count()
    if not count:
        return alone
    # An aggregate, not a window: copies of one row are reduced before they are shuffled.
    found = next_to(F.broadcast(copies) if count <= BROADCAST_KEYS else copies)
    one = found.groupBy("doc_id", "mark").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return alone.union(one.select("row.*"))
