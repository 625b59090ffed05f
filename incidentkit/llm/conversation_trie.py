"""Prefix trie of conversations from vertical bitmaps.

A conversation is a sequence of turns. Conversations are dealt into shards and
their positions into blocks. A shard holds, for every (position, turn) that
occurs, the bitset of its conversations that have it. A depth-first walk starts
with the bitset of all that share the same turns before the block; the
intersection of a node's bitset with the posting of the next turn of its lowest
member is a child, the next member that is in no child yet names the next one.
Set bits are members, the lowest one is the smallest id, and the members whose
length is the depth end there. Nodes of all shards are then merged by the key
of their prefix, an exclusive or of 128-bit hashes of (position, turn): such a
key can be continued from block to block, so that a conversation of any length
is never in one task as a whole.

Sums over subtrees need no walk over the merged trie. A node is named by its
smallest member, so the nodes of one name are a chain that ends where that
conversation ends. A subtree is the rest of the node's own chain and the whole
chains of those members that get their name further down. The second walk adds
up these chains for all nodes above them, again shard by shard.

Cases: turns are ordered by ``turn``, null first; equal ones by role, then by
the hash of role and text. A null role or text is empty. Rows without a
conv_id take no part. Repeated rows are turns of their own. Texts of any length
travel as hashes. An empty table has no nodes. Only these four columns are
read, so others of any name do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from incidentkit.operators.beside import beside
from incidentkit.session import checkpoint

#: Positions of a block, conversations of a shard, and ids side by side that go to the same shard.
BLOCK, SHARD, NEAR = 1024, 1024, 64
#: Ids of one node that are joined into one piece before they are hashed.
PIECE = 4096
ROOT = bytes(16)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key (hash of role and text) and size (bytes of the text) of every turn.

    Rows are ranged by conversation and turn, so a conversation of any size is
    cut; what a range adds to the positions of the next ones is one row each.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("key"), F.octet_length(text).cast("long").alias("size"),
    )
    order = ["conv_id", "turn", "role", "key"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "size")
    numbered = checkpoint(ranged.mapInArrow(_number, "conv_id long, key string, size long, pos long, part int"))
    edges = numbered.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos")).alias("last"))
    marks = edges.select("part", F.col("first").alias("conv_id"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"))
    marks = marks.union(edges.select("part", "last.conv_id", F.lit(1), "last.pos"))
    before = Window.partitionBy("conv_id").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    ahead = marks.withColumn("ahead", F.sum("n").over(before)).where("kind = 0 and ahead > 0").select("part", "conv_id", "ahead")
    # One row per range at most.
    return numbered.join(F.broadcast(ahead), ["part", "conv_id"], "left").select("conv_id", (F.col("pos") + F.coalesce("ahead", F.lit(0))).alias("pos"), "key", "size")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position of every row in its run of equal ids."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.asarray(batch.column(0))
        starts = np.flatnonzero(np.diff(ids, prepend=ids[0]) != 0)
        starts = np.concatenate([[0], starts])
        run = np.searchsorted(starts, np.arange(len(ids)), side="right") - 1
        pos = np.arange(len(ids)) - starts[run] + 1
        if last is not None and ids[0] == last:
            pos[run == 0] += count
        last, count = ids[-1], int(pos[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int64()), pa.array(np.full(len(ids), part), pa.int32())], names=["conv_id", "key", "size", "pos", "part"])


def reopened(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with the first ``head`` turns of conversation ``base`` and go on with their own turns after these.

    Both columns are made from conv_id; ``head`` is at most ``most``. Returns the
    turns, and (conv_id, n) with the length of every conversation, 0 included.
    """
    turns = turns.withColumn("head", head)
    own = checkpoint(turns.groupBy("conv_id").agg(F.max("pos").alias("own")))
    heads = turns.where(F.col("pos") <= most).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "size"))).alias("opening"))
    asked = own.select("conv_id", "own", base.alias("base"), head.alias("head"))
    opened = asked.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    opened = opened.withColumn("opening", F.coalesce(F.slice("opening", 1, F.col("head").cast("int")), F.array().cast("array<struct<pos:bigint,key:string,size:bigint>>")))
    opened = checkpoint(opened.select("conv_id", "opening", F.size("opening").cast("long").alias("k"), (F.size("opening") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("n")))
    start = opened.select("conv_id", "n", F.inline("opening"))
    rest = turns.where("pos > head").join(opened.select("conv_id", "k", "n"), "conv_id")
    rest = rest.select("conv_id", "n", (F.col("pos") - F.col("head") + F.col("k")).alias("pos"), "key", "size")
    return start.union(rest), opened.select("conv_id", "n")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are, in the form that ``nodes`` takes."""
    lengths = checkpoint(turns.groupBy("conv_id").agg(F.max("pos").alias("n")))
    return turns.join(lengths, "conv_id").select("conv_id", "n", "pos", "key", "size"), lengths


def _segments(turns: DataFrame, conversations: int) -> DataFrame:
    """One row per conversation and block: the hashes and sizes of its turns, and the key of all turns before."""
    halves = [F.conv(F.substring("key", at, 16), 16, -10).cast("long") for at in (1, 17)]
    hashed = turns.select("conv_id", "n", "pos", F.xxhash64("pos", *halves).alias("a"), F.xxhash64(halves[1], "pos", halves[0]).alias("b"), "size")
    block = F.expr(f"(pos - 1) div {BLOCK}")
    packed = hashed.groupBy("conv_id", block.alias("block")).agg(
        F.first("n").alias("n"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sort_array(F.collect_list(F.struct("pos", "a", "b", "size"))).alias("s")
    )
    shards = max(1, -(-conversations // SHARD))
    shard = F.pmod(F.xxhash64(F.floor(F.col("conv_id") / NEAR)), F.lit(shards)).cast("int")
    packed = checkpoint(packed.select("conv_id", "block", "n", "xa", "xb", F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.size").alias("size"), shard.alias("shard"), (F.col("block") * BLOCK).alias("at")))
    long = packed.where("block = 1").select("conv_id")
    steps = packed.select("conv_id", "block", "xa", "xb").join(long, "conv_id", "left_semi")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = steps.select("conv_id", "block", F.bit_xor("xa").over(before).alias("sa"), F.bit_xor("xb").over(before).alias("sb")).where("block > 0")
    rows = packed.drop("xa", "xb")
    zero = F.lit(0).cast("long")
    return rows.where("block = 0").withColumns({"sa": zero, "sb": zero}).unionByName(beside(rows.where("block > 0"), starts, ["conv_id", "block"]))


def _number_of(a: int, b: int) -> int:
    return (int(a) & ((1 << 64) - 1)) << 64 | (int(b) & ((1 << 64) - 1))


class _Shard:
    """Conversations of a shard in order of their ids, and the postings of a block."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("conv_id")
        self.ids = pdf["conv_id"].tolist()
        self.turns = [[_number_of(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)] for a, b in zip(pdf["a"], pdf["b"], strict=True)]
        self.postings: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.roots: dict[int, int] = {}
        for i, (turns, start) in enumerate(zip(self.turns, map(_number_of, pdf["sa"], pdf["sb"]), strict=True)):
            bit = 1 << i
            for turn in turns:
                self.postings[turn] = self.postings.get(turn, 0) | bit
            self.ends[len(turns)] = self.ends.get(len(turns), 0) | bit
            self.roots[start] = self.roots.get(start, 0) | bit

    def walk(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(key, key of the parent, steps from the block's start, bitset, lowest member) of every node."""
        stack = [(key, 0, members) for key, members in self.roots.items()]
        while stack:
            key, steps, members = stack.pop()
            rest = members & ~self.ends.get(steps, 0)
            while rest:
                lowest = (rest & -rest).bit_length() - 1
                turn = self.turns[lowest][steps]
                child = rest & self.postings[turn]
                rest &= ~child
                yield key ^ turn, key, steps + 1, child, lowest
                stack.append((key ^ turn, steps + 1, child))


def _bits(members: int) -> Iterator[int]:
    while members:
        lowest = members & -members
        yield lowest.bit_length() - 1
        members ^= lowest


def _local_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a shard and block, with the ids of the conversations that end there."""
    shard = _Shard(pdf)
    at = int(pdf["at"].iloc[0])
    pdf = pdf.sort_values("conv_id")
    sizes, lengths = [s.tolist() for s in pdf["size"]], pdf["n"].tolist()
    rows = []
    for key, parent, steps, members, lowest in shard.walk():
        ends = [shard.ids[i] for i in _bits(members & shard.ends.get(steps, 0)) if lengths[i] == at + steps]
        rows.append((key.to_bytes(16), parent.to_bytes(16), at + steps, members.bit_count(), shard.ids[lowest], sizes[lowest][steps - 1], ends))
    return pd.DataFrame(rows, columns=["key", "parent", "depth", "members", "conv_id", "size", "ends"])


def _local_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chains of the members of every node of a shard and block, which holds turns above these chains only."""
    shard = _Shard(pdf)
    pdf = pdf.sort_values("conv_id")
    saved, leaves = pdf["saved"].tolist(), pdf["leaves"].tolist()
    rows = []
    for key, _, _, members, _ in shard.walk():
        who = list(_bits(members))
        rows.append((key.to_bytes(16), sum(saved[i] for i in who), sum(leaves[i] for i in who)))
    return pd.DataFrame(rows, columns=["key", "below_saved", "below_leaves"])


def nodes(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes, and (key, conv_id) of every conversation that ends at a node.

    ``turns`` has conv_id, n, pos, key, size; ``lengths`` conv_id, n. A node has
    key, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves (childless nodes in its subtree) and saved_tokens (over its
    subtree, bytes of a node's last text for each member but one).
    """
    all_convs = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    segments = checkpoint(_segments(turns, all_convs.n))
    found = checkpoint(
        segments.groupBy("block", "shard").applyInPandas(_local_nodes, "key binary, parent binary, depth long, members long, conv_id long, size long, ends array<long>")
    )
    merged = found.groupBy("key", "depth").agg(F.sum("members").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.first("size").alias("size"))
    merged = checkpoint(merged)
    children = merged.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    root = lengths.groupBy().agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("size"))
    tree = merged.unionByName(root).join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    tree = tree.withColumns({"saved": (F.col("n_convs") - 1) * F.col("size"), "leaf": (F.col("n_children") == 0).cast("long"), "block": F.expr(f"depth div {BLOCK}")})
    tree = checkpoint(tree)

    # A name's chain: whole sums, and the rest from each node on.
    by_block = tree.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"), F.min("depth").alias("top"))
    by_block = checkpoint(by_block)
    chains = by_block.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.min("top").alias("top"))
    chains = checkpoint(chains)
    # Blocks of a chain follow one another, so only those that have a later one need more than their own sums.
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    cut = by_block.join(by_block.where("block > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    later = cut.select("conv_id", "block", F.sum("saved").over(after).alias("later_saved"), F.sum("leaves").over(after).alias("later_leaves")).where("later_saved is not null")
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    rest = tree.withColumns({"rest_saved": F.sum("saved").over(down), "rest_leaves": F.sum("leaf").over(down)})
    rest = beside(rest, later, ["conv_id", "block"], "left")

    # Chains that start below a node of another name: their members' turns above the chain.
    above = segments.join(chains.where("top > 1"), "conv_id")
    keep = (F.col("top") - 1 - F.col("block") * BLOCK).cast("int")
    above = above.where(keep > 0).withColumns({c: F.slice(c, 1, keep) for c in ("a", "b")})
    local = above.select("block", "shard", "conv_id", "a", "b", "sa", "sb", "saved", "leaves").groupBy("block", "shard").applyInPandas(_local_sums, "key binary, below_saved long, below_leaves long")
    below = local.groupBy("key").agg(F.sum("below_saved").alias("below_saved"), F.sum("below_leaves").alias("below_leaves"))
    in_all = chains.where("top > 0").agg(F.sum("saved").alias("below_saved"), F.sum("leaves").alias("below_leaves"))
    below = below.unionByName(in_all.select(F.lit(ROOT).alias("key"), "below_saved", "below_leaves"))

    of_zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    summed = rest.join(below, "key", "left").select(
        "key", "parent", "conv_id", "depth", "n_convs", "n_children",
        (F.col("rest_leaves") + of_zero("later_leaves") + of_zero("below_leaves")).alias("n_leaves"),
        (F.col("rest_saved") + of_zero("later_saved") + of_zero("below_saved")).alias("saved_tokens"),
    )
    # A node has its parent's name unless its chain starts with it. Many chains may start below one node: both sides
    # are cut, so that adaptive execution can split that key.
    summed = checkpoint(summed.join(chains.select("conv_id", "top"), "conv_id"))
    starts = summed.where("depth = top and depth > 1")
    names = checkpoint(tree.where("n_convs > 1").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    least = F.lit(all_convs.least).cast("long")
    own = F.when(F.col("depth") > 0, F.when(F.col("depth") == 1, least).otherwise(F.col("conv_id")))
    plain = summed.where("depth > top or depth < 2").withColumn("parent_conv_id", own)
    out = plain.unionByName(starts.join(names, "parent")).drop("parent", "top")
    ends = found.select("key", F.explode("ends").alias("conv_id")).unionByName(lengths.where("n = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    return out, ends


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a sorted range as comma-joined pieces: key, first id, text."""
    held: list[tuple[bytes, int, list[str]]] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.binary()), pa.array([h[1] for h in held], pa.int64()), pa.array([",".join(h[2]) for h in held])], names=["key", "first", "ids"])

    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and held[-1][0] == key and len(held[-1][2]) < PIECE:
                held[-1][2].append(str(conv))
            else:
                if len(held) > PIECE:
                    yield out()
                    held.clear()
                held.append((key, conv, [str(conv)]))
    if held:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the pieces of every key, in their order; one piece is held at a time."""
    key, state, done = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["key", "ends_sha256"])
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256, the hash of the ids that end there, ascending and comma-joined.

    Ids are ranged and joined into pieces where they land, so the task that
    hashes a node streams one piece per PIECE ids.
    """
    order = ["key", "conv_id"]
    pieces = checkpoint(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "key binary, first long, ids string"))
    ordered = pieces.repartition("key").sortWithinPartitions("key", "first")
    return ordered.select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")


def with_digests(found: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes with ends_sha256 in place of their key."""
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(end_digests(ends), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).drop("key")
