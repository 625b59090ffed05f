"""Trie of conversations against nested dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from incidentkit.llm import conversation_trie as ct, queries


def in_order(rows):
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            held.setdefault(c, []).append(((turn is not None, turn or 0), role, mark, text))
    return {c: [(role, text) for _, role, _, text in sorted(v)] for c, v in held.items()}


def rebuilt(held):
    out = {}
    for c, turns in held.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = held.get(base, [])[:h] + turns[h:]
    return out


def brute(held):
    """One row per distinct prefix, by looking at every prefix."""
    members = {}
    for c, turns in held.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
        leaves[path] = leaves.get(path, 0) + (path not in children)
        saved[path] = saved.get(path, 0) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
        if path:
            leaves[path[:-1]] = leaves.get(path[:-1], 0) + leaves[path]
            saved[path[:-1]] = saved.get(path[:-1], 0) + saved[path]
    out = []
    for path, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(held[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), children.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 5, "y") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, depth int, key string")


def plain(spark, rows):
    found = ct.with_digests(*ct.nodes(*ct.whole(ct.ordered_turns(frame(spark, rows)))))
    return sorted(map(tuple, found.select(COLUMNS).collect()), key=str)


def by_query(spark, rows, tmp_path):
    path = str(tmp_path / f"c{random.random()}")
    frame(spark, rows).write.parquet(path + "/conversations.parquet")
    return sorted(map(tuple, queries.op12_conversation_trie(spark, path).select(COLUMNS).collect()), key=str)


def awkward(seed, convs=90, alphabet=3, most=12):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["", None, "é", "hi", "x" * 50][:alphabet])))
    rows += [(7, 0, "user", "hi"), (7, 0, "user", "hi"), (7, None, "user", "first"), (None, 1, "user", "lost"), (-7, 1, "a", "b"), (-5, 0, "a", "b"), (-6, 0, None, None), (10**17 + 3, 4, "z", "z" * 200000)]
    return rows


@pytest.mark.parametrize(("block", "shard", "near", "piece"), [(1024, 1024, 64, 4096), (2, 7, 3, 2), (3, 4, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, tmp_path, block, shard, near, piece):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("NEAR", near), ("PIECE", piece)):
        monkeypatch.setattr(ct, name, value)
    rows = awkward(block)
    assert plain(spark, rows) == brute(in_order(rows))
    assert by_query(spark, rows, tmp_path) == brute(rebuilt(in_order(rows)))


def test_hot_groups(spark, monkeypatch):
    """One conversation with a third of all rows, one opening and one whole conversation shared by a third of all."""
    monkeypatch.setattr(ct, "BLOCK", 64)
    monkeypatch.setattr(ct, "SHARD", 32)
    rows = [(1, t, "user", str(t)) for t in range(700)] + [(2, t, "user", str(t if t < 650 else -t)) for t in range(700)]
    rows += [(1000 + c, t, "user", "same") for c in range(300) for t in range(2)] + [(2000 + c, t, "user", "hello" if t == 0 else f"{c}") for c in range(300) for t in range(2)]
    assert plain(spark, rows) == brute(in_order(rows))


def test_empty_and_turnless(spark, tmp_path):
    assert plain(spark, []) == [] and by_query(spark, [], tmp_path) == []
    assert plain(spark, [(None, 1, "a", "b")]) == []
    # 7 opens with turns of 5, which is absent, and has no turns after them.
    short = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(short, 0, "user", "gone")]
    got = by_query(spark, rows, tmp_path)
    assert got == brute(rebuilt(in_order(rows))) and got[0][:6] == (short, 0, None, 1, 0, 1)


def test_positions_over_many_ranges(spark):
    rows = [(c, t, "r", "x") for c in (1, 2, 3) for t in range(400)] + [(2, None, None, None)]
    got = ct.ordered_turns(frame(spark, rows).repartition(5)).groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("z"))
    assert sorted(map(tuple, got.collect())) == [(1, 400, 400, 1, 400), (2, 401, 401, 1, 401), (3, 400, 400, 1, 400)]
