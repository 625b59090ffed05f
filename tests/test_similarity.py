import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from incidentkit.operators import grouping as G, similarity as S
from incidentkit.operators.joins import first_claim
from incidentkit.plans.tickets import link_candidates, match_report


def test_cosine_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(5, 12))
    # One centre holds half of all vectors.
    pick = np.where(rng.random(400) < 0.5, 0, rng.integers(0, 5, 400))
    v = centers[pick] + 0.6 * rng.normal(size=(400, 12))
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id int, v array<double>")
    left, right = df.where("id < 150").withColumnRenamed("id", "a"), df.where("id >= 150").withColumnRenamed("id", "b")
    got = {(r.a, r.b) for r in S.cosine_join(left, right, "a", "b", "v", 0.75, pivots=6, block=16).collect()}
    size = np.linalg.norm(v, axis=1)
    unit = v / np.where(size > 0, size, 1)[:, None]
    want = {(i, j) for i in range(150) for j in range(150, 400) if unit[i] @ unit[j] > 0.75}
    assert got == want and len(want) > 100


def test_first_left_row_only(spark):
    rng = np.random.default_rng(2)
    v = np.vstack([np.tile([1.0, 0.2, 0.0], (90, 1)), rng.normal(size=(60, 3))])
    df = spark.createDataFrame([(i, (i * 37) % 150, [float(x) for x in row]) for i, row in enumerate(v)], "id int, row_no int, v array<double>")
    left, right = df.where("id % 2 = 0").withColumnRenamed("id", "a"), df.where("id % 2 = 1").withColumnRenamed("id", "b")
    every = S.cosine_join(left, right, "a", "b", "v", 0.75, pivots=4, block=8)
    few = S.cosine_join(left, right, "a", "b", "v", 0.75, pivots=4, block=8, first="row_no")

    def claims(pairs):
        rows = pairs.join(left.select("a", "row_no"), "a")
        return {r.b: r.a for r in first_claim(rows, "b", ["row_no", "a"]).collect()}

    assert few.count() < every.count() and claims(few) == claims(every)


def grams(text, n=5):
    t = text.translate(str.maketrans("", "", ",-./"))
    return Counter(t[i : i + n] for i in range(len(t) - n + 1))


def brute_pairs(names, threshold=0.8):
    counts = {x: grams(x) for x in names}
    df = Counter(g for c in counts.values() for g in c)
    vec = {}
    for x, c in counts.items():
        w = {g: k * (math.log((1 + len(names)) / (1 + df[g])) + 1) for g, k in c.items()}
        size = math.sqrt(sum(a * a for a in w.values())) or 1
        vec[x] = {g: a / size for g, a in w.items()}
    out = {}
    for a, b in itertools.combinations(sorted(names), 2):
        s = sum(w * vec[b].get(g, 0) for g, w in vec[a].items())
        if s >= threshold:
            out[a, b] = s
    return out


def test_self_join_is_exact(spark):
    names = [f"printer {k} in kamer {i % 40} doet het niet" for i in range(80) for k in ("a", "kleur", "zwart wit")]
    names += [f"outlook start niet op {i}" for i in range(40)] + ["kort", ""]
    names = sorted(set(names))
    df = spark.createDataFrame([(x,) for x in names], "name string")
    got = {(r.id1, r.id2): r.score for r in S.cosine_self_join(df, "name", "name").collect()}
    want = brute_pairs(names)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_groups_of_chain_star_and_ring(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 400)]
    ring = [(500 + i, 500 + (i + 1) % 20) for i in range(20)]
    joined = [(700, 701), (702, 703), (701, 702)]
    df = spark.createDataFrame(chain + star + ring + joined + [(900, 900)], "id1 long, id2 long")
    got = {r.name: r.group for r in G.connected_groups(df).collect()}
    want = {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 400)}, **{i: 500 for i in range(500, 520)}, **{i: 700 for i in range(700, 704)}}
    assert got == want


def test_no_pairs_no_groups(spark):
    assert G.connected_groups(spark.createDataFrame([], "id1 long, id2 long")).count() == 0


def test_hidden_incidents(spark):
    rows = [(1, "p", "a", 0.9, None), (2, "p", "b", 0.8, None), (3, "q", "c", 0.9, None), (4, "p", "a", 0.95, None), (5, "p", "d", 0.7, "m"), (6, "q", "a", 0.99, "m")]
    df = spark.createDataFrame(rows, "pair_id int, level2 string, level3 string, score double, linked_to string")
    assert {(r.level3, r.pair_id) for r in G.hidden_incidents(df).collect()} == {("a", 4), ("b", 2)}
    kept = G.hidden_incidents(df, workaround=F.col("pair_id") == 2)
    assert {r.level3 for r in kept.collect()} == {"a"}


def test_link_candidates(spark):
    vectors = spark.createDataFrame([("mail", [1.0, 0.0]), ("printer", [0.0, 1.0]), ("kapot", [0.1, 0.1])], "word string, vector array<double>")
    problems = spark.createDataFrame([("P1", 1, "mail kapot", "mail"), ("P2", 2, "mail", "mail kapot")], "problem_id string, row_no int, short_text string, request string")
    tickets = spark.createDataFrame(
        [("I1", 1, None, "Mail!", "mail"), ("I2", 2, None, "printer kapot", "printer"), ("I3", 3, "P2", "printer", "printer"), ("I4", 4, None, "onbekend", None)],
        "incident_id string, row_no int, problem_id string, short_text string, request string",
    )
    claims = link_candidates(problems, tickets, vectors, vectors, 2, 2)
    got = {r.incident_id: (r.problem_id, r.level2, r.phase) for r in claims.collect()}
    assert got == {"I1": ("P1", "P1", 1), "I2": ("P2", "I3", 2)}
    report = match_report(claims, problems, tickets.withColumn("link_kind", F.lit("RK")))
    assert len(report.columns) == 16 and report.count() == 2


def clustered(seed, groups, size, dims=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims))
    return np.repeat(middles, size, axis=0) + 0.05 * rng.normal(size=(groups * size, dims))


def test_block_pairs_grow_less_than_quadratically(spark):
    """Four times as many groups: sixteen times as many pairs of rows, but few more pairs of blocks per row."""

    def pairs(groups):
        v = clustered(3, groups, 40)
        df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id int, v array<double>")
        left, right = df.where("id % 2 = 0").withColumnRenamed("id", "a"), df.where("id % 2 = 1").withColumnRenamed("id", "b")
        return S._prepared(left, right, "a", "b", "v", 0.95, None, 16, None)[-1].count()

    assert pairs(80) < 10 * pairs(20)


def test_pivots_and_blocks_do_not_change_the_pairs(spark):
    v = clustered(5, 8, 30)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id int, v array<double>")
    left, right = df.where("id < 100").withColumnRenamed("id", "a"), df.where("id >= 100").withColumnRenamed("id", "b")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for threshold in (0.3, 0.9):
        want = {(i, j) for i in range(100) for j in range(100, 240) if unit[i] @ unit[j] > threshold}
        for pivots, block in ((None, 2048), (None, 8), (25, 4), (1, 50)):
            rows = S.cosine_join(left, right, "a", "b", "v", threshold, pivots=pivots, block=block).collect()
            assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)


def test_order_column_must_be_whole_numbers(spark):
    df = spark.createDataFrame([(1, "x", [1.0])], "a int, o string, v array<double>")
    try:
        S.cosine_join(df, df.withColumnRenamed("a", "b"), "a", "b", "v", 0.5, first="o")
    except ValueError:
        return
    raise AssertionError("a text column was taken as an order")


def test_links_connect_what_pairs_connect(spark, monkeypatch):
    names = [f"printer {k} in kamer {i % 40} doet het niet" for i in range(80) for k in ("a", "kleur", "zwart wit")]
    names += [f"outlook start niet op {i}" for i in range(40)] + ["kort", ""]
    df = spark.createDataFrame([(x,) for x in sorted(set(names))], "name string")
    pairs = S.cosine_self_join(df, "name", "name")
    want = {r.name: r.group for r in G.connected_groups(pairs).collect()}
    for postings in (512, 3):
        monkeypatch.setattr(S, "POSTINGS", postings)
        links = S.cosine_links(df, "name", "name")
        assert {r.name: r.group for r in G.connected_groups(links).collect()} == want
        got = {(r.id1, r.id2) for r in S.cosine_self_join(df, "name", "name").collect()}
        assert got == {(r.id1, r.id2) for r in pairs.collect()}
    # Many copies of one sentence: a star has as many links as texts, not as many as pairs.
    copies = spark.createDataFrame([(f"de printer op de derde verdieping van gebouw {i} geeft een melding",) for i in range(300)], "name string")
    links = S.cosine_links(copies, "name", "name", threshold=0.15)
    assert 0 < links.distinct().count() < 12 * 300 and len({r.group for r in G.connected_groups(links).collect()}) == 1


def test_low_threshold_meets_every_pair_once(spark):
    rng = np.random.default_rng(4)
    v, w = rng.normal(size=(120, 6)), rng.normal(size=(120, 4))
    v[3], w[3], w[50], v[70] = 0, 0, 0, 0
    rows = [(i, (i * 7) % 120, v[i].tolist(), w[i].tolist() if i != 90 else None) for i in range(120)]
    df = spark.createDataFrame(rows + [rows[1], rows[2]], "id int, row_no int, short_vector array<double>, request_vector array<double>")
    left, right = df.where("id % 3 = 0").withColumnRenamed("id", "a"), df.where("id % 3 <> 0").withColumnRenamed("id", "b").drop("row_no")
    w[90] = 0
    unit = [x / np.where((n := np.linalg.norm(x, axis=1)) > 0, n, 1)[:, None] for x in (v, w)]
    want = Counter()
    for i in range(0, 120, 3):
        for j in (j for j in range(120) if j % 3):
            s = [float(x[i] @ x[j]) for x in unit]
            if max(s) > 0.35:
                want[i, j, round(s[0], 9), round(s[1], 9)] += 1 + (j in (1, 2))
    pairs = S.score_pairs(left, right, "a", "b", threshold=0.35)
    assert Counter((r.a, r.b, round(r.score_short, 9) + 0.0, round(r.score_request, 9) + 0.0) for r in pairs.collect()) == want and len(want) > 500
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # pairs are neither made distinct nor joined back to their vectors
    few = S.score_pairs(left, right, "a", "b", threshold=0.35, first="row_no").collect()
    number = {i: (i * 7) % 120 for i in range(120)}
    best = {j: min((number[i], i) for i, k, *_ in want if k == j)[1] for _, j, *_ in want}
    assert {j: min((number[r.a], r.a) for r in few if r.b == j)[1] for j in best} == best
    assert S.score_pairs(left.limit(0), right, "a", "b", threshold=0.35).count() == 0
