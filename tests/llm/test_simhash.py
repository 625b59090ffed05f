"""Fingerprints against a plain form, components against brute force."""

import random

import pytest
import xxhash

from incidentkit.llm import simhash


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """Smallest id reachable over links of at most four bits."""
    n = len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return [names.get(find(i)) for i in range(n)]


def test_fingerprint():
    for text in (None, "", "One", "a b c", "A b\tC d e\x0bf", "É ß\xa0x y z", "one two three four five six " * 3000):
        assert simhash.fingerprint(text.encode() if text else text) & (2**64 - 1) == plain(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def points(seed, clouds, size, spread, chain=0):
    """Clouds of near fingerprints, single ones, and a chain of four-bit steps."""
    rng = random.Random(seed)
    out = []
    for _ in range(clouds):
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, spread)):
                x ^= 1 << b
            out.append(x)
    out += [rng.getrandbits(64) for _ in range(60)]
    x = rng.getrandbits(64)
    for _ in range(chain):
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        out.append(x)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("small", "block"), [(128, 2048), (4, 16), (1, 8)])
def test_components_equal_brute_force(spark, monkeypatch, small, block):
    """Small buckets by a join, large ones by blocks: both give the same components."""
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = [(i, x) for i, x in enumerate(points(3, 6, 40, 5, chain=30))]
    rows += [(None, rows[0][1]), (5000, rows[1][1]), (5000, rows[1][1])]
    df = spark.createDataFrame([(d, signed(x)) for d, x in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    got = sorted((str(r.doc_id), r.fp, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == sorted((str(d), signed(x), c) for (d, x), c in zip(rows, brute(rows), strict=True))


def test_query_equals_brute_force(spark):
    from incidentkit.llm.queries import op10_simhash

    rows = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op10_simhash(spark, "/root/testdata/sf0.001").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(plain(texts[d]) == fp for d, fp, _ in rows)
    assert [c for *_, c in rows] == brute([(d, fp) for d, fp, _ in rows])


def test_keep_one_and_awkward_rows(spark):
    rows = [(4, "a b c d e", 1, "k"), (2, "A b c d E", 2, "l"), (2, "A b c d E", 2, "l"), (9, None, 3, "m"), (7, "", 3, None), (None, "lost row", None, "n"), (3, "quite another text here", 5, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.fp) for r in kept.collect()) == [(0, "n"), (2, "l"), (3, "o"), (7, None)]
    # Copies without an id are one component; one id over two texts is two; columns of any name.
    rows = [(None, "some text without an id", "p"), (None, "some text without an id", "q"), (5, "first of two texts", "r"), (5, "quite a second one here", "s"), (6, "First of two texts", "t")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, mark string, n int, id int, row int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text.split()[0]) for r in kept.collect()) == [(0, "some"), (5, "first"), (5, "quite")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0
