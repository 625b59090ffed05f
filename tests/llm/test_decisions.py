"""Decontamination, quality, language, URL, secrets and main text on small fixtures."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentkit.llm import decontaminate, html_blocks, language_id, quality, queries, secret_ledger, url_templates
from incidentkit.llm.common import table

SMALL = "/root/testdata/sf0.001"


# Decontamination


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_best_place_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.randint(1, 4) for _ in range(rng.randint(3, 7))]
        region = [rng.randint(0, 4) for _ in range(rng.randint(0, 14))]
        edits, start = decontaminate.best_place(np.array(item), np.array(region, dtype=np.int64))
        least = min(edit_distance(item, region[i:j]) for i in range(len(region) + 1) for j in range(i, len(region) + 1))
        assert edits == least
        assert any(edit_distance(item, region[start:j]) == least for j in range(start, len(region) + 1))


def test_recall_on_planted_passages():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 60)))) for i in range(50)]
    index = decontaminate.Index(items)
    texts, truth = [], []
    for _ in range(400):
        i, text = rng.choice(items)
        words = text.split()
        most = decontaminate.accepted(len(words))
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choices(["zz", rng.choice(vocabulary)], k=rng.randint(0, 1))
        around = rng.choices(vocabulary, k=80)
        cut = rng.choice([0, 40, 80])
        texts.append(" ".join(around[:cut] + words + around[cut:]))
        truth.append(i)
    found = [{f[0]: f for f in own} for at in range(0, len(texts), 64) for own in index.find(texts[at : at + 64])]
    assert sum(i in own for i, own in zip(truth, found, strict=True)) >= 0.98 * len(texts)
    # What is reported is within its distance of the item, by brute force.
    by_id = dict(items)
    for text, own in list(zip(texts, found, strict=True))[:30]:
        words = text.split()
        for i, edits, n, first in own.values():
            item = by_id[i].split()
            assert n == len(item) and edits == min(edit_distance(item, words[first:e]) for e in range(first, min(len(words), first + n + edits) + 1))
    assert index.find([" ".join(rng.choices(vocabulary, k=300)) for _ in range(20)]) == [[]] * 20


@pytest.mark.parametrize("size", [8, 12, 20, 30, 40, 59])
@pytest.mark.parametrize("part", ["anywhere", "first half", "last half", "opening"])
def test_recall_at_the_accepted_distance(size, part):
    """As many edits as are accepted, wherever they are."""
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=size))) for i in range(30)]
    index, k = decontaminate.Index(items), decontaminate.accepted(size)
    low, high = {"anywhere": (0, size), "first half": (0, size // 2), "last half": (size - size // 2, size), "opening": (0, k)}[part]
    texts, truth = [], []
    for _ in range(150):
        i, text = rng.choice(items)
        words = text.split()
        for at in sorted(rng.sample(range(low, high), k), reverse=True):
            words[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
        around = rng.choices(vocabulary, k=60)
        cut = rng.choice([0, 30, 60])
        texts.append(" ".join(around[:cut] + words + around[cut:]))
        truth.append(i)
    found = [{f[0] for f in own} for at in range(0, len(texts), 64) for own in index.find(texts[at : at + 64])]
    assert sum(i in own for i, own in zip(truth, found, strict=True)) >= 0.98 * len(texts)


def test_short_items_and_scripts_without_blanks():
    index = decontaminate.Index([(1, "Forty two"), (2, "yes"), (3, "東京の首都はどこですか"), (4, "one two three four"), (5, "四 月")])
    texts = ["it is forty-two, forty two", "no", "問題：東京の首都はどこですか。", "one two three five four", "YES!", "eyes", "一二三四月五", "one two three four", "x" * 50, None]
    got = [sorted((f[0], f[1], f[3]) for f in own) for own in index.find(texts)]
    assert got == [[(1, 0, 2)], [], [(3, 0, 2)], [], [(2, 0, 0)], [], [(5, 0, 3)], [(4, 0, 0)], [], []]


def test_op1_finds_all_exact_passages(spark):
    clean = lambda t: " " + " ".join(decontaminate.words(t)) + " "
    docs = [(r.doc_id, clean(r.text)) for r in table(spark, SMALL, "documents").collect()]
    items = [(r.item_id, clean(r.text)) for r in table(spark, SMALL, "benchmark").collect()]
    exact = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op1_decontaminate(spark, SMALL).collect()}
    assert exact and exact <= {k for k, e in got.items() if e == 0}


def test_leaks_awkward_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (6, "clean text"), (5, item.upper()), (None, "one two three four five six")], "item_id long, text string")
    rows = [(1, f"x {item} y", "a"), (1, f"x {item} y", "b"), (2, None, None), (3, "", "c"), (None, item, "d"), (6, "word " * 50_000 + item, "e"), (7, "clean text", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = sorted((r.doc_id or 0, r.item_id, r.edits, r.first_word) for r in decontaminate.leaks(docs, items).collect())
    assert got == [(0, 1, 0, 0), (0, 5, 0, 0), (1, 1, 0, 1), (1, 1, 0, 1), (1, 5, 0, 1), (1, 5, 0, 1), (6, 1, 0, 50_000), (6, 5, 0, 50_000), (7, 6, 0, 0)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, items, per_pass=1).collect()) == [2, 3]
    assert sorted(map(tuple, decontaminate.leaks(docs, items, per_pass=1).collect()), key=str) == sorted(map(tuple, decontaminate.leaks(docs, items).collect()), key=str)
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


# Quality


def test_quality_features_equal_plain_form():
    text = "ab abc abc  d"
    words, pairs, grams = quality.Features()(quality.characters(text.encode()))
    assert len(words[0]) == 4 and words[0][1] == words[0][2] and len(set(words[0].tolist())) == 3
    assert len(pairs[0]) == 3
    # n-grams of " ab ", " abc ", " abc ", " d ": inside blanks are not allowed.
    plain = [w[i : i + n] for w in (" ab ", " abc ", " abc ", " d ") for n in quality.GRAMS for i in range(len(w) - n + 1)]
    assert len(grams[0]) == len(plain) and len(set(grams[0].tolist())) == len(set(plain))


def test_quality_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op2_quality(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    held = [(got[d].predicted, y) for d, y in truth.items() if d in got and got[d].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())


def test_quality_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 1.0), (2, "bad bad bad bad", 2.0), (3, None, 3.0), (4, "", 4.0), (None, "x " * 300_000, 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (9, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, may_teach=F.lit(True))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores.values()) and scores[1] > scores[2] and scores[3] == scores[4]
    assert quality.score(docs.limit(0), model).count() == 0
    for rows, least in (([], 0.5), ([(1, 1)], 0.9)):
        one = quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int"), may_teach=F.lit(True))
        assert quality.score(docs, one).agg(F.min("score")).first()[0] >= least


def test_long_texts_are_cut_at_blanks(monkeypatch):
    text = ("alpha beta " * 500).encode()
    whole = sorted(quality.Features()(quality.characters(text))[0][0].tolist())
    monkeypatch.setattr(quality, "PIECE", 100)
    parts = [b for run in quality.runs(quality.characters(text)) for b in quality.Features()(run)[0][0].tolist()]
    assert sorted(parts) == whole


# Language


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = language_id.Network(["a", "b", "c"], hidden=3)
    data = rng.integers(97, 100, (4, 5)).astype(np.uint8)
    mask = np.arange(5)[None, :] < np.array([5, 3, 4, 1])[:, None]
    y = np.array([0, 1, 2, 1])
    for p in (net.out, *(w.p for w in net.ways)):
        for k in p:
            p[k] = p[k].astype(np.float64)
    _, grads = net.gradients(data, mask, y)
    for p, g in zip((net.out, *(w.p for w in net.ways)), grads, strict=True):
        for k in p:
            flat, slope = p[k].ravel(), g[k].ravel()
            for i in np.argsort(-np.abs(slope))[:3]:
                old = flat[i]
                losses = []
                for step in (1e-3, -1e-3):
                    flat[i] = old + step
                    losses.append(net.gradients(data, mask, y)[0])
                flat[i] = old
                assert abs((losses[0] - losses[1]) / 2e-3 - slope[i]) < 1e-3 + 0.02 * abs(slope[i])


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in table(spark, folder, "documents").select("doc_id", "lang").collect()}
    rows = queries.op4_language(spark, folder).collect()
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]
    assert len(rows) == len(truth) and sum(held) / len(held) > 0.95


def test_language_awkward_rows(spark):
    rows = [(1, "der die das und", "de"), (2, "the of and to", "en"), (3, None, "en"), (4, "", None), (5, "123 !!", "de"), (None, "und", "de"), (7, "a" * 100_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in language_id.predict(docs, net).collect()}
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["de", "en", "und", "und", "und"]
    assert language_id.predict(docs.limit(0), net).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.limit(0), F.lit(True))).collect()} == {"und"}


# URLs


def plain_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest, re.S)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(t), v, t) for v, t in queries.RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return host, path, (max(fits)[1], max(fits)[2]) if fits else None


def test_urls_equal_plain_rules(spark):
    odd = [None, "", "no scheme", "://x", "http://NET", "http://Net/", "ftp://a.EXAMPLE.net/en/1", "http://a.example.net/enx", "http://example.com/de/?q", "http://x.org/fr/a?b#c", "http://xorg/fr/", "http://É.net/a\nb", "http://a://b/net/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(odd)] + [(None, "http://b.net/", "h"), (3, "://x", "h")], "page_id long, url string, host string")
    pages = pages.unionByName(table(spark, SMALL, "pages").select("page_id", "url", F.lit("h").alias("host")))
    inputs = sorted(map(str, (plain_rule(r.url)[:2] for r in pages.collect())))
    got = url_templates.judge(pages, queries.RULES).collect()
    assert sorted(map(str, ((r.host, r.path) for r in got))) == inputs
    for r in got:
        rule = plain_rule(f"x://{r.host}{r.path}")[2] if r.host else None
        assert r.rule == (rule[1] if rule else None) and r.verdict in ("allow", "block") and (not rule or r.verdict == rule[0])
    assert url_templates.judge(pages.limit(0), queries.RULES).count() == 0
    assert {r.verdict for r in url_templates.judge(pages, ()).collect()} == {"allow"}


def test_template_tree_learns_and_merges(spark):
    rows, labels = [], []
    for i in range(400):
        part = ["spam", "junk", "news", "blog"][i % 4]
        rows.append((i, f"http://h.test/{part}/{i}.html"))
        if i % 3:
            labels.append((i, int(part in ("spam", "junk"))))
    rows += [(1000 + i, f"http://h.test/u/name{chr(97 + i % 26)}{'x' * (i // 26)}/profile") for i in range(300)]
    got = {r.page_id: r for r in url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), (), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert {r.verdict for i, r in got.items() if i < 400 and i % 4 < 2} == {"block"} and {r.verdict for i, r in got.items() if i < 400 and i % 4 > 1} == {"allow"}
    assert {got[i].template for i in (0, 1)} == {"/junk|spam/#.html"} and {got[i].template for i in (2, 3)} == {"/blog|news/#.html"}
    assert {r.template for i, r in got.items() if i >= 1000} == {"/u/*/profile"} and {r.verdict for i, r in got.items() if i >= 1000} == {"allow"}


# Secrets


def plain_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out)]


def test_spans_equal_plain_patterns():
    rng = random.Random(2)
    parts = ["password", "PassWd", "ſecret", "token", "apiKey", "api_key", "=", ":", " ", '"', "'", "abcdefgh", "a1", "AKIA", "AKIAABCDEFGHIJKL", "é", "😀", "0123456789abcdef" * 2, "ff", "\n", "token=token:", "==", "-----BEGIN RSA PRIVATE KEY-----"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        base = [f"{k}:{s}:{e}" for k, s, e in secret_ledger.find_spans(text.encode()) if k in secret_ledger.BASE]
        assert base == plain_spans(text), text


def test_logins_of_any_length():
    for scheme in ("https", "x" * 4000 + "9+", "9ftp"):
        for user, password in (("u", "abc"), ("user" * 40, "p" * 5000)):
            text = f"é {scheme}://{user}:{password}@host/x"
            found = [s for s in secret_ledger.find_spans(text.encode()) if s[0] == "url_login"]
            start = 2 + (scheme == "9ftp")
            assert found == [("url_login", start, len(text) - len("host/x"))]
    for text in ("http://host/a:b@c", "x://u:abc@h", "://u:abc@h", "http://u:ab@h", "http://u v:abc@h"):
        assert not secret_ledger.find_spans(text.encode())
    start = time.time()
    secret_ledger.find_spans(b"a" * 2_000_000 + b"://" * 300_000)
    assert time.time() - start < 20


def test_op6_equals_plain_form(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    rows = queries.op6_secrets(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign:", "access:", "hex:"))
        assert [s for s in r.spans.split(",") if s.split(":")[0] in secret_ledger.BASE] == [s for s in base]


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_ledger_scans_only_what_is_new(spark, tmp_path, monkeypatch, broadcast_rows):
    monkeypatch.setattr(secret_ledger, "BROADCAST_ROWS", broadcast_rows)
    secret = "token=abcdefgh12"
    rows = [(1, f"é {secret}", "a"), (2, f"é {secret}", "b"), (3, None, "c"), (4, "", "d"), (None, f"lone {secret}", "e"), (5, "x" * 200_000 + secret, "f"), (5, "other", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    ledger = str(tmp_path / "ledger")
    one = sorted((r.doc_id or 0, r.spans) for r in secret_ledger.scan(docs, ledger).collect())
    assert one == sorted([(1, "assign:2:18"), (2, "assign:2:18"), (3, ""), (4, ""), (0, "assign:5:21"), (5, "assign:200000:200016"), (5, "")])
    held = lambda: spark.read.parquet(ledger).count()
    assert held() == 5
    secret_ledger.scan(docs, ledger).collect()
    assert held() == 5
    more = docs.union(spark.createDataFrame([(8, "new text", "")], docs.schema))
    assert secret_ledger.scan(more, ledger).count() == 8 and held() == 6
    monkeypatch.setattr(secret_ledger, "RULES", "later")
    secret_ledger.scan(more, ledger).collect()
    assert held() == 12
    assert secret_ledger.scan(docs.limit(0)).count() == 0


def test_redaction(spark):
    rows = [(1, "é token=abcdefgh12 end", 22, "s"), (2, "clean", 5, None), (None, "password: longenough1", 21, "t"), (3, None, None, "u"), (4, "token=token=abcdefgh AKIAABCDEFGHIJKL", 37, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, blob string")
    got = secret_ledger.redact(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: ("é [secret] end", 14), 2: ("clean", 5), None: ("[secret]", 8), 3: (None, None), 4: ("[secret] [secret]", 17)}


# Main text


def test_main_text_of_given_pages(spark):
    import html as h

    rows = {r.page_id: r for r in table(spark, SMALL, "pages").collect()}
    for r in queries.op9_main_text(spark, SMALL).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", rows[r.page_id].html)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == " ".join(p for p in parts if p) and r.n_chars == len(r.text)


PARAGRAPH = "The house on the hill was there for many of the years that we had in the town, and it was not as old as the one by the river that they had left. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<", ""),
        (f"<div><p>{PARAGRAPH * 2}</p></div>", (PARAGRAPH * 2).strip()),
        (f"<ul><li><a href='/'>Home</a></li></ul><h1>Title</h1><p>{PARAGRAPH * 2}</p><p>So it was.</p><p>{PARAGRAPH * 2}</p><div>Copyright ©</div>", f"Title {(PARAGRAPH * 2).strip()} So it was. {(PARAGRAPH * 2).strip()}"),
        ("<header>Site</header><article><header><h1>T &amp; U</h1></header><p>A<b>b</b>c  d<p>e<br>f</article><aside>x</aside>", "T & U Abc d e f"),
        ("<main><p>kept</p><section class='comments'><p>nice</p></section><form>mail</form><script>var x='</p>'</script></main><footer>f", "kept"),
        ("<article class='post'><p>one</p></article><article class='comment'><p>two</p></article><div class='cookie-notice'>we use</div>", "one"),
        ("<article><!-- <p>no</p> --><p>yes &#233;&nbsp;!</p><div hidden>no</div><div class='ad'>buy</div><p>last", "yes é ! last"),
        ("<article><p title='a > b'>x</p><p title=\"open>y</p></article>", "x y"),
    ],
)
def test_main_text(page, text):
    assert html_blocks.main_text(page or "") == text


def test_main_text_awkward_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<article>a</article>", "t"), (2, "u", "<b>" * 50_000, "t"), (2, "u", "<div>" * 20_000 + "x", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_blocks.extract(pages).collect()) == [(0, "a", 1), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert html_blocks.extract(pages.limit(0)).count() == 0
