import random
import random
import re
import unicodedata

from pyspark.sql import functions as F

from incidentkit.functions import text as T
from incidentkit.functions.dates import parse_day_first
from incidentkit.operators import joins as J
from incidentkit.plans.templates import prepare_templates
from incidentkit.plans.tickets import describe_tickets


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_ascii_fold_equals_decomposition(spark):
    rnd = random.Random(3)
    pools = [(32, 0x250), (0x250, 0x3000), (0x2000, 0x2200), (0x1D400, 0x1D7FF), (0xFB00, 0xFB07)]
    texts = ["".join(chr(rnd.randrange(*rnd.choice(pools))) for _ in range(40)) for _ in range(200)]
    texts += ["café naïve ĳs ﬁets ½ 10²", "", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, got in df.select("t", T.ascii_fold(F.col("t"))).collect():
        assert got == unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()


def test_template_pattern(spark):
    text = "Naam:\n\n  Omschrijving storing: \r\nTelefoon (10-cijferig):"
    got = one(spark, T.template_to_regex, text)
    lines = ["naam:", "omschrijving storing:", "telefoon (10-cijferig):"]
    assert got == "^" + re.escape(lines[0]) + ".*?" + re.escape(lines[1]) + "(.+?)" + re.escape(lines[2]) + ".*?$"
    assert re.search(got, "naam: x omschrijving storing: kapot telefoon (10-cijferig): 1").group(1) == " kapot "
    assert one(spark, T.template_to_regex, "Naam:") == "^(.+?)naam:.*?$"


def python_cascade(text, patterns, group):
    rest = text
    for p in patterns:
        now = rest if rest or group == 1 else text
        m = re.search(p, now.lower())
        rest = m.group(group).strip() if m and (group == 1 or m.group(group)) else now
    return rest


def test_anchored_patterns_match_alike():
    rng = random.Random(6)
    words = ["omschrijving", " storing", ":", " volledige", " naam", "\n", "x", " vraag", " antwoord", " probleem", "telefoonnummer", " inlognaam", "mailt", " e-mail"]
    for _ in range(3000):
        text = "".join(rng.choices(words, k=rng.randint(0, 12)))
        for p in (*T.REQUEST_PATTERNS, *T.PROBLEM_PATTERNS):
            old, new = re.search(p, text), re.search(T.anchored(p), text)
            assert (old and (old.span(), old.groups())) == (new and (new.span(), new.groups()))


def test_cascade_equals_python(spark):
    texts = [
        "Omschrijving storing: PC start niet Volledige naam: T. Jansen",
        "omschrijving van de storing:\n a \n volledige\tnaam: b telefoonnummer 10-cijferige): 1",
        "Klant mailt: help",
        "niets",
        "Omschrijving storing:   volledige naam: leeg",
        "Omschrijving probleem : geen geluid Inlognaam bas : x Volledige naam : y",
        "Omschrijving vraag : hoe laat Antwoord",
        "vraag eerst: wat antwoord nu",
        "Omschrijving probleem :   Inlognaam bas : x omschrijving vraag : nog iets antwoord",
        "vraag :   antwoord",
        "Omschrijving van de storing :   Inlognaam bas : a vraag : b antwoord",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns, group in ((T.REQUEST_PATTERNS, 1), (T.PROBLEM_PATTERNS, 2)):
        for t, got in df.select("t", T.extract_cascade(F.col("t"), patterns, group)).collect():
            assert got == python_cascade(t, patterns, group), (t, got)


def test_replace_and_stopwords(spark):
    tokens = F.array(*[F.lit(w) for w in ("De", "pc", "is", "kapot")])
    df = spark.range(1).select(
        T.replace_words(tokens, {"pc": "computer", "de": "lidwoord"}, ["de", "is"]).alias("a"),
        T.remove_stopwords(tokens, ["kapot"]).alias("b"),
        T.normalize(F.lit("De PC's 123 zíjn http://x.nl/a kapot!"), ["de"], {}).alias("c"),
    ).first()
    assert df.a == ["lidwoord", "computer", "pc", "kapot"]
    assert df.b == []
    assert df.c == ["pcs", "zijn", "kapot"]


def test_ngrams(spark):
    row = spark.range(1).select(
        T.word_ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2, 3).alias("w"),
        T.word_ngrams(F.array(F.lit("a")), 2, 3).alias("short"),
        T.char_ngrams(F.lit("abcd"), 2, 3).alias("c"),
    ).first()
    assert row.w == ["a b", "b c", "a b c"] and row.short == []
    assert row.c == ["ab", "bc", "cd", "abc", "bcd"]


def test_character_ngrams_are_of_code_points(spark):
    df = spark.createDataFrame([("a\n𝒳é𝒴",), ("a",), ("",), (None,)], "t string")
    got = [r.c for r in df.select(T.char_ngrams(F.col("t"), 1, 3).alias("c")).collect()]
    assert got == [["a", "\n", "𝒳", "é", "𝒴", "a\n", "\n𝒳", "𝒳é", "é𝒴", "a\n𝒳", "\n𝒳é", "𝒳é𝒴"], ["a"], [], None]


def test_dates(spark):
    df = spark.createDataFrame([("2-3-2020 08:15",), ("31/12/2019",), ("onzin",), (None,)], "t string")
    got = [r.x and r.x.isoformat() for r in df.select(parse_day_first(F.col("t")).alias("x")).collect()]
    assert got == ["2020-03-02T08:15:00", "2019-12-31T00:00:00", None, None]


def test_templates_to_description(spark):
    raw = spark.createDataFrame(
        [("Storing", "Mail", "Naam:\nOmschrijving storing:\nTelefoon:", "Omschrijving:"), ("Storing", "Mail", "Hallo", None)],
        "kind string, category string, request_1 string, request_2 string",
    )
    templates = prepare_templates(raw, ["kind", "category"], ["request_1", "request_2"])
    assert templates.count() == 2
    tickets = spark.createDataFrame(
        [
            (1, "Storing", "Mail", "02-03-2020 08:15 Jansen, Test: Naam : x\nOmschrijving storing: start niet\nTelefoon: 1"),
            (2, "Storing", "Mail", "Omschrijving: mail weg"),
            (3, "Vraag", "Mail", "Klant mailt: hoe zo"),
        ],
        "incident_id int, kind string, category string, request string",
    )
    out = {r.incident_id: r for r in describe_tickets(tickets, templates).collect()}
    assert out[1].description == "start niet" and out[2].description == "mail weg"
    assert out[3].description is None and out[3].description_rest == "hoe zo"


def test_hot_template_key_keeps_every_ticket(spark):
    tickets = spark.range(3000).selectExpr("id AS incident_id", "IF(id % 3 = 0, 'x', 'y') AS kind", "concat('a: ', id, ' b:') AS request")
    templates = spark.createDataFrame([("x", i, f"^a:(.+?)b:.*?{'z?' * i}$") for i in range(4)], "kind string, template_id int, regex string")
    got = J.match_templates(tickets, templates, ["kind"])
    assert got.count() == 3000
    hit = got.where("description IS NOT NULL")
    assert hit.count() == 1000 and hit.where("template_id <> 3").count() == 0


def test_index_finds_what_patterns_match():
    import random
    import re

    from incidentkit.operators.template_index import Index, fixed_parts

    assert fixed_parts(r"^naam:.*?omschrijving\ storing:(.+?)telefoon:.*?$") == ["naam:", "omschrijving storing:", "telefoon:"]
    assert fixed_parts("^a:(.+?)b:.*?z?$") == [] and fixed_parts(r"\d+") == [] and fixed_parts("^(.+?)$") == [] and fixed_parts("a|b") == []
    assert fixed_parts(r"kosten \$5\.") == ["kosten $5."]
    rng = random.Random(1)
    words = [f"veld {i}:" for i in range(12)] + ["naam:", "omschrijving:"]
    patterns = ["^" + ".*?".join(rng.sample(words, rng.randint(1, 3))) + "(.+?)" + rng.choice(words) + ".*?$" for _ in range(200)] + ["^(.+?)x?$", "^(.+?)slot:.*?$"]
    index = Index(patterns)
    automaton = index.automaton()
    for _ in range(300):
        text = " ".join(rng.choices(words + ["iets", "slot:"], k=rng.randint(0, 8)))
        may = index.candidates(text, automaton)
        assert may == sorted(may) and {i for i, p in enumerate(patterns) if re.search(p, text)} <= set(may)
    assert len(index.candidates("naam: iets omschrijving: meer", automaton)) < 20


def test_many_templates_find_the_same(spark):
    tickets = spark.range(400).selectExpr("id AS incident_id", "IF(id % 3 = 0, null, concat('Kop', id % 7, ': a Omschrijving ', id % 11, ': iets ', id, ' Slot: z')) AS request")
    rows = [(i, f"^kop{i % 9}:.*?omschrijving {i % 13}:(.+?)slot:.*?{'.*?' * (i % 3)}$") for i in range(1000)]
    templates = spark.createDataFrame(rows, "template_id int, regex string")
    got = {r.incident_id: (r.template_id, r.description) for r in J.match_any_template(tickets, templates).collect()}
    assert len(got) == 400
    import re

    ordered = sorted(rows, key=lambda t: (-len(t[1]), t[0]))
    for r in tickets.collect():
        text = (r.request or "").lower()
        hit = next(((i, re.search(p, text)[1].strip()) for i, p in ordered if r.request and re.search(p, text)), (None, None))
        assert got[r.incident_id] == hit
    none = spark.createDataFrame([], "template_id int, regex string")
    assert J.match_any_template(tickets, none).where("description IS NOT NULL").count() == 0


def test_candidates_take_few_texts_out_of_a_batch(spark, monkeypatch):
    from incidentkit.operators import template_index as TI

    monkeypatch.setattr(TI, "SLICE", 7)
    index = TI.Index(["^naam:.*?klacht:(.+?)$", "^(.+?)telefoon:.*?$"])
    texts = [None if i % 9 == 0 else ("naam: a klacht: b" if i % 2 else "b telefoon: 1") for i in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    found = df.select("id", TI.candidates(F.col("text"), index).alias("may"))
    assert [r.may for r in found.orderBy("id").collect()] == [[] if t is None else [0] if t.startswith("naam") else [1] for t in texts]
    assert "ArrowEvalPython" in found._jdf.queryExecution().optimizedPlan().toString() and not hasattr(TI, "pandas_udf")
