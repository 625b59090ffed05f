"""Text functions over whole documents, pages and names."""

from pyspark.sql import functions as F

from incidentkit.functions import text as T
from incidentkit.operators import features as FE
from incidentkit.plans.tickets import describe_tickets
from incidentkit.registry.common import WORD, WORDS, documents, money, query, r, table, words

# Small word lists made for the test texts.
STOP = ["the", "and", "de", "la", "en", "der", "die", "und", "el", "le"]
SWAP = {"the": "article", "que": "pronoun", "on": "position"}

_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


def _docs(spark, d):
    return documents(spark, d, "text")


@query(
    "f1_clean_controls",
    r"SELECT doc_id, replace(translate(replace(text, ' :', ':'), chr(10) || chr(13) || chr(9), '   '), '~', ' ') AS text FROM documents",
)
def _(spark, d):
    return _docs(spark, d).withColumn("text", T.clean_controls(F.col("text"), tilde=True))


@query(
    "f1_clean_quotes",
    r"SELECT doc_id, replace(replace(translate(replace(text, ' :', ':'), chr(10) || chr(13) || chr(9), '   '), '  ', ' '), '\"', '') AS text FROM documents".replace('\\"', '"'),
)
def _(spark, d):
    return _docs(spark, d).withColumn("text", T.clean_controls(F.col("text"), quotes=True))


_ENTRY = "CASE WHEN doc_id % 2 = 0 THEN '02-03-2020 08:15 Test, Afdeling: ' ELSE '' END || text"


@query(
    "f2_strip_entry_header",
    rf"""SELECT doc_id, regexp_replace(regexp_replace(t, '^\d\d-\d\d-\d\d\d\d\s\d\d:\d\d .+?, .+?:', ''), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS text
         FROM (SELECT doc_id, {_ENTRY} AS t FROM documents)""",
)
def _(spark, d):
    df = documents(spark, d, "text").selectExpr("doc_id", f"{_ENTRY} AS text")
    return df.withColumn("text", T.strip_entry_header(F.col("text")))


@query("f3_strip_marks", r"SELECT doc_id, regexp_replace(text, '[?:!.,;]', '', 'g') AS text FROM documents")
def _(spark, d):
    return _docs(spark, d).withColumn("text", T.strip_punct(F.col("text"), "marks"))


@query("f3_keep_letters", r"SELECT doc_id, regexp_replace(lower(text), '[^a-z]+', ' ', 'g') AS text FROM documents")
def _(spark, d):
    return _docs(spark, d).withColumn("text", T.strip_punct(F.lower("text"), "letters"))


@query("f3_strip_separators", r"SELECT doc_id, regexp_replace(text, '[,\-./]', '', 'g') AS text FROM documents")
def _(spark, d):
    return _docs(spark, d).withColumn("text", T.strip_punct(F.col("text"), "separators"))


@query("f4_strip_urls", r"SELECT page_id, regexp_replace(html, 'http\S+', '', 'g') AS html FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_urls(F.col("html")).alias("html"))


@query("f5_ascii_fold", r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS text FROM documents")
def _(spark, d):
    return _docs(spark, d).withColumn("text", T.ascii_fold(F.col("text")))


_MIXED = rf"SELECT doc_id, regexp_extract_all(text, '[0-9]+|{WORD}') AS tokens FROM documents"


@query("f6_drop_numbers", rf"SELECT doc_id, list_filter(tokens, lambda x: NOT regexp_matches(x, '^[0-9]+$')) AS tokens FROM ({_MIXED})")
def _(spark, d):
    return documents(spark, d, "text").select("doc_id", T.drop_numbers(T.tokenize(F.col("text"), rf"[0-9]+|{WORD}")).alias("tokens"))


@query(
    "f7_remove_stopwords",
    f"SELECT doc_id, list_filter(tokens, lambda x: length(x) >= 3 AND NOT list_contains({_STOP_SQL}, x)) AS tokens FROM ({WORDS})",
)
def _(spark, d):
    return words(spark, d).select("doc_id", T.remove_stopwords(F.col("tokens"), STOP).alias("tokens"))


_SWAP_SQL = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SWAP.items()) + " END"
_REPLACED = f"list_filter(flatten(list_transform(tokens, lambda x: [{_SWAP_SQL}, CASE WHEN NOT list_contains({_STOP_SQL}, x) THEN x END])), lambda y: y IS NOT NULL)"


@query("f8_replace_words", f"SELECT doc_id, {_REPLACED} AS tokens FROM ({WORDS})")
def _(spark, d):
    return words(spark, d).select("doc_id", T.replace_words(F.col("tokens"), SWAP, STOP).alias("tokens"))


@query(
    "f9_normalize",
    rf"""SELECT doc_id, {_REPLACED} AS tokens FROM (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(lower(regexp_replace(strip_accents(
         regexp_replace(text, 'http\S+', '', 'g')), '[^\x00-\x7F]', '', 'g')), '[^\w\s]', '', 'g'), '\S+'), lambda x: NOT regexp_matches(x, '^[0-9]+$')) AS tokens FROM documents)""",
)
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize(F.col("text"), STOP, SWAP).alias("tokens"))


@query("f10_tokenize_blanks", r"SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS tokens FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.tokenize(F.col("text"), r"[^ \t\n\r\f]+").alias("tokens"))


@query("f10_tokenize_words", r"SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]{2,}') AS tokens FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.tokenize(F.col("text"), r"[\p{L}\p{N}_]{2,}").alias("tokens"))


_GRAMS = "list_transform(generate_series(1, len(tokens) - {m}), lambda i: array_to_string(tokens[i:i + {m}], ' '))"


@query("f11_word_ngrams", f"SELECT doc_id, list_concat({_GRAMS.format(m=0)}, {_GRAMS.format(m=1)}) AS grams FROM ({WORDS})")
def _(spark, d):
    return words(spark, d).select("doc_id", T.word_ngrams(F.col("tokens"), 1, 2).alias("grams"))


@query(
    "f12_char_ngrams",
    "SELECT p_partkey, list_concat(list_transform(generate_series(1, length(p_name) - 1), lambda i: substr(p_name, i, 2)), list_transform(generate_series(1, length(p_name) - 2), lambda i: substr(p_name, i, 3))) AS grams FROM part",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.char_ngrams(F.col("p_name"), 2, 3).alias("grams"))


# A request form around the whole text of a document.
_FORM = """CASE doc_id % 4 WHEN 0 THEN 'Naam: x Omschrijving storing: ' || text || ' Volledige naam: y'
  WHEN 1 THEN 'Omschrijving van probleem: ' || text || ' volledige gegevens'
  WHEN 2 THEN 'Klant mailt: ' || text ELSE text END"""
_TRIM = r"regexp_replace({0}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"


def _forms(spark, d):
    return documents(spark, d, "text").selectExpr("doc_id", f"{_FORM} AS request")


def _hit(p):
    return f"CASE WHEN regexp_matches(t, '{p}') THEN {_TRIM.format(f"regexp_extract(t, '{p}', 1)")} END"


@query(
    "f13_extract_first",
    f"SELECT doc_id, coalesce({', '.join(_hit(p) for p in T.REQUEST_PATTERNS)}) AS description FROM (SELECT doc_id, lower({_FORM}) AS t FROM documents)",
)
def _(spark, d):
    return _forms(spark, d).select("doc_id", T.extract_first(F.col("request"), T.REQUEST_PATTERNS).alias("description"))


def _cascade_sql():
    sql = f"SELECT doc_id, {_FORM} AS t FROM documents"
    for p in T.REQUEST_PATTERNS:
        capture = _TRIM.format(f"regexp_extract(lower(t), '{p}', 1)")
        sql = f"SELECT doc_id, CASE WHEN regexp_matches(lower(t), '{p}') THEN {capture} ELSE t END AS t FROM ({sql})"
    return f"SELECT doc_id, t AS description FROM ({sql})"


@query("f14_extract_cascade", _cascade_sql())
def _(spark, d):
    return _forms(spark, d).select("doc_id", T.extract_cascade(F.col("request")).alias("description"))


# Tickets of two kinds with a template each, one kind without; entry headers, controls and a form around the text.
_LOGGED = """CASE doc_id % 2 WHEN 0 THEN '02-03-2020 08:15 Test, Afdeling: ' ELSE '' END || CASE doc_id % 5
  WHEN 0 THEN 'Naam : x' || chr(10) || 'Omschrijving storing : ' || text || ' Telefoon : y' WHEN 1 THEN 'Klant : a Omschrijving melding : ' || text || ' Volledige naam: b'
  WHEN 2 THEN 'Omschrijving van probleem: ' || text || ' volledige gegevens' WHEN 3 THEN 'Klant mailt: ' || text ELSE text END"""
_KNOWN = [("en", 1, "^naam:.*?omschrijving storing:(.+?)telefoon:.*?$"), ("fr", 2, "^klant:.*?omschrijving melding:(.+?)volledige naam:.*?$")]


def _described_sql():
    patterns = "(VALUES " + ", ".join(f"('{lang}', '{p}')" for lang, _, p in _KNOWN) + ") v(lang, regex)"
    sql = f"""
      SELECT doc_id, lang, {_TRIM.format("regexp_replace(c, '^[0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]\\s[0-9][0-9]:[0-9][0-9] .+?, .+?:', '')")} AS request
      FROM (SELECT doc_id, lang, replace(translate(replace({_LOGGED}, ' :', ':'), chr(10) || chr(13) || chr(9), '   '), '~', ' ') AS c FROM documents)"""
    sql = f"""SELECT r.doc_id, request, {_TRIM.format("CASE WHEN regexp_matches(lower(request), regex) THEN regexp_extract(lower(request), regex, 1) END")} AS description
      FROM ({sql}) r LEFT JOIN {patterns} ON v.lang = r.lang"""
    sql = f"SELECT doc_id, description, coalesce(description, request) AS t FROM ({sql})"
    for p in T.REQUEST_PATTERNS:
        capture = _TRIM.format(f"regexp_extract(lower(t), '{p}', 1)")
        sql = f"SELECT doc_id, description, CASE WHEN regexp_matches(lower(t), '{p}') THEN {capture} ELSE t END AS t FROM ({sql})"
    return rf"SELECT doc_id AS incident_id, description, regexp_replace(strip_accents(t), '[^\x00-\x7F]', '', 'g') AS description_rest FROM ({sql})"


@query("f14_describe_tickets", _described_sql())
def _(spark, d):
    docs = documents(spark, d, "lang", "text").selectExpr("doc_id AS incident_id", "lang", f"{_LOGGED} AS request")
    templates = spark.createDataFrame(_KNOWN, "lang string, template_id int, regex string")
    return describe_tickets(docs, templates, ["lang"]).select("incident_id", "description", "description_rest")


# Blank captures on the first, a middle and the last pattern stand among the forms.
_TICKET = """CASE doc_id % 6 WHEN 0 THEN 'Omschrijving van de storing : ' || text || ' Inlognaam bas : a Applicatie : b'
  WHEN 1 THEN 'Omschrijving vraag : ' || text || ' Antwoord volgt'
  WHEN 2 THEN text || ' Omschrijving storing:   Volledige naam: leeg'
  WHEN 3 THEN text || ' Omschrijving van de storing :   Inlognaam bas : a'
  WHEN 4 THEN text || ' vraag :   antwoord' ELSE text END"""


def _cascade2_sql():
    sql = f"SELECT doc_id, {_TICKET} AS whole, {_TICKET} AS rest FROM documents"
    for p in T.PROBLEM_PATTERNS:
        sql = f"SELECT doc_id, whole, CASE WHEN rest <> '' THEN rest ELSE whole END AS t FROM ({sql})"
        sql = f"SELECT doc_id, whole, t, regexp_extract(lower(t), '{p}', 2) AS raw FROM ({sql})"
        sql = f"SELECT doc_id, whole, CASE WHEN raw <> '' THEN {_TRIM.format('raw')} ELSE t END AS rest FROM ({sql})"
    return f"SELECT doc_id, rest AS description FROM ({sql})"


@query("f14_extract_cascade_tickets", _cascade2_sql())
def _(spark, d):
    df = documents(spark, d, "text").selectExpr("doc_id", f"{_TICKET} AS request")
    return df.select("doc_id", T.extract_cascade(F.col("request"), T.PROBLEM_PATTERNS, 2).alias("description"))


# Template texts of three lines made from part columns; only ASCII letters, digits, blanks, '#' and ':'.
@query(
    "f15_template_to_regex",
    r"""SELECT DISTINCT request, '^' || e1 || '.*?' || e2 || '(.+?)' || e3 || '.*?$' AS regex FROM (
        SELECT p_name || ':' || chr(10) || ' Omschrijving ' || p_brand || ':' || chr(10) || chr(10) || p_type || ':' AS request,
          regexp_replace(lower(p_name || ':'), '([ #])', '\\\1', 'g') AS e1,
          regexp_replace(lower('Omschrijving ' || p_brand || ':'), '([ #])', '\\\1', 'g') AS e2,
          regexp_replace(lower(p_type || ':'), '([ #])', '\\\1', 'g') AS e3 FROM part)""",
)
def _(spark, d):
    request = F.concat(
        "p_name", F.lit(":\n Omschrijving "), "p_brand", F.lit(":\n\n"), "p_type", F.lit(":")
    )
    part = table(spark, d, "part").select(request.alias("request")).distinct()
    return part.withColumn("regex", T.template_to_regex(F.col("request")))


@query(
    "f16_token_sequences",
    f"""WITH w AS ({WORDS}), v AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS rank FROM (SELECT unnest(tokens) AS word FROM w) GROUP BY 1),
        t AS (SELECT doc_id, list_slice(tokens, greatest(len(tokens) - 299, 1), len(tokens)) AS tail FROM w),
        p AS (SELECT doc_id, unnest(tail) AS word, generate_subscripts(tail, 1) AS pos FROM t),
        s AS (SELECT doc_id, list(rank ORDER BY pos) AS seq FROM p JOIN v USING (word) GROUP BY 1)
        SELECT t.doc_id, list_concat(list_transform(generate_series(1, 300 - len(tail)), lambda i: CAST(0 AS BIGINT)), coalesce(seq, [])) AS sequence
        FROM t LEFT JOIN s ON s.doc_id = t.doc_id""",
)
def _(spark, d):
    return FE.token_sequences(words(spark, d), "doc_id", "tokens", 300)


@query(
    "f17_text_stats",
    r"""SELECT doc_id, CAST(length(text) AS INTEGER) AS char_count, CAST(len(w) AS INTEGER) AS word_count, round(length(text) / (len(w) + 1), 6) AS word_density,
          CAST(length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')) AS INTEGER) AS punctuation_count,
          CAST(len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][^A-Z]*$'))) AS INTEGER) AS title_word_count,
          CAST(len(list_filter(w, lambda x: regexp_matches(x, '^[^a-z]*[A-Z][^a-z]*$'))) AS INTEGER) AS upper_case_word_count
        FROM (SELECT doc_id, translate(text, chr(11) || chr(133) || chr(160) || chr(8232) || chr(8233), '     ') AS text FROM documents), LATERAL (SELECT regexp_extract_all(text, '\S+') AS w)""",
)
def _(spark, d):
    flat = _docs(spark, d).withColumn("text", F.translate("text", "\x0b\x85\xa0\u2028\u2029", "     "))
    stats = T.text_stats(F.col("text"))
    stats["word_density"] = r(stats["word_density"])
    return flat.select("doc_id", *[c.cast("int").alias(n) if n != "word_density" else c.alias(n) for n, c in stats.items()])


_FLAGS = ["the", "and", "que", "und"]


@query(
    "f18_contains_flags",
    "SELECT doc_id, " + ", ".join(f"list_contains(tokens, '{w}') AS has_{w}" for w in _FLAGS) + f" FROM ({WORDS})",
)
def _(spark, d):
    flagged = words(spark, d).select("doc_id", T.contains_flags(F.col("tokens"), _FLAGS).alias("f"))
    return flagged.select("doc_id", *[F.coalesce(F.try_element_at("f", F.lit(w)), F.lit(False)).alias(f"has_{w}") for w in _FLAGS])


_NAME = "CASE p_size % 3 WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN split_part(p_name, ' ', 1) || ' ''' || p_brand || '''' ELSE p_name END"


@query(
    "f19_name_parts",
    f"""SELECT p_partkey, split_part(n, ' ', 1) || ' ' || split_part(n, ' ', 2) AS group_name, starts_with(split_part(n, ' ', 2), '''') AS is_exception,
               len(string_split(n, ' ')) >= 3 AS is_cultivar FROM (SELECT p_partkey, {_NAME} AS n FROM part)""",
)
def _(spark, d):
    quote = F.lit("'")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    name = (
        F.when(F.col("p_size") % 3 == 0, F.concat_ws(" ", "p_name", "p_brand"))
        .when(F.col("p_size") % 3 == 1, F.concat(first, F.lit(" "), quote, "p_brand", quote))
        .otherwise(F.col("p_name"))
    )
    part = table(spark, d, "part").select("p_partkey", name.alias("n"))
    return part.select("p_partkey", *[c.alias(k) for k, c in T.name_parts(F.col("n")).items()])


@query(
    "f20_sign_and_abs",
    "SELECT c_custkey, abs(b) AS units, CASE WHEN b < 0 THEN -1 ELSE 1 END AS factor FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS b FROM customer)",
)
def _(spark, d):
    df = table(spark, d, "customer").select("c_custkey", money("c_acctbal").alias("b"))
    return df.select("c_custkey", *[c.alias(k) for k, c in T.sign_and_abs(F.col("b")).items()])
