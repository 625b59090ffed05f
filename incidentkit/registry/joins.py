"""Joins over the test tables."""

from pyspark.sql import functions as F

from incidentkit.functions import text as T
from incidentkit.operators import joins as J, similarity as S
from incidentkit.operators.windows import persistence_forecast
from incidentkit.plans.tickets import backlog_series
from incidentkit.registry.common import TICKETS, documents, money, query, r, table, tickets


@query(
    "c1_keep_top_categories",
    """SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 50)""",
)
def _(spark, d):
    return J.keep_top_categories(table(spark, d, "events"), "user_id", 50).select("event_id", "user_id")


_MONTHS = "SELECT CAST(year(m) * 100 + month(m) AS BIGINT) AS month, CAST(m AS DATE) AS ts FROM (SELECT unnest(generate_series(DATE '1995-06-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS m)"


@query(
    "c2_open_backlog",
    f"SELECT month, count(t.ticket) AS open FROM ({_MONTHS}) LEFT JOIN ({TICKETS}) t ON opened <= month AND closed >= month GROUP BY 1",
)
def _(spark, d):
    return J.open_backlog(tickets(spark, d), "opened", "closed", 199506, 200112)


@query(
    "c2_open_backlog_by_kind",
    f"""SELECT k.kind, month, count(t.ticket) AS open FROM (SELECT DISTINCT o_orderstatus AS kind FROM orders) k, ({_MONTHS})
        LEFT JOIN ({TICKETS}) t ON opened <= month AND closed >= month AND t.kind = k.kind GROUP BY 1, 2""",
)
def _(spark, d):
    return J.open_backlog(tickets(spark, d), "opened", "closed", 199506, 200112, ["kind"])


@query(
    "c2_backlog_persistence",
    f"""SELECT 'all' AS series_id, ts, y, lag(y) OVER (ORDER BY ts) AS yhat FROM
        (SELECT ts, CAST(count(t.ticket) AS DOUBLE) AS y FROM ({_MONTHS}) LEFT JOIN ({TICKETS}) t ON opened <= month AND closed >= month GROUP BY 1)""",
)
def _(spark, d):
    return persistence_forecast(backlog_series(tickets(spark, d), "opened", "closed", 199506, 200112))


# Five form templates; the pattern with the most text wins.
_TEMPLATES = [
    (1, "naam:.*?omschrijving storing:(.+?)telefoon:.*?"),
    (2, "naam:.*?omschrijving:(.+?)telefoon:.*?"),
    (3, "naam:.*?omschrijving storing:(.+?)"),
    (4, "klant:.*?omschrijving melding:(.+?)telefoon:.*?"),
    (5, "(.+?)telefoon:.*?inlog:.*?"),
]
_REQUEST = """CASE doc_id % 6 WHEN 0 THEN 'Naam: ' || source || ' Omschrijving storing: ' || t || ' Telefoon: 1'
  WHEN 1 THEN 'Naam: ' || source || ' Omschrijving: ' || t || ' Telefoon: 2' WHEN 2 THEN 'Naam: ' || source || ' Omschrijving storing: ' || t
  WHEN 3 THEN 'Klant: a Omschrijving melding: ' || t || ' Telefoon: 3' WHEN 4 THEN t || ' Telefoon: 4 Inlog: x' ELSE t END"""
_FLAT = "translate(text, chr(10) || chr(13) || chr(9), '   ')"
_FORMS = f"SELECT doc_id AS incident_id, lang, {_REQUEST} AS request FROM (SELECT doc_id, lang, source, {_FLAT} AS t FROM documents)"
_TEMPLATE_SQL = "(VALUES " + ", ".join(f"({i}, '^{x}$')" for i, x in _TEMPLATES) + ") v(template_id, regex)"


def _forms(spark, d):
    flat = documents(spark, d, "lang", "source", "text").withColumn("t", F.translate("text", "\n\r\t", "   "))
    return flat.selectExpr("doc_id AS incident_id", "lang", f"{_REQUEST} AS request")


def _templates(spark):
    rows = [(i, f"^{x}$") for i, x in _TEMPLATES]
    return spark.createDataFrame(rows, "template_id int, regex string")


_MATCH = f"""SELECT incident_id, template_id, regexp_replace(c, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS description FROM (
    SELECT incident_id, template_id, c FROM (SELECT incident_id, template_id, regex, regexp_extract(lower(request), regex, 1) AS c
      FROM ({_FORMS}) JOIN {_TEMPLATE_SQL} ON {{on}} WHERE regexp_matches(lower(request), regex))
    QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY length(regex) DESC, template_id) = 1)"""


@query(
    "c3_match_templates",
    f"""WITH m AS ({_MATCH.format(on="lang IN ('en', 'fr') OR template_id < 4")})
        SELECT f.incident_id, CAST(template_id AS INTEGER) AS template_id, description FROM ({_FORMS}) f LEFT JOIN m ON m.incident_id = f.incident_id""",
)
def _(spark, d):
    # English and French have all five templates, the other languages three.
    langs = table(spark, d, "documents").select("lang").distinct()
    listed = _templates(spark).withColumn("lang", F.explode(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")])))
    listed = listed.where(F.col("lang").isin("en", "fr") | (F.col("template_id") < 4)).join(langs, "lang", "left_semi")
    return J.match_templates(_forms(spark, d), listed, ["lang"]).select("incident_id", "template_id", "description")


@query(
    "c3_match_any_template",
    f"""WITH m AS ({_MATCH.format(on="true")})
        SELECT f.incident_id, CAST(template_id AS INTEGER) AS template_id, description FROM ({_FORMS}) f LEFT JOIN m ON m.incident_id = f.incident_id""",
)
def _(spark, d):
    return J.match_any_template(_forms(spark, d), _templates(spark)).select("incident_id", "template_id", "description")


@query(
    "c4_map_or_keep",
    """SELECT p_partkey, coalesce(g, p_brand) AS p_brand FROM part LEFT JOIN
       (SELECT p_brand AS b, 'group of ' || min(p_name) AS g FROM part WHERE p_size < 10 AND p_type = 'PROMO' GROUP BY 1) ON b = p_brand""",
)
def _(spark, d):
    part = table(spark, d, "part")
    lookup = part.where("p_size < 10 AND p_type = 'PROMO'").groupBy("p_brand").agg(F.concat(F.lit("group of "), F.min("p_name")).alias("g"))
    return J.map_or_keep(part.select("p_partkey", "p_brand"), lookup, "p_brand", "p_brand", "g")


@query(
    "c5_anti_new_names",
    """SELECT p_partkey, p_name || '  ' || upper(p_brand) AS name FROM part WHERE p_size < 10 AND lower(p_name || ' ' || p_brand) NOT IN
       (SELECT lower(p_name || ' ' || p_brand) FROM part WHERE p_size >= 10)""",
)
def _(spark, d):
    part = table(spark, d, "part")
    names = part.where("p_size < 10").select("p_partkey", F.concat("p_name", F.lit("  "), F.upper("p_brand")).alias("name"))
    catalog = part.where("p_size >= 10").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return J.anti_new_names(names, catalog, "name")


_TAB = "SELECT 'user' || (k % 1200) || '@example.org' AS email"


def _tabs(spark, d):
    mail = lambda k: F.when(k % 40 == 3, F.lit(" ")).when(k % 40 != 4, F.concat(F.lit(" User"), k.cast("string"), F.lit("@Example.org")))
    return {
        "customer": table(spark, d, "customer").select(mail(F.col("c_custkey") % 1200).alias("email"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")),
        "supplier": table(spark, d, "supplier").select(mail(F.col("s_suppkey") * 17 % 1500).alias("email"), F.col("s_name").alias("name")),
        "nation": table(spark, d, "nation").select(mail(F.col("n_nationkey") * 31).alias("email"), F.col("n_name").alias("name")),
    }


def _mail(k):
    return f"CASE WHEN ({k}) % 40 NOT IN (3, 4) THEN 'user' || ({k}) || '@example.org' END"


@query(
    "c6_outer_merge",
    f"""WITH c AS (SELECT email, first(seg ORDER BY seg, nat) AS customer_segment, first(nat ORDER BY seg, nat) AS customer_nation, count(*) AS customer_rows
                   FROM (SELECT {_mail('c_custkey % 1200')} AS email, c_mktsegment AS seg, c_nationkey AS nat FROM customer) WHERE email IS NOT NULL GROUP BY 1),
            s AS (SELECT {_mail('s_suppkey * 17 % 1500')} AS email, min(s_name) AS supplier_name, count(*) AS supplier_rows FROM supplier GROUP BY 1 HAVING email IS NOT NULL),
            n AS (SELECT {_mail('n_nationkey * 31')} AS email, min(n_name) AS nation_name, count(*) AS nation_rows FROM nation GROUP BY 1 HAVING email IS NOT NULL)
       SELECT coalesce(c.email, s.email, n.email) AS email, customer_segment, customer_nation, supplier_name, nation_name,
              coalesce(customer_rows, 0) AS customer_rows, coalesce(supplier_rows, 0) AS supplier_rows, coalesce(nation_rows, 0) AS nation_rows,
              concat_ws(',', CASE WHEN c.email IS NOT NULL THEN 'customer' END, CASE WHEN n.email IS NOT NULL THEN 'nation' END, CASE WHEN s.email IS NOT NULL THEN 'supplier' END) AS sources
       FROM c FULL JOIN s ON s.email = c.email FULL JOIN n ON n.email = coalesce(c.email, s.email)""",
)
def _(spark, d):
    return J.outer_merge(_tabs(spark, d), "email")


@query(
    "c6_without_key",
    f"""SELECT 'customer' AS source, c_mktsegment AS customer_segment, c_nationkey AS customer_nation, NULL AS supplier_name, NULL AS nation_name FROM customer WHERE {_mail('c_custkey % 1200')} IS NULL
        UNION ALL SELECT 'supplier', NULL, NULL, s_name, NULL FROM supplier WHERE {_mail('s_suppkey * 17 % 1500')} IS NULL
        UNION ALL SELECT 'nation', NULL, NULL, NULL, n_name FROM nation WHERE {_mail('n_nationkey * 31')} IS NULL""",
)
def _(spark, d):
    return J.without_key(_tabs(spark, d), "email")


@query(
    "c7_snapshot_diff",
    """WITH a AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1),
            b AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
       SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CAST(coalesce(a.v, 0) - coalesce(b.v, 0) AS DECIMAL(38,2)) AS saldo FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", money("o_totalprice").alias("saldo"), F.year("o_orderdate").alias("y"))
    return J.snapshot_diff(orders.where("y = 1998"), orders.where("y = 1997"), ["o_custkey"], ["saldo"])


def _halves(spark, d):
    # Two scores per vector: the whole vector and the vector without its first half.
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.slice("embedding", 33, 32).alias("tail"))
    problems = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("problem_id"), F.col("embedding").alias("short_vector"), F.col("tail").alias("request_vector"))
    open_tickets = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("incident_id"), F.col("embedding").alias("short_vector"), F.col("tail").alias("request_vector"))
    return problems, open_tickets


_PAIRS = """SELECT * FROM (SELECT p.vec_id AS problem_id, t.vec_id AS incident_id,
      list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS s1,
      list_cosine_similarity(CAST(p.embedding[33:64] AS DOUBLE[]), CAST(t.embedding[33:64] AS DOUBLE[])) AS s2
    FROM embeddings p, embeddings t WHERE p.vec_id % 5 = 0 AND t.vec_id % 5 <> 0) WHERE s1 > 0.35 OR s2 > 0.35"""


@query("c8_score_pairs", f"SELECT problem_id, incident_id, round(s1, 6) AS score_short, round(s2, 6) AS score_request FROM ({_PAIRS})")
def _(spark, d):
    problems, free = _halves(spark, d)
    pairs = S.score_pairs(problems, free, "problem_id", "incident_id", threshold=0.35)
    return pairs.withColumns({"score_short": r("score_short"), "score_request": r("score_request")})


@query(
    "c9_first_claim",
    """SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END, l_orderkey, l_linenumber, l_extendedprice) = 1""",
)
def _(spark, d):
    pairs = table(spark, d, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("phase")
    )
    claims = J.first_claim(pairs, "l_partkey", ["l_orderkey", "l_linenumber", "l_extendedprice"], "phase")
    return claims.select("l_partkey", "l_orderkey", "l_linenumber")


# Names of two words, brand and type, compared by their 5-character runs.
NAMES = "SELECT DISTINCT p_name || ' ' || p_brand || ' ' || p_type AS name FROM part"
SIMILAR = f"""
  WITH n AS ({NAMES}), g AS (SELECT name, unnest(list_transform(generate_series(1, length(c) - 4), lambda i: substr(c, i, 5))) AS gram
         FROM (SELECT name, translate(name, ',-./', '') AS c FROM n)),
       tf AS (SELECT name, gram, count(*) AS n FROM g GROUP BY 1, 2),
       idf AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM n)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
       w AS (SELECT name, tf.gram, n * idf AS w FROM tf JOIN idf ON tf.gram = idf.gram),
       l AS (SELECT name, sqrt(sum(w * w)) AS l FROM w GROUP BY 1),
       u AS (SELECT w.name, gram, w / l AS w FROM w JOIN l ON l.name = w.name)
  SELECT a.name AS id1, b.name AS id2, sum(a.w * b.w) AS score FROM u a JOIN u b ON a.gram = b.gram AND a.name < b.name GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.8
"""


def names(spark, d):
    return table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"))


@query("c10_cosine_self_join", f"SELECT id1, id2, round(score, 6) AS score FROM ({SIMILAR})")
def _(spark, d):
    pairs = S.cosine_self_join(names(spark, d).distinct(), "name", "name")
    return pairs.withColumn("score", r("score"))
