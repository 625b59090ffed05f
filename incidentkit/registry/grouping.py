"""Groups of similar names and hidden tickets."""

from pyspark.sql import functions as F

from incidentkit.operators import grouping as G, similarity as S
from incidentkit.operators.rows import unfold
from incidentkit.plans import tickets as P
from incidentkit.registry.common import query, r, table
from incidentkit.registry.joins import SIMILAR, names

_LABELS = f"""
  WITH RECURSIVE p AS MATERIALIZED ({SIMILAR}), e AS MATERIALIZED (SELECT id1 AS a, id2 AS b FROM p UNION SELECT id2, id1 FROM p),
    reach(a, b) AS (SELECT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
  SELECT a AS name, min(b) AS "group" FROM reach GROUP BY 1
"""


@query("h1_connected_groups", _LABELS)
def _(spark, d):
    return G.connected_groups(S.cosine_links(names(spark, d).distinct(), "name", "name"))


@query(
    "h2_group_names",
    f"""SELECT p_partkey, n AS name, coalesce("group", n) AS "group" FROM (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS n FROM part)
        LEFT JOIN ({_LABELS}) l ON l.name = n""",
)
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"))
    return G.group_names(part, "name")


_PAIRS = """SELECT l_orderkey * 8 + l_linenumber AS pair_id, l_suppkey AS level2, l_partkey AS level3, l_discount AS score,
    CASE WHEN l_returnflag = 'A' THEN l_orderkey END AS linked_to FROM lineitem"""
_UNIQUE = "SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY level2, level3, score) AS k FROM (" + _PAIRS + ")"


@query(
    "h3_hidden_incidents",
    f"""WITH p AS ({_PAIRS}), i AS (SELECT * FROM p WHERE level2 IN (SELECT level2 FROM p WHERE linked_to IS NULL GROUP BY 1 HAVING count(*) > 1)),
          b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY level3 ORDER BY score DESC, pair_id, level2) = 1)
        SELECT level3, level2, score FROM b WHERE linked_to IS NULL""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    pairs = li.select(
        F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pair"), F.col("l_suppkey").alias("s")).alias("pair_id"),
        F.col("l_suppkey").alias("level2"),
        F.col("l_partkey").alias("level3"),
        F.col("l_discount").alias("score"),
        F.when(F.col("l_returnflag") == "A", F.col("l_orderkey")).alias("linked_to"),
    )
    return G.hidden_incidents(pairs).select("level3", "level2", "score")


# Parts as tickets: red parts of the smallest sizes are problems, every seventh other part is linked.
_NAMED = """SELECT p_partkey AS k, p_name AS s, p_name || ' ' || lower(p_type) AS r, p_size < 5 AND starts_with(p_name, 'red ') AS problem FROM part"""
# A word's toy vector: the sixteen first digits of its digest. A text's: the mean over its words.
_CLAIMS = f"""
  WITH p AS ({_NAMED}), t AS (SELECT s AS t FROM p UNION SELECT r FROM p), w AS (SELECT t, unnest(string_split(t, ' ')) AS w FROM t),
    d AS (SELECT t, i, avg(instr('0123456789abcdef', substr(md5(w), i::INT, 1)) - 8.5) AS x FROM w, (SELECT unnest(range(1, 17)) AS i) GROUP BY 1, 2),
    v AS (SELECT t, list(x ORDER BY i) AS v FROM d GROUP BY 1), c AS (SELECT a.t AS a, b.t AS b, list_cosine_similarity(a.v, b.v) AS c FROM v a, v b),
    m AS (SELECT 'P' || k AS level2, 'P' || k AS problem_id, k AS row_no, s, r, 1 AS phase FROM p WHERE problem
          UNION ALL SELECT 'I' || k, 'P' || k % 11, k, s, r, 2 FROM p WHERE NOT problem AND k % 7 = 0),
    g AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY phase, s, r ORDER BY row_no, level2) = 1),
    o AS (SELECT 'I' || k AS incident_id, s, r FROM p WHERE NOT problem AND k % 7 <> 0),
    h AS (SELECT o.s, o.r, g.level2, g.problem_id, g.phase, cs.c AS score_short, cr.c AS score_request
          FROM (SELECT DISTINCT s, r FROM o) o JOIN g ON true JOIN c cs ON cs.a = o.s AND cs.b = g.s JOIN c cr ON cr.a = o.r AND cr.b = g.r
          WHERE cs.c > 0.75 OR cr.c > 0.75 QUALIFY row_number() OVER (PARTITION BY o.s, o.r ORDER BY g.phase, g.row_no, g.level2) = 1)
  SELECT incident_id, problem_id, level2, phase, round(score_short, 6) AS score_short, round(score_request, 6) AS score_request FROM o JOIN h ON h.s = o.s AND h.r = o.r
"""


def _linked(spark, d):
    """(problems, tickets, claims) over parts, with toy vectors of sixteen numbers."""
    named = table(spark, d, "part").selectExpr(
        "p_partkey AS k", "p_name AS s", "concat(p_name, ' ', lower(p_type)) AS r", "p_size < 5 AND startswith(p_name, 'red ') AS problem"
    )
    spelled = unfold(named.select(F.split("r", " ").alias("tokens")), "tokens", "word").distinct()
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("word"), i, 1)) - 8.5
    vectors = spelled.select("word", F.array(*[digit(i) for i in range(1, 17)]).alias("vector"))
    problems = named.where("problem").selectExpr("concat('P', k) AS problem_id", "k AS row_no", "s AS short_text", "r AS request")
    tickets = named.where("NOT problem").selectExpr(
        "concat('I', k) AS incident_id", "k AS row_no", "IF(k % 7 = 0, concat('P', k % 11), null) AS problem_id", "s AS short_text", "r AS request", "IF(k % 7 = 0, 'RK', null) AS link_kind"
    )
    return problems, tickets, P.link_candidates(problems, tickets.drop("link_kind"), vectors, vectors, 16, 16)


@query("h4_link_candidates", _CLAIMS)
def _(spark, d):
    claims = _linked(spark, d)[2]
    return claims.select("incident_id", "problem_id", "level2", "phase", r("score_short").alias("score_short"), r("score_request").alias("score_request"))


@query(
    "h4_match_report",
    f"""WITH p AS ({_NAMED}), c AS ({_CLAIMS})
        SELECT c.problem_id, q.s AS problem_short, q.r AS problem_request, c.incident_id, i.s AS incident_short, i.r AS incident_request, score_short, score_request, CAST(NULL AS VARCHAR) AS link_kind,
          c.problem_id AS level1, level2, c.incident_id AS level3, q.s AS problem_short_clean, q.r AS problem_request_clean, i.s AS incident_short_clean, i.r AS incident_request_clean
        FROM c JOIN p i ON 'I' || i.k = c.incident_id JOIN p q ON q.problem AND 'P' || q.k = c.problem_id""",
)
def _(spark, d):
    problems, tickets, claims = _linked(spark, d)
    report = P.match_report(claims, problems, tickets)
    return report.withColumns({"score_short": r("score_short"), "score_request": r("score_request")})
