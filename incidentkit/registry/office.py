"""Customer tables derived from the test tables."""

from pyspark.sql import functions as F

from incidentkit.plans import back_office as B, templates as TP
from incidentkit.registry.common import money, query, table
from incidentkit.registry.sources import DEBITS, _debits

_SIZES = ["16-18 draadkluit hoogstam", "14-16 draadkluit hoogstam", "18-20 wortelgoed hoogstam"]
_SIZE = "CASE p_size % 3 WHEN 0 THEN '16-18 draadkluit hoogstam' WHEN 1 THEN '14-16 draadkluit hoogstam' ELSE '18-20 wortelgoed hoogstam' END"
# Catalogue: the larger parts. Names list: the smaller ones, some with a quoted second word, some of an unknown group.
_CATALOG = f"""SELECT p_type AS "group", p_name || ' ' || p_brand AS latin_name, {_SIZE} AS size_code,
    CAST(CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice END AS DECIMAL(18,2)) AS price, p_partkey AS row_no FROM part WHERE p_size >= 10"""
_NAMES = """SELECT p_type AS "group", CASE p_partkey % 5 WHEN 0 THEN split_part(p_name, ' ', 1) || ' ''' || p_brand || ''''
    WHEN 1 THEN 'Nova ' || p_name ELSE p_name || ' ' || p_brand END AS latin_name, p_partkey AS row_no FROM part WHERE p_size < 10"""
_STANDARD = "(VALUES " + ", ".join(f"('{s}')" for s in B.STANDARD_SIZES) + ") z(size_code)"


@query(
    "j1_extend_catalog",
    f"""WITH c AS ({_CATALOG}), n AS ({_NAMES}),
      new AS (SELECT * FROM n WHERE lower(latin_name) NOT IN (SELECT lower(latin_name) FROM c) QUALIFY row_number() OVER (PARTITION BY lower(latin_name) ORDER BY row_no) = 1),
      k AS (SELECT *, lower(split_part(latin_name, ' ', 1) || ' ' || split_part(latin_name, ' ', 2)) AS key, starts_with(split_part(latin_name, ' ', 2), '''') AS odd FROM new),
      d AS (SELECT lower(split_part(latin_name, ' ', 1) || ' ' || split_part(latin_name, ' ', 2)) AS key, "group" AS g, latin_name AS donor FROM c WHERE size_code IN ('{_SIZES[0]}', '{_SIZES[1]}')
            QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE size_code WHEN '{_SIZES[0]}' THEN 1 ELSE 2 END, price DESC NULLS LAST, row_no) = 1),
      x AS (SELECT k.*, g, CASE WHEN NOT odd THEN donor END AS donor FROM k LEFT JOIN d ON d.key = k.key)
      SELECT "group", latin_name, size_code, price, CAST(NULL AS VARCHAR) AS control FROM c
      UNION ALL SELECT g, x.latin_name, c.size_code, c.price, donor FROM x JOIN c ON c."group" = g AND c.latin_name = donor
      UNION ALL SELECT "group", latin_name, z.size_code, NULL, NULL FROM x, {_STANDARD} WHERE donor IS NULL""",
)
def _(spark, d):
    part = table(spark, d, "part")
    size = F.when(F.col("p_size") % 3 == 0, _SIZES[0]).when(F.col("p_size") % 3 == 1, _SIZES[1]).otherwise(_SIZES[2])
    full = F.concat_ws(" ", "p_name", "p_brand")
    catalog = part.where("p_size >= 10").select(
        F.col("p_type").alias("group"),
        full.alias("latin_name"),
        size.alias("size_code"),
        F.when(F.col("p_partkey") % 10 != 0, money("p_retailprice")).alias("price"),
        F.col("p_partkey").alias("row_no"),
    )
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    kind = F.col("p_partkey") % 5
    name = (
        F.when(kind == 0, F.concat(first, F.lit(" '"), "p_brand", F.lit("'")))
        .when(kind == 1, F.concat(F.lit("Nova "), "p_name"))
        .otherwise(full)
    )
    names = part.where("p_size < 10").select(F.col("p_type").alias("group"), name.alias("latin_name"), F.col("p_partkey").alias("row_no"))
    return B.extend_catalog(names, catalog)


_WEEK = "SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS s, sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus <> 'F') AS t, CAST(0 AS DECIMAL(18,2)) AS u FROM orders WHERE year(o_orderdate) = {y} GROUP BY 1"


@query(
    "j2_tvt_export",
    f"""WITH a AS ({_WEEK.format(y=1999)}), b AS ({_WEEK.format(y=1998)}), x AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey,
          coalesce(a.s, 0) + coalesce(a.t, 0) + coalesce(a.u, 0) - coalesce(b.s, 0) - coalesce(b.t, 0) - coalesce(b.u, 0) AS v FROM a FULL JOIN b ON a.o_custkey = b.o_custkey)
        SELECT o_custkey, DATE '2021-01-01' AS start, DATE '2021-12-31' AS "end", 10 AS kind, CASE WHEN v < 0 THEN -1 ELSE 1 END AS factor, CAST(abs(v) AS DECIMAL(38,2)) AS units FROM x WHERE v <> 0""",
)
def _(spark, d):
    orders = table(spark, d, "orders").withColumn("p", money("o_totalprice"))

    def week(year):
        return orders.where(F.year("o_orderdate") == year).groupBy("o_custkey").agg(
            F.sum(F.when(F.col("o_orderstatus") == "F", F.col("p"))).alias("s"),
            F.sum(F.when(F.col("o_orderstatus") != "F", F.col("p"))).alias("t"),
            F.lit(0).cast("decimal(18,2)").alias("u"),
        )

    out = B.tvt_export(week(1999), week(1998), ["o_custkey"], ["s", "t", "u"], 2021)
    return out.withColumn("units", F.col("units").cast("decimal(38,2)"))


@query(
    "j3_leave_export",
    """WITH l AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 12 AS INTEGER) AS b, CAST(o_orderkey % 4 + 5 AS INTEGER) AS hours FROM orders WHERE o_orderstatus = 'F'),
            x AS (SELECT o_custkey, hours, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM l),
            w AS (SELECT o_custkey, CAST(date_trunc('week', day) AS DATE) AS start, CAST(sum(hours) AS BIGINT) AS units FROM x WHERE isodow(day) < 6 GROUP BY 1, 2)
       SELECT c_custkey AS o_custkey, start, start + 4 AS "end", 15 AS kind, -1 AS factor, coalesce(units, 0) AS units FROM customer LEFT JOIN w ON w.o_custkey = c_custkey""",
)
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    leave = table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        "o_custkey",
        day.alias("start"),
        F.date_add(day, (F.col("o_orderkey") % 12).cast("int")).alias("end"),
        (F.col("o_orderkey") % 4 + 5).cast("int").alias("hours"),
    )
    staff = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return B.leave_export(leave, ["o_custkey"], staff)


@query(
    "j4_export_diff",
    """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, max(l_quantity) AS q, max(l_tax) AS t FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1, 2, 3),
            w AS (SELECT l_orderkey, l_linenumber, l_partkey, round(max(l_quantity) / 10) * 10 AS q, max(l_tax) AS t FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1, 2, 3)
       SELECT coalesce(g.l_orderkey, w.l_orderkey) AS l_orderkey, coalesce(g.l_linenumber, w.l_linenumber) AS l_linenumber, coalesce(g.l_partkey, w.l_partkey) AS l_partkey,
              CASE WHEN w.l_orderkey IS NULL THEN 'extra' WHEN g.l_orderkey IS NULL THEN 'missing' ELSE 'changed' END AS status,
              CASE WHEN w.l_orderkey IS NOT NULL AND g.l_orderkey IS NOT NULL THEN 'q' END AS fields
       FROM g FULL JOIN w ON w.l_orderkey = g.l_orderkey AND w.l_linenumber = g.l_linenumber AND w.l_partkey = g.l_partkey
       WHERE g.l_orderkey IS NULL OR w.l_orderkey IS NULL OR g.q <> w.q""",
)
def _(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    base = table(spark, d, "lineitem").groupBy(*keys).agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    got = base.where("l_orderkey % 7 <> 0")
    wanted = base.where("l_orderkey % 5 <> 0").withColumn("q", F.round(F.col("q") / 10) * 10)
    return B.export_diff(got, wanted, keys, ["q", "t"]).select(*keys, "status", "fields")


def _weeks(spark, d):
    li = table(spark, d, "lineitem")
    week = F.weekofyear("l_shipdate")
    rows = li.select(
        F.col("l_returnflag").alias("flag"),
        week.alias("week"),
        F.col("l_suppkey").alias("worker"),
        (F.col("l_partkey") % 10).alias("client"),
        F.when(F.col("l_quantity") > 2, money("l_quantity")).alias("hours"),
        F.lit(20).cast("decimal(18,2)").alias("buy_rate"),
        (F.lit(25) + F.col("l_linenumber")).cast("decimal(18,2)").alias("sell_rate"),
        (F.col("l_discount") * 100).cast("decimal(18,2)").alias("recruiter_fee"),
        F.when(F.col("l_linenumber") == 1, F.lit(5).cast("decimal(18,2)")).alias("material"),
        (F.col("l_tax") * 100).cast("decimal(18,2)").alias("travel"),
        F.when(F.col("l_linenumber") > 5, F.lit(2).cast("decimal(18,2)")).alias("overtime_hours"),
        F.lit(150).cast("decimal(18,2)").alias("overtime_pct"),
        (F.col("l_linestatus") == "F").alias("invoiced"),
    )
    metal = rows.where("flag = 'A'").drop("flag").withColumn("department", F.lit("metal"))
    building = rows.where("flag <> 'A'").drop("flag").withColumn("department", F.lit("building"))
    return B.weekly_margin(metal, building)


_MARGIN = """SELECT department, week, worker, client, sales, purchase, costs, sales - purchase - costs AS margin, paid = 0 AS missing_hours, sales > 0 AND NOT invoiced AS to_invoice FROM (
    SELECT *, CAST(paid * sell_rate AS DECIMAL(18,4)) AS sales, CAST(paid * 20 AS DECIMAL(18,4)) AS purchase FROM (
    SELECT CASE WHEN l_returnflag = 'A' THEN 'metal' ELSE 'building' END AS department, CAST(weekofyear(l_shipdate) AS INTEGER) AS week, l_suppkey AS worker, l_partkey % 10 AS client,
      CAST(CASE WHEN l_quantity > 2 THEN l_quantity ELSE 0 END + CASE WHEN l_linenumber > 5 THEN 3 ELSE 0 END AS DECIMAL(18,2)) AS paid, CAST(25 + l_linenumber AS DECIMAL(18,2)) AS sell_rate,
      CAST(CAST(l_discount * 100 AS DECIMAL(18,2)) + CASE WHEN l_linenumber = 1 THEN 5 ELSE 0 END + CAST(l_tax * 100 AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS costs, l_linestatus = 'F' AS invoiced FROM lineitem))"""


@query("j5_weekly_margin", f"SELECT department, week, worker, client, sales, purchase, costs, CAST(margin AS DECIMAL(20,4)) AS margin, missing_hours, to_invoice FROM ({_MARGIN})")
def _(spark, d):
    out = _weeks(spark, d).select("department", "week", "worker", "client", "sales", "purchase", "costs", "margin", "missing_hours", "to_invoice")
    return out.withColumn("margin", F.col("margin").cast("decimal(20,4)"))


_SUMS = ", ".join(f"CAST(sum({m}) AS DECIMAL(38,4)) AS {m}" for m in ("sales", "purchase", "costs", "margin"))


@query("j5_margin_totals", f"SELECT department, client, {_SUMS}, CAST(grouping(department) + grouping(client) AS INTEGER) AS level FROM ({_MARGIN}) GROUP BY ROLLUP (department, client)")
def _(spark, d):
    out = B.margin_totals(_weeks(spark, d))
    return out.withColumns({m: F.col(m).cast("decimal(38,4)") for m in ("sales", "purchase", "costs", "margin")})


@query(
    "j5_cumulative_margin",
    f"""SELECT week, department, client, level, {", ".join(f"CAST(sum({m}) OVER w AS DECIMAL(38,4)) AS {m}" for m in ("sales", "purchase", "costs", "margin"))} FROM
        (SELECT week, department, client, CAST(grouping(department) * 2 + grouping(client) AS INTEGER) AS level, {_SUMS} FROM ({_MARGIN})
         GROUP BY GROUPING SETS ((week, department, client), (week, department), (week))) WINDOW w AS (PARTITION BY level, department, client ORDER BY week)""",
)
def _(spark, d):
    out = B.cumulative_margin(_weeks(spark, d))
    return out.withColumns({m: F.col(m).cast("decimal(38,4)") for m in ("sales", "purchase", "costs", "margin")})


@query(
    "j6_reconcile_debits",
    f"""SELECT o_orderstatus, announced_count, announced_sum, counted, CAST(summed AS DECIMAL(38,2)) AS summed, counted - announced_count AS count_gap, CAST(summed - announced_sum AS DECIMAL(38,2)) AS sum_gap FROM
        (SELECT o_orderstatus, count(*) AS announced_count, CAST(sum(amount) AS DECIMAL(18,2)) - 0.04 AS announced_sum FROM ({DEBITS}) GROUP BY 1)
        JOIN (SELECT o_orderstatus AS s, count(*) AS counted, sum(amount) AS summed FROM ({DEBITS}) GROUP BY 1) ON s = o_orderstatus""",
)
def _(spark, d):
    tx = _debits(spark, d)
    gap = F.lit("0.04").cast("decimal(3,2)")
    header = tx.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("announced_count"), (F.sum("amount") - gap).cast("decimal(18,2)").alias("announced_sum"))
    out = B.reconcile_debits(tx, header, ["o_orderstatus"])
    return out.withColumns({c: F.col(c).cast("decimal(38,2)") for c in ("summed", "sum_gap")})


@query(
    "j7_debits_per_mandate",
    rf"SELECT mandate_id, CAST(regexp_extract(remittance, 'Adv-W(\d+)-', 1) AS INTEGER) AS week, count(*) AS n, CAST(sum(amount) AS DECIMAL(28,2)) AS amount FROM ({DEBITS}) GROUP BY 1, 2",
)
def _(spark, d):
    return B.debits_per_mandate(_debits(spark, d))


@query(
    "f15_prepare_templates",
    """SELECT DISTINCT p_type, request, CAST(1 AS INTEGER) AS lines FROM (
         SELECT p_type, p_name || ' omschrijving' AS request FROM part UNION ALL SELECT p_type, p_brand FROM part UNION ALL SELECT p_type, CASE WHEN p_size > 25 THEN p_name || '  keuze' END FROM part)
       WHERE request IS NOT NULL""",
)
def _(spark, d):
    part = table(spark, d, "part").select(
        "p_type",
        F.concat("p_name", F.lit(" omschrijving")).alias("request_1"),
        F.col("p_brand").alias("request_2"),
        F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(" Ja/Nee keuze"))).alias("request_3"),
    )
    return TP.prepare_templates(part, ["p_type"], ["request_1", "request_2", "request_3"]).select("p_type", "request", "lines")
