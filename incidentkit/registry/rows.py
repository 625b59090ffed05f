"""Row operators over the test tables."""

from pyspark.sql import functions as F

from incidentkit.operators import joins as J, rows as R
from incidentkit.registry.common import query, table


@query(
    "b1_select_rename",
    "SELECT o_orderkey AS incident_id, o_orderdate AS opened, o_orderstatus AS kind, o_orderpriority AS impact FROM orders",
)
def _(spark, d):
    names = {"o_orderkey": "incident_id", "o_orderdate": "opened", "o_orderstatus": "kind", "o_orderpriority": "impact"}
    return R.select_rename(table(spark, d, "orders"), names)


@query("b2_drop_events", "SELECT event_id, event_type, value FROM events WHERE event_type IS DISTINCT FROM 'error'")
def _(spark, d):
    return R.drop_events(table(spark, d, "events"), "event_type", "error").select("event_id", "event_type", "value")


@query("b3_filter_eq", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    return R.filter_eq(table(spark, d, "events"), "event_type", "purchase").select("event_id", "user_id")


_GAPS = "SELECT o_orderkey, CASE WHEN l.k IS NULL THEN NULL ELSE l.k END AS shipped FROM orders LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS k FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey"


def _gaps(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("shipped"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")


@query("b3_filter_empty", f"SELECT o_orderkey FROM ({_GAPS}) WHERE shipped IS NULL")
def _(spark, d):
    return R.filter_eq(_gaps(spark, d), "shipped", None).select("o_orderkey")


@query("b4_fill_defaults", f"SELECT o_orderkey, coalesce(shipped, 0) AS shipped FROM ({_GAPS})")
def _(spark, d):
    return R.fill_defaults(_gaps(spark, d), {"shipped": 0})


@query("b5_drop_missing", f"SELECT o_orderkey, shipped FROM ({_GAPS}) WHERE shipped IS NOT NULL")
def _(spark, d):
    return R.drop_missing(_gaps(spark, d), ["shipped"])


@query(
    "b6_sample_n",
    "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':8'), o_orderkey LIMIT 4000",
)
def _(spark, d):
    return R.sample_n(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 4000, "o_orderkey", seed=8)


@query(
    "b6_sample_fraction",
    "SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':8'), 1, 8) AS BIGINT) < 2147483648",
)
def _(spark, d):
    return R.sample_fraction(table(spark, d, "orders").select("o_orderkey"), 0.5, "o_orderkey", seed=8)


@query("b7_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    return R.head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, ["o_orderkey"])


@query("b8_drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(spark, d):
    return R.drop_columns(table(spark, d, "customer"), ["c_name", "c_acctbal"])


@query(
    "b9_cast_columns",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders",
)
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return R.cast_columns(df, {"o_orderkey": "string", "o_totalprice": "decimal(18,2)", "o_orderdate": "date"})


@query(
    "b10_null_counts",
    f"""SELECT 'o_orderkey' AS column_name, count(*) - count(o_orderkey) AS nulls, count(o_orderkey) AS filled FROM ({_GAPS})
        UNION ALL SELECT 'shipped', count(*) - count(shipped), count(shipped) FROM ({_GAPS})""",
)
def _(spark, d):
    return R.null_counts(_gaps(spark, d))


@query("b11_distinct_rows", "SELECT DISTINCT p_name, p_brand FROM part")
def _(spark, d):
    return R.distinct_rows(table(spark, d, "part"), ["p_name", "p_brand"])


@query(
    "b12_month_keys",
    """SELECT o_orderkey, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
              strftime(o_orderdate, '%b') AS month_name, CAST(o_orderdate AS DATE) AS day FROM orders""",
)
def _(spark, d):
    return R.month_keys(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "b13_any_contains",
    "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')",
)
def _(spark, d):
    return R.any_contains(table(spark, d, "documents"), ["text", "source"], "LICENSE").select("doc_id", "n_chars")


@query(
    "b14_unpivot_variants",
    """SELECT DISTINCT p_type, request FROM (SELECT p_type, p_name AS request FROM part UNION ALL SELECT p_type, p_brand FROM part
       UNION ALL SELECT p_type, CASE WHEN p_size > 25 THEN p_name || ' large' END FROM part) WHERE request IS NOT NULL""",
)
def _(spark, d):
    part = table(spark, d, "part").select(
        "p_type",
        F.col("p_name").alias("request_1"),
        F.col("p_brand").alias("request_2"),
        F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(" large"))).alias("request_3"),
    )
    return R.unpivot_variants(part, ["p_type"], ["request_1", "request_2", "request_3"])


@query(
    "b15_union_series",
    "SELECT o_orderstatus AS series_id, o_orderkey AS t, o_totalprice AS y FROM orders UNION ALL SELECT l_linestatus, l_orderkey, l_extendedprice FROM lineitem",
)
def _(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderstatus").alias("series_id"), F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("y"))
    b = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("series_id"), F.col("l_orderkey").alias("t"), F.col("l_extendedprice").alias("y"))
    return R.union_series(a, b)


_NAMED = "SELECT p_name || ' ' || p_brand AS name, p_size FROM part"


@query("u2_set_difference", f"SELECT name FROM ({_NAMED}) WHERE p_size < 10 EXCEPT SELECT name FROM ({_NAMED}) WHERE p_size > 20")
def _(spark, d):
    part = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"), "p_size")
    small = part.where("p_size < 10").select("name").distinct()
    return J.anti_new_names(small, part.where("p_size > 20"), "name")
