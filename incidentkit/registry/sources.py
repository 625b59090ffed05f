"""Readers and writers, each over a file that Spark writes from a test table."""

from pyspark.sql import functions as F

from incidentkit.operators import models as M
from incidentkit.operators.rows import unfold
from incidentkit.registry.common import WORDS, money, query, table, words
from incidentkit.session import scratch
from incidentkit.sources import direct_debit as X, files as S, tables as B

_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date"


@query("a1_read_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def _(spark, d):
    path = scratch(spark, "orders")
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date"))
    S.write_csv(df, path, "\t")
    return S.read_csv(spark, path, _ORDERS, "\t")


@query("a1_read_csv_multiline", "SELECT doc_id, lang, length(text) AS size FROM documents")
def _(spark, d):
    path = scratch(spark, "documents")
    S.write_csv(table(spark, d, "documents").select("doc_id", "lang", "text"), path, ";")
    back = S.read_csv(spark, path, "doc_id bigint, lang string, text string", ";", multiline=True)
    return back.select("doc_id", "lang", F.length("text").cast("bigint").alias("size"))


@query("a2_read_series", "SELECT CAST(ts AS DATE) AS ts, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "series")
    daily = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("ts")).agg(F.count(F.lit(1)).alias("y"))
    S.write_csv(daily, path, header=False)
    return S.read_series(spark, path)


@query("a3_read_many", "SELECT l_returnflag, count(*) AS n, 4 AS files FROM lineitem GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "chunks")
    S.write_csv(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag").repartition(4), path)
    chunks = S.read_many(spark, f"{path}/part-*", "l_orderkey bigint, l_returnflag string")
    return chunks.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_file").cast("int").alias("files"))


@query("a4_read_wordlist", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part")
def _(spark, d):
    path = scratch(spark, "words")
    table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("value")).write.text(path)
    return S.read_wordlist(spark, path).select("word")


@query("a4_read_wordmap", "SELECT DISTINCT p_name AS word, upper(p_name) AS replacement FROM part")
def _(spark, d):
    path = scratch(spark, "map")
    part = table(spark, d, "part")
    part.select(F.concat("p_name", F.lit(" = "), F.upper("p_name")).alias("value")).write.text(path)
    return S.read_wordmap(spark, path)


@query(
    "a5_read_dutch_csv",
    """SELECT CAST(1 AS INTEGER) AS employer_id, CAST(l_orderkey AS INTEGER) AS person_no, CAST(l_shipdate AS DATE) AS start, CAST(l_shipdate AS DATE) + 4 AS end,
              CASE WHEN l_returnflag = 'A' THEN 10 ELSE 15 END AS kind, CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END AS factor,
              CASE WHEN l_linenumber = 1 THEN 0.03 ELSE l_extendedprice END AS units FROM lineitem""",
)
def _(spark, d):
    units = F.when(F.col("l_linenumber") == 1, F.lit("3,00E-02")).otherwise(
        F.replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    )
    day = F.col("l_shipdate").cast("date")
    first = F.col("l_returnflag") == "A"
    lines = table(spark, d, "lineitem").select(
        F.lit("1").alias("WerkgeverID"),
        F.lit("7").alias("PersnrVerl"),
        F.col("l_orderkey").alias("Persnr"),
        F.lit("Testpersoon A.").alias("Naam"),
        F.date_format(day, "d-M-yyyy").alias("Ingangsdatum"),
        F.date_format(F.date_add(day, 4), "d-M-yyyy").alias("Einddatum"),
        F.when(first, "10").otherwise("15").alias("Soort"),
        F.when(first, "1").otherwise("-1").alias("Factor"),
        units.alias("Eenheden"),
        F.lit(None).cast("string").alias(" "),
    )
    path = scratch(spark, "leave")
    S.write_csv(lines, path, ";")
    return S.read_dutch_csv(spark, path).select("employer_id", "person_no", "start", "end", "kind", "factor", "units")


def _debits(spark, d):
    orders = table(spark, d, "orders")
    week = F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0")
    return orders.select(
        F.col("o_orderkey"),
        F.concat(F.lit("M-"), (F.col("o_custkey") % 16).cast("string")).alias("mandate_id"),
        money("o_totalprice").alias("amount"),
        F.concat(F.lit("Adv-W"), week, F.lit("-Fact-"), F.col("o_orderkey").cast("string")).alias("remittance"),
        F.col("o_orderdate").cast("date").alias("signed_on"),
        "o_orderstatus",
    )


DEBITS = """SELECT o_orderkey, 'M-' || (o_custkey % 16) AS mandate_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
    'Adv-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') || '-Fact-' || o_orderkey AS remittance, CAST(o_orderdate AS DATE) AS signed_on, o_orderstatus FROM orders"""


@query("a6_read_direct_debits", f"SELECT 'E-' || o_orderkey AS end_to_end_id, amount, 'EUR' AS currency, mandate_id, signed_on, 'BANKNL2A' AS bic, remittance FROM ({DEBITS})")
def _(spark, d):
    path = scratch(spark, "debits")
    rows = _debits(spark, d).select(
        F.struct(F.concat(F.lit("E-"), "o_orderkey").alias("EndToEndId")).alias("PmtId"),
        F.struct(F.lit("EUR").alias("_Ccy"), F.col("amount").alias("_VALUE")).alias("InstdAmt"),
        F.struct(F.struct(F.col("mandate_id").alias("MndtId"), F.col("signed_on").alias("DtOfSgntr")).alias("MndtRltdInf")).alias("DrctDbtTx"),
        F.struct(F.struct(F.lit("BANKNL2A").alias("BIC")).alias("FinInstnId")).alias("DbtrAgt"),
        F.struct(F.lit("T. Test").alias("Nm"), F.struct(F.array(F.lit("Straat 1"), F.lit("Stad")).alias("AdrLine")).alias("PstlAdr")).alias("Dbtr"),
        F.struct(F.struct(F.lit("X").alias("IBAN")).alias("Id")).alias("DbtrAcct"),
        F.struct(F.col("remittance").alias("Ustrd")).alias("RmtInf"),
    )
    rows.write.format("xml").option("rootTag", "PmtInf").option("rowTag", "DrctDbtTxInf").save(path)
    return X.read_direct_debits(spark, path).select("end_to_end_id", "amount", "currency", "mandate_id", "signed_on", "bic", "remittance")


@query("a6_read_dd_header", f"SELECT o_orderstatus AS message_id, count(*) AS announced_count, CAST(sum(amount) AS DECIMAL(18,2)) AS announced_sum FROM ({DEBITS}) GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "headers")
    heads = _debits(spark, d).groupBy(F.col("o_orderstatus").alias("MsgId")).agg(
        F.count(F.lit(1)).alias("NbOfTxs"), F.sum("amount").cast("decimal(18,2)").alias("CtrlSum")
    )
    heads.write.format("xml").option("rootTag", "Document").option("rowTag", "GrpHdr").save(path)
    return X.read_dd_header(spark, path).drop("created")


@query("a6_read_dd_batch", f"SELECT o_orderstatus AS batch_id, count(*) AS announced_count, CAST(sum(amount) AS DECIMAL(18,2)) AS announced_sum, max(signed_on) AS collect_on FROM ({DEBITS}) GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "batches")
    batches = _debits(spark, d).groupBy(F.col("o_orderstatus").alias("PmtInfId")).agg(
        F.count(F.lit(1)).alias("NbOfTxs"), F.sum("amount").cast("decimal(18,2)").alias("CtrlSum"), F.max("signed_on").alias("ReqdColltnDt")
    )
    batches.write.format("xml").option("rootTag", "CstmrDrctDbtInitn").option("rowTag", "PmtInf").save(path)
    return X.read_dd_batch(spark, path)


@query("a7_write_csv", "SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal FROM customer")
def _(spark, d):
    path = scratch(spark, "customer")
    S.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", money("c_acctbal").alias("c_acctbal")), path, ";")
    return S.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal decimal(18,2)", ";")


@query("a7_match_report", "SELECT l_partkey AS problem_id, l_orderkey AS incident_id, l_discount AS score_short FROM lineitem")
def _(spark, d):
    path = scratch(spark, "report")
    given = {"problem_id": F.col("l_partkey"), "incident_id": F.col("l_orderkey"), "score_short": F.col("l_discount"), "problem_request": F.lit("café")}
    rows = table(spark, d, "lineitem").select(*[given.get(c, F.lit("x")).alias(c) for c in S.MATCH_REPORT])
    S.write_match_report(rows, path)
    schema = ", ".join(f"{c} {'double' if c.startswith('score') else 'bigint' if c in ('problem_id', 'incident_id') else 'string'}" for c in S.MATCH_REPORT)
    return S.read_csv(spark, path, schema, "~").select("problem_id", "incident_id", "score_short")


@query("a8_checkpoint_table", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, d):
    return B.checkpoint_table(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), scratch(spark, "stage"))


@query("a9_saved_model")
def _(spark, d):
    from pyspark.ml.clustering import KMeansModel

    df = M.as_vector(table(spark, d, "embeddings"), "embedding")
    path = scratch(spark, "model")
    B.save_model(M.kmeans(df, 5, 10), path)
    return B.load_model(path, KMeansModel).transform(df).groupBy("cluster").count()


@query(
    "a10_write_cluster_terms",
    f"""SELECT lang || ',' || string_agg(word, ',' ORDER BY k) AS value FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k
        FROM (SELECT lang, unnest(tokens) AS word FROM ({WORDS})) GROUP BY 1, 2) WHERE k <= 10 GROUP BY lang""",
)
def _(spark, d):
    from pyspark.sql import Window

    counts = unfold(words(spark, d), "tokens", "term", "lang").groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).where("rank <= 10")
    path = scratch(spark, "terms")
    S.write_cluster_terms(top.select(F.col("lang").alias("cluster"), "rank", "term"), path)
    return spark.read.text(path)
