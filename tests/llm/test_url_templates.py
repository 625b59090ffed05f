"""What the template tree rejects on rule labels alone."""

from incidentkit.llm import queries, url_templates


def test_rule_labels_reject_and_allow_other_urls(spark):
    urls = [f"http://h{i % 5}.example.net/{part}/page{i}" for i in range(100) for part in ("es", "en")]
    urls += [f"http://a.example.com/{part}/page{i}" for i in range(10) for part in ("es", "en")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_templates.judge(pages, queries.RULES).collect()
    free = {(r.path.split("/")[1], r.verdict) for r in got if r.rule is None}
    assert len(got) == len(urls) and free == {("es", "block"), ("en", "allow")}


def test_a_branch_without_labels_takes_the_share_of_its_host(spark):
    rows = [(i, f"http://bad.test/known/{i}") for i in range(50)] + [(100 + i, f"http://bad.test/new/{i}") for i in range(5)] + [(200, "http://other.test/x/1")]
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "page_id long, bad int")
    got = url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), (), labels).collect()
    assert {r.verdict for r in got if r.host == "bad.test"} == {"block"} and {r.verdict for r in got if r.host != "bad.test"} == {"allow"}
