"""Every stage against a plain version of its decision, and the whole run."""

import corpus_pipeline as cp
from incidentkit.llm import decontaminate, quality
from incidentkit.llm.common import table
from test_decisions import plain_spans
from test_simhash import brute, plain

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # holds secrets


def test_stages(spark, tmp_path):
    docs = table(spark, LARGER, "documents")
    columns, kept = docs.columns, docs
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in kept.collect()}
        path = str(tmp_path / name)
        stage(spark, kept, LARGER).write.parquet(path)
        kept = spark.read.parquet(path)
        after = {r.doc_id: r for r in kept.collect()}
        assert kept.count() == len(after) and set(after) <= set(before)
        if name == "byte_bpe":
            assert set(after) == set(before)
            break
        assert kept.columns == columns
        if name != "secrets":
            assert all(after[d] == before[d] for d in after)
        if name == "quality":
            scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, table(spark, LARGER, "labels"))).collect()}
            assert set(after) == {d for d, s in scores.items() if s >= cp.QUALITY_CUT}
        if name == "near_duplicates":
            rows = [(d, plain(r.text)) for d, r in before.items()]
            assert set(after) == set(brute(rows))
        if name == "decontamination":
            clean = lambda t: " " + " ".join(decontaminate.words(t)) + " "
            items = [clean(r.text) for r in table(spark, LARGER, "benchmark").collect()]
            assert not any(i in clean(r.text) for r in after.values() for i in items)
            found = {r.doc_id for r in decontaminate.leaks(spark.createDataFrame(list(before.values()), docs.schema), table(spark, LARGER, "benchmark")).collect()}
            assert set(after) == set(before) - found
        if name == "secrets":
            assert set(after) == set(before) and any(plain_spans(r.text) for r in before.values())
            for d, r in after.items():
                assert not plain_spans(r.text) and (r == before[d] or plain_spans(before[d].text) or "[secret]" in r.text)


def test_run_and_awkward_rows(spark, tmp_path):
    assert {"doc_id", "n_tokens"} <= set(cp.run(spark, SMALL).columns)
    labels, items = table(spark, SMALL, "labels"), table(spark, SMALL, "benchmark")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    good = table(spark, SMALL, "documents").where("doc_id < 40")
    from pyspark.sql import functions as F

    odd = good.unionByName(good.limit(5)).withColumns({"score": F.lit("clash"), "path": F.lit(1)})
    odd = odd.union(spark.createDataFrame([(None, None, None, None, None, "clash", 1), (900, "", "en", "s", 0, "x", 2)], odd.schema))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    for folder in (tmp_path,):
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, str(folder))
            assert out.columns == docs.columns
            assert stage(spark, docs.limit(0), str(folder)).count() == 0
            docs = out
        assert cp.STAGES[-1][1](spark, docs, str(folder)).count() == docs.count()
