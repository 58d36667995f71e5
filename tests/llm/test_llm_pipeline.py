"""The corpus pipeline: every stage's decision takes effect, columns stay, nothing else goes."""

import corpus_pipeline
from visiflow.llm.common import write_table

DATA = "/root/testdata/sf0.001"


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before, seen = docs.columns, docs.count(), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, DATA), name)
        seen[name] = docs
    counts = [seen[n].count() for n, _ in corpus_pipeline.STAGES]
    assert all(list(seen[n].columns) == columns for n, _ in corpus_pipeline.STAGES[:-1])
    assert before >= counts[0] >= counts[1] >= counts[2] == counts[3] == counts[4] > before // 2
    groups = corpus_pipeline.jaccard_join.jaccard_groups(seen["near_duplicates"])
    assert groups.filter("n_links > 0").count() == 0
    left = corpus_pipeline.llm.contamination(seen["decontamination"], spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert left.filter("contaminated").count() == 0
    assert seen["personal_data"].filter("text rlike '[a-z]@[a-z]+[.][a-z]'").count() == 0


def test_near_duplicate_stage_keeps_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (3, text + " end", "en", "s", 1), (4, "other words here", "en", "s", 1),
            (5, None, None, None, None), (6, "", "en", "s", 0), (None, "no id", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), DATA).count() == 0


def test_decisions_hold_by_row(spark, tmp_path):
    text, other, leak = (" ".join(f"{p}{k}" for k in range(60)) for p in "abc")
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    row = lambda i, t: (i, t, "en", "s", None if t is None else len(t))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([row(None, leak), row(None, text), row(2, leak + " x"), row(2, other)], shape)
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, text), (2, other)]
    docs = spark.createDataFrame([row(None, text), row(3, text + " end"), row(4, text), row(4, leak), row(None, other), row(None, other), row(None, ""),
                                  row(None, ""), row(None, None), row(None, None), row(5, ""), row(5, "")], shape)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()
    want = [(0, ""), (0, ""), (0, None), (0, None), (0, other), (3, text + " end"), (4, leak), (5, "")]
    assert sorted((r.doc_id or 0, str(r.text)) for r in left) == sorted((i, str(t)) for i, t in want)
    rows = [row(k if k < 390 else None, text if k % 2 else "### " * 40) for k in range(400)] + [row(1, "### " * 40)]
    spark.createDataFrame([(k, k % 2) for k in range(2, 390)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.classify_quality(spark, spark.createDataFrame(rows, shape), str(tmp_path)).collect()
    assert len(left) == 200 and all(r.text == text for r in left) and sum(r.doc_id is None for r in left) == 5
