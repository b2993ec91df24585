"""The pipeline's stages, held against plain versions of what each must keep."""

import corpus_pipeline
from flowlens.llm import dartminhash, decontam

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name != "mix":
            assert docs.columns == columns
        assert {r["doc_id"] for r in rows} <= set(before)
        if name == "quality":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
            gone = set(before) - {r["doc_id"] for r in rows}
            assert len(gone & bad) >= 0.7 * len(bad)
        if name == "near_dedup":
            again = dartminhash.near_duplicates(docs).collect()
            assert all(r["doc_id"] == r["class_id"] for r in again)
        if name == "decontaminate":
            assert decontam.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if name == "mix":
            assert all({k: r[k] for k in columns} == before[r["doc_id"]].asDict() for r in rows)
        else:
            before = {r["doc_id"]: r for r in rows}


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "copy"} <= set(rows[0].asDict())


def test_line_stage_keeps_one_of_a_large_group_of_copies(spark):
    copy = "\n".join(f"line {j} of a text that was copied over and over" for j in range(6))
    rows = [(i, copy, "en", "s", len(copy)) for i in range(40)]
    rows += [(100 + i, f"menu\nown words of page {i} and of no other page", "en", "s", 5) for i in range(80)]
    rows += [(300, None, "en", "s", None), (301, "", "en", "s", 0), (302, "menu", "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cleaned = corpus_pipeline.lines(spark, docs, SF)
    got = {r["doc_id"]: r for r in cleaned.collect()}
    assert sorted(got) == [r[0] for r in rows] and cleaned.columns == docs.columns
    assert all(got[i]["text"] == copy and got[i]["n_chars"] == len(copy) for i in range(40))
    assert got[105]["text"] == "own words of page 5 and of no other page"
    assert (got[300]["text"], got[301]["text"], got[302]["text"]) == (None, "", "menu")
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, cleaned, SF).collect()}
    assert {i for i in left if i < 100} == {0}
