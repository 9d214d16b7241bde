import __spark_entry__ as entry


def test_every_question_of_a_text_counts(spark, tmp_path):
    text = "问：供应商准入有哪些条件？\n答：见办法。\n问：合同归档的流程是什么？\n答：见制度。"
    spark.createDataFrame([(1, text), (2, "没有问题"), (3, None), (4, "问：印章管理办法是什么？")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["question_keywords"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.question_no) for r in got) == [(1, 1), (1, 2), (4, 1)]
    assert "合同归档" in next(r.keywords for r in got if r.question_no == 2)
