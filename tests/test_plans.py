from pyspark.sql import functions as F

from clausewise.functions import text as X
from clausewise.plans import pipelines, search

CHUNK = "id bigint, document_id bigint, chunk_no int, section_no string, section_title string, subsection_no string, subsection_title string, content string, page_no int"


def tables(spark):
    docs = spark.createDataFrame([(1, "澜梧控股采购管理办法", "办法", "有效"), (2, "蘅水集团劳动用工办法", None, None), (3, "作废办法", None, "失效")], "id bigint, title string, doc_type string, status string")
    rows = [
        (1, 1, 1, "1", "第一章 总则", None, None, ".", 1),
        (2, 1, 2, "1", "第一章 总则", "1", "第一条", "为规范采购行为，制定本办法。", 1),
        (3, 1, 3, "1", "第一章 总则", "2", "第二条", "采购部门负责组织采购。", 1),
        (4, 1, 4, "2", "第二章 供应商准入", "3", "第三条", "供应商应当提交资信证明。", 2),
        (5, 2, 1, "1", "第一章 招聘", "1", "第一条", "招聘应当公开。", 1),
    ]
    return docs, spark.createDataFrame(rows, CHUNK)


def test_search(spark):
    docs, chunks = tables(spark)
    index = search.index_vectors(chunks, docs)
    q = spark.createDataFrame([(1, "澜梧控股采购管理办法第一章有哪些内容"), (2, "供应商应当提交什么资信证明"), (3, " "), (4, "第三条怎么规定供应商")], "query_id bigint, question string")
    got = {}
    for r in search.search(q, docs, chunks, index, top_k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.stage))
    assert got[1] == [(2, "chapter-full"), (3, "chapter-full")]
    assert got[2][0][0] == 4 and got[4][0][0] == 4 and 3 not in got
    assert search.search(q.limit(0), docs, chunks, index).count() == 0


def test_references_spelled_once_or_in_each_row(spark, monkeypatch):
    docs, chunks = tables(spark)
    index = search.index_vectors(chunks, docs)
    q = spark.createDataFrame([(1, "第三条怎么规定供应商"), (2, "采购部门第 2 条")], "query_id bigint, question string")
    found = lambda: sorted(tuple(r) for r in search.search(q, docs, chunks, index).collect())
    once = found()
    monkeypatch.setattr(search, "REFS", 0)
    assert once and found() == once


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_expressions(spark):
    assert {"第三条", "第3条", "3"} <= set(one(spark, "第三条", search.ref_variants)) and {"第三条", "第3条"} <= set(one(spark, "第 3 条.p1", search.ref_variants))
    assert one(spark, None, search.ref_variants) == []
    assert one(spark, "什么 供应商准入 第三条", search.query_terms)[1:] == ["供应商准入", "第三条"]
    assert one(spark, "采购办法第二章讲讲", search.asks_overview) and not one(spark, "第二条有哪些内容", search.asks_overview) and not one(spark, "采购流程", search.asks_overview)
    d = spark.createDataFrame([("采购部门负责组织采购", 1.0), ("协助采购部门", -0.10), ("其他", -0.5)], "t string, r double")
    assert [abs(r.s - r.r) < 1e-9 for r in d.select("r", search.role_score(F.col("t"), F.array(F.lit("采购部门")), F.lit(True)).alias("s")).collect()] == [True] * 3


def test_pipelines(spark):
    text = "第一条 为规范采购行为，依据有关规定制定本办法，请遵照执行。\n第二条 采购部门负责组织采购并按期归档全部文件资料。"
    docs = spark.createDataFrame([("f/a.txt", "甲", text), ("f/b.txt", "乙案例", text), ("f/c.txt", "丙", "短"), ("f/讲话.txt", "丁", "领导讲话" * 20)], "path string, title string, content string")
    new, counts = pipelines.source_rows(docs, spark.createDataFrame([], "content_hash string"))
    assert sorted((r.title, r.category) for r in new.collect()) == [("丁", "speech"), ("甲", "policy")] and counts.first()["noise"] == 1
    sources = new.orderBy("title").withColumn("id", F.monotonically_increasing_id())
    c = pipelines.clauses(spark.createDataFrame([(1, text), (2, "领导讲话" * 20)], "id bigint, content_text string"))
    assert sorted((r.id, r.clause_no) for r in c.collect()) == [(1, "第一条"), (1, "第二条"), (2, "AUTO-001")] and sources.count() == 2
    changed = c.withColumn("content_hash", F.when(F.col("clause_no") == "第二条", "x").otherwise(F.col("content_hash")))
    acts = {(r.id, r.clause_no): r.action for r in pipelines.clause_actions(changed, c.where("id = 1")).collect()}
    assert acts == {(1, "第一条"): "keep", (1, "第二条"): "update", (2, "AUTO-001"): "insert"}


def test_freshness_and_checks(spark):
    docs, chunks = tables(spark)
    timed = chunks.withColumn("created_at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    stored = pipelines.fingerprint(timed)
    assert pipelines.is_fresh(timed, stored) and not pipelines.is_fresh(timed.where("id > 1"), stored)
    assert {r.name: r.failures for r in pipelines.checks(docs, chunks).collect()} == {"chunk without document": 0, "repeated chunk number": 0, "repeated chunk id": 0, "document without chunks": 1}
    assert one(spark, "a_b", X.markdown_escaped) == "a\\_b"
