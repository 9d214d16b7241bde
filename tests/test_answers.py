import pytest
from pyspark.sql import functions as F

from clausewise.functions import questions as Q
from clausewise.plans import answers


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,bare", [("请问请帮我讲解公司注销流程", "公司注销流程"), ("请", "请"), ("讲解", "讲解"), ("采购", "采购")])
def test_without_requests(spark, text, bare):
    assert one(spark, text, Q.without_requests) == bare


@pytest.mark.parametrize("text,bare", [("公司注销都包括哪些步骤", "公司注销"), ("合规原则是什么", "合规原则"), ("采购的流程有哪些", "采购的流程"), ("采购", "采购")])
def test_without_tail(spark, text, bare):
    assert one(spark, text, Q.without_tail) == bare


def test_keywords(spark):
    got = one(spark, "请问公司注销工作以及清税证明有哪些？", Q.keywords)
    assert "公司注销工作" in got and "清税证明" in got and len(got) <= 8 and "流程" not in got
    assert one(spark, "", Q.keywords) == [Q.DEFAULT] and one(spark, None, Q.keywords) == [Q.DEFAULT]


def test_lists(spark):
    assert one(spark, "1. 提交申请； 2. 审核。 3. 提交申请；", Q.numbered_items) == ["提交申请", "审核"]
    assert one(spark, "1. 只有一项", Q.numbered_items) == []
    assert one(spark, "（一）甲方付款；（二）乙方交货；甲方付款", Q.list_parts) == ["甲方付款", "乙方交货"]
    assert one(spark, "没有列表。", Q.list_parts) == [] and one(spark, None, Q.list_parts) == []
    assert one(spark, "甲？乙？", Q.is_multiple) and not one(spark, "甲？", Q.is_multiple)


def test_distinct_hits(spark):
    rows = [(1, 1, 10, 7, "2", "供应商应当提交资信证明。"), (1, 2, 11, 7, "2.1", "另一段文字"), (1, 3, 12, 7, "3", "供应商应当提交资信证明"), (1, 4, 13, 8, "3", "供应商应当提交资信证明"), (1, 5, 14, 7, "5", None), (2, 1, 15, 7, None, "x")]
    d = spark.createDataFrame(rows, "query_id bigint, rank int, id bigint, document_id bigint, clause_no string, text string")
    got = [(r.query_id, r.rank, r.id) for r in answers.distinct_hits(d).orderBy("query_id", "rank").collect()]
    # 11 is a deeper clause than its parent 10 and takes its place; 12 says then what none of its document says
    assert got == [(1, 1, 11), (1, 2, 12), (1, 3, 13), (1, 4, 14), (2, 1, 15)]
    assert answers.distinct_hits(d.limit(0)).count() == 0


def test_answers(spark):
    docs = spark.createDataFrame([(7, "采购办法")], "id bigint, title string")
    chunks = spark.createDataFrame([(10, 7, 1, "1", "第一章 总则", "2", "第二条", "供应商应当\n提交资信证明。", 3)], "id bigint, document_id bigint, chunk_no int, section_no string, section_title string, subsection_no string, subsection_title string, content string, page_no int")
    hits = spark.createDataFrame([(1, 10, 1)], "query_id bigint, id bigint, rank int")
    ctx = answers.context_items(hits, chunks, docs)
    assert ctx.first()["label"] == "采购办法，第一章 总则，第二条，第3页"
    used = spark.createDataFrame([(1, [9, 1])], "query_id bigint, ids array<int>")
    assert [r.ctx_id for r in answers.citations(ctx, used).collect()] == [1]
    asked = spark.createDataFrame([(1, "交什么"), (2, "别的")], "query_id bigint, question string")
    got = {r.query_id: r.markdown for r in answers.answers(asked, ctx).collect()}
    assert got[1] == "# 交什么\n\n1. 供应商应当 提交资信证明。\n\n## 依据\n- [采购办法，第一章 总则，第二条，第3页](kb://document/7/chunk/10?page=3)"
    assert got[2] == "# 别的\n\n未检索到依据"
