import pytest
from pyspark.sql import functions as F

from clausewise.functions import text as X
from clausewise.operators import merge, retrieval, sections
from clausewise.plans import pipelines, search
from clausewise.sources import sinks

CHUNK = "id bigint, document_id bigint, chunk_no int, section_no string, section_title string, subsection_no string, subsection_title string, content string, page_no int"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_expressions(spark):
    assert one(spark, "《办法》第3条，甲; 第五条", X.reference_tokens) == ["《办法》第3条", "第五条"]
    d = spark.createDataFrame([("第 三条", "第三条 准入"), ("第三条", "第三条"), ("第三条甲", "第三条"), (None, "准入"), ("3", None)], "n string, t string")
    assert [r.x.title for r in d.select(X.section_label(F.col("n"), F.col("t")).alias("x")).collect()][1:] == ["", "", "准入", ""]
    pages = spark.createDataFrame([(3, None, None), (0, "kb://d?page=7", None), (None, None, "见第 12 页"), (None, "x", "y")], "p int, u string, t string")
    assert [r.x for r in pages.select(X.page_of(F.col("p"), F.col("u"), F.col("t")).alias("x")).collect()] == [3, 7, 12, None]
    assert [one(spark, x, X.first_digits) for x in ("第007条", "000", "无", None)] == ["7", "0", "", ""]
    assert one(spark, " A b　C", X.name_form) == "abc"
    assert spark.sql("select array('1', 'x', null, '3') v").select(X.int_list(F.col("v")).alias("r")).first()["r"] == [1, 3]
    assert one(spark, "供应商", lambda c: X.relevance_weight(c, ["供应商", "付款"])) == 0.8 and one(spark, "", lambda c: X.relevance_weight(c, [])) == 0.8
    assert one(spark, " 问 ", lambda c: X.query_text(c, F.array(F.lit("问"), F.lit(None), F.lit("供应商")))) == "问 供应商"


@pytest.mark.parametrize("stretch", [4096, 2])
def test_counts_in_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(sections, "STRETCH", stretch)
    d = spark.createDataFrame([(g, i, i % 3 == 0) for g in (1, 2) for i in range(11)], "g int, n int, f boolean")
    got = {(r.g, r.n): r.part for r in sections.counted(d, "g", "n", part=F.col("f")).collect()}
    assert got == {(g, i): i // 3 + 1 for g in (1, 2) for i in range(11)}


def test_page_chunks(spark):
    lines = [("供应商管理办法", 1), ("前言", 1), ("第一章 总则", 1), ("第一条 【目的】为规范采购", 1), ("供应商管理办法", 2), ("行为，制定本办法。", 2), ("第二条", 2), ("另行规定。", 3), ("第二章　附则", 3), ("第三条 自发布起施行。", 3)]
    d = spark.createDataFrame([(1, "供应商管理办法", p, i, x) for i, (x, p) in enumerate(lines)] + [(2, "无", 1, 0, "只有正文"), (3, "无", 1, 0, "  ")], "d bigint, title string, page_no int, line_no int, line string")
    got = [(r.d, r.chunk_no, r.section_no, r.section_title, r.subsection_no, r.content, r.page_no, r.confidence) for r in sections.page_chunks(d, "d").orderBy("d", "chunk_no").collect()]
    assert got == [
        (1, 1, "1", "第一章 总则", "1", "为规范采购 行为，制定本办法。", 1, 0.88),
        (1, 2, "1", "第一章 总则", "2", "另行规定。", 3, 0.88),
        (1, 3, "2", "第二章 附则", "3", "自发布起施行。", 3, 0.92),
        (2, 1, "1", "第一章", None, "只有正文", 1, 0.84),
    ]
    assert sections.page_chunks(d.limit(0), "d").count() == 0


def test_merges(spark):
    old = spark.createDataFrame([(1, 10, "A"), (2, None, "B"), (3, 10, "C")], "id bigint, s bigint, c string")
    new = spark.createDataFrame([(10, "X"), (11, "B"), (12, "D"), (None, None)], "s bigint, c string")
    assert {(r.s, r.old_number) for r in merge.matched(new, old, ["s"], ["c"]).collect()} == {(10, 1), (11, 2), (12, None), (None, None)}
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 1), ("b", 5)], "g string, i int")
    got = {(r.g, r.i): r.no for r in merge.numbered_in_groups(rows, spark.createDataFrame([("a", 7)], "g string, no bigint"), "g", "no", "i").collect()}
    assert got == {**{("a", i): 8 + i for i in range(50)}, (None, 1): 1, ("b", 5): 1}
    clause = "id bigint, document_id bigint, clause_no string, clause_text string, content_hash string"
    was = spark.createDataFrame([(1, 1, "一", "甲", "h1"), (2, 1, "二", "乙", "h2"), (3, 1, "三", "丙", "h3")], clause)
    comes = spark.createDataFrame([(8, 1, "一", "甲", "h1"), (9, 1, "二", "新", "h9"), (10, 2, "一", "丁", "h4"), (11, 2, "一", "戊", "h5")], clause)
    assert {(r.id, r.clause_text, r.action) for r in pipelines.merged_clauses(comes, was).collect()} == {(1, "甲", "keep"), (2, "新", "update"), (3, "丙", "absent"), (10, "丁", "insert")}
    # a second run changes nothing
    after = pipelines.merged_clauses(comes, was).drop("action")
    again = pipelines.merged_clauses(comes, after)
    assert again.count() == after.count() and {r.action for r in again.collect()} == {"keep", "absent"}


def test_incremental_index(spark):
    rows = spark.createDataFrame([(1, True, [1.0]), (2, False, [2.0]), (3, None, [3.0])], "id bigint, is_indexed boolean, vector array<double>")
    index = spark.createDataFrame([(1, 5, [1.0])], "id bigint, place bigint, vector array<double>")
    flagged, grown = pipelines.indexed(rows, index)
    assert {(r.id, r.place) for r in grown.collect()} == {(1, 5), (2, 6), (3, 7)} and flagged.where("is_indexed").count() == 3
    assert pipelines.indexed(flagged, grown)[1].count() == 3


def test_backfill(spark):
    rows = [(1, 1, 1, None, None, None, "第一条", "甲", 1), (2, 1, 2, None, None, None, None, "（一）乙", 1), (3, 1, 26, None, None, None, None, "（二）丙", 1), (4, 1, 25, "2", None, "3", None, "（三）", 1)]
    c = spark.createDataFrame(rows, CHUNK)
    found = sections.backfilled_parents(c, F.col("subsection_title").isNotNull(), F.col("content").startswith("（"), F.col("subsection_title"))
    assert [(r.id, r.parent) for r in found.collect()] == [(2, "第一条")]
    assert {(r.id, r.parent_section) for r in sections.with_parents_filled(c, found).collect()} == {(1, ""), (2, "第一条"), (3, ""), (4, "2")}


def chunks(spark):
    docs = spark.createDataFrame([(1, "采购管理办法", "办法", "有效"), (2, "劳动用工办法", None, None), (3, "作废采购办法", None, "失效")], "id bigint, title string, doc_type string, status string")
    rows = [(1, 1, 1, "1", "第一章 总则", None, None, ".", 1), (2, 1, 2, "1", "第一章 总则", "1", "第一条", "经理层负责组织采购工作并报董事会。", 1), (3, 1, 3, "1", "第一章 总则", "2", "第二条", "审计部门监督采购，配合经理层。", 1), (4, 2, 1, "1", "招聘", "1", "第一条", "招聘应当公开进行。", 1), (5, 3, 1, "1", "采购", "1", "第一条", "采购采购采购采购采购采购。", 1)]
    return docs, spark.createDataFrame(rows, CHUNK).withColumn("created_at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))


def test_keyword_stage(spark):
    docs, c = chunks(spark)
    terms = spark.createDataFrame([(1, "采购"), (1, "审计部门"), (2, "无此词"), (1, "采购")], "query_id bigint, term string")
    got = [(r.query_id, r.id, r.score) for r in retrieval.keyword_hits(terms, docs, c, 2).orderBy("rank").collect()]
    assert got == [(1, 3, 40), (1, 2, 26)]
    q = spark.createDataFrame([(7, "招聘公开", ["招聘"])], "query_id bigint, question string, keywords array<string>")
    # no vector is near, so the words decide
    index = c.select("id", F.array(*[F.lit(0.0)] * 256).alias("vector"))
    assert [(r.query_id, r.id, r.stage) for r in search.search(q, docs, c, index).collect()] == [(7, 4, "keyword")]


def test_roles(spark):
    assert one(spark, "经理层和业务及职能部门的职责", search.role_anchors) == ["经理层和业务及职能部门"]
    assert one(spark, "党委、董事会如何分工", search.role_anchors) == ["董事会", "党委"]
    assert one(spark, None, search.role_anchors) == []
    d = spark.createDataFrame([("经理层负责采购", 0.45 + 0.55 + 0.35), ("配合经理层工作", 0.45 - 0.55 + 0.35), ("审计部门负责", -0.50 - 0.45), ("其他", -0.50), ("", 0.0)], "t string, r double")
    got = d.select("r", search.role_score(F.col("t"), F.array(F.lit("经理层")), F.lit(True)).alias("s")).collect()
    assert all(abs(x.s - x.r) < 1e-9 for x in got)


def test_stored_index(spark, tmp_path):
    docs, c = chunks(spark)
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [[1.0, float(len(t or ""))] for t in texts]

    path = str(tmp_path / "index")
    first = search.stored_index(spark, c, docs, path, "1", model)
    assert {r.id for r in first.collect()} == {1, 2, 3, 4, 5}
    made = calls.value
    assert search.stored_index(spark, c, docs, path, "1", model).count() == 5 and calls.value == made
    assert search.stored_index(spark, c.where("id < 5"), docs, path, "1", model).count() == 4
    assert search.stored_index(spark, c.where("id < 5"), docs, path, "2", model).count() == 4 and calls.value > made


def test_tables_that_change(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.createDataFrame([(1, "x")], "id int, a string").write.parquet(at)
    spark.createDataFrame([(2, 5)], "id int, b int").write.mode("append").parquet(at)
    assert sorted(tuple(r) for r in sinks.evolved(spark, at, ("a",)).select("id", "b").fillna(0).collect()) == [(1, 0), (2, 5)]
    assert not sinks.truncate_table(spark, "t", "u")
