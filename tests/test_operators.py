import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.operators import merge, retrieval, sections, vectors
from clausewise.operators.components import connected
from clausewise.operators.skew import in_several
from clausewise.operators.vectors import vector_top

CHUNK = "id bigint, document_id bigint, chunk_no int, section_no string, section_title string, subsection_no string, subsection_title string, content string, page_no int"


def chunk(i, no, section, content, title=None, doc=1, sub=None):
    return (i, doc, no, section, title, sub, None, content, None)


def test_packed_paragraphs(spark):
    sizes = [500, 600, 300, 1200]
    d = spark.createDataFrame([(1, "\n\n".join("甲" * n for n in sizes)), (2, None), (3, ""), (4, "短")], "id bigint, t string")
    got = [(r.id, r.seq, len(r.clause_text)) for r in sections.packed_paragraphs(d, "id", "t").orderBy("id", "seq").collect()]
    assert got == [(1, 1, 1102), (1, 2, 300), (1, 3, 1200), (4, 1, 1)]


def test_packed_paragraphs_against_loop(spark):
    rng = np.random.default_rng(1)
    texts = [["".join("乙" for _ in range(n)) for n in rng.integers(1, 900, size=k)] for k in rng.integers(1, 12, size=30)]
    d = spark.createDataFrame([(i, "\n\n".join(p)) for i, p in enumerate(texts)], "id bigint, t string")
    got = {}
    for r in sections.packed_paragraphs(d, "id", "t").orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append(r.clause_text)
    for i, parts in enumerate(texts):
        parts = [p for p in parts if len(p) >= 20] or ["\n\n".join(parts)]
        packs, cur = [], []
        for p in parts:
            if cur and sum(map(len, cur)) + len(p) > 1200:
                packs.append("\n\n".join(cur))
                cur = []
            cur.append(p)
        assert got[i] == [*packs, "\n\n".join(cur)]


def test_articles(spark):
    text = "前言\n第一条 总则：\n本办法适用于公司各部门的全部采购活动。\n第二条\n各部门应当按期归档验收记录与会议纪要文件。\n第三条 短"
    got = sections.articles(spark.createDataFrame([(1, text), (2, None), (3, "无条文")], "id bigint, t string"), "id", "t").orderBy("seq").collect()
    assert [(r.clause_no, r.clause_title) for r in got] == [("第一条", "总则"), ("第二条", "第二条")]


def test_nearest_before_tolerance(spark):
    rows = [(1, 1, 1, "A"), (2, 1, 121, None), (3, 1, 122, None), (4, 2, 1, None)]
    d = spark.createDataFrame(rows, "id bigint, g int, n int, s string")
    got = {r.id: r.nearest for r in sections.nearest_before(d, "g", "n", F.col("s").isNotNull(), F.col("s"), 120).collect()}
    assert got[2] == "A" and (got[3] or "") == "" and (got[4] or "") == "" and (got[1] or "") == ""


def test_merged_wraps(spark):
    rows = [chunk(1, 1, "第一条", "合规管理部门应当"), chunk(2, 2, "第一条.p1", "牵头 开展审查。"), chunk(3, 3, "第二条", "完整的一句话。"), chunk(4, 4, "3", "很长" * 20 + "。"), chunk(5, 5, "3.p1", "续")]
    got = [(r.id, r.chunk_no, r.content) for r in sections.merged_wraps(spark.createDataFrame(rows, CHUNK)).orderBy("chunk_no").collect()]
    assert got[:2] == [(1, 1, "合规管理部门应当牵头 开展审查。"), (3, 2, "完整的一句话。")]
    assert [x[0] for x in got] == [1, 3, 4, 5]


def test_effective_contents(spark):
    rows = [
        chunk(1, 1, "第一条", "经理层履行下列职责：", sub=None),
        chunk(2, 2, "（一）", "拟订制度；"),
        chunk(3, 3, "（一）.p1", "并组织实施。"),
        chunk(4, 4, "（二）", "拟订制度；"),
        chunk(5, 5, "（三）", "监督检查。"),
        chunk(6, 6, "第二条", "与此无关。"),
        chunk(7, 7, "2", ".", title="第二章"),
        chunk(8, 8, "2", "子条款一。", sub="5"),
    ]
    got = {r.id: r.effective for r in sections.effective_contents(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got[1] == "经理层履行下列职责： 拟订制度； 并组织实施。 监督检查。"
    assert got[7] == "子条款一。"
    assert 6 not in got


def test_chunks_of_lines(spark):
    lines = ["前言", "第一章 总则", "第一条 甲", "乙", "第二条", "第二章 附则", "第三条 丙"]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "无结构"), (2, 1, "正文")], "id bigint, line_no int, line string")
    got = [(r.id, r.chunk_no, r.section_no, r.subsection_no, r.content) for r in sections.chunks_of_lines(d, "id").orderBy("id", "chunk_no").collect()]
    assert got == [(1, 1, "1", "1", "甲\n乙"), (1, 2, "2", "3", "丙"), (2, 1, "1", None, "无结构\n正文")]


def test_clear_winner(spark):
    d = spark.createDataFrame([(1, 10, 25), (1, 11, 23), (2, 10, 25), (2, 11, 22), (3, 10, 5)], "k int, i int, s int")
    assert {(r.k, r.i) for r in retrieval.clear_winner(d, "k", "i", "s", 2).collect()} == {(2, 10), (3, 10)}


@pytest.mark.parametrize("shard,block", [(100_000, 20_000), (1, 20_000), (2, 1)])
def test_containing(spark, monkeypatch, shard, block):
    monkeypatch.setattr(retrieval, "SHARD_TERMS", shard)
    monkeypatch.setattr(retrieval, "BLOCK_TEXTS", block)
    texts = spark.createDataFrame([(1, "采购合同"), (2, ""), (3, None), (4, "合同合同")], "id int, t string")
    terms = spark.createDataFrame([("合同",), ("采购合同",), ("",), (None,), ("无",)], "w string")
    got = sorted((r.id, r.w) for r in retrieval.containing(texts, "t", terms, "w").collect())
    assert got == [(1, "合同"), (1, "采购合同"), (4, "合同")]


@pytest.mark.parametrize("block", [2048, 4])
def test_vector_top_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    m[7] = m[9]
    m[11] = 0
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "id bigint, vector array<double>")
    got = {}
    for r in vector_top(d, d.where("id < 5"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = m / np.where(n > 0, n, 1)
    for q in range(5):
        s = np.round(u @ u[q], 12)
        best = sorted((i for i in range(60) if i != q), key=lambda i: (-s[i], i))[:4]
        assert got[q] == best


@pytest.mark.parametrize("held", [65_536, 1])
def test_vector_top_makes_the_base_once_and_ties_by_id(spark, monkeypatch, held):
    monkeypatch.setattr(vectors, "HELD", held)
    rng = np.random.default_rng(5)
    m = rng.integers(-3, 4, size=60).astype(float)
    rows = [(i, rng.permutation(m).tolist()) for i in range(40)]
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    base = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(3).mapInArrow(count, "id bigint, vector array<double>")
    asked = spark.createDataFrame([(-i, [float(i)] * 60) for i in (1, 2, 3)], "id bigint, vector array<double>").repartition(3, "id")
    passes = 1 if held > 3 else sum(n > 0 for n in asked.rdd.glom().map(len).collect())
    got = sorted(tuple(r) for r in vector_top(base, asked, 7).select("query_id", "rank", "id").collect())
    # every order of the same numbers is equally near to a vector of ones
    assert got == [(q, n + 1, n) for q in (-3, -2, -1) for n in range(7)]
    assert made.value == 40 * passes


def test_merge(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("c", None, "z")], "k string, v string, d string")
    new = spark.createDataFrame([("a", "1", ""), ("b", "3", "n"), ("d", "4", "m"), ("c", None, None)], "k string, v string, d string")
    acts = {r.k: r.action for r in merge.merge_actions(new, old, ["k"], "v").collect()}
    assert acts == {"a": "keep", "b": "update", "c": "keep", "d": "insert"}
    got = {r.k: (r.v, r.d) for r in merge.merged(new, old, ["k"], ("d",)).collect()}
    assert got == {"a": ("1", "x"), "b": ("3", "n"), "c": (None, "z"), "d": ("4", "m")}
    assert merge.only_new(new, old, ["k"], "v").count() == 1
    timed = [x.withColumn("at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))) for x in (new, old)]
    late = {r.k: r.at.year > 2024 for r in merge.merged(*timed, ["k"], ("d",), "at").collect()}
    assert late == {"a": False, "b": True, "c": False, "d": True}


def test_numbered_after(spark):
    rows = spark.range(100).select(F.col("id").alias("x"))
    got = sorted(r.no for r in merge.numbered_after(rows, spark.createDataFrame([(7,)], "no bigint"), "no", ["x"]).collect())
    assert got == list(range(8, 108))


def test_connected_against_union_find(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, size=(45, 2))] + [(i, i + 1) for i in range(100, 140)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r["class"] for r in connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in nodes}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("total", [10, 10_000])
def test_in_several_with_a_hot_key(spark, total):
    rows = [(1, d) for d in range(50)] + [(2, 1), (2, 1), (3, 1), (3, 2), (None, 1), (None, 2)]
    d = spark.createDataFrame(rows, "k bigint, o bigint")
    got = sorted((r.k, r.o) for r in in_several(d, "k", "o", total).collect())
    assert got == sorted([(1, x) for x in range(50)] + [(3, 1), (3, 2)])
