"""Answering many questions at once: whole chapters, nearest vectors, keywords, and their reranking.

Questions are a table (query_id, question); every step is a join or window keyed by the question.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.functions import text as X
from clausewise.operators import retrieval, sections
from clausewise.operators.durable import durable
from clausewise.operators.vectors import vector_top
from clausewise.plans import pipelines
from clausewise.plans.providers import embedded
from clausewise.sources.sinks import exists

TOP_K, EXPAND, MIN_SCORE, LEXICAL_WEIGHT, KEYWORD_N = 14, 5, 0.13, 0.35, 12
#: Different section references that are sent to every task with their spellings; with more, each row spells out its own.
REFS = 50_000
#: Words of questions for duties or principles (fixed values).
DUTY_TERMS = ("职责", "履行", "负责", "主要负责", "主要履行", "原则", "遵循")
#: Roles, and the endings of what may be one (fixed values).
ROLE_TERMS = ("经理层", "董事会", "党委", "党组", "业务及职能部门", "合规管理部门", "主要负责人", "首席合规官", "合规管理委员会", "纪检监察机构", "审计部门", "巡察部门", "监督追责部门")
ROLE_ENDINGS = ("层", "会", "部门", "机构", "委员会", "负责人", "官")
#: Words that say nothing in a question (fixed values).
STOP_TERMS = ("什么", "呢", "吗", "啊", "呀", "怎么", "如何", "主要", "工作", "事项", "要求", "处理", "处置", "应对")
#: Words that ask for a chapter as a whole, and such that ask for something in it (fixed values).
OVERVIEW = ("总则", "都有什么", "有哪些", "主要内容", "内容", "概述", "介绍", "讲解", "讲讲", "说明", "体系", "章节")
NOT_OVERVIEW = ("流程", "步骤", "材料", "审批", "报批", "提交", "办理", "时限")
#: Words for duties, and for helping with another's (fixed values).
DUTIES, HELPS = ("负责", "履行", "主要履行", "主要职责", "职责", "原则", "遵循", "承担"), ("协助", "配合", "指导", "支持", "服务")


def query_terms(question: Column, keywords: Column | None = None) -> Column:
    """Up to 40 different terms of a question and its first 16 keywords in comparison form: themselves, their tokens and section references."""
    seeds = F.array(question) if keywords is None else F.concat(F.array(question), F.slice(F.coalesce(keywords, F.array().cast("array<string>")), 1, 16))
    raw = F.flatten(F.transform(seeds, lambda x: F.concat(F.array(x), X.tokens(x), X.section_refs(x))))
    terms = F.array_distinct(F.transform(raw, X.comparison_form))
    return F.slice(F.filter(terms, lambda t: (F.char_length(t) >= 2) & ~t.isin(*STOP_TERMS)), 1, 40)


def asks_duty(asked: Column) -> Column:
    """Whether a question in comparison form asks for duties or principles."""
    return asked.rlike("|".join(DUTY_TERMS))


def role_anchors(question: Column, keywords: Column | None = None) -> Column:
    """Up to 8 roles that a question and its first 8 keywords name, the longest first, without those inside longer ones."""
    seeds = F.array(F.coalesce(question, F.lit(""))) if keywords is None else F.concat(F.array(F.coalesce(question, F.lit(""))), F.slice(F.coalesce(keywords, F.array().cast("array<string>")), 1, 8))
    pattern = F.lit(f"[\\u4e00-\\u9fff]{{2,12}}(?:{'|'.join(ROLE_ENDINGS)})")
    named = lambda x: F.concat(F.filter(F.array(*[F.lit(r) for r in ROLE_TERMS]), lambda r: x.contains(r)), F.regexp_extract_all(x, pattern, F.lit(0)))
    found = F.filter(F.array_distinct(F.transform(F.flatten(F.transform(seeds, named)), X.comparison_form)), lambda t: F.char_length(t) >= 2)
    longest = F.array_sort(found, lambda a, b: F.when(F.char_length(a) > F.char_length(b), -1).when(F.char_length(a) < F.char_length(b), 1).otherwise(0))
    kept = F.aggregate(longest, F.array().cast("array<string>"), lambda s, t: F.when(F.exists(s, lambda x: x.contains(t)), s).otherwise(F.concat(s, F.array(t))))
    return F.slice(kept, 1, 8)


def ref_variants(ref: Column) -> Column:
    """A section reference in its spellings: as it is, without a suffix, with the number as digits, in Chinese, and alone."""
    r = F.regexp_replace(F.coalesce(ref, F.lit("")), "(?U)\\s+", "")
    bare = F.regexp_replace(r, "(?:\\.[psh]|~).*$", "")
    number = X.numeral_value(F.regexp_extract(bare, f"^第?([{X.NUMERAL}]+)", 1))
    kind = F.regexp_extract(bare, "([章节条款目])$", 1)
    written = lambda n: F.when(number > 0, F.concat(F.lit("第"), n, kind))
    alone = F.when(bare.rlike(f"^[{X.NUMERAL}]+$") & (number > 0), number.cast("string"))
    found = F.array(r, bare, F.when(kind != "", written(number.cast("string"))), F.when(kind != "", written(X.numeral_text(number))), alone, F.when(kind != "", number.cast("string")))
    return F.array_distinct(F.filter(found, lambda v: v.isNotNull() & (v != "")))


def spelled(rows: DataFrame, chunks: DataFrame, names: list[str]) -> DataFrame:
    """`rows` with the references in the columns `names`, all of which are in `chunks`, replaced by their spellings: different ones are few, so each is spelled out once."""
    refs = durable(chunks.select(F.explode(F.array(*names)).alias("_ref")).distinct().select("_ref", ref_variants(F.col("_ref")).alias("_spelled")))
    if refs.count() > REFS:
        return rows.withColumns({n: ref_variants(F.col(n)) for n in names})
    for n in names:
        one = refs.select(F.col("_ref").alias(n), F.col("_spelled").alias(f"_{n}"))
        rows = rows.join(F.broadcast(one), n).drop(n).withColumnRenamed(f"_{n}", n)
    return rows


def asks_overview(question: Column) -> Column:
    """Whether a question wants a chapter as a whole."""
    q = X.collapsed(question)
    has = lambda words: q.rlike("|".join(words))
    return ~q.rlike(f"第\\s*[{X.NUMERAL}]+\\s*条") & (q.rlike(f"第\\s*[{X.NUMERAL}]+\\s*章") | (has(OVERVIEW) & has(("章", "总则", "体系")) & ~has(NOT_OVERVIEW) & (F.char_length(q) <= 48)))


def chapter_full(questions: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id, score, stage) of all chunks with content of the section that an overview question names, in its document.

    A document is named by an alias, a section by its number or title; both must win clearly, else the question has no rows.
    """
    asked = questions.where(asks_overview(F.col("question"))).select("query_id", X.comparison_form(F.col("question")).alias("asked"), "question")
    aliases = retrieval.active_documents(documents).select(F.col("id").alias("document_id"), F.explode(X.title_aliases(F.col("title"))).alias("alias"))
    named = retrieval.containing(asked, "asked", aliases, "alias").groupBy("query_id", "document_id").agg(F.max(20 + F.char_length("alias")).alias("score"))
    target = retrieval.clear_winner(named, "query_id", "document_id", "score", 2).select("query_id", "document_id")
    heads = chunks.where(F.col("section_no").rlike("^[0-9]+$")).groupBy("document_id", "section_no").agg(F.min_by("section_title", F.struct("chunk_no", "id")).alias("title"))
    body = X.comparison_form(F.regexp_replace(X.collapsed(F.col("title")), f"^第\\s*[{X.NUMERAL}]+\\s*章\\s*", ""))
    wanted = X.numeral_value(F.regexp_extract("question", f"第\\s*([{X.NUMERAL}]+)\\s*章", 1))
    met = target.join(asked, "query_id").join(heads, "document_id").withColumn("body", body)
    score = F.when(wanted == F.col("section_no").cast("bigint"), 1000).when((F.col("body") != "") & F.col("asked").contains(F.col("body")), 30 + F.least(F.char_length("body"), F.lit(12))).otherwise(0)
    scored = met.withColumn("score", score).where("score > 0").withColumn("section", F.col("section_no").cast("bigint"))
    won = retrieval.clear_winner(scored, "query_id", "section", "score", 1).join(target, "query_id")
    rows = chunks.where(~X.is_empty_body(F.col("content"))).join(won.select("query_id", "document_id", F.col("section").cast("string").alias("section_no")), ["document_id", "section_no"])
    return rows.select("query_id", "id", F.lit(1.0).alias("score"), F.lit("chapter-full").alias("stage"))


def index_vectors(chunks: DataFrame, documents: DataFrame, call: Callable | None = None) -> DataFrame:
    """(id, vector) of the chunks that say something, themselves or by what stands below them, embedded with their headings behind their document's title."""
    titled = documents.select(F.col("id").alias("document_id"), "title")
    parts = [F.coalesce(F.col(x), F.lit("")) for x in ("title", "section_no", "section_title", "subsection_no", "subsection_title", "content")]
    told = chunks.join(sections.effective_contents(chunks), "id", "left").withColumn("content", F.coalesce("effective", "content"))
    texts = told.where(~X.is_empty_body(F.col("content"))).join(titled, "document_id").select("id", F.concat_ws(" ", *parts).alias("text")).where(F.char_length("text") >= 2)
    return embedded(texts, "text", call).select("id", "vector")


def _keywords(questions: DataFrame) -> Column:
    """The questions' keywords, an array, if they have such a column."""
    return F.col("keywords") if "keywords" in questions.columns else F.array().cast("array<string>")


def nearest(questions: DataFrame, index: DataFrame, k: int, call: Callable | None = None) -> DataFrame:
    """(query_id, id, score, stage) of the k nearest chunks of each question above the least score."""
    text = X.query_text(F.col("question"), _keywords(questions))
    asked = durable(embedded(questions.select((-F.col("query_id") - 1).alias("id"), text.alias("text")), "text", call).select("id", "vector"))
    return vector_top(index, asked, k, MIN_SCORE).select((-F.col("query_id") - 1).alias("query_id"), "id", "score", F.lit("vector").alias("stage"))


def with_parents(hits: DataFrame, chunks: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The hits and, for each, the first chunk of the section above it if it is no hit itself, at nine tenths of the score or the least; up to twice `top_k` a question."""
    c = chunks.select("id", "document_id", X.parent_section(F.col("section_no"), F.col("subsection_no")).alias("parent"))
    need = hits.join(c, "id").where("parent <> ''").groupBy("query_id", "document_id", "parent").agg(F.max("score").alias("score"))
    first = chunks.where(F.col("section_no").isNotNull() & ~X.is_empty_body(F.col("content"))).groupBy("document_id", F.col("section_no").alias("parent")).agg(F.min_by("id", F.struct("chunk_no", "id")).alias("id"))
    extra = need.join(first, ["document_id", "parent"]).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    more = extra.groupBy("query_id", "id").agg(F.greatest(F.max("score") * 0.9, F.lit(MIN_SCORE)).alias("score")).select("query_id", "id", "score", F.lit("structure-parent").alias("stage"))
    w = Window.partitionBy("query_id").orderBy(F.col("stage") == "structure-parent", F.desc("score"), "id")
    room = F.greatest(F.lit(2 * top_k), F.count_if(F.col("stage") != "structure-parent").over(Window.partitionBy("query_id")))
    return hits.unionByName(more).withColumn("_n", F.row_number().over(w)).withColumn("_room", room).where("_n <= _room").drop("_n", "_room")


def role_score(text: Column, anchors: Column, duty_question: Column) -> Column:
    """How a text in comparison form speaks of the roles (an array): early, as the ones in charge, or only as ones helped; less if it names none; and by the role that it opens with."""

    def of(anchor: Column) -> Column:
        at = F.instr(text, anchor) - 1
        subject = F.regexp_like(text, F.concat(anchor, F.lit(f".{{0,12}}(?:{'|'.join(DUTIES)})")))
        helped = F.regexp_like(text, F.concat(F.lit(f"(?:{'|'.join(HELPS)}).{{0,10}}"), anchor))
        place = F.when(at <= 20, 0.45).when(at <= 80, 0.22).otherwise(0.06)
        return F.when(at < 0, 0.0).otherwise(place + F.when(subject, 0.55).when(helped, -0.55).when(duty_question, -0.18).otherwise(0.0))

    named = F.exists(anchors, lambda a: F.instr(text, a) > 0)
    said = F.aggregate(anchors, F.lit(0.0), lambda s, a: s + of(a)) + F.when(named, 0.0).otherwise(F.when(duty_question, -0.50).otherwise(-0.30))
    lead = F.coalesce(*[F.when(F.instr(text, r).between(1, 17), F.lit(r)) for r in sorted(ROLE_TERMS, key=len, reverse=True)])
    led = F.when(lead.isNull(), 0.0).when(F.array_contains(anchors, lead), 0.35).otherwise(-0.45)
    return F.when((F.size(anchors) == 0) | (text == ""), 0.0).otherwise(said + led)


def rerank(hits: DataFrame, questions: DataFrame, chunks: DataFrame, documents: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(query_id, id, hybrid_score, stage, rank): hits by vector score, lexical share of the question's best, and named sections and roles.

    Ties go to the higher vector score, then the smaller id.
    """
    titled = documents.select(F.col("id").alias("document_id"), "title")
    joined = lambda *names: X.comparison_form(F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names]))
    c = chunks.join(titled, "document_id").select(
        "id",
        joined("section_no", "section_title", "subsection_no", "subsection_title").alias("head"),
        joined("content", "title").alias("body"),
        F.coalesce("section_no", F.lit("")).alias("sec"),
        F.coalesce("subsection_title", "subsection_no", F.lit("")).alias("sub"),
        X.parent_section(F.col("section_no"), F.col("subsection_no")).alias("par"),
    )
    q = questions.select("query_id", query_terms(F.col("question"), _keywords(questions)).alias("terms"), role_anchors(F.col("question"), _keywords(questions)).alias("roles"), F.array_distinct(F.flatten(F.transform(X.section_refs(F.col("question")), ref_variants))).alias("refs"), X.comparison_form(X.query_text(F.col("question"), _keywords(questions))).alias("asked"))
    d = spelled(hits.join(c, "id").join(q, "query_id"), c, ["sec", "sub", "par"])
    term = lambda t: F.when(F.col("head").contains(t), 3.2 + F.least(F.char_length(t), F.lit(4)) * 0.15).otherwise(0.0) + F.when(F.col("body").contains(t), 1.8 + F.least(F.char_length(t), F.lit(5)) * 0.1).otherwise(0.0)
    named = F.when(F.arrays_overlap("refs", "sub"), 0.5).when(F.arrays_overlap("refs", "sec"), 0.45).when(F.arrays_overlap("refs", "par"), 0.30).otherwise(0.0)
    duty = asks_duty(F.col("asked"))
    role = role_score(F.col("said"), F.col("roles"), duty) * F.when(duty & (F.size("roles") == 1), 1.2).otherwise(1.0)
    # scored where the texts are: behind the window it would have to send them about
    d = d.withColumn("said", F.concat("head", "body")).select("query_id", "id", "stage", F.col("score").alias("vector_score"), F.aggregate("terms", F.lit(0.0), lambda s, t: s + term(t)).alias("lexical"), named.alias("named"), role.alias("role"))
    d = retrieval.hybrid(d, LEXICAL_WEIGHT).withColumn("hybrid_score", F.col("hybrid_score") + F.col("named") + F.col("role"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), F.desc("vector_score"), "id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "id", "hybrid_score", "stage", "rank")


def search(questions: DataFrame, documents: DataFrame, chunks: DataFrame, index: DataFrame, top_k: int = TOP_K, call: Callable | None = None) -> DataFrame:
    """(query_id, id, score, stage, rank): for each question the whole chapter it asks for, else its best chunks by vector and text, else those that its terms fit best.

    Questions are (query_id, question) and may have `keywords`, an array. One that is blank or meets nothing has no rows.
    """
    asked = questions.where(X.collapsed(F.col("question")) != "")
    whole = durable(chapter_full(asked, documents, chunks))
    rest = asked.join(whole.select("query_id").distinct(), "query_id", "left_anti")
    hits = durable(nearest(rest, index, max(EXPAND * top_k, top_k + 20), call))
    best = rerank(with_parents(hits, chunks, top_k), rest, chunks, documents, top_k)
    unmet = rest.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    terms = unmet.select("query_id", F.explode(query_terms(F.col("question"), _keywords(unmet))).alias("term"))
    worded = retrieval.keyword_hits(durable(terms), documents, chunks, KEYWORD_N).select("query_id", "id", F.col("score").cast("double").alias("score"), F.lit("keyword").alias("stage"), "rank")
    ordered = whole.join(chunks.select("id", "chunk_no"), "id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_no", "id")))
    vector = best.select("query_id", "id", F.col("hybrid_score").alias("score"), "stage", "rank")
    return ordered.select("query_id", "id", "score", "stage", "rank").unionByName(vector).unionByName(worded)


def stored_index(spark: SparkSession, chunks: DataFrame, documents: DataFrame, path: str, version: str, call: Callable | None = None) -> DataFrame:
    """(id, vector): the index stored at `path` if it is fresh, else a new one, stored in its place.

    An index is fresh if it was made by the same version of chunks with the same count, largest id and last time. Each one lies in a
    folder of its own; what names the one in use is written last, so an index that was only half written is never read.
    """
    wanted = pipelines.fingerprint(chunks).withColumn("version", F.lit(version))
    if exists(spark, f"{path}/current"):
        current = spark.read.json(f"{path}/current", schema=f"{pipelines.FINGERPRINT}, version string, folder string")
        if wanted.exceptAll(current.drop("folder")).isEmpty():
            return spark.read.parquet(current.first()["folder"])
    folder = f"{path}/{uuid.uuid4().hex}"
    index_vectors(chunks, documents, call).write.parquet(folder)
    wanted.withColumn("folder", F.lit(folder)).coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return spark.read.parquet(folder)
