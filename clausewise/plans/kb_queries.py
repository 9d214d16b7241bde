"""Queries over the knowledge base tables: text, joins, windows, scores, top-k."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.functions import questions as Q
from clausewise.functions import text as X
from clausewise.operators import merge, retrieval, sections
from clausewise.operators.components import descendants
from clausewise.operators.durable import durable, ensure_checkpoint_dir
from clausewise.operators.vectors import vector_top
from clausewise.plans import answers, pipelines, search
from clausewise.sources.tables import table
from clausewise.streaming.ingest import ingest_available

#: The question that the keyword queries ask, as keywords in comparison form, and words that make a topic.
KEYWORDS = ["供应商", "价款支付", "授权委托书", "arbitration", "第三条"]
TOPICS = {"supply": ["供应商", "采购", "招标"], "payment": ["价款", "付款", "费用", "收款"], "data": ["数据", "个人信息", "保密"], "dispute": ["诉讼", "仲裁", "争议"]}
SPACE = "[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


_CLEAN = _strip(f"regexp_replace(replace(replace(regexp_replace(regexp_replace(content_text, '[.\\-_]{{3,}}', '', 'g'), '(?m)^\\d+{SPACE}*$', '', 'g'), '&nbsp;', ' '), chr(160), ' '), '\\n{{3,}}', chr(10) || chr(10), 'g')")
_LINES = _strip("regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")


def _cmp(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^\\x{{4e00}}-\\x{{9fff}}a-z0-9_]+', '', 'g')"


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SPACE}+', ' ', 'g'))"


QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query, with its SQL if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"SELECT id, sha256({_CLEAN}) AS clean_hash, CAST(length({_CLEAN}) AS BIGINT) AS n_chars FROM biz_source_documents WHERE content_text IS NOT NULL")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned text of each source document, as its hash and length."""
    d = table(spark, folder, "biz_source_documents").where("content_text is not null")
    clean = X.document_text(F.col("content_text"))
    return d.select("id", F.sha2(clean, 256).alias("clean_hash"), F.char_length(clean).cast("bigint").alias("n_chars"))


@query(f"SELECT id, title FROM biz_source_documents WHERE length({_CLEAN}) >= 30 AND NOT regexp_matches(content_text, '{pipelines.NOISE}')")
def noise_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Source documents that are neither stubs nor error pages."""
    d = table(spark, folder, "biz_source_documents")
    bad = F.col("content_text").rlike(pipelines.NOISE)
    return d.where((F.char_length(X.document_text(F.col("content_text"))) >= 30) & ~bad).select("id", "title")


@query("SELECT min(id) AS id, content_hash, count(*) AS copies FROM biz_source_documents GROUP BY content_hash")
def exact_dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first of each group of equal texts, and how many there are."""
    return table(spark, folder, "biz_source_documents").groupBy("content_hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS agreeing FROM (SELECT sha256(content_text) = content_hash AS ok FROM biz_source_documents)")
def hash_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How many stored hashes are those of their texts."""
    d = table(spark, folder, "biz_source_documents")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(X.content_hash(F.col("content_text")) == F.col("content_hash")).alias("agreeing"))


@query("SELECT id, CASE WHEN regexp_matches(s, '讲话|发言|致辞|演讲|speech') THEN 'speech' WHEN regexp_matches(s, '案例|判决|裁定|裁判|审判|case|judgment') THEN 'case' ELSE 'policy' END AS inferred, category FROM (SELECT *, lower(file_name || ' ' || title) AS s FROM biz_source_documents)")
def category_infer(spark: SparkSession, folder: str) -> DataFrame:
    """The category that a document's name suggests, beside the stored one."""
    d = table(spark, folder, "biz_source_documents")
    return d.select("id", X.first_match(F.lower(F.concat_ws(" ", "file_name", "title")), pipelines.CATEGORY_WORDS, "policy").alias("inferred"), "category")


_SCORE = " + ".join(f"CASE WHEN contains({_cmp(f)}, '{k}') THEN {w} ELSE 0 END" for k in KEYWORDS for f, w in retrieval.FIELD_WEIGHTS.items())
_NAME = "trim(concat_ws(' ', nullif(trim(section_no), ''), nullif(trim(section_title), ''), nullif(trim(subsection_no), ''), nullif(trim(subsection_title), '')))"


@query(f"""
WITH s AS (SELECT c.*, d.title, d.doc_type, greatest({_SCORE} - CASE WHEN length(content) <= 10 THEN 6 ELSE 0 END, 0) AS score
  FROM kb_chunk c JOIN kb_document d ON d.id = c.document_id
  WHERE (d.status IS NULL OR d.status IN ('有效', 'active', 'ACTIVE')) AND {_cmp('content')} <> '')
SELECT id AS knowledge_id, document_id AS source_doc_id, CAST(score AS INTEGER) AS score, coalesce(nullif({_NAME}, ''), title || ' chunk-' || chunk_no) AS name,
  CASE WHEN length({_squeezed('content')}) > 180 THEN {_squeezed('content')}[1:180] || '...' ELSE {_squeezed('content')} END AS description,
  CASE WHEN length({_squeezed('content')}) > 320 THEN {_squeezed('content')}[1:320] || '...' ELSE {_squeezed('content')} END AS source_excerpt,
  coalesce(title, '') AS source_title, coalesce(doc_type, '') AS domain,
  'kb://document/' || document_id || '/chunk/' || id || CASE WHEN coalesce(page_no, 0) > 0 THEN '?page=' || page_no ELSE '' END AS source_ref,
  CASE WHEN trim(coalesce(subsection_no, '')) = '' THEN '' WHEN trim(coalesce(section_no, '')) <> '' AND trim(section_no) <> trim(subsection_no) THEN trim(section_no)
       WHEN contains(subsection_no, '.') THEN regexp_replace(trim(subsection_no), '\\.[^.]*$', '') ELSE '' END AS parent_section
FROM s WHERE score > 0 ORDER BY score DESC, chunk_no DESC, id DESC LIMIT 12""")
def keyword_topn(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve chunks of active documents that the keywords fit best, as knowledge items."""
    return retrieval.keyword_top(table(spark, folder, "kb_document"), table(spark, folder, "kb_chunk"), KEYWORDS, 12)


_PARENT = "CASE WHEN trim(coalesce(subsection_no, '')) = '' THEN '' WHEN trim(coalesce(section_no, '')) <> '' AND trim(section_no) <> trim(subsection_no) THEN trim(section_no) WHEN contains(subsection_no, '.') THEN regexp_replace(trim(subsection_no), '\\.[^.]*$', '') ELSE '' END"


@query(f"""SELECT id, {_PARENT} AS parent_section,
  CASE WHEN trim(content) IN ('', '.') AND (trim(coalesce(section_title, '')) <> '' OR trim(coalesce(subsection_title, '')) <> '') THEN 1 ELSE 0 END AS is_title,
  CASE WHEN trim(coalesce(subsection_no, '')) <> '' THEN 2 WHEN trim(coalesce(section_no, '')) <> '' THEN 1 ELSE 0 END AS level_no FROM kb_chunk""")
def chunk_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The computed columns of the chunks."""
    return table(spark, folder, "kb_chunk").select(
        "id",
        X.parent_section(F.col("section_no"), F.col("subsection_no")).alias("parent_section"),
        X.is_title(F.col("content"), F.col("section_title"), F.col("subsection_title")).alias("is_title"),
        X.level_no(F.col("section_no"), F.col("subsection_no")).alias("level_no"),
    )


@query("SELECT count(*) AS chunks, count(DISTINCT document_id) AS documents, max(id) AS max_id, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS max_created FROM kb_chunk")
def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    """What tells whether an index is fresh: count, documents, largest id and time."""
    return table(spark, folder, "kb_chunk").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("document_id").alias("documents"), F.max("id").alias("max_id"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("max_created"))


@query("SELECT d.id, d.title FROM kb_document d ANTI JOIN (SELECT document_id FROM kb_chunk WHERE trim(coalesce(section_title, '')) = '' OR section_no IS NULL) c ON c.document_id = d.id")
def complete_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents none of whose chunks lacks its section."""
    gaps = table(spark, folder, "kb_chunk").where((F.trim(F.coalesce("section_title", F.lit(""))) == "") | F.col("section_no").isNull())
    return table(spark, folder, "kb_document").join(gaps.select(F.col("document_id").alias("id")), "id", "left_anti").select("id", "title")


@query(f"SELECT c.id AS chunk_id, sha256(coalesce(d.title, '') || ' ' || coalesce(section_no, '') || ' ' || coalesce(section_title, '') || ' ' || coalesce(subsection_no, '') || ' ' || coalesce(subsection_title, '') || ' ' || coalesce(content, '')) AS text_hash FROM kb_chunk c JOIN kb_document d ON d.id = c.document_id WHERE {_strip('coalesce(content, chr(46))')} NOT IN ('', '.', '。', '-', '…')")
def index_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts to embed: a chunk's headings and content behind its document's title, as hashes."""
    titled = table(spark, folder, "kb_document").select(F.col("id").alias("document_id"), "title")
    c = table(spark, folder, "kb_chunk").where(~X.is_empty_body(F.col("content"))).join(titled, "document_id")
    parts = [F.coalesce(F.col(x), F.lit("")) for x in ("title", "section_no", "section_title", "subsection_no", "subsection_title", "content")]
    spaced = [p for x in parts for p in (F.lit(" "), x)][1:]
    return c.select(F.col("id").alias("chunk_id"), F.sha2(F.concat(*spaced), 256).alias("text_hash"))


@query(f"""
WITH l AS (SELECT doc_id, string_split({_LINES}, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM l),
p AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*第[一二三四五六七八九十百千万〇零0-9]+条') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM n),
g AS (SELECT doc_id, part, {_strip('string_agg(line, chr(10) ORDER BY line_no)')} AS body, first(line ORDER BY line_no) AS head FROM p WHERE part > 0 GROUP BY doc_id, part),
t AS (SELECT *, regexp_extract(head, '^\\s*(第[一二三四五六七八九十百千万〇零0-9]+条)', 1) AS no, regexp_replace(regexp_extract(head, '^\\s*第[一二三四五六七八九十百千万〇零0-9]+条\\s*([^\\n]{{0,80}})', 1), '^[ ：:;；\\t]+|[ ：:;；\\t]+$', '', 'g') AS title FROM g WHERE length(body) >= 20)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) AS INTEGER) AS seq, no AS clause_no, CASE WHEN title = '' THEN no ELSE title[1:255] END AS clause_title, sha256(body) AS clause_hash FROM t""")
def article_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """The articles of each text, with number, title and hash."""
    a = sections.articles(table(spark, folder, "documents"), "doc_id", "text")
    return a.select("doc_id", "seq", "clause_no", "clause_title", F.sha2("clause_text", 256).alias("clause_hash"))


_SOURCE_LINES = _LINES.replace("(text,", "(content_text,")


@query(f"""
WITH RECURSIVE t AS (SELECT id, {_SOURCE_LINES} AS body FROM biz_source_documents WHERE content_text IS NOT NULL),
k AS (SELECT id, body, list_filter(list_transform(regexp_split_to_array(body, '\\n{{2,}}'), lambda x: {_strip('x')}), lambda x: length(x) >= 20) AS ps FROM t),
l AS (SELECT id, CASE WHEN len(ps) > 0 THEN ps WHEN body <> '' THEN [body] ELSE [] END AS ps FROM k),
p AS (SELECT id, unnest(ps) AS para, generate_subscripts(ps, 1) AS i FROM l),
r AS (SELECT id, i, para, 1 AS g, length(para) AS size FROM p WHERE i = 1
  UNION ALL SELECT p.id, p.i, p.para, CASE WHEN r.size + length(p.para) <= 1200 THEN r.g ELSE r.g + 1 END, CASE WHEN r.size + length(p.para) <= 1200 THEN r.size + length(p.para) ELSE length(p.para) END FROM r JOIN p ON p.id = r.id AND p.i = r.i + 1),
c AS (SELECT id, g, string_agg(para, chr(10) || chr(10) ORDER BY i) AS body FROM r GROUP BY id, g),
h AS (SELECT *, {_strip("regexp_extract(body, '^[^。；;\n]*')")} AS head FROM c)
SELECT id, CAST(g AS INTEGER) AS seq, 'AUTO-' || lpad(CAST(g AS VARCHAR), 3, '0') AS clause_no, CASE WHEN head = '' THEN '自动条款' || g ELSE head[1:36] END AS clause_title, sha256(body) AS clause_hash FROM h""")
def packed_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of the source documents packed to 1,200 characters."""
    p = sections.packed_paragraphs(table(spark, folder, "biz_source_documents"), "id", "content_text")
    return p.select("id", "seq", "clause_no", "clause_title", F.sha2("clause_text", 256).alias("clause_hash"))


_CUT = "regexp_matches(coalesce(subsection_title, ''), '^第[一二三四五六七八九十百]+条$') AND length(content) >= 20"


@query(f"""
WITH t AS (SELECT *, length(content) // 2 AS half FROM kb_chunk)
SELECT id * 2 AS id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_no, id) AS INTEGER) AS chunk_no, sha256(CASE WHEN {_CUT} THEN {_squeezed('content[1:half]')} || {_squeezed('content[half + 1:]')} ELSE content END) AS content_hash FROM t""")
def wrap_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose articles were cut in two, the second half as a continuation row behind the first: joined and numbered anew."""
    c = table(spark, folder, "kb_chunk").withColumn("half", F.expr("length(content) div 2").cast("int"))
    cut = F.coalesce(F.col("subsection_title").rlike("^第[一二三四五六七八九十百]+条$") & (F.char_length("content") >= 20), F.lit(False))
    whole = c.select("*", F.when(cut, F.col("subsection_title")).alias("article"))
    part = lambda rows, at, section, content: rows.select((F.col("id") * 2 + at).alias("id"), "document_id", (F.col("chunk_no") * 2 + at).alias("chunk_no"), section.alias("section_no"), F.when(F.col("article").isNull(), F.col("section_title")).alias("section_title"), F.lit(None).cast("string").alias("subsection_no"), F.lit(None).cast("string").alias("subsection_title"), content.alias("content"))
    first = part(whole, 0, F.col("article"), F.when(F.col("article").isNull(), F.col("content")).otherwise(F.substring(F.col("content"), F.lit(1), F.col("half"))))
    second = part(whole.where("article is not null"), 1, F.concat("article", F.lit(".p1")), F.substring(F.col("content"), F.col("half") + 1, F.char_length("content")))
    return sections.merged_wraps(first.unionByName(second)).select("id", "chunk_no", F.sha2("content", 256).alias("content_hash"))


@query("""
WITH t AS (SELECT *, trim(content) IN ('', '.') AND (trim(coalesce(section_title, '')) <> '' OR trim(coalesce(subsection_title, '')) <> '') AS head FROM kb_chunk),
w AS (SELECT *, last_value(CASE WHEN head THEN chunk_no END IGNORE NULLS) OVER p AS spot, last_value(CASE WHEN head THEN coalesce(section_no, '') END IGNORE NULLS) OVER p AS sec FROM t
  WINDOW p AS (PARTITION BY document_id ORDER BY chunk_no, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, coalesce(CASE WHEN chunk_no - spot <= 120 THEN sec ELSE '' END, '') AS inferred_section FROM w WHERE section_no IS NULL AND NOT head""")
def nearest_section(spark: SparkSession, folder: str) -> DataFrame:
    """For chunks without a section, that of the nearest title row before them, up to 120 rows back."""
    c = table(spark, folder, "kb_chunk")
    head = X.is_title(F.col("content"), F.col("section_title"), F.col("subsection_title")) == 1
    near = sections.nearest_before(c, "document_id", "chunk_no", head, F.coalesce("section_no", F.lit("")), 120)
    return near.where(F.col("section_no").isNull() & ~head).select("id", F.coalesce("nearest", F.lit("")).alias("inferred_section"))


@query(f"""
WITH k AS (SELECT document_id, {_PARENT} AS parent, chunk_no, id, content FROM kb_chunk WHERE {_strip('coalesce(content, chr(46))')} NOT IN ('', '.', '。', '-', '…')),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, parent ORDER BY chunk_no, id) AS n FROM k WHERE parent <> '')
SELECT document_id, parent, max(n) AS children, sha256(string_agg({_squeezed('content')}, ' ' ORDER BY n) FILTER (WHERE n <= 6)) AS first_hash FROM r GROUP BY document_id, parent""")
def child_contents(spark: SparkSession, folder: str) -> DataFrame:
    """What stands for a section without content of its own: its first six children joined."""
    parent = X.parent_section(F.col("section_no"), F.col("subsection_no"))
    k = table(spark, folder, "kb_chunk").where(~X.is_empty_body(F.col("content"))).withColumn("parent", parent).where("parent <> ''")
    counts = k.groupBy("document_id", "parent").agg(F.count(F.lit(1)).alias("children"))
    # the filter on the rank goes before the shuffle, so a section of many rows sends six from each task
    ranked = k.select("document_id", "parent", "chunk_no", "id", X.collapsed(F.col("content")).alias("t")).withColumn("n", F.row_number().over(Window.partitionBy("document_id", "parent").orderBy("chunk_no", "id"))).where("n <= 6")
    first = ranked.groupBy("document_id", "parent").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("six"))
    return counts.join(first, ["document_id", "parent"]).select("document_id", "parent", "children", F.sha2(F.array_join(F.transform("six", lambda x: x["t"]), " "), 256).alias("first_hash"))


_TOPIC_ROWS = ", ".join(f"('{t}', {i}, '{w}')" for i, (t, ws) in enumerate(TOPICS.items()) for w in ws)


@query(f"""
WITH r(topic, prio, word) AS (VALUES {_TOPIC_ROWS}),
h AS (SELECT d.id, r.topic, r.prio, count(*) AS hits FROM biz_source_documents d JOIN r ON contains(d.content_text, r.word) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, prio) AS n FROM h)
SELECT id, topic, hits FROM k WHERE (hits >= 2 AND n <= 3) OR n = 1
UNION ALL SELECT id, 'other', 0 FROM biz_source_documents d WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.id = d.id)""")
def topic_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Topics of a document by the words it holds: the best three with two hits or more, else the best, else 'other'."""
    d = table(spark, folder, "biz_source_documents").select("id", "content_text")
    words = spark.createDataFrame([(t, i, w) for i, (t, ws) in enumerate(TOPICS.items()) for w in ws], "topic string, prio int, word string")
    hits = retrieval.containing(d, "content_text", words, "word").groupBy("id", "topic", "prio").agg(F.count(F.lit(1)).alias("hits"))
    ranked = hits.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("hits"), "prio")))
    best = ranked.where("(hits >= 2 and n <= 3) or n = 1").select("id", "topic", "hits")
    rest = d.join(best.select("id").distinct(), "id", "left_anti").select("id", F.lit("other").alias("topic"), F.lit(0).cast("bigint").alias("hits"))
    return best.unionByName(rest)


@query("""SELECT id, CASE WHEN regexp_matches(content, '不得|禁止') THEN 3 WHEN regexp_matches(content, '应当|必须|需|须|严禁') THEN 1 WHEN regexp_matches(content, '可|建议|酌情|视情况') THEN 2 ELSE 1 END AS level,
  regexp_extract(content, '(\\d+\\s*(?:个)?(?:工作)?日内|\\d+\\s*天内|当日|即时|月底前|季度内|年度内)', 1) AS due, 'AUTO_' || upper(sha256(id || '|' || document_id || '|' || chunk_no)[1:12]) AS code,
  trim(regexp_extract(trim(content), '^[^。；;\\n]*'))[1:36] AS headline FROM kb_chunk""")
def clause_levels(spark: SparkSession, folder: str) -> DataFrame:
    """What a clause's words say: whether it forbids, obliges or allows, by when, its code and first sentence."""
    c = table(spark, folder, "kb_chunk")
    due = F.regexp_extract("content", "(\\d+\\s*(?:个)?(?:工作)?日内|\\d+\\s*天内|当日|即时|月底前|季度内|年度内)", 1)
    code = F.concat(F.lit("AUTO_"), F.upper(F.substring(F.sha2(F.concat_ws("|", "id", "document_id", "chunk_no"), 256), 1, 12)))
    return c.select("id", X.modality(F.col("content")).alias("level"), due.alias("due"), code.alias("code"), X.first_sentence(F.col("content"), 36).alias("headline"))


_WORDS = ", ".join(f"('{k}')" for k in KEYWORDS)


@query(f"WITH w(word) AS (VALUES {_WORDS}), h AS (SELECT word, id, row_number() OVER (PARTITION BY word ORDER BY id) AS n FROM w JOIN kb_chunk ON contains(content, word) OR contains(coalesce(section_title, ''), word)) SELECT word, id FROM h WHERE n <= 3")
def keyword_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    """The first three chunks that hold each keyword in title or content."""
    c = table(spark, folder, "kb_chunk").select("id", F.concat_ws("\x01", "content", F.coalesce("section_title", F.lit(""))).alias("both"))
    hits = retrieval.containing(c, "both", spark.createDataFrame([(k,) for k in KEYWORDS], "word string"), "word")
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy("id"))).where("n <= 3").select("word", "id")


_BASE = _cmp(f"regexp_split_to_array({_squeezed('title')}, '[-—－_]')[1]")


@query(f"""
WITH b AS (SELECT id, title, {_BASE} AS base FROM kb_document WHERE status IS NULL OR status IN ('有效', 'active', 'ACTIVE')),
r AS (SELECT *, regexp_replace(base, '^(.+?)(?:集团股份有限公司|股份有限公司|有限责任公司|集团有限公司|有限公司|集团公司|集团)+$', '\\1') AS reduced FROM b),
c AS (SELECT *, regexp_replace(reduced, '科技|股份|集团|公司', '', 'g') AS compact FROM r),
l AS (SELECT id, title, unnest(list_distinct(list_filter([base, reduced, compact], lambda x: length(x) >= 2) || list_transform(list_filter([base, reduced, compact], lambda x: length(x) >= 4), lambda x: x[1:4]))) AS alias FROM c),
s AS (SELECT q.id AS source_id, l.id AS document_id, max(20 + length(alias)) + max(CASE WHEN contains({_cmp('l.title')}, {_cmp('q.title')}) THEN least(length({_cmp('q.title')}), 8) ELSE 0 END) AS score
  FROM biz_source_documents q JOIN l ON contains({_cmp('q.title')}, l.alias) GROUP BY q.id, l.id),
k AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, document_id DESC))
SELECT source_id, document_id, CAST(score AS BIGINT) AS score FROM k WHERE n = 1 AND (second IS NULL OR score > second + 2)""")
def target_document(spark: SparkSession, folder: str) -> DataFrame:
    """The active document that a source document's title names, if no other comes within two points."""
    d = retrieval.active_documents(table(spark, folder, "kb_document"))
    aliases = d.select(F.col("id").alias("document_id"), X.comparison_form(F.col("title")).alias("named"), F.explode(X.title_aliases(F.col("title"))).alias("alias"))
    asked = table(spark, folder, "biz_source_documents").select(F.col("id").alias("source_id"), X.comparison_form(F.col("title")).alias("asked"))
    hits = retrieval.containing(asked, "asked", aliases, "alias")
    bonus = F.when(F.col("named").contains(F.col("asked")), F.least(F.char_length("asked"), F.lit(8))).otherwise(0)
    scored = hits.groupBy("source_id", "document_id").agg((F.max(20 + F.char_length("alias")) + F.max(bonus)).cast("bigint").alias("score"))
    return retrieval.clear_winner(scored, "source_id", "document_id", "score", 2)


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, b.vec_id AS id, list_inner_product(q.e, b.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(b.e, b.e))) AS score FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s)
SELECT query_id, id, round(score, 6) AS score, CAST(n AS INTEGER) AS rank FROM k WHERE n <= 14""")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 14 nearest vectors of each stated query vector (ids divisible by 20), exactly."""
    base = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    top = vector_top(base, base.where("id % 20 = 0"), 14)
    return top.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, b.vec_id AS id, b.label, list_inner_product(q.e, b.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(b.e, b.e))) AS score FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0),
t AS (SELECT * FROM s WHERE score >= 0.13), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM t),
g AS (SELECT query_id, label, arg_max(id, (score, -id)) AS id, round(max(score), 6) AS score FROM k WHERE n <= 66 GROUP BY ALL)
SELECT * FROM g""")
def best_score_per_label(spark: SparkSession, folder: str) -> DataFrame:
    """Of each query's candidates above the least score, the best of each label."""
    e = table(spark, folder, "embeddings")
    base = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    top = vector_top(base, base.where("id % 20 = 0"), 66, 0.13).join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return retrieval.best_of_each(top, ["query_id", "label"], "score", "id").select("query_id", "label", "id", F.round("score", 6).alias("score"))


def _lexical_sql() -> str:
    head = _cmp("coalesce(section_no, '') || ' ' || coalesce(section_title, '') || ' ' || coalesce(subsection_no, '') || ' ' || coalesce(subsection_title, '')")
    body = _cmp("coalesce(content, '') || ' ' || coalesce(title, '')")
    return " + ".join(f"CASE WHEN contains({head}, '{k}') THEN {3.2 + min(len(k), 4) * 0.15} ELSE 0 END + CASE WHEN contains({body}, '{k}') THEN {1.8 + min(len(k), 5) * 0.1} ELSE 0 END" for k in KEYWORDS)


@query(f"""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1),
v AS (SELECT vec_id AS id, list_inner_product(CAST(embedding AS DOUBLE[]), q.e) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(q.e, q.e))) AS vector_score FROM embeddings, q WHERE embedding IS NOT NULL),
s AS (SELECT c.id, coalesce(v.vector_score, 0) AS vector_score, CAST({_lexical_sql()} AS DOUBLE) AS lexical FROM kb_chunk c JOIN kb_document d ON d.id = c.document_id LEFT JOIN v ON v.id = c.id),
h AS (SELECT id, vector_score + 0.35 * CASE WHEN max(lexical) OVER () > 0 THEN lexical / max(lexical) OVER () ELSE 0 END AS hybrid FROM s)
SELECT id, round(hybrid, 6) AS hybrid_score FROM h ORDER BY hybrid DESC, id LIMIT 20""")
def hybrid_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by a mixed score: the likeness of their stored vector to a question's (the first stored one), and the lexical score as a share of the best."""
    titled = table(spark, folder, "kb_document").select(F.col("id").alias("document_id"), "title")
    joined = lambda *names: X.comparison_form(F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names]))
    c = table(spark, folder, "kb_chunk").join(titled, "document_id")
    c = c.select("id", joined("section_no", "section_title", "subsection_no", "subsection_title").alias("_head"), joined("content", "title").alias("_body"))
    lexical = c.select("id", retrieval.lexical_score(KEYWORDS, F.col("_head"), F.col("_body")).alias("lexical"))
    stored = table(spark, folder, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    # one row
    asked = stored.orderBy("id").limit(1).select(F.col("e").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    vectors = stored.join(F.broadcast(asked)).select("id", (dot("e", "q") / (F.sqrt(dot("e", "e")) * F.sqrt(dot("q", "q")))).alias("vector_score"))
    # scores are made once: their best is asked for before their rows
    scored = durable(lexical.join(vectors, "id", "left").select("id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), "lexical"))
    best = scored.agg(F.max("lexical").alias("best"))
    mixed = scored.join(F.broadcast(best)).withColumn("hybrid_score", F.col("vector_score") + F.when(F.col("best") > 0, 0.35 * F.col("lexical") / F.col("best")).otherwise(0.0))
    return mixed.orderBy(F.desc("hybrid_score"), "id").limit(20).select("id", F.round("hybrid_score", 6).alias("hybrid_score"))


@query("SELECT id, client_name, strftime(created_at, '%Y-%m-%d %H:%M') AS at FROM legal_opinions ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 10 OFFSET 10")
def history_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of ten, the newest first."""
    o = table(spark, folder, "legal_opinions").orderBy(F.col("created_at").desc_nulls_last(), F.desc("id")).offset(10).limit(10)
    return o.select("id", "client_name", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("at"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers out of JSON text, by type of event."""
    e = table(spark, folder, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_sum"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\x{4e00}-\\x{9fff}]{2,14}|[a-z0-9_]{3,24}'))) AS token FROM documents WHERE text IS NOT NULL) SELECT token, count(*) AS documents FROM t GROUP BY token HAVING count(*) >= 5")
def token_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and how many documents have them, from five on."""
    t = table(spark, folder, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("documents")).where("documents >= 5")


_UP_TO_99 = "concat(CASE WHEN k >= 20 THEN '一二三四五六七八九'[k // 10] ELSE '' END, CASE WHEN k >= 10 THEN '十' ELSE '零' END, CASE WHEN k % 10 > 0 THEN '一二三四五六七八九'[k % 10] ELSE '' END)"


@query(f"""WITH t AS (SELECT id, CAST(subsection_no AS BIGINT) AS number, subsection_title AS written, CAST(subsection_no AS BIGINT) % 99 + 1 AS k FROM kb_chunk WHERE subsection_title IS NOT NULL AND subsection_no IS NOT NULL)
SELECT id, number, written, '一百' || {_UP_TO_99} AS past_hundred, '一千' || CASE WHEN k < 10 THEN {_UP_TO_99} ELSE '零' || {_UP_TO_99} END AS past_thousand FROM t""")
def article_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The number that an article's title writes, the number written again, and numbers past a hundred and a thousand made of it."""
    c = table(spark, folder, "kb_chunk").where("subsection_title is not null and subsection_no is not null")
    number = X.numeral_value(F.regexp_extract("subsection_title", f"第\\s*([{X.NUMERAL}]+)\\s*条", 1))
    past = lambda n: X.numeral_text(number % 99 + 1 + n)
    return c.select("id", number.alias("number"), F.concat(F.lit("第"), X.numeral_text(number), F.lit("条")).alias("written"), past(100).alias("past_hundred"), past(1000).alias("past_thousand"))


@query("WITH p AS (SELECT id, unnest(regexp_split_to_array(content, '（[一二三四五六七八九十]+）')[2:]) AS item, generate_subscripts(regexp_split_to_array(content, '（[一二三四五六七八九十]+）')[2:], 1) AS n FROM kb_chunk WHERE regexp_matches(content, '（[一二三四五六七八九十]+）')) SELECT id, CAST(n AS INTEGER) AS n, trim(regexp_replace(item, '\\s+', ' ', 'g')) AS item FROM p")
def list_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items of lists inside clauses, with their place."""
    c = table(spark, folder, "kb_chunk").where(F.col("content").rlike("（[一二三四五六七八九十]+）"))
    items = F.slice(F.split("content", "（[一二三四五六七八九十]+）"), 2, 1000000)
    return c.select("id", F.posexplode(items).alias("p", "t")).select("id", (F.col("p") + 1).cast("int").alias("n"), F.trim(F.regexp_replace("t", "\\s+", " ")).alias("item"))


@query("""
WITH c AS (SELECT (epoch_us(min(created_at)) + epoch_us(max(created_at))) // 2 AS cut FROM biz_source_documents),
s AS (SELECT title, content_hash, id, coalesce(epoch_us(created_at) < cut, true) AS early FROM biz_source_documents, c),
o AS (SELECT title, arg_max(content_hash, id) AS h FROM s WHERE early GROUP BY title), l AS (SELECT title, arg_max(content_hash, id) AS h FROM s WHERE NOT early GROUP BY title)
SELECT coalesce(l.title, o.title) AS title, CASE WHEN o.title IS NULL THEN 'insert' WHEN l.title IS NULL THEN 'absent' WHEN o.h = l.h THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN l ON l.title = o.title""")
def manifest_actions(spark: SparkSession, folder: str) -> DataFrame:
    """What the ingests of the later half of the time do to those of the earlier half, title by title and by the hash of the last content; rows without a time count as early."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', created_at)")
    d = table(spark, folder, "biz_source_documents").select("title", "content_hash", "id", at.alias("at"))
    cut = d.agg(F.expr("(min(at) + max(at)) div 2").alias("cut"))
    told = d.join(F.broadcast(cut)).withColumn("early", F.coalesce(F.col("at") < F.col("cut"), F.lit(True)))
    last = lambda side: told.where(side).groupBy("title").agg(F.max_by("content_hash", "id").alias("h"))
    return merge.merge_actions(last(~F.col("early")), last(F.col("early")), ["title"], "h").select("title", "action")


@query("WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND text <> ''), f AS (SELECT min(doc_id) AS doc_id, h FROM h GROUP BY h) SELECT f.doc_id FROM f ANTI JOIN biz_source_documents b ON b.content_hash = f.h")
def new_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Texts not ingested yet, the first of each."""
    d = table(spark, folder, "documents").where("text <> ''").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    return merge.only_new(d, table(spark, folder, "biz_source_documents"), ["content_hash"], "doc_id").select("doc_id")


@query("SELECT document_id, section_no, arg_max(id, (length(content), -id)) AS id, CAST(max(length(content)) AS INTEGER) AS size FROM kb_chunk WHERE section_no IS NOT NULL AND content IS NOT NULL GROUP BY ALL")
def longest_of_section(spark: SparkSession, folder: str) -> DataFrame:
    """The longest chunk of each section."""
    c = table(spark, folder, "kb_chunk").where("section_no is not null and content is not null").withColumn("size", F.char_length("content"))
    return retrieval.best_of_each(c, ["document_id", "section_no"], "size", "id").select("document_id", "section_no", "id", "size")


_NUMERALS = "SELECT n, concat(CASE WHEN n >= 20 THEN '一二三四五六七八九'[n // 10] ELSE '' END, CASE WHEN n >= 10 THEN '十' ELSE '' END, CASE WHEN n % 10 > 0 THEN '一二三四五六七八九'[n % 10] ELSE '' END) AS w FROM (SELECT unnest(generate_series(1, 99)) AS n)"


@query(f"""
WITH m AS ({_NUMERALS}), l AS (SELECT doc_id, string_split({_LINES}, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM l),
a AS (SELECT n.*, m.n AS art FROM n LEFT JOIN m ON m.w = regexp_extract(line, '^\\s*第\\s*([一二三四五六七八九十]+)\\s*条', 1)),
p AS (SELECT *, sum(CASE WHEN art IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS part, max(art) OVER (PARTITION BY doc_id) AS any_article FROM a),
b AS (SELECT *, {_strip("CASE WHEN art IS NOT NULL THEN regexp_replace(line, '^\\s*第\\s*[一二三四五六七八九十]+\\s*条[\\s\\x{3000}]*', '') ELSE line END")} AS body FROM p WHERE part > 0 OR any_article IS NULL),
g AS (SELECT doc_id, part, max(art) AS art, string_agg(body, chr(10) ORDER BY line_no) FILTER (WHERE body <> '') AS content FROM b GROUP BY doc_id, part)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) AS INTEGER) AS chunk_no, '1' AS section_no, CAST(art AS VARCHAR) AS subsection_no, sha256(content) AS content_hash FROM g WHERE coalesce(content, '') NOT IN ('', '.', '。', '-', '…')""")
def line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that the lines of a text open by chapter and article numbers."""
    n = sections.lines(table(spark, folder, "documents"), "doc_id", "text")
    return sections.chunks_of_lines(n, "doc_id").select("doc_id", "chunk_no", "section_no", "subsection_no", F.sha2("content", 256).alias("content_hash"))


_ELEMENTS = ["document_name", "document_type", "case_cause", "court_name", "filing_date", "plaintiff_names", "plaintiff_addresses", "defendant_names", "claims_items", "principal_amount", "attachments"]


@query(f"SELECT id, CAST({' + '.join(f'''CASE WHEN trim(coalesce({c}, '')) NOT IN ('', '无', '/', '暂无') THEN 1 ELSE 0 END''' for c in _ELEMENTS)} AS INTEGER) AS filled, CAST(round_even(100.0 * ({' + '.join(f'''CASE WHEN trim(coalesce({c}, '')) NOT IN ('', '无', '/', '暂无') THEN 1 ELSE 0 END''' for c in _ELEMENTS)}) / {len(_ELEMENTS)}, 0) AS INTEGER) AS completeness FROM complaints")
def filled_elements(spark: SparkSession, folder: str) -> DataFrame:
    """How many of a complaint's elements say something, and that as a percentage, half to even."""
    c = table(spark, folder, "complaints")
    n = sum(((~F.trim(F.coalesce(F.col(x), F.lit(""))).isin("", "无", "/", "暂无")).cast("int") for x in _ELEMENTS[1:]), (~F.trim(F.coalesce(F.col(_ELEMENTS[0]), F.lit(""))).isin("", "无", "/", "暂无")).cast("int"))
    return c.select("id", n.alias("filled"), F.bround(F.lit(100.0) * n / len(_ELEMENTS), 0).cast("int").alias("completeness"))


@query("""
WITH RECURSIVE edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
tree AS (SELECT r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT tree.root, edges.child, tree.depth + 1 FROM tree JOIN edges ON edges.parent = tree.node)
SELECT root, CAST(depth AS INTEGER) AS depth, count(*) AS nodes FROM tree GROUP BY root, depth""")
def type_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes below each root of a hierarchy, level by level, however many there are."""
    r, n, s = (table(spark, folder, t) for t in ("region", "nation", "supplier"))
    edge = lambda d, a, up, b, down: d.select(F.concat(F.lit(a), F.col(up).cast("string")).alias("parent"), F.concat(F.lit(b), F.col(down).cast("string")).alias("child"))
    edges = edge(n, "r", "n_regionkey", "n", "n_nationkey").unionByName(edge(s, "n", "s_nationkey", "s", "s_suppkey"))
    roots = r.select(F.col("r_regionkey").alias("root"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return descendants(roots, edges).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"SELECT DISTINCT sha256(content_text) AS content_hash, CAST(length({_CLEAN}) AS INTEGER) AS n_chars FROM biz_source_documents WHERE length({_CLEAN}) >= 30 AND NOT regexp_matches(content_text, '{pipelines.NOISE}')")
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The different source texts worth keeping, by a stream over the files there are."""
    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = table(spark, folder, "biz_source_documents").schema
    return ingest_available(spark, f"{folder}/biz_source_documents.parque[t]", schema, f"{shared}/out", f"{shared}/state").select("content_hash", "n_chars")


@query()
def effective_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that stand for more than their own content, with that as a hash and its length."""
    e = sections.effective_contents(table(spark, folder, "kb_chunk"))
    return e.select("id", F.sha2("effective", 256).alias("text_hash"), F.char_length("effective").alias("n_chars"))


@query()
def knowledge_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best chunks for questions made of stored chunks' headings (ids divisible by 20), against all chunks."""
    documents, chunks = table(spark, folder, "kb_document"), table(spark, folder, "kb_chunk")
    index = search.index_vectors(chunks, documents)
    asked = chunks.where("id % 20 = 0 and content not in ('', '.')").select(F.col("id").alias("query_id"), F.concat_ws(" ", "section_title", "subsection_title", X.first_sentence(F.col("content"), 36)).alias("question"))
    found = search.search(asked, documents, chunks, index)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "stage", "rank")


@query()
def source_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses of the source documents and what they do to those of the first ingest of each title."""
    d = table(spark, folder, "biz_source_documents")
    first = d.join(d.groupBy("title").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")
    new, old = pipelines.clauses(d), pipelines.clauses(first)
    return pipelines.clause_actions(new, old)


@query("""SELECT 'chunk without document' AS name, count(*) AS failures FROM kb_chunk c ANTI JOIN kb_document d ON d.id = c.document_id
UNION ALL SELECT 'repeated chunk number', count(*) FROM (SELECT 1 FROM kb_chunk GROUP BY document_id, chunk_no HAVING count(*) > 1)
UNION ALL SELECT 'repeated chunk id', count(*) FROM (SELECT 1 FROM kb_chunk GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'document without chunks', count(*) FROM kb_document d ANTI JOIN kb_chunk c ON d.id = c.document_id""")
def table_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that break what the tables promise."""
    return pipelines.checks(table(spark, folder, "kb_document"), table(spark, folder, "kb_chunk"))


@query("""SELECT id, CASE WHEN regexp_matches(content, '第[一二三四五六七八九十百千万零〇两0-9]{1,10}[章条款目]') THEN array_to_string(list_distinct(regexp_extract_all(content, '第[一二三四五六七八九十百千万零〇两0-9]{1,10}?[章条款目]')), ' ') ELSE '' END AS refs FROM kb_chunk""")
def section_references(spark: SparkSession, folder: str) -> DataFrame:
    """The sections that each chunk names."""
    return table(spark, folder, "kb_chunk").select("id", F.array_join(X.section_refs(F.col("content")), " ").alias("refs"))


@query()
def question_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords of each question that stands in the texts, with its place among the text's questions."""
    lines = F.regexp_extract_all("text", F.lit("(?m)^问：(.+)$"), F.lit(1))
    d = table(spark, folder, "documents").where(F.col("text").contains("问：")).select("doc_id", F.posexplode(lines).alias("p", "question"))
    return d.select("doc_id", (F.col("p") + 1).cast("int").alias("question_no"), F.array_join(Q.keywords(F.col("question")), " ").alias("keywords"), Q.is_multiple(F.col("question")).alias("several"))


@query(f"""
WITH b AS (SELECT id, regexp_replace({_squeezed('claims_items')}, '^[。；;]+|[。；;]+$', '', 'g') AS body FROM complaints WHERE claims_items IS NOT NULL),
l AS (SELECT id, CASE WHEN regexp_matches(body, '[；;]') THEN regexp_split_to_array(body, '[；;]') WHEN len(regexp_extract_all(body, '。')) >= 2 THEN string_split(body, '。') WHEN len(regexp_extract_all(body, '、')) >= 2 THEN string_split(body, '、') ELSE [] END AS ls FROM b),
u AS (SELECT id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM l),
c AS (SELECT id, i, regexp_replace(regexp_replace(x, '^[：:，,。；; ]+|[：:，,。；; ]+$', '', 'g'), '^\\s*(?:\\d+[.、)]|[(（]?[一二三四五六七八九十]{{1,3}}[、.)）])\\s*', '') AS part FROM u),
d AS (SELECT id, part, min(i) AS i FROM c WHERE length(part) >= 2 GROUP BY id, part)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS n, part FROM d""")
def list_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of claims that list things, in order."""
    c = table(spark, folder, "complaints").where("claims_items is not null")
    return c.select("id", F.posexplode(Q.list_parts(F.col("claims_items"))).alias("n", "part"))


@query()
def keyword_answers(spark: SparkSession, folder: str) -> DataFrame:
    """A Markdown answer made of the twelve best chunks for the keywords."""
    documents, chunks = table(spark, folder, "kb_document"), table(spark, folder, "kb_chunk")
    top = retrieval.keyword_top(documents, chunks, KEYWORDS, 12).select(F.lit(1).cast("bigint").alias("query_id"), F.col("knowledge_id").alias("id"), "score")
    hits = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    asked = spark.createDataFrame([(1, " ".join(KEYWORDS))], "query_id bigint, question string")
    return answers.answers(asked, answers.context_items(hits, chunks, documents))
