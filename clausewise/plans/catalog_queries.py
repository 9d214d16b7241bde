"""Queries over merges, backfills, ingest of pages, lookups and small expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.functions import text as X
from clausewise.operators import merge, retrieval, sections
from clausewise.plans import pipelines, search
from clausewise.plans.kb_queries import _LINES, _PARENT, KEYWORDS, TOPICS, _cmp, _squeezed
from clausewise.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    """Register a query with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


_NUMERALS = "SELECT n, concat(CASE WHEN n >= 20 THEN '一二三四五六七八九'[n // 10] ELSE '' END, CASE WHEN n >= 10 THEN '十' ELSE '' END, CASE WHEN n % 10 > 0 THEN '一二三四五六七八九'[n % 10] ELSE '' END) AS w FROM (SELECT unnest(generate_series(1, 99)) AS n)"


def _halves(table_name: str) -> str:
    """SQL of a table with `early`: whether a row is of the earlier half of the time; rows without a time are."""
    return f"c AS (SELECT (epoch_us(min(created_at)) + epoch_us(max(created_at))) // 2 AS cut FROM {table_name}), s AS (SELECT t.*, coalesce(epoch_us(created_at) < cut, true) AS early FROM {table_name} t, c)"


def halves(rows: DataFrame) -> DataFrame:
    """`rows` with `early`, as `_halves` has it."""
    told = rows.withColumn("_at", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', created_at)"))
    cut = told.agg(F.expr("(min(_at) + max(_at)) div 2").alias("_cut"))
    return told.join(F.broadcast(cut)).withColumn("early", F.coalesce(F.col("_at") < F.col("_cut"), F.lit(True))).drop("_at", "_cut")


@query(f"""
WITH {_halves('biz_source_documents')},
o AS (SELECT id, CASE WHEN category IS NOT NULL THEN id END AS source_doc_id, 'RAW-POLICY-' || id AS doc_code, CASE WHEN category = 'policy' THEN 'v0.9' END AS version_no FROM s WHERE early),
n AS (SELECT id AS source_doc_id, 'RAW-POLICY-' || id AS doc_code, title FROM s)
SELECT n.source_doc_id, n.doc_code, n.title AS doc_name, coalesce(a.version_no, b.version_no, 'v1.0') AS version_no, CASE WHEN a.id IS NULL AND b.id IS NULL THEN 'insert' ELSE 'update' END AS action
FROM n LEFT JOIN o a ON a.source_doc_id = n.source_doc_id LEFT JOIN o b ON b.doc_code = n.doc_code""")
def document_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """All source documents as policy documents, merged by source id, else by code, into those made of the earlier half, some of which have lost their source."""
    s = halves(table(spark, folder, "biz_source_documents"))
    code = F.concat(F.lit("RAW-POLICY-"), F.col("id").cast("string")).alias("doc_code")
    old = s.where("early").select("id", F.when(F.col("category").isNotNull(), F.col("id")).alias("source_doc_id"), code, F.when(F.col("category") == "policy", "v0.9").alias("version_no"))
    new = s.select(F.col("id").alias("source_doc_id"), code, F.col("title").alias("doc_name"))
    met = merge.matched(new, old, ["source_doc_id"], ["doc_code"]).join(old.select(F.col("id").alias("old_number"), "version_no"), "old_number", "left")
    return met.select("source_doc_id", "doc_code", "doc_name", F.coalesce("version_no", F.lit("v1.0")).alias("version_no"), F.when(F.col("old_number").isNull(), "insert").otherwise("update").alias("action"))


@query(f"""
WITH {_halves('kb_chunk')},
t AS (SELECT id, document_id, subsection_no AS clause_no, content AS clause_text, sha256(document_id || '|' || subsection_no || '|' || content) AS content_hash, early FROM s WHERE subsection_no IS NOT NULL AND document_id IS NOT NULL AND length(content) >= 20),
o AS (SELECT * FROM t WHERE early), n AS (SELECT *, row_number() OVER (PARTITION BY document_id, clause_no ORDER BY id) AS k FROM t WHERE NOT early),
m AS (SELECT n.*, (SELECT min(o.id) FROM o WHERE o.content_hash = n.content_hash) AS same, (SELECT min(o.id) FROM o WHERE o.document_id = n.document_id AND o.clause_no = n.clause_no) AS there FROM n WHERE k = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY coalesce(same, there) ORDER BY id) AS j FROM m WHERE same IS NOT NULL OR there IS NOT NULL)
SELECT o.id, o.document_id, o.clause_no, CASE WHEN x.id IS NOT NULL AND x.same IS NULL THEN x.content_hash ELSE o.content_hash END AS content_hash, CASE WHEN x.id IS NULL THEN 'absent' WHEN x.same IS NOT NULL THEN 'keep' ELSE 'update' END AS action
FROM o LEFT JOIN x ON coalesce(x.same, x.there) = o.id AND x.j = 1
UNION ALL SELECT id, document_id, clause_no, content_hash, 'insert' FROM m WHERE same IS NULL AND there IS NULL""")
def clause_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The clauses of the chunks of the later half merged into those of the earlier half, by hash, else by number."""
    s = halves(table(spark, folder, "kb_chunk")).where("subsection_no is not null and document_id is not null").where(F.char_length("content") >= 20)
    t = s.select("id", "document_id", F.col("subsection_no").alias("clause_no"), F.col("content").alias("clause_text"), F.sha2(F.concat_ws("|", "document_id", "subsection_no", "content"), 256).alias("content_hash"), "early")
    return pipelines.merged_clauses(t.where("not early").drop("early"), t.where("early").drop("early")).drop("clause_text")


@query(f"""
WITH {_halves('biz_source_documents')}, f AS (SELECT coalesce(category, '') AS type, lower(regexp_replace(title, '\\s+', '', 'g')) AS name, id, early FROM s),
e AS (SELECT type, name, row_number() OVER (PARTITION BY type ORDER BY min(id)) AS step_no FROM f WHERE early GROUP BY type, name),
n AS (SELECT type, name, min(id) AS id FROM f WHERE NOT early GROUP BY type, name), x AS (SELECT n.* FROM n ANTI JOIN e ON e.type = n.type AND e.name = n.name),
b AS (SELECT type, max(step_no) AS most FROM e GROUP BY type)
SELECT x.type, x.name, coalesce(b.most, 0) + row_number() OVER (PARTITION BY x.type ORDER BY x.id) AS step_no FROM x LEFT JOIN b ON b.type = x.type""")
def step_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the later half that a type does not have yet, numbered on after the type's own."""
    f = halves(table(spark, folder, "biz_source_documents")).select(F.coalesce("category", F.lit("")).alias("type"), X.name_form(F.col("title")).alias("name"), "id", "early")
    first = lambda rows: rows.groupBy("type", "name").agg(F.min("id").alias("id"))
    nothing = f.limit(0).select("type", F.lit(0).cast("bigint").alias("step_no"))
    old = merge.numbered_in_groups(first(f.where("early")), nothing, "type", "step_no", "id")
    new = merge.only_new(first(f.where("not early")), old, ["type", "name"], "id")
    return merge.numbered_in_groups(new, old, "type", "step_no", "id").select("type", "name", "step_no")


@query(f"""
WITH w AS (SELECT *, {_PARENT} AS own, last_value(CASE WHEN subsection_title IS NOT NULL THEN chunk_no END IGNORE NULLS) OVER p AS spot, last_value(subsection_title IGNORE NULLS) OVER p AS near FROM kb_chunk
  WINDOW p AS (PARTITION BY document_id ORDER BY chunk_no, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, near AS parent FROM w WHERE subsection_title IS NULL AND content NOT IN ('', '.') AND own = '' AND near IS NOT NULL AND chunk_no - spot <= 24""")
def parent_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """For chunks without an article, the last article up to 24 places before them: what a backfill would put in."""
    c = table(spark, folder, "kb_chunk")
    article = F.col("subsection_title").isNotNull()
    return sections.backfilled_parents(c, article, ~article & ~F.col("content").isin("", "."), F.col("subsection_title"))


@query(f"""
WITH {_halves('kb_chunk')} SELECT id, row_number() OVER (ORDER BY NOT early, id) AS place FROM s WHERE content IS NOT NULL""")
def incremental_index(spark: SparkSession, folder: str) -> DataFrame:
    """An index of the earlier half after what is not indexed yet was added to it."""
    s = halves(table(spark, folder, "kb_chunk")).where("content is not null")
    rows = s.select("id", F.col("early").alias("is_indexed"), F.lit(None).cast("array<double>").alias("vector"))
    nothing = rows.limit(0).select("id", F.lit(0).cast("bigint").alias("place"), "vector")
    old = merge.numbered_after(rows.where("is_indexed").select("id", "vector"), nothing, "place", ["id"]).select("id", "place", "vector")
    return pipelines.indexed(rows, old)[1].select("id", "place")


_FIELD_SCORE = " + ".join(f"CASE WHEN contains({_cmp(f)}, term) THEN {w} ELSE 0 END" for f, w in retrieval.FIELD_WEIGHTS.items())


@query(f"""
WITH q AS (SELECT id AS query_id, unnest(list_distinct(regexp_extract_all(lower(title), '[\\x{{4e00}}-\\x{{9fff}}]{{2,14}}|[a-z0-9_]{{3,24}}'))) AS term FROM kb_document WHERE id % 20 = 0),
c AS (SELECT c.*, d.title FROM kb_chunk c JOIN kb_document d ON d.id = c.document_id WHERE (d.status IS NULL OR d.status IN ('有效', 'active', 'ACTIVE')) AND {_cmp('content')} <> ''),
s AS (SELECT query_id, c.id, chunk_no, sum({_FIELD_SCORE}) - CASE WHEN length(content) <= 10 THEN 6 ELSE 0 END AS score FROM q, c GROUP BY query_id, c.id, chunk_no, content),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no DESC, id DESC) AS rank FROM s WHERE score > 0)
SELECT query_id, id, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 12""")
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve chunks that the words of stored titles (ids divisible by 20) fit best, against all chunks: the last stage of a search."""
    documents, chunks = table(spark, folder, "kb_document"), table(spark, folder, "kb_chunk")
    terms = documents.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.explode(X.tokens(F.col("title"))).alias("term"))
    return retrieval.keyword_hits(terms, documents, chunks, 12)


_TERMS = sorted({*KEYWORDS, *[w for ws in TOPICS.values() for w in ws]})
_TERM_ROWS = ", ".join(f"('{w}')" for w in _TERMS)


@query(f"""
WITH r(term) AS (VALUES {_TERM_ROWS}),
s AS (SELECT d.id, sum(CASE WHEN contains({_cmp('d.title')}, term) THEN 8 + least(length(term), 4) ELSE 0 END + CASE WHEN contains({_cmp('d.content_text')}, term) THEN 3 ELSE 0 END) AS score FROM biz_source_documents d, r GROUP BY d.id)
SELECT id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 8""")
def type_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The eight source documents that the words of the topics fit best by name and description."""
    d = table(spark, folder, "biz_source_documents").select("id", F.col("title").alias("name"), F.col("content_text").alias("description"))
    terms = spark.createDataFrame([(w,) for w in _TERMS], "term string")
    return retrieval.type_scores(terms, d, 8)


@query("""
SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, c.c_custkey AS customer_id, c.c_mktsegment AS segment FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
WHERE l.l_returnflag = 'R' AND o.o_orderstatus = 'F' AND c.c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def mapped_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a map joined with what they map and with its owner, by the status of each and a list of types."""
    m = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"))
    o = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    c = table(spark, folder, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    return m.join(o, "order_id").join(c, "customer_id").select("order_id", "line_no", "customer_id", "segment")


@query("SELECT c.id AS number, d.title AS origin, c.section_title AS principle, d.doc_type AS domain, c.page_no AS page FROM kb_chunk c JOIN kb_document d ON d.id = c.document_id ORDER BY c.id DESC LIMIT 20")
def knowledge_preview(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty newest clauses beside their documents."""
    d = table(spark, folder, "kb_document").select(F.col("id").alias("document_id"), "title", "doc_type")
    c = table(spark, folder, "kb_chunk").join(d, "document_id").orderBy(F.desc("id")).limit(20)
    return c.select(F.col("id").alias("number"), F.col("title").alias("origin"), F.col("section_title").alias("principle"), F.col("doc_type").alias("domain"), F.col("page_no").alias("page"))


@query("""
WITH r AS (SELECT source, min(channel) AS channel FROM source_register GROUP BY source), p AS (SELECT site, min(channel) AS channel FROM source_register GROUP BY site)
SELECT doc_id, coalesce(r.channel, p.channel) AS channel, CASE WHEN r.source IS NOT NULL THEN 'source' WHEN p.site IS NOT NULL THEN 'site' ELSE 'none' END AS met
FROM documents d LEFT JOIN r ON r.source = CASE WHEN d.lang = 'zh' THEN d.source END LEFT JOIN p ON p.site = split_part(d.source, '/', 1)""")
def source_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The channel of each document by its source, where that counts (Chinese ones), else by the site of its source."""
    register = table(spark, folder, "source_register")
    by = lambda key: register.groupBy(F.col(key).alias(f"_{key}")).agg(F.min("channel").alias(f"_{key}_channel"))
    d = table(spark, folder, "documents").select("doc_id", F.when(F.col("lang") == "zh", F.col("source")).alias("_source"), F.split("source", "/")[0].alias("_site"))
    met = d.join(by("source"), "_source", "left").join(by("site"), "_site", "left")
    how = F.when(F.col("_source_channel").isNotNull(), "source").when(F.col("_site_channel").isNotNull(), "site").otherwise("none")
    return met.select("doc_id", F.coalesce("_source_channel", "_site_channel").alias("channel"), how.alias("met"))


@query(f"""
WITH r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '第[一二三四五六七八九十百千万零〇两0-9]{{1,10}}?[章条款目]')) AS ref FROM documents),
l AS (SELECT doc_id, unnest(string_split({_LINES}, chr(10))) AS line FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, regexp_extract(line, '^\\s*(第[一二三四五六七八九十百千万〇零0-9]+条)', 1) AS ref FROM l)
SELECT r.doc_id, r.ref FROM r ANTI JOIN o ON o.doc_id = r.doc_id AND o.ref = r.ref""")
def uncited_references(spark: SparkSession, folder: str) -> DataFrame:
    """References that a text makes and has no article for."""
    d = table(spark, folder, "documents")
    refs = d.select("doc_id", F.explode(X.section_refs(F.col("text"))).alias("ref")).distinct()
    own = sections.lines(d, "doc_id", "text").select("doc_id", F.regexp_extract("line", sections.ARTICLE_LINE, 1).alias("ref"))
    return refs.join(own, ["doc_id", "ref"], "left_anti")


_LABEL_NO, _LABEL_TITLE = _squeezed("subsection_title"), _squeezed("coalesce(subsection_title, '') || ' ' || coalesce(section_title, '')")


@query(f"""
WITH t AS (SELECT *, {_LABEL_NO} AS no, {_LABEL_TITLE} AS said FROM kb_chunk)
SELECT id, no, CASE WHEN no = '' OR said = '' THEN said WHEN replace(no, ' ', '') = replace(said, ' ', '') THEN '' WHEN starts_with(replace(said, ' ', ''), replace(no, ' ', '')) THEN trim(said[length(no) + 1:]) WHEN starts_with(replace(no, ' ', ''), replace(said, ' ', '')) THEN '' ELSE said END AS title,
  coalesce(nullif(page_no, 0), TRY_CAST(nullif(regexp_extract(content, '第\\s*(\\d{{1,9}})\\s*页', 1), '') AS INTEGER), 0) AS page,
  CASE WHEN regexp_extract(content, '[0-9]+') = '' THEN '' WHEN ltrim(regexp_extract(content, '[0-9]+'), '0') = '' THEN '0' ELSE ltrim(regexp_extract(content, '[0-9]+'), '0') END AS digits,
  array_to_string(list_filter(list_transform(regexp_split_to_array(content, '[，。；、,.;:\\s]+'), lambda x: lower(trim(x))), lambda x: length(x) >= 2)[1:8], '|') AS tokens,
  CAST(list_sum(list_filter(list_transform(string_split(coalesce(section_no, 'x') || ',' || coalesce(subsection_no, '') || ',7', ','), lambda x: TRY_CAST(nullif(x, '') AS INTEGER)), lambda x: x IS NOT NULL)) AS BIGINT) AS numbers,
  round_even(least(1.0, 0.6 + ({' + '.join(f"CAST(contains(content, '{k}') AS INTEGER)" for k in KEYWORDS)}) / {len(KEYWORDS)}.0 * 0.4), 2) AS weight,
  concat_ws(' ', nullif(trim(coalesce(section_title, '')), ''), CASE WHEN trim(coalesce(subsection_title, '')) <> trim(coalesce(section_title, '')) THEN nullif(trim(coalesce(subsection_title, '')), '') END) AS asked FROM t""")
def chunk_expressions(spark: SparkSession, folder: str) -> DataFrame:
    """Small expressions over chunks: a heading without its number, the page, the first digits, reference tokens, whole numbers, the weight by keywords, the text to embed."""
    c = table(spark, folder, "kb_chunk")
    label = X.section_label(F.col("subsection_title"), F.concat_ws(" ", F.coalesce("subsection_title", F.lit("")), F.coalesce("section_title", F.lit(""))))
    numbers = X.int_list(F.split(F.concat_ws(",", F.coalesce("section_no", F.lit("x")), F.coalesce("subsection_no", F.lit("")), F.lit("7")), ","))
    return c.withColumn("label", label).select(
        "id", "label.no", "label.title",
        F.coalesce(X.page_of(F.col("page_no"), F.lit(None).cast("string"), F.col("content")), F.lit(0)).alias("page"),
        X.first_digits(F.col("content")).alias("digits"),
        F.array_join(X.reference_tokens(F.col("content")), "|").alias("tokens"),
        F.aggregate(numbers, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("numbers"),
        X.relevance_weight(F.col("content"), KEYWORDS).cast("double").alias("weight"),
        X.query_text(F.coalesce("section_title", F.lit("")), F.array(F.coalesce("subsection_title", F.lit("")), F.coalesce("section_title", F.lit("")))).alias("asked"),
    )


@query(f"""SELECT id, sha256(regexp_replace(lower(coalesce(content, '')), '[^\\x{{4e00}}-\\x{{9fff}}a-z0-9]+', '', 'g')) AS line_form, trim(coalesce(content, '')) IN ('', '.', '。', '-', '—') AS empty_line,
  coalesce(regexp_matches(subsection_title, '^第[\\x{{4e00}}-\\x{{9fa5}}\\d]+条$'), false) AS article, regexp_matches(coalesce(content, ''), '^(?:[（(][\\x{{4e00}}-\\x{{9fa5}}\\d]{{1,4}}[）)]|[\\x{{4e00}}-\\x{{9fa5}}\\d]{{1,4}}[.、])') AS item,
  {_squeezed('content')} <> '' AND (regexp_matches({_squeezed('content')}, '[：:]$') OR (length({_squeezed('content')}) <= 80 AND regexp_matches({_squeezed('content')}, '以下|如下|原则|要点|路径|程序|职责'))) AS leads,
  regexp_matches({_cmp('content')}, '职责|履行|负责|主要负责|主要履行|原则|遵循') AS duty, coalesce('CT' || strftime(created_at, '%Y%m%d%H%M%S%f'), '') AS stamp FROM kb_chunk""")
def chunk_predicates(spark: SparkSession, folder: str) -> DataFrame:
    """What kind of text a chunk has: its form as a line, whether it is empty, an article, a list item, announces a list or speaks of duties, and a number by its time."""
    c = table(spark, folder, "kb_chunk")
    stamp = F.concat(F.lit("CT"), F.date_format("created_at", "yyyyMMddHHmmssSSSSSS"))
    return c.select(
        "id", F.sha2(X.comparison_form(F.col("content"), ""), 256).alias("line_form"), X.is_empty_body(F.col("content"), X.EMPTY_LINES).alias("empty_line"),
        F.coalesce(F.col("subsection_title").rlike(sections.ARTICLE), F.lit(False)).alias("article"), F.coalesce("content", F.lit("")).rlike(sections.LIST_ITEM).alias("item"),
        sections.leads(X.collapsed(F.col("content"))).alias("leads"), search.asks_duty(X.comparison_form(F.col("content"))).alias("duty"), F.coalesce(stamp, F.lit("")).alias("stamp"),
    )


@query("SELECT id, to_json(struct_pack(id := id, document_id := document_id, section_no := section_no, page_no := page_no, created_at := strftime(created_at, '%Y-%m-%dT%H:%M:%S'))) AS payload FROM kb_chunk")
def row_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as JSON without their content, times in ISO form."""
    row = F.struct("id", "document_id", "section_no", "page_no", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    return table(spark, folder, "kb_chunk").select("id", F.to_json(row, {"ignoreNullFields": "false"}).alias("payload"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, coalesce(nullif(json_extract_string(props, '$.name'), ''), event_type) AS name FROM events")
def json_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Fields out of JSON text, with a default for what is missing, empty or of another kind."""
    e = table(spark, folder, "events").withColumn("p", F.from_json("props", "k string, name string"))
    return e.select("event_id", F.coalesce(F.col("p.k").try_cast("int"), F.lit(-1)).alias("k"), F.coalesce(F.nullif(F.col("p.name"), F.lit("")), F.col("event_type")).alias("name"))


@query(f"""
WITH a AS (SELECT c.id, {_cmp('d.title')} AS x, {_cmp('c.section_title')} AS y FROM kb_chunk c JOIN kb_document d ON d.id = c.document_id)
SELECT id FROM a WHERE NOT (x <> '' AND y <> '' AND (x = y OR ((contains(x, y) OR contains(y, x)) AND least(length(x), length(y)) >= greatest(length(x), length(y)) * 0.75)))""")
def told_apart(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose section title says something else than their document's title."""
    d = table(spark, folder, "kb_document").select(F.col("id").alias("document_id"), "title")
    return table(spark, folder, "kb_chunk").join(d, "document_id").where(~X.similar(F.col("title"), F.col("section_title"))).select("id")


def _page_lines(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks written out as lines of pages again: headings, and articles behind their numbers."""
    title = F.coalesce("subsection_title", F.lit(""))
    line: Column = F.when(F.col("content").isin("", "."), F.coalesce("section_title", F.lit(""))).otherwise(F.concat(title, F.lit(" "), F.col("content")))
    told = documents.select(F.col("id").alias("document_id"), "title")
    return chunks.where("content is not null").join(told, "document_id").select("document_id", "title", "page_no", F.col("chunk_no").alias("line_no"), line.alias("line"))


_LINE = _squeezed("CASE WHEN content IN ('', '.') THEN coalesce(section_title, '') ELSE coalesce(subsection_title, '') || ' ' || content END")


@query(f"""
WITH m AS ({_NUMERALS}), l AS (SELECT c.document_id, d.title, c.page_no, c.chunk_no AS line_no, {_LINE} AS line FROM kb_chunk c JOIN kb_document d ON d.id = c.document_id WHERE content IS NOT NULL),
n AS (SELECT l.*, a.n AS c, CASE WHEN a.n IS NULL THEN b.n END AS a FROM l LEFT JOIN m a ON a.w = regexp_extract(line, '^第\\s*([一二三四五六七八九十]+)\\s*章', 1) LEFT JOIN m b ON b.w = regexp_extract(line, '^第\\s*([一二三四五六七八九十]+)\\s*条', 1) WHERE line <> ''),
r AS (SELECT *, trim(regexp_replace(regexp_replace(line, '^第\\s*[一二三四五六七八九十]+\\s*条[：:\\s、．.]*', ''), '^[（(【\\[《][^）)】\\]》]{{1,24}}[）)】\\]》][：:、，,\\s]*', '')) AS rest, trim(regexp_replace(line, '^第\\s*[一二三四五六七八九十]+\\s*章[：:\\s、．.]*', '')) AS tail FROM n),
f AS (SELECT *, CASE WHEN c IS NOT NULL THEN '' WHEN a IS NOT NULL THEN rest ELSE line END AS said FROM r),
g AS (SELECT *, CASE WHEN NOT regexp_matches(said, '^第\\s*[一二三四五六七八九十百千万零〇两\\d]+\\s*[章条]') AND {_cmp('said')} <> '' AND {_cmp('title')} <> '' AND ({_cmp('said')} = {_cmp('title')} OR (length({_cmp('said')}) >= 6 AND (contains({_cmp('title')}, {_cmp('said')}) OR contains({_cmp('said')}, {_cmp('title')})))) THEN '' ELSE said END AS body FROM f),
p AS (SELECT *, sum(CASE WHEN c IS NOT NULL OR a IS NOT NULL THEN 1 ELSE 0 END) OVER w AS part, last_value(c IGNORE NULLS) OVER w AS section, last_value(CASE WHEN c IS NOT NULL THEN tail END IGNORE NULLS) OVER w AS heading, max(CASE WHEN c IS NOT NULL OR a IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id) AS structured FROM g WINDOW w AS (PARTITION BY document_id ORDER BY line_no)),
k AS (SELECT document_id, part, max(section) AS section, max(heading) AS heading, max(a) AS article, {_squeezed("string_agg(body, chr(10) ORDER BY line_no) FILTER (WHERE body <> '')")} AS content, first(page_no ORDER BY line_no) FILTER (WHERE body <> '') AS page_no,
  min(CASE WHEN a IS NOT NULL THEN 0.92 WHEN part = 0 THEN 0.84 ELSE 0.88 END) FILTER (WHERE body <> '') AS sure FROM p WHERE part > 0 OR structured = 0 GROUP BY document_id, part)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY part) AS INTEGER) AS chunk_no, CAST(coalesce(section, 1) AS VARCHAR) AS section_no,
  '第' || (SELECT w FROM m WHERE m.n = coalesce(section, 1)) || '章' || CASE WHEN coalesce(heading, '') <> '' THEN ' ' || heading ELSE '' END AS section_title, CAST(article AS VARCHAR) AS subsection_no, sha256(content) AS content_hash, page_no,
  CAST(round(greatest(0, least(1, sure - CASE WHEN article IS NULL AND regexp_matches(content, '^第\\s*[一二三四五六七八九十百千万零〇两\\d]+\\s*条') THEN 0.25 ELSE 0 END)), 2) AS DOUBLE) AS confidence
FROM k WHERE coalesce(content, '') NOT IN ('', '.', '。', '-', '…')""")
def page_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks made again of the lines of all documents' pages, with their page and how sure they are."""
    lines = _page_lines(table(spark, folder, "kb_chunk"), table(spark, folder, "kb_document"))
    return sections.page_chunks(lines, "document_id").select("document_id", "chunk_no", "section_no", "section_title", "subsection_no", F.sha2("content", 256).alias("content_hash"), "page_no", "confidence")
