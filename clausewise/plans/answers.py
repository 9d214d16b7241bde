"""From hits to numbered context, citations and a Markdown answer, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.functions import text as X

#: Hits that an answer tells apart, and those it cites.
MOST, CITED = 6, 3


def distinct_hits(hits: DataFrame, most: int = MOST) -> DataFrame:
    """The hits (query_id, rank, document_id, clause_no, text) told apart: one that says what an earlier one of its document says, or is its
    parent or child clause, takes its place if it is deeper or longer, else goes. Up to `most` a question, numbered anew in `rank`.

    A question has few hits, so one row holds them; their order is that of `rank`.
    """
    # a section's title counts, where hits come with it
    titled = F.when(X.stripped(F.col("title")) != "", 2).otherwise(0) if "title" in hits.columns else F.lit(0)
    row = F.struct("document_id", F.coalesce("clause_no", F.lit("")).alias("clause_no"), "id", F.coalesce("text", F.lit("")).alias("text"), X.comparison_form(F.col("text")).alias("form"), titled.alias("titled"))
    of = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))).alias("all"))
    rows = F.transform("all", lambda x: x["row"])

    def same(a, b):
        short, long = F.least(F.char_length(a["form"]), F.char_length(b["form"])), F.greatest(F.char_length(a["form"]), F.char_length(b["form"]))
        text = (a["form"] != "") & (b["form"] != "") & ((a["form"] == b["form"]) | ((a["form"].contains(b["form"]) | b["form"].contains(a["form"])) & (short >= long * 0.75)))
        family = (a["clause_no"] != "") & (b["clause_no"] != "") & (a["clause_no"].startswith(F.concat(b["clause_no"], F.lit("."))) | b["clause_no"].startswith(F.concat(a["clause_no"], F.lit("."))))
        return a["document_id"].eqNullSafe(b["document_id"]) & (text | family)

    def worth(r):
        return X.depth(r["clause_no"]) * 10 + r["titled"] + F.least(F.char_length(r["form"]), F.lit(400)) / 100.0

    def step(kept, r):
        first = F.array_position(F.transform(kept, lambda k: same(r, k)), True)
        swapped = F.transform(kept, lambda k, i: F.when((i + 1 == first) & (worth(r) >= worth(k)), r).otherwise(k))
        return F.when(F.size(kept) >= most, kept).when(first > 0, swapped).otherwise(F.concat(kept, F.array(r)))

    kept = F.aggregate(rows, F.slice(rows, 1, 0), step)
    return of.select("query_id", F.posexplode(kept).alias("p", "r")).select("query_id", (F.col("p") + 1).alias("rank"), "r.id", "r.document_id", "r.clause_no", "r.text")


def context_items(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, ctx_id, id, document_id, clause_no, label, text, uri) of hits (query_id, id, rank): what an answer may use, numbered from 1, trimmed by its length."""
    titled = documents.select(F.col("id").alias("document_id"), F.coalesce("title", F.lit("")).alias("title"))
    told = hits.join(chunks, "id").join(titled, "document_id")
    page = F.when(F.coalesce("page_no", F.lit(0)) > 0, F.concat(F.lit("第"), F.col("page_no").cast("string"), F.lit("页")))
    label = F.concat_ws("，", F.col("title"), F.nullif(X.collapsed(F.col("section_title")), F.lit("")), F.nullif(X.collapsed(F.col("subsection_title")), F.lit("")), page)
    size = F.char_length(X.collapsed(F.col("content")))
    text = F.when(size <= 360, X.collapsed(F.col("content"))).when(size <= 520, X.shortened(F.col("content"), 520)).when(size <= 620, X.shortened(F.col("content"), 620)).otherwise(X.shortened(F.col("content"), 1400))
    clause = F.concat_ws(".", F.nullif(X.stripped(F.col("section_no")), F.lit("")), F.nullif(X.stripped(F.col("subsection_no")), F.lit("")))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    return told.select("query_id", number.alias("ctx_id"), "id", "document_id", clause.alias("clause_no"), label.alias("label"), text.alias("text"), X.chunk_uri(F.col("document_id"), F.col("id"), F.col("page_no")).alias("uri"))


def citations(context: DataFrame, used: DataFrame | None = None, most: int = CITED) -> DataFrame:
    """(query_id, ctx_id, label, uri): what is cited: the context numbers in `used` (query_id, ids) that exist, else the first ones, up to `most`."""
    first = context.where(F.col("ctx_id") <= most).select("query_id", "ctx_id", "label", "uri")
    if used is None:
        return first
    named = used.select("query_id", F.explode(F.slice(F.array_distinct("ids"), 1, most)).alias("ctx_id")).join(context, ["query_id", "ctx_id"]).select("query_id", "ctx_id", "label", "uri")
    return named.unionByName(first.join(named.select("query_id").distinct(), "query_id", "left_anti"))


def answers(questions: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, markdown): each question with its distinct context as a numbered list and its citations; one without context says so."""
    hits = distinct_hits(context.select("query_id", F.col("ctx_id").alias("rank"), "id", "document_id", "clause_no", "text"))
    item = F.concat(F.col("rank").cast("string"), F.lit(". "), X.markdown_escaped(F.col("text")))
    body = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    cite = citations(context)
    refs = cite.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ctx_id", F.concat(F.lit("- ["), F.col("label"), F.lit("]("), F.col("uri"), F.lit(")")).alias("line")))), lambda x: x["line"]), "\n").alias("refs"))
    whole = questions.join(body, "query_id", "left").join(refs, "query_id", "left")
    text = F.when(F.col("body").isNull(), F.lit("未检索到依据")).otherwise(F.concat(F.col("body"), F.lit("\n\n## 依据\n"), F.col("refs")))
    return whole.select("query_id", F.concat(F.lit("# "), X.collapsed(F.col("question")), F.lit("\n\n"), text).alias("markdown"))
