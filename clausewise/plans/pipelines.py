"""From files to clauses and an index, as jobs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.functions import text as X
from clausewise.operators import merge, sections

CATEGORY_WORDS = [("speech", ("讲话", "发言", "致辞", "演讲", "speech")), ("case", ("案例", "判决", "裁定", "裁判", "审判", "case", "judgment"))]
NOISE = "HTTP ERROR|502 Bad Gateway|404 Not Found"
#: What `fingerprint` gives.
FINGERPRINT = "n bigint, max_id bigint, max_created string"


def source_rows(documents: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, counts): documents (path, title, content) as source documents not there yet, and how many were new, noise or known.

    Rows: file_name, title, content_text, content_hash, category. The first path of equal texts counts.
    """
    name = F.element_at(F.split("path", "/"), -1)
    told = documents.select("path", name.alias("file_name"), "title", X.document_text(F.col("content")).alias("content_text"))
    told = told.withColumn("content_hash", X.content_hash(F.col("content_text"))).withColumn("noise", (F.char_length("content_text") < 30) | F.col("content_text").rlike(NOISE))
    told = told.withColumn("category", X.first_match(F.lower(F.concat_ws(" ", "file_name", "title")), CATEGORY_WORDS, "policy"))
    new = merge.only_new(told.where(~F.col("noise")), existing, ["content_hash"], "path").select("file_name", "title", "content_text", "content_hash", "category")
    counts = told.agg(F.count(F.lit(1)).alias("seen"), F.count_if("noise").alias("noise"))
    return new, counts


def clauses(sources: DataFrame, most: int | None = None) -> DataFrame:
    """(id, seq, clause_no, clause_title, clause_text, content_hash) of each source document: its articles, else its paragraphs packed, of 20 characters or more; the first `most` only if that is given."""
    art = sections.articles(sources, "id", "content_text")
    rest = sources.join(art.select("id").distinct(), "id", "left_anti")
    both = art.unionByName(sections.packed_paragraphs(rest, "id", "content_text")).where(F.char_length("clause_text") >= 20)
    if most is not None:
        both = both.where(F.col("seq") <= most)
    return both.withColumn("content_hash", F.sha2(F.concat_ws("|", "id", "clause_no", "clause_text"), 256))


def merged_clauses(new: DataFrame, old: DataFrame) -> DataFrame:
    """The clauses (id, document_id, clause_no, clause_text, content_hash, action) after new ones came to old ones (without `action`).

    A new clause whose hash is there changes nothing; one whose document and number are there takes the place of the first such; others are added.
    Of new clauses with one document and number the first counts, and so does the first of those that meet one old clause. Old ones that nothing meets are 'absent'.
    """
    by_hash = old.where("content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("same"))
    by_number = old.groupBy("document_id", "clause_no").agg(F.min("id").alias("there"))
    told = merge.first_of_each(new, ["document_id", "clause_no"], "id").join(by_hash, "content_hash", "left").join(by_number, ["document_id", "clause_no"], "left")
    met = told.where("same is not null or there is not null").select(F.coalesce("same", "there").alias("old_id"), F.col("id").alias("new_id"), F.col("same").isNotNull().alias("kept"), F.col("clause_text").alias("new_text"), F.col("content_hash").alias("new_hash"))
    met = merge.first_of_each(met, ["old_id"], "new_id")
    action = F.when(F.col("kept").isNull(), "absent").when(F.col("kept"), "keep").otherwise("update")
    pick = lambda n, o: F.when(F.col("kept") == F.lit(False), F.col(n)).otherwise(F.col(o)).alias(o)
    after = old.join(met, old["id"] == met["old_id"], "left").select("id", "document_id", "clause_no", pick("new_text", "clause_text"), pick("new_hash", "content_hash"), action.alias("action"))
    added = told.where("same is null and there is null").select("id", "document_id", "clause_no", "clause_text", "content_hash", F.lit("insert").alias("action"))
    return after.unionByName(added)


def indexed(rows: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`rows` with `is_indexed` set, the index with what was not indexed before, its `place` going on after the largest one), of (id, is_indexed, vector) and (id, place, vector)."""
    new = rows.where("not coalesce(is_indexed, false)").select("id", "vector")
    more = merge.numbered_after(new, index, "place", ["id"]).select("id", "place", "vector")
    return rows.withColumn("is_indexed", F.lit(True)), index.select("id", "place", "vector").unionByName(more)


def clause_actions(new: DataFrame, old: DataFrame) -> DataFrame:
    """(id, clause_no, action): keep a clause whose hash is there, update one whose number is, else insert it; the first of a number counts."""
    first = merge.first_of_each(new, ["id", "clause_no"], "seq")
    known = old.select("content_hash").distinct().withColumn("same", F.lit(True))
    numbered = old.select("id", "clause_no").distinct().withColumn("there", F.lit(True))
    action = F.when(F.col("same"), "keep").when(F.col("there"), "update").otherwise("insert")
    return first.join(known, "content_hash", "left").join(numbered, ["id", "clause_no"], "left").select("id", "clause_no", action.alias("action"))


def fingerprint(chunks: DataFrame) -> DataFrame:
    """What tells a fresh index from a stale one: (n, max_id, max_created)."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("max_id"), F.max("created_at").cast("string").alias("max_created"))


def is_fresh(chunks: DataFrame, stored: DataFrame) -> bool:
    """Whether an index whose fingerprint was stored still fits the chunks."""
    return fingerprint(chunks).exceptAll(stored.select("n", "max_id", "max_created")).isEmpty()


def checks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, failures): rows that break what the tables promise."""
    orphan = chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti").agg(F.count(F.lit(1)).alias("failures"))
    repeated = chunks.groupBy("document_id", "chunk_no").count().where("count > 1").agg(F.count(F.lit(1)).alias("failures"))
    ids = chunks.groupBy("id").count().where("count > 1").agg(F.count(F.lit(1)).alias("failures"))
    empty = documents.join(chunks.select(F.col("document_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("failures"))
    named = [("chunk without document", orphan), ("repeated chunk number", repeated), ("repeated chunk id", ids), ("document without chunks", empty)]
    out = None
    for name, d in named:
        one = d.select(F.lit(name).alias("name"), "failures")
        out = one if out is None else out.unionByName(one)
    return out
