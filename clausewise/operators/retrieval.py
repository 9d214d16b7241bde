"""Scores and top-k over chunks."""

from __future__ import annotations

from functools import reduce
from operator import add

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.functions import text as X

ACTIVE = ("有效", "active", "ACTIVE")
#: Weight of a keyword by the field it stands in (fixed values).
FIELD_WEIGHTS = {"title": 12, "section_no": 8, "section_title": 10, "subsection_no": 9, "subsection_title": 11, "content": 14}


def active_documents(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("status").isNull() | F.col("status").isin(*ACTIVE))


def comparable(rows: DataFrame) -> DataFrame:
    """`rows` with the weighted fields in comparison form as columns of their own, so that each is made once however many keywords ask for it."""
    return rows.withColumns({f"_{f}": X.comparison_form(F.col(f)) for f in FIELD_WEIGHTS})


def keyword_score(keywords: list[str]) -> Column:
    """The weighted count of keywords in a comparable chunk joined with its document's title: 0 without content, less for a very short one, never negative."""
    hits = [F.when(F.col(f"_{f}").contains(k), w).otherwise(0) for k in keywords for f, w in FIELD_WEIGHTS.items()]
    total = reduce(add, hits, F.lit(0)) - F.when(F.char_length("content") <= 10, 6).otherwise(0)
    return F.when(F.col("_content") == "", 0).otherwise(F.greatest(total, F.lit(0)))


def keyword_top(documents: DataFrame, chunks: DataFrame, keywords: list[str], n: int) -> DataFrame:
    """The n best chunks of active documents as knowledge items; ties go to the later chunk, then the larger id."""
    titled = active_documents(documents).select(F.col("id").alias("document_id"), "title", "doc_type")
    scored = comparable(chunks.join(titled, "document_id")).withColumn("score", keyword_score(keywords))
    # filtered behind the limit: before it, the filter would make all scores a second time
    best = scored.orderBy(F.desc("score"), F.desc("chunk_no"), F.desc("id")).limit(n).where("score > 0")
    return best.select(
        F.col("id").alias("knowledge_id"),
        F.col("document_id").alias("source_doc_id"),
        "score",
        X.chunk_name(F.col("section_no"), F.col("section_title"), F.col("subsection_no"), F.col("subsection_title"), F.concat(F.col("title"), F.lit(" chunk-"), F.col("chunk_no").cast("string"))).alias("name"),
        X.shortened(F.col("content"), 180).alias("description"),
        X.shortened(F.col("content"), 320).alias("source_excerpt"),
        F.coalesce("title", F.lit("")).alias("source_title"),
        F.coalesce("doc_type", F.lit("")).alias("domain"),
        X.chunk_uri(F.col("document_id"), F.col("id"), F.col("page_no")).alias("source_ref"),
        X.parent_section(F.col("section_no"), F.col("subsection_no")).alias("parent_section"),
    )


def lexical_score(terms: list[str], head: Column, body: Column) -> Column:
    """Weighted count of terms in a heading and a body, both in comparison form."""
    some = [t for t in terms if len(t) >= 2]
    parts = [F.when(head.contains(t), 3.2 + min(len(t), 4) * 0.15).otherwise(0.0) + F.when(body.contains(t), 1.8 + min(len(t), 5) * 0.1).otherwise(0.0) for t in some]
    return reduce(add, parts, F.lit(0.0))


def hybrid(scored: DataFrame, weight: float = 0.35) -> DataFrame:
    """`hybrid_score` of (query_id, vector_score, lexical): the vector score plus the lexical one as a share of the query's best."""
    best = F.max("lexical").over(Window.partitionBy("query_id"))
    share = F.when(best > 0, F.col("lexical") / best).otherwise(0.0)
    return scored.withColumn("hybrid_score", F.col("vector_score") + weight * share)


def best_of_each(rows: DataFrame, key: list[str], score: str, tie: str) -> DataFrame:
    """The row of the best score for each key, ties to the smallest `tie`."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def clear_winner(scored: DataFrame, key: str, item: str, score: str, margin: float) -> DataFrame:
    """(key, item, score) of the best item of each key, unless the second is within `margin` of it."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.desc(item))
    ranked = scored.withColumn("_rank", F.row_number().over(w)).withColumn("_second", F.lead(score).over(w))
    return ranked.where((F.col("_rank") == 1) & (F.col("_second").isNull() | (F.col(score) > F.col("_second") + margin))).select(key, item, score)


#: Terms that one automaton holds; more are looked for in shards.
SHARD_TERMS = 100_000
#: Texts that meet a shard of terms in one task.
BLOCK_TEXTS = 20_000


def _hits(texts: list[str | None], words: list[str]) -> list[list[str]]:
    """The different words that each text holds, by one pass over it."""
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    if not words:
        return [[] for _ in texts]
    automaton.make_automaton()
    return [sorted({w for _, w in automaton.iter(t)}) if t else [] for t in texts]


def containing(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Each row of `texts` with each row of `terms` whose term its text holds; null and empty terms are in none.

    An automaton over the terms goes over each text once, so the work grows with the texts, not with texts times terms. Terms of
    one shard, their number checked, go to every task; more are spread over shards, each of which meets the texts block by block.
    """
    terms = terms.where(F.col(term).isNotNull() & (F.col(term) != ""))
    count = terms.count()
    if count <= SHARD_TERMS:
        words = terms.sparkSession.sparkContext.broadcast(sorted({r[0] for r in terms.select(term).collect()}))
        find = F.pandas_udf(lambda s: pd.Series(_hits(s.tolist(), words.value)), T.ArrayType(T.StringType()))
        # not to be made again in a filter on what it gives
        told = texts.withColumn("_part", F.explode(find.asNondeterministic()(text)))
        return told.join(F.broadcast(terms), F.col("_part") == F.col(term)).drop("_part")
    shards, blocks = -(-count // SHARD_TERMS), max(1, -(-texts.count() // BLOCK_TEXTS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = F.struct(*texts.columns)
    left = texts.select(row.alias("_row"), F.col(text).alias("_text"), F.pmod(F.xxhash64(*texts.columns), F.lit(blocks)).alias("_block")).withColumn("_shard", every(shards))
    right = terms.select(F.col(term).alias("_word")).distinct().withColumn("_shard", F.pmod(F.xxhash64("_word"), F.lit(shards)).cast("int")).withColumn("_block", every(blocks))

    def find_in(a: pa.Table, b: pa.Table) -> pa.Table:
        hits = pa.array(_hits(a.column("_text").to_pylist(), b.column("_word").to_pylist()), type=pa.list_(pa.string()))
        return pa.table({"_row": a.column("_row"), "_part": hits})

    schema = T.StructType([T.StructField("_row", texts.schema), T.StructField("_part", T.ArrayType(T.StringType()))])
    met = left.withColumn("_block", F.col("_block").cast("int")).groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInArrow(find_in, schema)
    return met.select("_row.*", F.explode("_part").alias("_part")).join(terms, F.col("_part") == F.col(term)).drop("_part")


def keyword_hits(terms: DataFrame, documents: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """(query_id, id, score, rank): the n best chunks of active documents for the terms (query_id, term) in comparison form of each query.

    Scores and ties are those of `keyword_top`. Each field's text is gone over once, whatever the number of queries and terms.
    """
    titled = active_documents(documents).select(F.col("id").alias("document_id"), "title")
    c = chunks.join(titled, "document_id").where(X.comparison_form(F.col("content")) != "")
    fields = F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), X.comparison_form(F.col(f)).alias("form")) for f, w in FIELD_WEIGHTS.items()]))
    long = c.select("id", "chunk_no", (F.char_length("content") <= 10).alias("short"), fields.alias("f")).select("id", "chunk_no", "short", "f.*")
    met = containing(long, "form", terms.select("query_id", "term").distinct(), "term")
    scored = met.groupBy("query_id", "id").agg(F.sum("weight").alias("s"), F.first("chunk_no").alias("chunk_no"), F.first("short").alias("short"))
    scored = scored.withColumn("score", F.col("s") - F.when(F.col("short"), 6).otherwise(0)).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("chunk_no"), F.desc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query_id", "id", "score", "rank")


def type_scores(terms: DataFrame, types: DataFrame, n: int) -> DataFrame:
    """(id, score): the n types (id, name, description) that the terms (term) fit best: 8 and up to 4 for a term in the name, 3 for one in the description; ties go to the larger id."""
    name, said = X.comparison_form(F.col("name")), X.comparison_form(F.col("description"))
    both = types.select("id", F.explode(F.array(F.struct(F.lit(True).alias("named"), name.alias("form")), F.struct(F.lit(False).alias("named"), said.alias("form")))).alias("f")).select("id", "f.*")
    met = containing(both, "form", terms.select("term").distinct(), "term")
    worth = F.when(F.col("named"), 8 + F.least(F.char_length("term"), F.lit(4))).otherwise(3)
    return met.groupBy("id").agg(F.sum(worth).alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(n)
