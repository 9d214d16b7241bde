"""The queries of the llm subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausewise.llm.canonical import clause_classes, clause_forms, equal_clauses
from clausewise.llm.encoding import encode_corpus
from clausewise.llm.name_variants import firm_and_party_names, name_classes, same_names
from clausewise.llm.packing import pack
from clausewise.llm.personal import personal_data, personal_texts, redacted
from clausewise.llm.scan_repair import scan_noise, scan_repaired, scanned_texts, unscanned_texts
from clausewise.llm.shared_spans import shared_runs, shared_share
from clausewise.sources.tables import table



def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return equal_clauses(table(spark, folder, "kb_chunk"))


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    return clause_forms(table(spark, folder, "kb_chunk"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return clause_classes(table(spark, folder, "kb_chunk"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_names(firm_and_party_names(table(spark, folder, "legal_opinions"), table(spark, folder, "complaints")))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    return name_classes(firm_and_party_names(table(spark, folder, "legal_opinions"), table(spark, folder, "complaints")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(personal_texts(table(spark, folder, "complaints"), table(spark, folder, "legal_opinions")))


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redacted(personal_texts(table(spark, folder, "complaints"), table(spark, folder, "legal_opinions")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise(scanned_texts(*(table(spark, folder, t) for t in ("kb_chunk", "kb_document", "biz_source_documents"))))


def p5_repaired(spark: SparkSession, folder: str) -> DataFrame:
    chunks, documents, sources = (table(spark, folder, t) for t in ("kb_chunk", "kb_document", "biz_source_documents"))
    return scan_repaired(scanned_texts(chunks, documents, sources)).unionByName(unscanned_texts(chunks, sources))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_documents(spark, folder))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_documents(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_runs(_documents(spark, folder))


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    return shared_share(_documents(spark, folder))


QUERIES = {f.__name__: f for f in (p2_found, p2_forms, p2_classes, p3_found, p3_classes, p4_found, p4_redacted, p5_found, p5_repaired, p6_ids, p7_packed, p8_found, p8_share)}
SQL: dict[str, str] = {}
