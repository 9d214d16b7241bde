"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausewise.operators.packed_values import long_form, unpack
from clausewise.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(field, id, pos, value) of every field that holds two or more values."""
    opinions, complaints = table(spark, folder, "legal_opinions"), table(spark, folder, "complaints")
    fields = long_form(
        [
            ("legal_opinions.case_numbers", opinions, "id", "case_numbers"),
            ("legal_opinions.case_names", opinions, "id", "case_names"),
            ("complaints.defendant_names", complaints, "id", "defendant_names"),
        ]
    )
    return unpack(fields, at_least=2)


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
