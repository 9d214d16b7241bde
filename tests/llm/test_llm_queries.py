from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
COLUMNS = {
    "p2_found": "field string, id_a bigint, id_b bigint",
    "p2_forms": "field string, id bigint, form string",
    "p2_classes": "field string, document_id bigint, class bigint, texts bigint, rows bigint",
    "p3_found": "name_group string, name_a string, name_b string",
    "p3_classes": "name_group string, name string, class string, spellings bigint",
    "p4_found": "field string, id bigint, kind string, value string",
    "p4_redacted": "field string, id bigint, text string",
    "p5_found": "field string, id bigint, kind string, value string",
    "p5_repaired": "field string, id bigint, text string",
    "p6_ids": "doc_id bigint, ids array<int>",
    "p7_packed": "doc_id bigint, piece int, container string, tokens int, score double",
    "p8_found": "doc_id bigint, span_start int, span_end int",
    "p8_share": "doc_id bigint, chars bigint, shared_chars bigint, share double",
}


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    got = entry.queries()[name](spark, str(DATA))
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == COLUMNS[name]
    rows = got.collect()
    assert rows and len({str(r) for r in rows}) == len(rows)
