import math
import re
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
CORE = sorted(entry.core.SQL)


def plain(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(x, 6) if isinstance(x, float) else str(x)

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    told = con.sql(entry.oracle_sql()[name])
    columns = sorted(told.columns)
    got = entry.queries()[name](spark, str(DATA))
    assert sorted(got.columns) == columns
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(told.df()[columns].astype(object).where(lambda d: d.notna(), None).itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_entry_and_rows_only_queries(spark):
    assert entry.entry(spark).count() == 12
    run = lambda name: entry.queries()[name](spark, str(DATA))
    rows_only = set(entry.core.QUERIES) - set(CORE)
    assert rows_only == {"p1_found", "effective_contents", "knowledge_search", "source_clauses", "question_keywords", "keyword_answers"}
    # every chunk that asks is near itself: its own headings and first sentence
    found = [tuple(r) for r in run("knowledge_search").select("query_id", "id", "rank", "stage").collect()]
    asked = {q for q, *_ in found}
    assert asked and all(q % 20 == 0 for q in asked) and sum(q == i for q, i, *_ in found) >= 0.9 * len(asked)
    assert all(sorted(r for q, _, r, _ in found if q == x) == list(range(1, sum(q == x for q, *_ in found) + 1)) for x in asked)
    # the first ingest of a title has nothing to change of itself
    acts = [r.action for r in run("source_clauses").collect()]
    assert set(acts) <= {"keep", "update", "insert"} and acts.count("keep") > 0.5 * len(acts)
    texts = spark.read.parquet(str(DATA / "documents.parquet"))
    questions = sum(len(re.findall("(?m)^问：.+$", r.text)) for r in texts.where("text is not null").collect())
    assert run("question_keywords").count() == questions
    assert run("keyword_answers").count() == 1 and run("keyword_answers").first().markdown.startswith("# 供应商")
    chunks = spark.read.parquet(str(DATA / "kb_chunk.parquet"))
    assert run("effective_contents").join(chunks, "id").where("n_chars <= coalesce(length(content), 0)").count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_packed_values_columns(spark):
    got = entry.queries()["p1_found"](spark, str(DATA))
    assert got.dtypes == [("field", "string"), ("id", "bigint"), ("pos", "int"), ("value", "string")]
    rows = got.collect()
    assert rows and len(set(rows)) == len(rows)
