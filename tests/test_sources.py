from pyspark.sql import functions as F

from clausewise.plans import providers
from clausewise.sources import files, schemas, sinks
from clausewise.streaming import ingest


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("条款一".encode("gbk"))
    (tmp_path / "b.csv").write_bytes("﻿标题,正文\n甲,内容一\n,内容二\n丙,nan\n".encode())
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.MD").write_text("深处")
    got = sorted((r.title, r.content) for r in files.documents(files.scan(spark, str(tmp_path))).collect())
    assert got == [("a", "条款一"), ("b-2", "内容二"), ("甲", "内容一")]
    assert files.scan(spark, str(tmp_path), recursive=True).count() == 3
    assert files.decode(b"\xff\xfe\x81") is not None and files.decode(None) is None


def test_uploads_requests_and_pages(spark, tmp_path):
    (tmp_path / "long.txt").write_text("长" * 30_000)
    (tmp_path / "empty.txt").write_text("  ")
    (tmp_path / "rows.csv").write_text("标题,正文\n一,乙\n二,甲\n三,丙\n")
    (tmp_path / "bad.csv").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.uploads(files.scan(spark, str(tmp_path))).collect()}
    assert got["long.txt"].content.endswith(files.TRUNCATED) and got["empty.txt"].problem == "empty"
    assert got["rows.csv"].content == "乙\n甲\n丙" and got["rows.csv"].title == "一" and got["rows.csv"].problem is None
    assert "bad.csv" not in got  # a file without a byte is no upload
    assert sorted((r.title, r.content) for r in files.table_documents(spark, str(tmp_path / "rows.csv")).collect()) == [("一", "乙"), ("三", "丙"), ("二", "甲")]
    assert files.parse("csv", "x", b"")[1] == "unreadable: EmptyDataError" and files.parse("bin", "x", b"1")[1] == "unknown kind"
    r = spark.createDataFrame([(1, "问", None), (2, "问", "文"), (3, " ", "文"), (4, None, "")], "request_id int, message string, file_text string")
    assert [(x.request_id, x.text, x.input_mode) for x in files.requests(r).orderBy("request_id").collect()] == [(1, "问", "text"), (2, "问\n\n文", "text+file"), (3, "文", "file")]
    p = spark.createDataFrame([("d", 1, "第一条\n\n- 3 -\n 正文 "), ("d", 2, None)], "document string, page_no int, text string")
    assert [x.line for x in files.page_lines(p).orderBy("line_no").collect()] == ["第一条", "正文"]


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id bigint, h string")
    sinks.append_new(rows, at, ["h"], "id")
    sinks.append_new(rows.union(spark.createDataFrame([(4, "c")], "id bigint, h string")), at, ["h"], "id")
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [1, 3, 4]
    chunks = str(tmp_path / "chunks")
    sinks.replace_documents(spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "document_id bigint, c string"), chunks, buckets=2)
    sinks.replace_documents(spark.createDataFrame([(1, "new")], "document_id bigint, c string"), chunks, buckets=2)
    assert sorted((r.document_id, r.c) for r in spark.read.parquet(chunks).collect()) == [(1, "new"), (2, "z")]
    v1 = sinks.write_merged(rows, str(tmp_path / "m"), "1", ["id"])
    assert spark.read.parquet(v1).count() == 3
    assert sinks.load_manifest(spark, str(tmp_path / "none")).count() == 0
    m = spark.createDataFrame([("p", "h", 1, "t")], "path string, sha256 string, document_id bigint, title string")
    sinks.save_manifest(m, str(tmp_path / "manifest"))
    assert sinks.load_manifest(spark, str(tmp_path / "manifest")).count() == 1
    f = spark.createDataFrame([("p", bytearray(b"1"))], "path string, content binary")
    known = f.select("path", F.sha2("content", 256).alias("sha256"))
    assert sinks.changed(f, known).count() == 0 and sinks.changed(f, known.limit(0)).count() == 1


def test_schemas(spark):
    for columns in schemas.SCHEMAS.values():
        assert spark.createDataFrame([], columns).count() == 0


def test_providers(spark):
    d = spark.createDataFrame([(1, "合规管理"), (2, None), (3, "")], "id int, t string")
    got = {r.id: r.vector for r in providers.embedded(d, "t").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and not any(got[2]) and not any(got[3])

    def fails(texts):
        raise RuntimeError("down")

    assert all(r.result is None for r in providers.in_batches(d, fails, "string", "t", wait_s=0).collect())


def test_stream(spark, tmp_path):
    rows = [(1, "正文" * 20, "2024-01-01 00:00:00"), (2, "正文" * 20, "2024-01-02 00:00:00"), (3, "短", "2024-01-01 00:00:00"), (4, "404 Not Found " + "x" * 40, "2024-01-01 00:00:00")]
    d = spark.createDataFrame(rows, "id bigint, content_text string, at string").select("id", "content_text", F.to_timestamp_ntz("at").alias("created_at"))
    d.write.parquet(str(tmp_path / "in"))
    got = ingest.ingest_available(spark, str(tmp_path / "i[n]"), d.schema, str(tmp_path / "out"), str(tmp_path / "state"))
    assert got.count() == 1
    # a date far ahead does not make later rows late; what is stored already is not stored again
    more = spark.createDataFrame([(5, "另文" * 20, "2090-01-01 00:00:00"), (6, "旧文" * 20, "1999-01-01 00:00:00"), (7, "正文" * 20, "2024-01-03 00:00:00")], "id bigint, content_text string, at string")
    more.select("id", "content_text", F.to_timestamp_ntz("at").alias("created_at")).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = ingest.ingest_available(spark, str(tmp_path / "i[n]"), d.schema, str(tmp_path / "out"), str(tmp_path / "state"))
    assert again.count() == 3
