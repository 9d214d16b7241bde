"""Files of a folder as (title, content) documents, by extension."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.functions.text import collapsed

EXTENSIONS = ("csv", "xlsx", "xls", "txt", "md", "pdf", "docx")
#: Columns that may hold a table's titles and contents, the first that says something counts (fixed values).
TITLE_COLUMNS = ["标题", "文章标题", "name", "Name", "Title", "subject"]
CONTENT_COLUMNS = ["文章内容", "正文", "内容", "摘要", "Content", "content", "text"]
#: Largest upload in bytes and characters kept of one.
UPLOAD_BYTES, UPLOAD_CHARS = 15 * 1024 * 1024, 20_000
TRUNCATED = "\n...[truncated]"
DOCUMENT = "path string, title string, content string"


def scan(spark: SparkSession, folder: str, recursive: bool = False, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, name, stem, extension, size, content) of the folder's files of the extensions, in any case of letters; others, and files without a byte, are left out."""
    either = "{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*.{either}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, "\\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, "\\.([^.]*)$", 1)).alias("extension"), F.col("length").alias("size"), "content")


def decode(raw: bytes | None) -> str | None:
    """Bytes as text: UTF-8 with or without a mark, else GBK, else UTF-8 without what does not decode."""
    if raw is None:
        return None
    for encoding in ("utf-8-sig", "gbk"):
        try:
            return bytes(raw).decode(encoding)
        except UnicodeDecodeError:
            continue
    return bytes(raw).decode("utf-8", "ignore")


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(decode)


def says(value: object) -> bool:
    return value is not None and str(value).strip().lower() not in ("", "nan", "none", "null")


def table_rows(frame: pd.DataFrame, stem: str) -> list[tuple[str, str]]:
    """(title, content) of each row that has a content; a row without title is called after the file and its number."""
    out = []
    for i, row in enumerate(frame.to_dict("records")):
        content = next((str(row[c]).strip() for c in CONTENT_COLUMNS if c in row and says(row[c])), "")
        title = next((str(row[c]).strip() for c in TITLE_COLUMNS if c in row and says(row[c])), f"{stem}-{i + 1}")
        if content:
            out.append((title, content))
    return out


def parse(extension: str, stem: str, raw: bytes) -> tuple[list[tuple[str, str]], str | None]:
    """(title, content) documents of one file in order, and what was wrong with it: its library is not installed, or it cannot be read."""
    try:
        if extension in ("txt", "md"):
            return [(stem, decode(raw).strip())], None
        if extension == "csv":
            return table_rows(pd.read_csv(io.StringIO(decode(raw)), dtype=str), stem), None
        if extension in ("xlsx", "xls"):
            return table_rows(pd.read_excel(io.BytesIO(raw), dtype=str), stem), None
        if extension == "pdf":
            from pypdf import PdfReader

            return [(stem, "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages))], None
        if extension == "docx":
            import docx

            return [(stem, "\n".join(p.text for p in docx.Document(io.BytesIO(raw)).paragraphs if p.text.strip()))], None
    except ImportError as e:
        return [], f"no reader: {e.name}"
    except (ValueError, OSError) as e:
        return [], f"unreadable: {type(e).__name__}"
    return [], "unknown kind"


def parsed(files: DataFrame) -> DataFrame:
    """(path, place, title, content, problem) of scanned files: their documents in order, from place 1; one without any has a row with its problem, or 'empty'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, extension, stem, raw in zip(pdf["path"], pdf["extension"], pdf["stem"], pdf["content"]):
                found, problem = parse(extension, stem, bytes(raw))
                found = [(t, c) for t, c in found if c]
                rows += [(path, i, t, c, None) for i, (t, c) in enumerate(found, 1)] or [(path, 0, None, None, problem or "empty")]
            yield pd.DataFrame(rows, columns=["path", "place", "title", "content", "problem"])

    return files.select("path", "extension", "stem", "content").mapInPandas(run, "path string, place int, title string, content string, problem string")


def documents(files: DataFrame) -> DataFrame:
    """(path, title, content) of scanned files; an unreadable or empty file gives no row (see `parsed` for why)."""
    return parsed(files).where("problem is null").select("path", "title", "content")


def table_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, content) of CSV files of any size in UTF-8, read by Spark in splits: the first of the usual columns that says something counts.

    Rows without a content are left out; one without a title has none, as rows have no number across splits.
    """
    rows = spark.read.option("header", True).option("escape", '"').csv(path).withColumn("_path", F.input_file_name())

    def first(names: list[str]):
        some = [F.when(~F.lower(F.trim(F.col(f"`{n}`"))).isin("", "nan", "none", "null"), F.trim(F.col(f"`{n}`"))) for n in names if n in rows.columns]
        return F.coalesce(*some, F.lit(None).cast("string"))

    return rows.select(F.col("_path").alias("path"), first(TITLE_COLUMNS).alias("title"), first(CONTENT_COLUMNS).alias("content")).where("content is not null")


def uploads(files: DataFrame) -> DataFrame:
    """(path, title, content, problem) of uploaded files: too large, of no known kind, unreadable or empty ones come with a problem; rows of a table keep their order; long ones are cut with a mark."""
    known = files.withColumn("problem", F.when(F.col("size") > UPLOAD_BYTES, "too large").when(~F.col("extension").isin(*EXTENSIONS), "unknown kind"))
    rows = parsed(known.where("problem is null"))
    # an upload has few bytes, so one row holds its rows
    whole = rows.groupBy("path").agg(F.min_by("title", "place").alias("title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), "\n").alias("content"), F.max("problem").alias("why"))
    cut = F.when(F.char_length("content") > UPLOAD_CHARS, F.concat(F.substring("content", 1, UPLOAD_CHARS), F.lit(TRUNCATED))).when(F.col("content") != "", F.col("content"))
    return known.select("path", "problem").join(whole, "path", "left").select("path", "title", cut.alias("content"), F.coalesce("problem", "why").alias("problem"))


def requests(messages: DataFrame) -> DataFrame:
    """(request_id, text, input_mode) of (request_id, message, file_text): what was asked, from the message, the file or both; blank ones are left out."""
    m, f = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("message", "file_text"))
    mode = F.when((m != "") & (f != ""), "text+file").when(f != "", "file").otherwise("text")
    return messages.select("request_id", F.concat_ws("\n\n", F.when(m != "", m), F.when(f != "", f)).alias("text"), mode.alias("input_mode")).where("text <> ''")


def page_lines(pages: DataFrame) -> DataFrame:
    """(document, page_no, line_no, line) of (document, page_no, text), blanks collapsed; empty lines and page numbers are left out."""
    lined = pages.select("document", "page_no", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\r?\\n")).alias("p", "raw"))
    line = collapsed(F.col("raw"))
    return lined.select("document", "page_no", (F.col("p") + 1).alias("line_no"), line.alias("line")).where((F.col("line") != "") & ~F.col("line").rlike("^[-—–\\s]*(?:第\\s*)?\\d{1,4}(?:\\s*/\\s*\\d{1,4})?(?:\\s*页)?[-—–\\s]*$"))
