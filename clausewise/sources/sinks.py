"""Writing: new rows, whole documents, merged versions, manifests, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators.durable import durable
from clausewise.operators.merge import merged, only_new


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at `path`."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def append_new(rows: DataFrame, path: str, key: list[str], order: str) -> None:
    """Adds the rows whose key the table at `path` does not have yet, the first of each key."""
    spark = rows.sparkSession
    old = spark.read.parquet(path).select(*key) if exists(spark, path) else rows.select(*key).limit(0)
    only_new(rows, old, key, order).write.mode("append").parquet(path)


def replace_documents(chunks: DataFrame, path: str, document: str = "document_id", buckets: int = 64) -> None:
    """Puts a document's new chunks in place of its old ones, leaving other documents' as they are.

    Documents lie in `buckets` folders by hash; only the folders of the new documents are written again, so neither small
    documents make a folder each nor the whole table is rewritten.
    """
    spark = chunks.sparkSession
    new = chunks.withColumn("bucket", F.pmod(F.xxhash64(document), F.lit(buckets)).cast("int"))
    rows = new
    if exists(spark, path):
        touched = new.select("bucket").distinct()
        kept = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi").join(new.select(document).distinct(), document, "left_anti")
        # the kept rows are read from the folders that are written: they are cut loose first
        rows = durable(new.unionByName(kept.select(*new.columns)))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_merged(new: DataFrame, path: str, version: str, key: list[str], keep_if_empty: tuple[str, ...] = ()) -> str:
    """Writes the table at `path` merged with the new rows to a new version beside it, and returns that; the old version stays readable."""
    spark = new.sparkSession
    rows = merged(new, spark.read.parquet(path).select(*new.columns), key, keep_if_empty) if exists(spark, path) else new
    to = f"{path}.{version}"
    rows.write.parquet(to)
    return to


def save_manifest(files: DataFrame, path: str) -> None:
    """The manifest (path, sha256, document_id, title) of what was ingested."""
    files.select("path", "sha256", "document_id", "title").write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, empty if there is none or it cannot be read as one."""
    columns = "path string, sha256 string, document_id bigint, title string"
    return spark.read.schema(columns).json(path).where("path is not null") if exists(spark, path) else spark.createDataFrame([], columns)


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The scanned files that a manifest does not have with the same content."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    return hashed.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")


def drop_table(spark: SparkSession, name: str, confirmation: str) -> bool:
    """Drops a table if the confirmation repeats its name; says whether it did."""
    if confirmation != name:
        return False
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return True


def write_reports(reports: DataFrame, path: str) -> None:
    """One text row for each (report)."""
    reports.select("report").write.mode("overwrite").text(path, lineSep="\n\n---\n\n")


def truncate_table(spark: SparkSession, name: str, confirmation: str) -> bool:
    """Empties a table if the confirmation repeats its name; says whether it did."""
    if confirmation != name:
        return False
    spark.sql(f"TRUNCATE TABLE {name}")
    return True


def evolved(spark: SparkSession, path: str, dropped: tuple[str, ...] = ()) -> DataFrame:
    """The table at `path` with the columns of all its files, null where a file is older than a column, and without the dropped ones."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop(*dropped)
