"""File sources and sinks.

A document is one whole file; folders are read with the text source in
whole-text mode (one row per file, split across executors by file) or the
binary source for admission checks. Nothing is listed or read on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------
ALLOWED_SUFFIXES = [".xml", ".txt"]
# ---------------------------------------------------------------------------


def suffix_of(name):
    return F.regexp_extract(name, r"^(.*?)(\.[^.]+)?$", 2)


def stem_of(name):
    return F.regexp_extract(name, r"^(.*?)(\.[^.]+)?$", 1)


def fmt_of(name):
    """Markup mode for a lower-cased ``.xml`` suffix, plain otherwise."""
    return F.when(F.lower(suffix_of(name)) == ".xml", F.lit("xml")).otherwise(F.lit("txt"))


def file_name():
    """Name of the file a row comes from; the path is a URI, where a ``+`` is a plus."""
    last = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """``*.xml`` and ``*.txt`` of one folder (not recursive) ->
    docs(doc_id, name, fmt, text). Line ends are normalised to LF, as a
    text-mode read does."""
    # text() applies its own keyword defaults, so the options go there
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.{xml,txt}", recursiveFileLookup=False)
    return df.select(file_name().alias("name"), F.regexp_replace("value", "\r\n?", "\n").alias("text")).select(
        F.col("name").alias("doc_id"), "name", fmt_of(F.col("name")).alias("fmt"), "text")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files as (name, content) for admission (S3)."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def admission(files: DataFrame) -> DataFrame:
    """S3: suffix allow-list, valid UTF-8; the first failing rule is the
    reason. files(name, content BINARY, ...) -> + size, status, reason. The
    size is information: documents of any size are worked."""
    size = F.octet_length("content")
    ok_suffix = F.lower(suffix_of(F.col("name"))).isin(ALLOWED_SUFFIXES)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    reason = F.when(~ok_suffix, F.lit("suffix")).when(~utf8, F.lit("encoding"))
    return files.withColumn("size", size.cast("long")).withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), F.lit("accepted")).otherwise(F.lit("rejected")))


def assign_cases(manifest: DataFrame, cases: DataFrame) -> DataFrame:
    """manifest(doc_id, case_id, new_case_id) with the existing case id
    and/or a new one (trimmed). Both given -> rejected; an unknown new id is
    created once. Output: doc_id, case_id, status, created."""
    new = F.trim(F.col("new_case_id"))
    x = manifest.withColumn("new", F.when(new != "", new))
    both = F.col("case_id").isNotNull() & F.col("new").isNotNull()
    known = cases.select(F.col("case_id").alias("new"), F.lit(True).alias("known"))
    x = x.join(known, "new", "left")
    return x.select(
        "doc_id",
        F.when(both, F.lit(None)).otherwise(F.coalesce("new", "case_id")).alias("case_id"),
        F.when(both, F.lit("rejected")).when(F.col("new").isNotNull() | F.col("case_id").isNotNull(), F.lit("ok"))
        .otherwise(F.lit("none")).alias("status"),
        (~both & F.col("new").isNotNull() & F.col("known").isNull()).alias("created"))


def new_cases(assigned: DataFrame) -> DataFrame:
    """Each new case id created once."""
    return assigned.where("created").select("case_id").distinct()


def result_name(name):
    """``<stem>_anon<suffix>``."""
    return F.concat(stem_of(name), F.lit("_anon"), suffix_of(name))


def write_results(results: DataFrame, path: str, run_id: str) -> None:
    """Results written under ``run_id=...``; a rerun of the same run id
    replaces only its own partition."""
    (results.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def ingest_bucketed(docs: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """One-time ingest of documents into a table bucketed (and sorted) by
    doc_id. Reads of the table carry a hash partitioning on doc_id, so a
    redaction run with ``Config(clustered=True)`` does not shuffle the
    text at all; the bucket count is the run's parallelism."""
    w = docs.write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy("doc_id").format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
