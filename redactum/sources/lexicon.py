"""The inflection table that name keys are made with.

A lexicon is a text file of analyses, one a line: the form, the number of the
analysis among those of the form, its lemma and its tag, separated by tabs, e.g.
``Kowalskiego<TAB>0<TAB>Kowalski<TAB>subst:sg:gen:m1``. Lemmas may carry a suffix
after a colon. Blank lines and those that begin with ``#`` are skipped; lines of
another shape are quarantined, not dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    line = F.regexp_replace("value", "\r$", "")
    x = spark.read.text(path).select(line.alias("line")).where("trim(line) <> '' AND NOT startswith(line, '#')")
    part = F.split("line", "\t", -1)
    ord_ = F.try_to_number(F.trim(F.get(part, F.lit(1))), F.lit("999999999")).cast("int")
    fine = (F.size(part) == 4) & (F.trim(F.get(part, F.lit(0))) != "") & ord_.isNotNull() & (F.trim(F.get(part, F.lit(3))) != "")
    field = lambda k: F.trim(F.get(part, F.lit(k)))
    return x.select("line", F.coalesce(fine, F.lit(False)).alias("fine"), field(0).alias("orth"), ord_.alias("ord"),
                    field(2).alias("lemma"), field(3).alias("tag"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """lemmas(orth, ord, lemma, tag), each analysis once."""
    return _lines(spark, path).where("fine").select("orth", "ord", "lemma", "tag").distinct()


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of the lines that are no analysis."""
    return _lines(spark, path).where("NOT fine").select("line")


def ingest_lexicon(lemmas: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Write the lexicon once as a table bucketed by form: runs then join their
    distinct words to it without moving it."""
    w = lemmas.write.mode("overwrite").bucketBy(buckets, "orth").sortBy("orth", "ord").format("parquet")
    (w.option("path", path) if path else w).saveAsTable(table)
