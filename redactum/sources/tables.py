"""Test-table roles: which given table plays which part of the data model.

``documents`` are plain-text documents (``source`` is the case), ``pages.html``
is markup, ``conversations`` are documents whose turns are runs, ``events``
is the processing ledger (``user_id`` = document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: event type -> ledger status ------------------------------
STATUS_OF_EVENT = {"view": "pending", "click": "processing", "purchase": "done",
                   "error": "failed", "signup": "cancelled"}
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.lit("txt").alias("fmt"), F.col("source").alias("case_id"))


def markup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.lit("xml").alias("fmt"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> ledger(doc_id, ts, seq, status, value)."""
    m = F.create_map(*[x for kv in STATUS_OF_EVENT.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("seq"),
        m[F.col("event_type")].alias("status"), F.col("value").alias("duration"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name variants derived from part names: titles, hyphens, dashes."""
    p = table(spark, sf_dir, "part")
    w1 = F.split("p_name", " ").getItem(0)
    w2 = F.element_at(F.split("p_name", " "), -1)
    k = F.pmod(F.col("p_partkey"), F.lit(6))
    name = (F.when(k == 0, F.concat(F.upper(F.substring(w1, 1, 1)), w1.substr(F.lit(2), F.length(w1)), F.lit(" "),
                                    F.upper(F.substring(w2, 1, 1)), w2.substr(F.lit(2), F.length(w2))))
            .when(k == 1, F.concat(F.lit("dr "), F.col("p_name")))
            .when(k == 2, F.concat(w1, F.lit(" -"), w2))
            .when(k == 3, F.concat(F.lit("pani "), w1, F.lit(" "), w2, F.lit("-"), w1))
            .when(k == 4, F.concat(w1, F.lit(" – "), w2))
            .otherwise(F.concat(F.lit("Prof. mgr "), w1, F.lit(" - "), w2)))
    return p.select(name.alias("name"), F.col("p_name"), F.col("p_partkey"))


PART_NAMES_SQL = """(SELECT CASE p_partkey % 6
    WHEN 0 THEN upper(substring(string_split(p_name, ' ')[1], 1, 1)) || substring(string_split(p_name, ' ')[1], 2) || ' '
                || upper(substring(string_split(p_name, ' ')[-1], 1, 1)) || substring(string_split(p_name, ' ')[-1], 2)
    WHEN 1 THEN 'dr ' || p_name
    WHEN 2 THEN string_split(p_name, ' ')[1] || ' -' || string_split(p_name, ' ')[-1]
    WHEN 3 THEN 'pani ' || string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[-1] || '-' || string_split(p_name, ' ')[1]
    WHEN 4 THEN string_split(p_name, ' ')[1] || ' – ' || string_split(p_name, ' ')[-1]
    ELSE 'Prof. mgr ' || string_split(p_name, ' ')[1] || ' - ' || string_split(p_name, ' ')[-1] END AS name,
    p_name, p_partkey FROM part)"""
