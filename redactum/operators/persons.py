"""Person numbering (W1-W3, G4, G5, J4) and case-wide numbering.

Processing order (W1): runs ascending and, inside a run, the last mention
first (the reference splices right-to-left). The first mention of a person in
that order decides the person's initials (G5); the k-th new person with the
same initials in a document is numbered ``(k)`` (W2) and the number is dropped
when the initials are unique in the document (W3, structural: source text is
never edited). Windows are partitioned by document, which is a unit of
work, so no window partition grows with the collection.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import initials
from ..functions.substitutes import label_substitute
from ..session import scratch_path


def order_key(order: str = "reference"):
    if order == "reading":
        return F.struct(F.col("run_no"), F.col("start"))
    return F.struct(F.col("run_no"), (-F.col("start")).alias("neg_start"))


def persons(mentions: DataFrame, shift: int = 0, order: str = "reference",
            scope: str = "doc_id", fold: str = "reference") -> DataFrame:
    """mentions(doc_id, run_no, start, text, person_key) ->
    persons(doc_id, person_key, initials, ord, k, n_same, substitute)."""
    m = mentions.withColumn("ord", order_key(order)).withColumn("ini", initials(F.col("text"), shift, fold))
    p = (m.groupBy(scope, "person_key")
         .agg(F.min_by("ini", "ord").alias("initials"), F.min("ord").alias("ord"),
              F.count(F.lit(1)).alias("n_mentions")))
    w = Window.partitionBy(scope, "initials")
    p = (p.withColumn("k", F.row_number().over(w.orderBy("ord")))
         .withColumn("n_same", F.count(F.lit(1)).over(w)))
    sub = F.when(F.col("n_same") == 1, F.col("initials")).otherwise(
        F.concat(F.col("initials"), F.lit(" ("), F.col("k").cast("string"), F.lit(")")))
    return p.withColumn("substitute", sub)


def case_persons(mentions: DataFrame, shift: int = 0, order: str = "reference") -> DataFrame:
    """One substitute per person across a case's documents.

    Mentions are first reduced to one row per (case, document, person), so a
    case holding a third of all documents contributes one row per document
    and person, not per mention. Documents are ordered by doc_id. The
    numbering window is split: rows are range-partitioned on
    (case_id, initials, ord), each slice is ranked locally and shifted by the
    counts of the slices before it, so a hot (case, initials) group is never
    ranked in one task.
    """
    m = mentions.withColumn("ord", order_key(order)).withColumn("ini", initials(F.col("text"), shift))
    per_doc = (m.groupBy("case_id", "doc_id", "person_key")
               .agg(F.min_by("ini", "ord").alias("ini"), F.min("ord").alias("ord")))
    gord = F.struct(F.col("doc_id"), F.col("ord"))
    p = (per_doc.groupBy("case_id", "person_key")
         .agg(F.min_by("ini", gord).alias("initials"), F.min(gord).alias("gord")))
    return split_rank(p, ["case_id", "initials"], "gord")


def split_rank(df: DataFrame, keys: list, order_col: str, slices: int | None = None) -> DataFrame:
    """``rank_slices`` with the substitute of each person (skew-safe W2/W3)."""
    sub = F.when(F.col("n_same") == 1, F.col("initials")).otherwise(
        F.concat(F.col("initials"), F.lit(" ("), F.col("k").cast("string"), F.lit(")")))
    return rank_slices(df, keys, order_col, slices).withColumn("substitute", sub)


def rank_slices(df: DataFrame, keys: list, order_col: str, slices: int | None = None) -> DataFrame:
    """Exact row_number ``k`` and group count ``n_same`` over ``keys`` ordered
    by ``order_col`` without putting a whole group into one task."""
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = df.repartitionByRange(n, *[F.col(k) for k in keys], F.col(order_col))
    # written once: ranks and counts below must see the same slices, and a range
    # exchange that is planned twice may sample different bounds
    path = scratch_path(spark, f"ranked-{uuid.uuid4().hex}")
    x.withColumn("_slice", F.spark_partition_id()).write.parquet(path)
    x = spark.read.parquet(path)
    local = Window.partitionBy(*keys, "_slice").orderBy(order_col)
    x = x.withColumn("_lk", F.row_number().over(local))
    counts = x.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    wk = Window.partitionBy(*keys).orderBy("_slice")
    # one row per (group, slice): at most groups x slices rows
    counts = (counts.withColumn("_before", F.coalesce(F.sum("_c").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("n_same", F.sum("_c").over(Window.partitionBy(*keys))))
    x = x.join(counts, keys + ["_slice"])
    x = x.withColumn("k", (F.col("_lk") + F.col("_before")).cast("int"))
    return x.drop("_slice", "_lk", "_c", "_before")


def mention_substitutes(spans: DataFrame, keys: DataFrame, shift: int = 0,
                        order: str = "reference", fold: str = "reference") -> DataFrame:
    """Every kept span with its substitute; persons through their key."""
    per = (spans.where(F.col("label") == "PERSON")
           .join(keys.select(F.col("name").alias("text"), "person_key"), "text", "left"))
    ps = persons(per, shift, order, fold=fold)
    per = per.join(ps.select("doc_id", "person_key", "substitute"), ["doc_id", "person_key"], "left")
    other = spans.where(F.col("label") != "PERSON").withColumn(
        "substitute", label_substitute(F.col("label"), F.col("text"))).withColumn(
        "person_key", F.lit(None).cast("string"))
    return per.unionByName(other)
