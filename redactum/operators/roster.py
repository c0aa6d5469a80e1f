"""Person rosters per document and per case.

The case roster is kept as a normalised table ``(case_id, person_key,
initials)`` rather than one JSON map per case: merging is a groupBy on
(case, person) and never collects a whole case into one row; removals are
tombstones in a roster log where the latest operation wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .persons import rank_slices


def doc_roster(persons: DataFrame) -> DataFrame:
    """(doc_id, person_key, initials); the number is dropped when the
    initials are unique in the document, as in the rewritten text."""
    return persons.select("doc_id", "person_key", F.col("substitute").alias("initials"))


def merge_case_roster(doc_rosters: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Key union over a case's documents; for a key present in several
    documents the last completed document (greatest seq) wins."""
    return (doc_rosters.groupBy("case_id", "person_key")
            .agg(F.max_by("initials", F.col(seq_col)).alias("initials")))


def completed(doc_rosters: DataFrame, ledger: DataFrame, current: bool = False) -> DataFrame:
    """The rosters of documents that were done, with ``done`` = (ts, seq)
    of their last done event, the order of completion. Documents that never
    were add nothing; with ``current`` only those whose latest state is done
    (Q8: the merged view keeps what later retries and failures took back)."""
    at = F.struct("ts", "seq")
    done = (ledger.groupBy("doc_id").agg(F.max(F.when(F.col("status") == "done", at)).alias("done"), F.max(at).alias("last"))
            .where(F.col("done").isNotNull()))
    if current:
        done = done.where(F.col("done") == F.col("last"))
    return doc_rosters.join(done.select("doc_id", "done"), "doc_id")


def roster_log(doc_rosters: DataFrame, removals: DataFrame) -> DataFrame:
    """Append-only roster log: merges (op 'put') and removals (op 'del')."""
    puts = doc_rosters.select("case_id", "person_key", "initials", F.lit("put").alias("op"), F.col("seq"))
    dels = removals.select("case_id", "person_key", F.lit(None).cast("string").alias("initials"),
                           F.lit("del").alias("op"), F.col("seq"))
    return puts.unionByName(dels)


def current_roster(log: DataFrame) -> DataFrame:
    """Latest operation per (case, person) wins; deleted keys vanish."""
    last = log.groupBy("case_id", "person_key").agg(F.max_by(F.struct("op", "initials"), F.col("seq")).alias("l"))
    return last.where(F.col("l.op") == "put").select("case_id", "person_key", F.col("l.initials").alias("initials"))


def removal_found(roster: DataFrame, removals: DataFrame) -> DataFrame:
    """Whether each removal request named a person in the roster."""
    present = roster.select("case_id", "person_key", F.lit(True).alias("found"))
    return (removals.select("case_id", "person_key").join(present, ["case_id", "person_key"], "left")
            .select("case_id", "person_key", F.coalesce("found", F.lit(False)).alias("found")))


def roster_json(roster: DataFrame) -> DataFrame:
    """(case_id, person_key, json), one JSON line per person and one per
    case with the number of its persons (person_key null); non-ASCII kept.

    The same lines at every size, instead of one map per case that a single
    row would have to hold."""
    line = F.to_json(F.struct("case_id", F.col("person_key").alias("person"), "initials"), {"ignoreNullFields": "false"})
    counts = roster.groupBy("case_id").agg(F.count(F.lit(1)).alias("count"))
    total = F.to_json(F.struct("case_id", "count"), {"ignoreNullFields": "false"})
    return roster.select("case_id", "person_key", line.alias("json")).unionByName(
        counts.select("case_id", F.lit(None).cast("string").alias("person_key"), total.alias("json")))


def sorted_roster(roster: DataFrame) -> DataFrame:
    """O2: roster rows with their position in person order; a case is ranked
    in slices, so none is sorted in one task."""
    return rank_slices(roster, ["case_id"], "person_key").withColumnRenamed("k", "rn").drop("n_same")
