"""Processing ledger: an append-only table of status events per document.

ledger(doc_id, ts, seq, status, ...). The latest state of a document is the
event with the greatest (ts, seq) (T3); subsets (F4), work selection (J6, J7),
bulk erase (J8), stop/retry resolution (T4), overdue detection (T6), interval
throughput (T7), sessions (T8), day/status cube (G14) and case summaries (G9,
O1) are ordinary aggregations and joins over it. Everything is keyed by
document or case; aggregation is partial before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------
PENDING, PROCESSING, DONE, FAILED, CANCELLED = "pending", "processing", "done", "failed", "cancelled"
FINISHED = [DONE, FAILED, CANCELLED]
IN_PROGRESS = [PENDING, PROCESSING]
OVERDUE_SECONDS = 1800
# ---------------------------------------------------------------------------


def latest(ledger: DataFrame) -> DataFrame:
    """latest(doc_id, status, ts, n_events)."""
    k = F.struct("ts", "seq")
    return (ledger.groupBy("doc_id")
            .agg(F.max_by("status", k).alias("status"), F.max("ts").alias("ts"),
                 F.count(F.lit(1)).alias("n_events")))


def subsets(lat: DataFrame, resolved: DataFrame) -> DataFrame:
    """pending / in progress / finished / stopping flags of the latest
    state; ``resolved`` are the documents with requests (T4)."""
    s = F.col("status")
    x = lat.select("doc_id", "status").join(resolved.select("doc_id", "stopping"), "doc_id", "left")
    return x.select("doc_id", "status", (s == PENDING).alias("pending"), s.isin(IN_PROGRESS).alias("in_progress"),
                    s.isin(FINISHED).alias("finished"), F.coalesce("stopping", F.lit(False)).alias("stopping"))


def todo(docs: DataFrame, lat: DataFrame) -> DataFrame:
    """Documents whose latest state is pending (a rerun picks up only those)."""
    return docs.join(lat.where(F.col("status") == PENDING).select("doc_id"), "doc_id", "left_semi")


def withdrawn(lat: DataFrame) -> DataFrame:
    return lat.where(F.col("status") == CANCELLED).select("doc_id")


def publish(results: DataFrame, lat: DataFrame) -> DataFrame:
    """Drop results of documents withdrawn meanwhile."""
    return results.join(withdrawn(lat), "doc_id", "left_anti")


def erase(selected: DataFrame, lat: DataFrame) -> DataFrame:
    """Erase the selected documents except those processing."""
    x = selected.select("doc_id").distinct().join(lat.select("doc_id", "status"), "doc_id", "left")
    return x.select("doc_id", F.when(F.col("status") == PROCESSING, F.lit("skipped"))
                    .otherwise(F.lit("deleted")).alias("outcome"))


def resolve_requests(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """T4: ledger(doc_id, ts, seq, status), requests(doc_id, ts, seq, request
    in {stop, retry}) -> one row per document that has a request: its ledger
    status, the newest request after that status and its outcome (null if the
    status is newer), the status that results, whether a running attempt is
    to be stopped, and the number of its attempts (accepted retries + 1).

    Requests take their place among the events (after an event of the same
    ts and seq) and meet the state that holds there: what the events say, as
    changed by earlier requests since the last event. While a document is
    processing, no request changes that state; otherwise a retry makes it
    pending, and a stop cancels it if it is pending. A request before the
    first event finds no document and does nothing.
    """
    none = F.lit(None).cast("string")
    x = (ledger.select("doc_id", "ts", "seq", F.lit(0).alias("kind"), "status", none.alias("request"))
         .unionByName(requests.select("doc_id", "ts", "seq", F.lit(1).alias("kind"), none.alias("status"), "request")))
    w = Window.partitionBy("doc_id").orderBy("ts", "seq", "kind")
    x = (x.withColumn("base", F.last("status", ignorenulls=True).over(w))
         .withColumn("epoch", F.count("status").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    since = Window.partitionBy("doc_id", "epoch").orderBy("ts", "seq", "kind")
    before = since.rowsBetween(Window.unboundedPreceding, -1)
    q, base, prev = F.col("request"), F.col("base"), F.lag("request").over(since)
    retried = F.coalesce(F.max(q == "retry").over(before), F.lit(False))
    state = (F.when(base.isNull() | (base == PROCESSING) | prev.isNull(), base)
             .when(prev == "retry", F.lit(PENDING))
             .when(retried | (base == PENDING), F.lit(CANCELLED)).otherwise(base))
    s = F.col("state")
    outcome = (F.when(q.isNull(), none)
               .when(s.isNull(), F.lit("noop"))
               .when((q == "stop") & (s == PENDING), F.lit("cancelled"))
               .when((q == "stop") & (s == PROCESSING), F.lit("stopping"))
               .when(q == "stop", F.lit("noop"))
               .when(s == PROCESSING, F.lit("refused"))
               .otherwise(F.lit("requeued")))
    x = x.withColumn("state", state).withColumn("outcome", outcome)
    # the last row of a document holds its state; stops since its last event are seen by epoch
    at = F.struct("epoch", "ts", "seq", "kind")
    last = x.groupBy("doc_id").agg(
        F.max_by(F.struct("base", "state", "request", "outcome"), at).alias("l"),
        F.max("epoch").alias("epoch"),
        F.max(F.when(F.col("outcome") == "stopping", F.col("epoch"))).alias("stop_epoch"),
        F.count_if(F.col("outcome") == "requeued").alias("retries"), F.count("request").alias("n_requests"))
    stopping = F.coalesce((F.col("l.base") == PROCESSING) & (F.col("stop_epoch") == F.col("epoch")), F.lit(False))
    result = (F.when(stopping | (F.col("l.outcome") == "cancelled"), F.lit(CANCELLED))
              .when(F.col("l.outcome") == "requeued", F.lit(PENDING)).otherwise(F.col("l.state")))
    return last.where("n_requests > 0").select(
        "doc_id", F.col("l.base").alias("status"), F.col("l.request").alias("request"),
        F.col("l.outcome").alias("outcome"), result.alias("new_status"), stopping.alias("stopping"),
        (F.col("retries") + 1).alias("attempt"))


def overdue(lat: DataFrame, asof, limit_s: int = OVERDUE_SECONDS) -> DataFrame:
    """Processing for longer than ``limit_s`` at ``asof``."""
    age = F.unix_timestamp(F.lit(asof).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return (lat.where(F.col("status") == PROCESSING).withColumn("age_s", age)
            .where(F.col("age_s") > F.lit(limit_s)))


def throughput(ledger: DataFrame, every: str = "1 hour", slide: str | None = None) -> DataFrame:
    """T7 (batch form): finished documents per interval and their mean
    duration; tumbling, or sliding when ``slide`` is given."""
    win = F.window("ts", every, slide) if slide else F.window("ts", every)
    return (ledger.where(F.col("status") == DONE)
            .groupBy(win.alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("avg_s")))


def sessions(ledger: DataFrame, key: str, gap: str = "30 minutes", sub_key: str = "doc_id") -> DataFrame:
    """Gap-based work sessions per key (e.g. case).

    Pre-aggregated so a hot case is not sessionised event by event in one
    task: sessions are first built per (key, sub_key) (e.g. per document),
    their intervals [first, last + gap) are merged per key and day of their
    start, and what is left, at most one interval per gap, per key;
    overlapping intervals chain exactly as the events do."""
    s1 = (ledger.groupBy(key, sub_key, F.session_window("ts", gap).alias("s"))
          .agg(F.count(F.lit(1)).alias("n"))
          .select(key, F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), "n"))
    by_day = _merged(s1.withColumn("day", F.date_trunc("day", "s_start")), [key, "day"])
    return _merged(by_day, [key]).select(key, F.struct(F.col("s_start").alias("start"), F.col("s_end").alias("end")).alias("s"), "n")


def _merged(intervals: DataFrame, keys: list) -> DataFrame:
    """Overlapping intervals (s_start, s_end, n) of the same keys as one."""
    w = Window.partitionBy(*keys).orderBy("s_start", "s_end")
    prev_end = F.max("s_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = intervals.withColumn("new", F.when(prev_end.isNull() | (F.col("s_start") >= prev_end), 1).otherwise(0))
    x = x.withColumn("sid", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "sid").agg(F.min("s_start").alias("s_start"), F.max("s_end").alias("s_end"), F.sum("n").alias("n"))


def by_day_status(ledger: DataFrame) -> DataFrame:
    """Events per day and status with all sub-totals (cube)."""
    day = F.date_format(F.col("ts"), "yyyy-MM-dd").alias("day")
    return (ledger.cube(day, F.col("status"))
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")))


def newest_per_case(docs: DataFrame, created: DataFrame, n: int = 3) -> DataFrame:
    """O1: newest n documents per case (created desc, doc_id)."""
    x = docs.join(created, "doc_id", "left")
    w = Window.partitionBy("case_id").orderBy(F.col("created").desc_nulls_last(), F.col("doc_id"))
    return x.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def case_summary(docs: DataFrame, lat: DataFrame, roster: DataFrame) -> DataFrame:
    """Documents, done documents and persons per case, zero-filled."""
    d = (docs.join(lat.select("doc_id", "status"), "doc_id", "left").groupBy("case_id")
         .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("status") == DONE).alias("n_done")))
    p = roster.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_persons"))
    return d.join(p, "case_id", "left").select("case_id", "n_docs", "n_done",
                                               F.coalesce("n_persons", F.lit(0)).alias("n_persons"))
