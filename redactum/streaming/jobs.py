"""Structured Streaming jobs.

T1: arriving documents (rows, or ``.xml`` and ``.txt`` files) are redacted by
running the batch plan inside ``foreachBatch``; a document is one row and
numbering is per document, so a stream gives the same result as a batch. Each
micro-batch writes its own ``batch_id=`` partition with overwrite, so a
replayed batch after a failure replaces its own output (idempotent sink);
``lifecycle`` is the job with claims, requests and failures. T2 drops duplicate
submissions of any age, T3 and T5 keep the latest states and the case roster,
each against a state table of which a batch rewrites only the buckets it
touches (``tables``). T7 counts finished documents per event-time window with
a watermark (late rows are dropped). Checkpoints live under the cluster's
checkpoint folder.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import roster as R
from ..plans.pipeline import Redaction
from ..session import checkpoint_dir
from ..sources.files import file_name, fmt_of
from .tables import Batch, State, Store, newest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _paths(spark: SparkSession, name: str, path: str | None = None):
    """(output, checkpoint) of a stream: under ``path``, or a folder of its own."""
    base = path or f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"
    return f"{base}/out", f"{base}/checkpoint"


def _drain(writer, checkpoint: str) -> None:
    """Run a stream until its source has no more."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def document_stream(spark: SparkSession, folder: str, file_glob: str = "documents*.parquet",
                    max_files: int | None = None) -> DataFrame:
    """Arriving documents; ``max_files`` bounds the files of one micro-batch.

    What ``file_glob`` names may be files or folders of part files: the glob is
    part of the path (a ``pathGlobFilter`` sees names of files only)."""
    s = spark.readStream.schema(DOC_SCHEMA)
    if max_files:
        s = s.option("maxFilesPerTrigger", max_files)
    return s.parquet(f"{folder.rstrip('/')}/{file_glob}")


def file_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Arriving ``.xml`` and ``.txt`` files, each one row
    docs(doc_id, name, fmt, text), as ``sources.files.read_folder`` reads them."""
    options = {"maxFilesPerTrigger": max_files} if max_files else {}
    df = spark.readStream.options(**options).text(folder, wholetext=True, pathGlobFilter="*.{xml,txt}", recursiveFileLookup=False)
    return df.select(file_name().alias("name"), F.regexp_replace("value", "\r\n?", "\n").alias("text")).select(
        F.col("name").alias("doc_id"), "name", fmt_of(F.col("name")).alias("fmt"), "text")


def event_stream(spark: SparkSession, folder: str, file_glob: str = "events*.parquet", max_files: int | None = None) -> DataFrame:
    """Ledger events; event time is cast to TIMESTAMP (watermarks need it;
    the session time zone is UTC, so wall-clock values are unchanged)."""
    s = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        s = s.option("maxFilesPerTrigger", max_files)
    s = s.parquet(f"{folder.rstrip('/')}/{file_glob}")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


Redact = Callable[[DataFrame], Redaction]  # docs(doc_id, text, fmt) -> its plan


def redact_stream(spark: SparkSession, folder: str, redact: Redact, out: str | None = None,
                  docs: DataFrame | None = None) -> str:
    """Documents arriving in ``folder`` -> redacted parquet at the returned
    path. ``docs(doc_id, text, fmt)`` is another stream to read, e.g. ``file_stream``."""
    out_path, ckpt = _paths(spark, "redact")
    out_path = out or out_path
    arriving = docs if docs is not None else document_stream(spark, folder).withColumn("fmt", F.lit("txt"))

    def per_batch(batch: DataFrame, batch_id: int):
        r = redact(batch.select("doc_id", "text", "fmt"))
        r.redacted().write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        r.discard()

    _drain(arriving.writeStream.foreachBatch(per_batch), ckpt)
    return out_path


SUBMISSIONS = State("doc_id long, ts timestamp, event_id long", ("doc_id",))


def dedup_stream(spark: SparkSession, folder: str, max_files: int | None = None, path: str | None = None) -> Store:
    """The first submission of each document, whenever the others come.

    A batch joins its ids with the known ids of the buckets they fall into,
    keeps those that are new (the earliest submission of a batch counts) and
    adds them to the known ids under the same manifest: a duplicate of any age
    is no row, and the state grows by a slim row a document. The store's table
    ``accepted`` holds (doc_id, ts, event_id)."""
    out_path, ckpt = _paths(spark, "dedup", path)
    store = Store(spark, out_path, {"accepted": SUBMISSIONS.schema}, {"known": SUBMISSIONS})

    def per_batch(batch: DataFrame, batch_id: int):
        if store.committed(batch_id):
            return
        work = store.begin(batch_id)
        first = F.min(F.struct("ts", "event_id"))
        asked = work.keep("asked", batch.where("doc_id IS NOT NULL").groupBy("doc_id").agg(first.alias("x")).select("doc_id", "x.*"))
        known = work.current("known", asked)
        new = work.keep("new", asked.join(known.select("doc_id"), "doc_id", "left_anti"))
        work.append("accepted", new)
        work.upsert("known", new, lambda old, more: old.unionByName(more))
        work.commit()
        work.discard()

    s = (event_stream(spark, folder, max_files=max_files).where(F.col("event_type") == "view")
         .select(F.col("user_id").alias("doc_id"), "ts", "event_id"))
    _drain(s.writeStream.foreachBatch(per_batch), ckpt)
    return store


def throughput_stream(spark: SparkSession, folder: str, every: str = "1 hour", delay: str = "1 hour") -> str:
    """Finished documents per tumbling window, update mode: every batch
    writes the windows it changed, open ones too, as its own ``batch_id=``
    partition (a replayed batch replaces it); ``current_throughput`` reads
    the newest row of each window. Rows later than the watermark are
    dropped, which bounds the state."""
    out_path, ckpt = _paths(spark, "throughput")
    led = (event_stream(spark, folder).where(F.col("event_type") == "purchase")
           .select("ts", F.col("value").alias("duration")).withWatermark("ts", delay))
    agg = led.groupBy(F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("avg_s"))

    def per_batch(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    _drain(agg.writeStream.outputMode("update").foreachBatch(per_batch), ckpt)
    return out_path


def current_throughput(updates: DataFrame) -> DataFrame:
    """(w, n, avg_s): the newest row of each window."""
    return (updates.groupBy("w").agg(F.max_by(F.struct("n", "avg_s"), "batch_id").alias("x"))
            .select("w", "x.n", "x.avg_s"))


ROSTER = State("case_id string, person_key string, initials string, seq long", ("case_id", "person_key"))


def roster_stream(spark: SparkSession, folder: str, redact: Redact, max_files: int | None = None,
                  path: str | None = None) -> Store:
    """T5: running case roster, the state table ``roster`` of the store. Each
    micro-batch redacts its documents and merges their persons into it (G7:
    the last document by seq wins); it reads and rewrites the buckets of the
    (case, person) keys it holds, nothing written before them. A batch that
    is replayed after its commit changes nothing."""
    out_path, ckpt = _paths(spark, "roster", path)
    store = Store(spark, out_path, {}, {"roster": ROSTER})

    def per_batch(batch: DataFrame, batch_id: int):
        if store.committed(batch_id):
            return
        work = store.begin(batch_id)
        r = redact(batch.select("doc_id", "text", F.lit("txt").alias("fmt")))
        cases = batch.select("doc_id", F.col("source").alias("case_id"))
        new = work.keep("new", R.doc_roster(r.persons).join(cases, "doc_id").where("case_id IS NOT NULL")
                        .select("case_id", "person_key", "initials", F.col("doc_id").alias("seq")))
        work.upsert("roster", new, newest(["case_id", "person_key"], ["seq"]))
        work.commit()
        r.discard()
        work.discard()

    _drain(document_stream(spark, folder, max_files=max_files).writeStream.foreachBatch(per_batch), ckpt)
    return store


LATEST = State("doc_id long, event_type string, ts timestamp, seq long", ("doc_id",))


def latest_status_stream(spark: SparkSession, folder: str, max_files: int | None = None, path: str | None = None,
                         on_batch: Callable[[Batch], None] | None = None) -> Store:
    """T3 as a stream: the state table ``latest`` of the store holds the newest
    event of each document; a batch is reduced to one row a document and
    merged into the buckets it touches. ``on_batch`` sees each batch before its commit."""
    out_path, ckpt = _paths(spark, "latest", path)
    store = Store(spark, out_path, {}, {"latest": LATEST})

    def per_batch(batch: DataFrame, batch_id: int):
        if store.committed(batch_id):
            return
        work = store.begin(batch_id)
        last = F.max_by(F.struct("event_type", "ts", "seq"), F.struct("ts", "seq"))
        new = work.keep("new", batch.where("doc_id IS NOT NULL").groupBy("doc_id").agg(last.alias("x")).select("doc_id", "x.*"))
        work.upsert("latest", new, newest(["doc_id"], ["ts", "seq"]))
        if on_batch:
            on_batch(work)
        work.commit()
        work.discard()

    led = event_stream(spark, folder, max_files=max_files).select(
        F.col("user_id").alias("doc_id"), "event_type", "ts", F.col("event_id").alias("seq"))
    _drain(led.writeStream.foreachBatch(per_batch), ckpt)
    return store
