"""The document lifecycle as a stream job.

Documents arrive in a stream; each micro-batch claims, works, rechecks and
commits:

1. claim: a document is worked if its id is new, or if a retry was asked for
   after its last event; any other submission of a known id is a duplicate, at
   whatever time it comes. One that was asked to stop before the claim is
   cancelled without being worked. Of several submissions of one id in a batch
   the first by name and text counts; rows without an id take no part.
2. work: the batch plan, with failures isolated by document (T9).
3. recheck: the requests are read anew. A document that was asked to stop in the
   meantime is cancelled and its result dropped; a deleted one leaves nothing.
4. commit: results, ledger rows, roster log and the touched buckets of the
   current states are written, then one manifest. Readers see all of a batch or
   nothing, and a batch that is replayed after its commit does nothing.

``requests`` is a function that reads the requests anew each time it is called:
(doc_id, request in stop, retry, delete, seq), with seq a number that grows
with the batches (an event of batch b has seq b).
"""

from __future__ import annotations

from dataclasses import replace
from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import roster as R
from ..plans.failures import isolated, outcomes
from ..plans.pipeline import Config
from ..sources.files import fmt_of, result_name
from .tables import Batch, State, Store, newest

APPENDS = {
    "results": "run_id string, doc_id {id}, attempt int, result_name string, text string",
    "ledger": "doc_id {id}, case_id string, seq long, step int, attempt int, status string, entity_count long, "
              "person_count long, error string",
    "roster_log": "case_id string, person_key string, initials string, doc_id {id}, attempt int, seq long",
}
DOCUMENTS = "doc_id {id}, case_id string, status string, attempt int, seq long"
ROSTER = "case_id string, person_key string, initials string, seq long, doc_id {id}"
NO_REQUESTS = "doc_id {id}, request string, seq long"


class Lifecycle:
    def __init__(self, spark: SparkSession, path: str, lemmas, model_factory: Callable,
                 requests: Optional[Callable[[], DataFrame]] = None, config: Optional[Config] = None, id_type: str = "bigint",
                 buckets: int = 64, **options):
        self.spark, self.path, self.lemmas, self.model_factory = spark, path, lemmas, model_factory
        self.config, self.options = config, options
        of = lambda schema: schema.format(id=id_type)
        self.requests = requests or (lambda: spark.createDataFrame([], of(NO_REQUESTS)))
        self.store = Store(spark, path, {k: of(v) for k, v in APPENDS.items()}, {
            "documents": State(of(DOCUMENTS), ("doc_id",), buckets),
            "roster": State(of(ROSTER), ("case_id", "person_key"), buckets)})

    # -- what readers see ------------------------------------------------------

    def results(self) -> DataFrame:
        """(run_id, doc_id, attempt, result_name, text) of every done attempt."""
        return self.store.read("results").drop("batch_id")

    def current_results(self) -> DataFrame:
        """Results of the documents that are done now, their last attempt."""
        return self.results().join(self._done(), ["doc_id", "attempt"], "left_semi")

    def ledger(self) -> DataFrame:
        return self.store.read("ledger").drop("batch_id")

    def documents(self) -> DataFrame:
        """The current state of every document; deleted ones are gone."""
        return self.store.read("documents").where("status <> 'deleted'")

    def roster(self) -> DataFrame:
        """G7, merged: for a person of a case, the initials of the last completed
        document; later retries and deletions take nothing back (Q8)."""
        return self.store.read("roster").select("case_id", "person_key", "initials")

    def current_roster(self) -> DataFrame:
        """G7, current: from the last attempts of documents that are done now."""
        log = self.store.read("roster_log").join(self._done(), ["doc_id", "attempt"], "left_semi")
        return R.merge_case_roster(log.withColumn("done", F.struct("seq", "doc_id")), "done")

    def _done(self) -> DataFrame:
        return self.documents().where("status = 'done'").select("doc_id", "attempt")

    # -- one batch -------------------------------------------------------------

    def batch(self, submitted: DataFrame, batch_id: int) -> None:
        """submitted(doc_id, case_id, name, text); the foreachBatch function."""
        if self.store.committed(batch_id):
            return
        work = self.store.begin(batch_id)
        rows = submitted.where("doc_id IS NOT NULL").select("doc_id", "name", "text", "case_id")
        # dealt by document once: every later step reads the files as they are
        sub = self._first(work, work.keep("submitted", rows.repartition("doc_id")))
        ids = sub.select("doc_id", "case_id", "name")
        claims = work.keep("claims", self._claims(ids, work.current("documents", ids), batch_id))

        # what is not claimed is mostly little: told to the texts, it does not deal them again
        rest = work.keep("rest", ids.join(claims.where("claim = 'claimed'"), "doc_id", "left_anti").select("doc_id"))
        todo = sub.join(rest, "doc_id", "left_anti")
        docs = todo.select("doc_id", "text", fmt_of(F.col("name")).alias("fmt"))
        config = replace(self.config or Config(), clustered=True)
        good, failures = isolated(docs, self.lemmas, self.model_factory, config, **self.options)
        worked = work.keep("worked", outcomes(good.redacted(), failures))
        persons = work.keep("persons", R.doc_roster(good.persons).join(failures.select("doc_id"), "doc_id", "left_anti"))

        final = work.keep("final", self._final(claims, worked.drop("text"), persons, batch_id))
        done = final.where("status = 'done'").select("doc_id", "attempt", "case_id", "name")
        work.append("results", worked.select("doc_id", "text").join(done, "doc_id").select(
            F.lit(f"run-{batch_id}").alias("run_id"), "doc_id", "attempt", result_name(F.col("name")).alias("result_name"), "text"))
        work.append("ledger", self._events(final, batch_id))
        entries = persons.join(done, "doc_id").where("case_id IS NOT NULL").select(
            "case_id", "person_key", "initials", "doc_id", "attempt", F.lit(batch_id).cast("long").alias("seq"))
        work.append("roster_log", entries)
        work.upsert("roster", entries, newest(["case_id", "person_key"], ["seq", "doc_id"]))
        work.upsert("documents", final.select("doc_id", "case_id", "status", "attempt", F.lit(batch_id).cast("long").alias("seq")),
                    newest(["doc_id"], ["seq"]))
        work.commit()
        good.discard()
        work.discard()

    @staticmethod
    def _first(work: Batch, rows: DataFrame) -> DataFrame:
        """One submission of an id, the first by name and text. Texts are compared
        only for ids that come again; the others' rows pass as they are."""
        again = work.keep("again", rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
        if again.isEmpty():
            return rows
        first = F.min(F.struct(*rows.columns[1:])).alias("x")
        of = lambda how: rows.join(again, "doc_id", how)
        return of("left_anti").unionByName(of("left_semi").groupBy("doc_id").agg(first).select("doc_id", "x.*"))

    def _asked(self, ids: DataFrame) -> DataFrame:
        """(doc_id, stop, retry, deleted): seq of the last request of each kind."""
        last = lambda what: F.max(F.when(F.col("request") == what, F.col("seq")))
        return (self.requests().join(ids.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id")
                .agg(last("stop").alias("stop"), last("retry").alias("retry"), last("delete").alias("deleted")))

    def _claims(self, ids: DataFrame, state: DataFrame, batch_id: int) -> DataFrame:
        known = state.select("doc_id", "status", F.col("attempt").alias("before"), F.col("seq").alias("since"),
                             F.col("case_id").alias("old_case"))
        x = ids.join(known, "doc_id", "left").join(self._asked(ids), "doc_id", "left")
        after = lambda c: F.coalesce(F.col(c) > F.coalesce("since", F.lit(-1)), F.lit(False))
        again = after("retry") & (F.col("status") != "deleted")
        # a stop after the retry takes it back, one before it does not
        stop = after("stop") & F.coalesce(F.col("stop") >= F.col("retry"), F.lit(True))
        claim = (F.when(F.col("status").isNotNull() & ~again, F.lit("duplicate"))
                 .when(after("deleted"), F.lit("deleted")).when(stop, F.lit("cancelled")).otherwise(F.lit("claimed")))
        return x.where(claim != "duplicate").select(
            "doc_id", F.coalesce("old_case", "case_id").alias("case_id"), "name", claim.alias("claim"),
            (F.coalesce("before", F.lit(0)) + 1).cast("int").alias("attempt"), F.coalesce("since", F.lit(-1)).alias("since"))

    def _final(self, claims: DataFrame, worked: DataFrame, persons: DataFrame, batch_id: int) -> DataFrame:
        """Claims with their outcome after the recheck of the requests."""
        n = persons.groupBy("doc_id").agg(F.count("*").alias("n_persons"))
        asked = self._asked(claims)
        x = claims.join(worked, "doc_id", "left").join(n, "doc_id", "left").join(asked, "doc_id", "left")
        after = lambda c: F.coalesce(F.col(c) > F.col("since"), F.lit(False))
        stop = after("stop") & F.coalesce(F.col("stop") >= F.col("retry"), F.lit(True))
        status = (F.when((F.col("claim") == "deleted") | after("deleted"), F.lit("deleted"))
                  .when((F.col("claim") == "cancelled") | stop, F.lit("cancelled")).otherwise(F.col("status")))
        x = x.withColumn("outcome", status)
        done, of = F.col("outcome") == "done", lambda c: F.coalesce(c, F.lit(0)).cast("long")
        return x.select("doc_id", "case_id", "name", "attempt", "claim", F.col("outcome").alias("status"),
                        F.when(done, of("n_mentions")).alias("entity_count"), F.when(done, of("n_persons")).alias("person_count"),
                        F.when(F.col("outcome") == "failed", F.col("error")).alias("error"))

    @staticmethod
    def _events(final: DataFrame, batch_id: int) -> DataFrame:
        """Ledger rows of a batch: pending, processing (if claimed) and the outcome; deleted documents have none."""
        steps = F.array(F.lit("pending"), F.when(F.col("claim") == "claimed", F.lit("processing")), F.col("status"))
        x = final.where("status <> 'deleted'").select("*", F.posexplode(steps).alias("step", "event")).where("event IS NOT NULL")
        last = lambda c: F.when(F.col("step") == 2, F.col(c)).alias(c)
        return x.select("doc_id", "case_id", F.lit(batch_id).cast("long").alias("seq"), F.col("step").cast("int").alias("step"),
                        "attempt", F.col("event").alias("status"), last("entity_count"), last("person_count"), last("error"))

    def run(self, documents: DataFrame) -> "Lifecycle":
        """Work a stream of documents(doc_id, case_id, name, text) until it has no more."""
        q = (documents.writeStream.foreachBatch(lambda batch, i: self.batch(batch, i))
             .option("checkpointLocation", f"{self.path.rstrip('/')}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
        return self
