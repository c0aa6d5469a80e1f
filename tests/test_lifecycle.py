"""Streams over several batches, the lifecycle job, failures and the in-row rewrite."""

import json
import os
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import docs_df
from redactum.operators import ledger as L
from redactum.operators import recognize, rewrite
from redactum.operators import roster as R
from redactum.fixtures.lexicon import rule_lemmas
from redactum.fixtures.model import fragile_model_factory, rule_model_factory
from redactum.plans.failures import redact_isolated
from redactum.fixtures.plan import fixture_redaction
from redactum.plans.pipeline import Config
from redactum.sources.files import read_folder
from redactum.streaming import jobs as SJ
from redactum.streaming.lifecycle import Lifecycle
from redactum.streaming.tables import State, Store, newest

DOC = "doc_id long, case_id string, name string, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- lifecycle ---------------------------------------------------------------------

class Requests:
    """Requests as they stand at each reading."""

    def __init__(self, spark):
        self.spark, self.views = spark, []

    def __call__(self):
        view = self.views.pop(0) if self.views else []
        return self.spark.createDataFrame(view, "doc_id long, request string, seq long")


def test_lifecycle_of_several_batches(spark, tmp_path):
    asked = Requests(spark)
    job = Lifecycle(spark, str(tmp_path / "run"), rule_lemmas, fragile_model_factory, asked, buckets=4)
    batch = lambda *docs: spark.createDataFrame(docs, DOC)
    first = batch((1, "a", "one.txt", "Jan Kowalski pisze."), (2, "a", "two.txt", "numer 123456789"), (3, "a", "three.txt", "Ewa Nowak"),
                  (4, "a", "four.txt", "Iga Nowak"), (5, "a", "five.txt", "Ola Nowak"), (6, None, "six.xml", "<p>Jan Kowalski</p>"),
                  (7, "a", "seven.txt", "bez osób"), (None, "a", "null.txt", "x"), (1, "a", "two-again.txt", "Jan Innyczasem"))
    asked.views = [[(3, "stop", 0)], [(3, "stop", 0), (4, "stop", 0), (5, "delete", 0)]]
    job.batch(first, 0)
    events = {(r.doc_id, r.step): r for r in job.ledger().collect()}
    status = lambda: {r.doc_id: (r.status, r.attempt) for r in job.documents().collect()}
    assert status() == {1: ("done", 1), 2: ("failed", 1), 3: ("cancelled", 1), 4: ("cancelled", 1), 6: ("done", 1), 7: ("done", 1)}
    assert {k for k in events if k[0] in (1, 2, 3, 5)} == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0), (3, 2)}
    assert events[1, 2].entity_count == 1 and events[1, 2].person_count == 1 and events[7, 2].person_count == 0
    message, _, trace = events[2, 2].error.partition("\n\n")
    assert message == "cannot read 123456789" and trace.startswith("Traceback") and "cannot read" in trace
    done = [("run-0", 1, 1, "one_anon.txt", "J. K. pisze."), ("run-0", 6, 1, "six_anon.xml", "<p><xAnon xSubst='J. K.'>Jan Kowalski</xAnon></p>"),
            ("run-0", 7, 1, "seven_anon.txt", "bez osób")]
    assert rows(job.results().select("run_id", "doc_id", "attempt", "result_name", "text")) == done
    assert rows(job.roster()) == [("a", "jan kowalski", "J. K.")]

    seen = [rows(t) for t in (job.results(), job.ledger(), job.documents(), job.roster())]
    job.batch(first, 0)  # replayed after the commit, with other requests
    work = job.store.begin(1)  # a batch that is cut off before its commit
    work.append("results", job.results().drop("batch_id"))
    assert [rows(t) for t in (job.results(), job.ledger(), job.documents(), job.roster())] == seen

    # duplicates change nothing; a retry gives a new attempt; a lower id that completes later wins the roster
    asked.views = [[(2, "retry", 1), (3, "stop", 0)]] * 2
    job.batch(batch((1, "b", "one.txt", "Zła Kopia"), (2, "a", "two.txt", "Jan Kowalska i Jan Kowalski"), (5, "a", "five.txt", "Ola Nowak"),
                    (8, "a", "eight.txt", "Jan Kowalski i Jan Kot")), 1)
    assert status()[2] == ("done", 2) and status()[8] == ("done", 1) and 5 not in status()
    asked.views = [[(1, "retry", 2), (3, "retry", 2)], [(1, "retry", 2), (3, "retry", 2), (3, "stop", 3)]]
    job.batch(batch((1, "a", "one.txt", "Jan Kowalski i Jola Krawczyk"), (3, "a", "three.txt", "Ewa Nowak")), 2)
    assert status()[1] == ("done", 2) and status()[3] == ("cancelled", 2)
    merged = {r.person_key: r.initials for r in job.roster().collect()}
    assert merged["jan kowalski"] == "J. K. (2)"  # of document 1, the lower id but the later completion
    assert {r.doc_id for r in job.current_results().collect()} == {1, 2, 6, 7, 8}
    assert {r.attempt for r in job.current_results().where("doc_id = 1").collect()} == {2}
    asked.views = [[(1, "retry", 3)]] * 2
    job.batch(batch((1, "a", "one.txt", "numer 123456789")), 3)
    assert status()[1] == ("failed", 3)
    assert "jola krawczyk" in {r.person_key for r in job.roster().collect()}  # merged: nothing is taken back
    assert "jola krawczyk" not in {r.person_key for r in job.current_roster().collect()}


def test_lifecycle_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in {"a.txt": "Jan Kowalski\r\nw domu", "b+c.xml": "<p>Ewa Nowak</p>", "ż.txt": "numer 123456789"}.items():
        (folder / name).write_bytes(text.encode())
        os.utime(folder / name, (1, {"a.txt": 10, "b+c.xml": 20, "ż.txt": 30}[name]))
    docs = SJ.file_stream(spark, str(folder), max_files=1).select("doc_id", F.lit("case").alias("case_id"), "name", "text")
    job = Lifecycle(spark, str(tmp_path / "run"), rule_lemmas, fragile_model_factory, id_type="string", buckets=2).run(docs)
    assert {(r.doc_id, r.status, r.seq) for r in job.documents().collect()} == {("a.txt", "done", 0), ("b+c.xml", "done", 1), ("ż.txt", "failed", 2)}
    one = redact_isolated(read_folder(spark, str(folder)), rule_lemmas, rule_model_factory)
    want = {r.doc_id: r.text for r in one.collect() if r.doc_id != "ż.txt"}
    assert {r.doc_id: r.text for r in job.results().collect()} == want


def test_text_file_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, (name, text) in enumerate({"a.txt": "Jan Kowalski\r\nw domu", "b+c.xml": "<p>Ewa Nowak</p>", "c d.txt": "in Berlin"}.items()):
        (folder / name).write_bytes(text.encode())
        os.utime(folder / name, (1, 10 * i))
    out = SJ.redact_stream(spark, str(folder), fixture_redaction, docs=SJ.file_stream(spark, str(folder), max_files=1))
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() == 3
    assert rows(got.drop("batch_id")) == rows(fixture_redaction(read_folder(spark, str(folder))).redacted())


# -- state tables -------------------------------------------------------------------

def event_files(spark, folder, batches):
    """One parquet file of events a batch, in order of time."""
    for i, events in enumerate(batches):
        path = f"{folder}/events-{i}"
        spark.createDataFrame(events, SJ.EVENT_SCHEMA).coalesce(1).write.parquet(path)
        part = next(p for p in os.listdir(path) if p.endswith(".parquet"))
        os.rename(f"{path}/{part}", f"{folder}/events{i}.parquet")
        os.utime(f"{folder}/events{i}.parquet", (1, 1000 + i))


def test_duplicates_of_any_age_are_dropped(spark, tmp_path):
    t = datetime(2024, 1, 1)
    views = [[(1, t, 7, "view", 1.0, ""), (2, t, 7, "view", 1.0, ""), (3, t, 8, "click", 1.0, "")],
             [(4, t + timedelta(days=400), 7, "view", 1.0, ""), (5, t + timedelta(days=1), 9, "view", 1.0, ""), (6, t, None, "view", 1.0, "")],
             [(7, t + timedelta(days=900), 9, "view", 1.0, ""), (8, t, 7, "view", 1.0, "")]]
    event_files(spark, str(tmp_path), views)
    store = SJ.dedup_stream(spark, str(tmp_path), max_files=1)
    assert rows(store.read("accepted").select("doc_id", "event_id", "batch_id")) == [(7, 1, 0), (9, 5, 1)]
    assert store.last_batch() == 2


def test_latest_states_read_no_history(spark, tmp_path):
    rnd, t = random.Random(5), datetime(2024, 1, 1)
    kinds = ["view", "click", "purchase", "error"]
    batches = [[(100 * b + i, t + timedelta(minutes=rnd.randint(0, 9999)), rnd.randint(0, 40), rnd.choice(kinds), 1.0, "") for i in range(100)]
               for b in range(10)]
    event_files(spark, str(tmp_path), batches)
    read = []

    def on_batch(work):
        folders = [f.removeprefix("file:") for f in work.read_folders]
        read.append(sum(os.path.getsize(f"{f}/{p}") for f in folders for p in os.listdir(f) if p.endswith(".parquet")))

    store = SJ.latest_status_stream(spark, str(tmp_path), max_files=1, on_batch=on_batch)
    led = spark.createDataFrame([e for b in batches for e in b], SJ.EVENT_SCHEMA).select(
        F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    want = rows(L.latest(led).select("doc_id", "status"))
    assert rows(store.read("latest").select("doc_id", "event_type")) == want
    assert len(read) == 10 and read[0] == 0 and max(read[2:]) <= 1.3 * read[2]


def test_batches_touch_their_own_buckets(spark, tmp_path):
    state = State("k long, v long", ("k",), 8)
    store = Store(spark, str(tmp_path / "s"), {}, {"t": state})
    for b in range(4):
        work = store.begin(b)
        work.upsert("t", work.keep("new", spark.createDataFrame([(b, b * 10)], "k long, v long")), newest(["k"], ["v"]))
        assert len(work.read_folders) <= 1
        work.commit()
    assert rows(store.read("t")) == [(b, b * 10) for b in range(4)]
    again = Store(spark, str(tmp_path / "s"), {}, {"t": state})  # opened anew
    assert again.last_batch() == 3 and rows(again.read("t")) == rows(store.read("t"))


def test_roster_stream_over_batches(spark, tmp_path):
    texts = [["Jan Kowalski", "Ewa Nowak i Jan Kowalski"], ["Jan Kot i Jan Kowalski"], ["bez osób"]]
    doc = 0
    for i, batch in enumerate(texts):
        data = []
        for text in batch:
            data.append((doc, text, "pl", "c", len(text)))
            doc += 1
        path = f"{tmp_path}/d{i}"
        spark.createDataFrame(data, SJ.DOC_SCHEMA).coalesce(1).write.parquet(path)
        part = next(p for p in os.listdir(path) if p.endswith(".parquet"))
        os.rename(f"{path}/{part}", f"{tmp_path}/documents{i}.parquet")
        os.utime(f"{tmp_path}/documents{i}.parquet", (1, 1000 + i))
    store = SJ.roster_stream(spark, str(tmp_path), fixture_redaction, max_files=1)
    docs = docs_df(spark, [(i, t) for i, t in enumerate(x for b in texts for x in b)])
    per_doc = R.doc_roster(fixture_redaction(docs).persons).withColumns({"case_id": F.lit("c"), "seq": F.col("doc_id")})
    assert store.last_batch() == 2
    assert rows(store.read("roster").select("case_id", "person_key", "initials")) == rows(R.merge_case_roster(per_doc))


# -- failures -----------------------------------------------------------------------

def strange_model():
    """A factory that workers need no module for."""
    def factory():
        def predict(runs):
            if any("raise" in w for w in runs):
                raise RuntimeError("no such word")
            return [[("B-SENSITIVE", 0.9) if x == "secret" else ("O", 1.0) for x in w][: 1 if "short" in w else None] for w in runs]
        return predict
    return factory


def test_failures_leave_the_others_alone(spark):
    docs = docs_df(spark, [(1, "a secret here"), (2, "please raise now"), (3, None), (4, "nul \x00 secret"), (5, "short answers fail"), (6, "")])
    got = {r.doc_id: r for r in redact_isolated(docs, rule_lemmas, strange_model()).collect()}
    assert {d: r.status for d, r in got.items()} == {1: "done", 2: "failed", 3: "failed", 4: "done", 5: "failed", 6: "done"}
    assert got[1].text == "a (...) here" and got[4].text == "nul \x00 (...)" and got[6].text == ""
    assert got[2].error.startswith("no such word\n\nTraceback") and got[2].text is None and got[2].n_mentions == 0
    assert "one label for each word" in got[5].error and got[3].error == "no text"
    xml = docs_df(spark, [(1, "<p>fine</p><p>raise</p><p>secret</p>")], fmt="xml")
    assert [r.status for r in redact_isolated(xml, rule_lemmas, strange_model()).collect()] == ["failed"]


def test_windows_of_a_failing_run(spark):
    docs = docs_df(spark, [(1, "w " * 20 + "raise"), (2, "w " * 20 + "secret")])
    got = {r.doc_id: r.status for r in redact_isolated(docs, rule_lemmas, strange_model(), window=(8, 4)).collect()}
    assert got == {1: "failed", 2: "done"}
    preds = recognize.model_predictions(fixture_redaction(docs).pieces, strange_model(), window=(8, 4))
    assert [r.error.split("\n")[0] for r in preds.where("error IS NOT NULL").collect()] == ["no such word"]


# -- rewrite ------------------------------------------------------------------------

def test_splices_equal_python(spark):
    rnd, data, want = random.Random(2), [], {}
    for d in range(80):
        text = "".join(rnd.choices("ab c\U0001F600é\n", k=rnd.choice([0, 5, 1023, 1024, 1025, 2048, 5000])))
        cuts = sorted(rnd.sample(range(len(text) + 1), min(len(text) // 4, rnd.choice([0, 1, 3, 20])) * 2))
        spans = [(a, b, rnd.choice(["X.", "(...)"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        out, at = "", 0
        for a, b, s in spans:
            out, at = out + text[at:a] + (f"<xAnon xSubst='{s}'>{text[a:b]}</xAnon>" if d % 2 else s), b
        data.append((d, text, spans))
        want[d] = (out + text[at:], len(spans))
    df = spark.createDataFrame(data, "doc_id long, text string, spans array<struct<start: int, end: int, substitute: string>>")
    spans = df.where("size(spans) > 0").select("doc_id", "spans")
    got = rewrite.rewritten(df.drop("spans"), spans, F.col("doc_id") % 2 == 1)
    assert {r.doc_id: (r.text, r.n_mentions) for r in got.collect()} == want


def test_one_exchange_of_the_text(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = docs_df(spark, [(i, f"Jan Kowalski {i} in Berlin") for i in range(50)]).repartition(3)
        out = fixture_redaction(docs, config=Config()).redacted()
        plan = out._jdf.queryExecution().explainString(out._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) \
            if hasattr(out, "_jvm") else out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
        own = [b for b in re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning", plan) if "text#" in b]
        assert len(own) == 1 and "ObjectHashAggregate" in plan and "Generate" not in plan
        assert out.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_roster_lines_are_json(spark):
    ro = spark.createDataFrame([("c\n\"1\\\u0001", "jan\tk", "J. K."), ("c2", "ż", None)], "case_id string, person_key string, initials string")
    lines = [json.loads(r.json) for r in R.roster_json(ro).collect()]
    assert {"case_id": "c\n\"1\\\u0001", "person": "jan\tk", "initials": "J. K."} in lines
    assert {"case_id": "c2", "person": "ż", "initials": None} in lines and {"case_id": "c2", "count": 1} in lines


def test_roster_views_by_completion(spark):
    rosters = spark.createDataFrame([("c", "jan", "J. K.", 1), ("c", "jan", "J. K. (2)", 2), ("c", "ewa", "E. N.", 3), ("c", "iga", "I. L.", 4)],
                                    "case_id string, person_key string, initials string, doc_id long")
    led = spark.createDataFrame([(1, 9, 1, "done"), (2, 5, 1, "done"), (3, 4, 1, "done"), (3, 6, 1, "failed"), (4, 1, 1, "pending")],
                                "doc_id long, ts long, seq long, status string")
    view = lambda current: {r.person_key: r.initials for r in R.merge_case_roster(R.completed(rosters, led, current), "done").collect()}
    assert view(False) == {"jan": "J. K.", "ewa": "E. N."}  # document 1, the lower id, completed later
    assert view(True) == {"jan": "J. K."}
