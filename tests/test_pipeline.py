"""End-to-end redaction of an invented judgment (markup) with external
predictions and a small dictionary, checked against hand-derived answers."""

import os
import re

from pyspark.sql import functions as F

from conftest import docs_df
from redactum.operators import recognize, rewrite
from redactum.fixtures.plan import fixture_redaction
from redactum.plans.pipeline import Config

JUDGMENT = """<?xml version="1.0" encoding="UTF-8"?>
<xPart xVersion="1.0" xLang="PL" xml:space="preserve">
  <xName>Wyrok</xName>
  <xText>Sędzia Barbara Wiśniewska</xText>
  <xText>z powództwa <xBx>Tomasza Zielińskiego</xBx> zamieszkałego w Gdańsku</xText>
  <xText a="x">przeciwko Tomasz Zieliński oraz Teresa Zając</xText>
  <xText>Świadek Teodor Zalewski, PESEL 85012312345</xText>
  <xText xTitle="a > b">bez danych</xText>
</xPart>
"""

LABELS = {"Barbara": "B-PERSON", "Wiśniewska": "I-PERSON", "Tomasza": "B-PERSON", "Zielińskiego": "I-PERSON",
          "Tomasz": "B-PERSON", "Zieliński": "I-PERSON", "Teresa": "B-PERSON", "Zając": "I-PERSON",
          "Teodor": "B-PERSON", "Zalewski": "I-PERSON", "Gdańsku": "B-LOCATION", "85012312345": "B-SENSITIVE"}

LEMMAS = [("Tomasza", 0, "Tomasz", "subst:sg:gen:m1"), ("Tomasza", 1, "Tomasza", "subst:sg:nom:f"),
          ("Tomasz", 0, "Tomasz", "subst:sg:nom:m1"), ("Zielińskiego", 0, "Zieliński", "subst:sg:gen:m1"),
          ("Zieliński", 0, "Zieliński", "subst:sg:nom:m1"), ("Teresa", 0, "Teresa", "subst:sg:nom:f"),
          ("Zając", 0, "zając", "subst:sg:nom:m2"), ("Zając", 1, "Zając", "subst:sg:nom:f"),
          ("Teodor", 0, "Teodor", "subst:sg:nom:m1"), ("Zalewski", 0, "Zalewski", "subst:sg:nom:m1")]


def _run(spark, officials=False):
    docs = docs_df(spark, [(1, JUDGMENT)], fmt="xml")
    lemmas = spark.createDataFrame(LEMMAS, "orth string, ord int, lemma string, tag string")
    terms = spark.createDataFrame([(k, v, 0.95) for k, v in LABELS.items()], "term string, label string, confidence double")
    rec = lambda p: recognize.gazetteer_labels(p, terms)
    return fixture_redaction(docs, lemmas=lemmas, recognizer=rec, config=Config(officials=officials, materialize="none"))


def test_judgment_substitutes(spark):
    r = _run(spark)
    out = r.redacted().collect()[0]
    t = out.text
    assert "<xAnon xSubst='T. Z. (1)'>Tomasza Zielińskiego</xAnon>" in t
    assert "<xAnon xSubst='T. Z. (1)'>Tomasz Zieliński</xAnon>" in t  # inflected and base form: one person
    assert "<xAnon xSubst='T. Z. (2)'>Teresa Zając</xAnon>" in t       # last mention of a run first
    assert "<xAnon xSubst='T. Z. (3)'>Teodor Zalewski</xAnon>" in t
    assert "<xAnon xSubst='B. W.'>Barbara Wiśniewska</xAnon>" in t    # unique initials: no number
    assert "<xAnon xSubst='G.'>Gdańsku</xAnon>" in t
    assert "<xAnon xSubst='(...)'>85012312345</xAnon>" in t
    assert out.n_mentions == 7
    # markup identical outside the mentions
    assert re.sub(r"<xAnon xSubst='[^']*'>(.*?)</xAnon>", r"\1", t) == JUDGMENT


def test_officials_stay_clear_and_roundtrip(spark):
    r = _run(spark, officials=True)
    red = r.redacted()
    t = red.collect()[0].text
    assert "Sędzia Barbara Wiśniewska" in t
    m = rewrite.parse_mentions(red).collect()
    assert len(m) == 6 and {x.subst for x in m} >= {"T. Z. (1)", "T. Z. (2)", "G.", "(...)"}
    plain = red.select(rewrite.tagged_to_plain(F.col("text")).alias("p")).collect()[0].p
    assert "T. Z. (2)" in plain and "Teresa" not in plain
    clean = red.select(rewrite.clean_text(F.col("text")).alias("c")).collect()[0].c
    assert "<" not in clean and "T. Z. (2)" in clean and "Barbara Wiśniewska" in clean and len(clean) > 40


def test_text_mode_and_identity(spark):
    docs = docs_df(spark, [(1, "Nic tu nie ma.\r\n"), (2, ""), (3, "Jan Kowalski i Jan Kowalski")])
    terms = spark.createDataFrame([("Jan", "B-PERSON", 0.9), ("Kowalski", "I-PERSON", 0.9)],
                                  "term string, label string, confidence double")
    r = fixture_redaction(docs, recognizer=lambda p: recognize.gazetteer_labels(p, terms), config=Config(materialize="none"))
    got = {x.doc_id: (x.text, x.n_mentions) for x in r.redacted().collect()}
    assert got[1] == ("Nic tu nie ma.\r\n", 0)
    assert got[2] == ("", 0)
    assert got[3] == ("J. K. i J. K.", 2)


def test_bucketed_input_needs_no_text_shuffle(spark):
    from conftest import SF_SMALL
    from redactum.sources import files
    from redactum.sources import tables as T

    import tempfile
    import uuid

    docs = T.text_docs(spark, SF_SMALL)
    name = "redactum_test_docs_" + uuid.uuid4().hex[:8]
    files.ingest_bucketed(docs, name, 4, path=tempfile.mkdtemp(prefix="redactum-test-") + "/t")
    b = spark.table(name)
    r = fixture_redaction(b, config=Config(clustered=True, materialize="none"))
    plan = r.marked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    got = {tuple(x) for x in r.redacted().collect()}
    want = {tuple(x) for x in fixture_redaction(docs).redacted().collect()}
    assert got == want


def test_rule_prefilter_is_a_superset(spark):
    from pyspark.sql import functions as F
    from conftest import SF_SMALL
    from redactum.sources import tables as T

    extra = docs_df(spark, [(10 ** 6 + i, t) for i, t in enumerate([
        "Ala Ola", "x in Paryż", "MIT License", "123456789", "Ab Cd", "Ala\nOla", "in\tBerlin", "ABC-License",
        "Zażółć Gęślą", "nic"])])
    docs = T.text_docs(spark, SF_SMALL).select("doc_id", "text", "fmt").unionByName(extra)
    cols = ["doc_id", "run_no", "start", "end", "label", "text"]
    a = {tuple(r) for r in fixture_redaction(docs, config=Config(materialize="none")).spans.select(*cols).collect()}
    b = {tuple(r) for r in fixture_redaction(docs, config=Config(materialize="none"), prefilter=lambda s: F.lit(True)).spans.select(*cols).collect()}
    assert a == b and len(a) > 0


def test_mixed_formats_in_one_plan(spark):
    from conftest import SF_SMALL
    from redactum.sources import tables as T

    txt = T.text_docs(spark, SF_SMALL).select("doc_id", "text", "fmt")
    xml = T.markup_docs(spark, SF_SMALL).select((F.col("doc_id") + 10 ** 7).alias("doc_id"), "text", "fmt")
    mixed = {tuple(r) for r in fixture_redaction(txt.unionByName(xml)).redacted().collect()}
    separate = {tuple(r) for r in fixture_redaction(txt).redacted().collect()} | {tuple(r) for r in fixture_redaction(xml).redacted().collect()}
    assert mixed == separate


def test_model_windows_equal_whole_runs(spark):
    from conftest import SF_SMALL
    from redactum.fixtures.model import rule_model_factory
    from redactum.sources import tables as T

    docs = T.text_docs(spark, SF_SMALL).select("doc_id", "text", "fmt")
    cols = ["doc_id", "run_no", "start", "end", "label", "text"]
    whole = fixture_redaction(docs, recognizer=lambda p: recognize.model_labels(p, rule_model_factory),
                      config=Config(materialize="none")).spans.select(*cols)
    win = fixture_redaction(docs, recognizer=lambda p: recognize.model_labels(p, rule_model_factory, window=(16, 4)),
                    config=Config(materialize="none")).spans.select(*cols)
    a, b = {tuple(r) for r in whole.collect()}, {tuple(r) for r in win.collect()}
    assert a == b and len(a) > 0


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    from redactum.operators import recognize

    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda runs: [[("B-PERSON" if w == "Jan" else "O", 0.9) for w in r] for r in runs]

    docs = spark.createDataFrame([(f"f{i}.txt", "Jan idzie do domu", "txt") for i in range(40)],
                                 "doc_id string, text string, fmt string")
    rec = lambda p: recognize.model_labels(p, factory)
    for _ in range(2):
        got = fixture_redaction(docs, recognizer=rec, config=Config(partitions=8)).spans.collect()
        assert {(r.doc_id, r.text) for r in got} == {(f"f{i}.txt", "Jan") for i in range(40)}
    loads = [x.split("-")[0] for x in os.listdir(folder)]
    assert len(loads) == len(set(loads)) > 0


def test_documents_without_a_match_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, "bez nazw " * 50, "txt") for i in range(50)] + [(99, "x 123456789 y", "txt"), (100, None, "txt")],
                                 "doc_id long, text string, fmt string")
    r = fixture_redaction(docs, config=Config(materialize="none"))
    assert [(x.doc_id, x.text) for x in r.spans.collect()] == [(99, "123456789")]
    plan = r.spans._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE", plan.index("RepartitionByExpression")) > 0
