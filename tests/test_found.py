"""Recognizers that find their tokens in the runs' own rows: the spans are those of
the recognizer that labels every token, and no token without a label becomes a row."""

from __future__ import annotations

import random

from conftest import docs_df
from pyspark.sql import functions as F

from redactum.fixtures.lexicon import rule_lemmas
from redactum.fixtures.model import rule_model_factory
from redactum.fixtures.plan import fixture_redaction
from redactum.operators import corpus as C
from redactum.operators import recognize
from redactum.operators import spans as SP
from redactum.plans.failures import isolated, outcomes
from redactum.plans.pipeline import Config
from redactum.streaming.lifecycle import Lifecycle
from redactum.streaming.tables import Store

TEXTS = ["Anna Nowak in Berlin", "  \t lead and Jan Kowalski \n ", "", "   ", "a\U0001F600b \U0001F600\U0001F600 Jan Kowalski, MIT License 123456789",
         "Ala Ola @ Ewa Iga.", None, "de Paris de Lyon np. tak-nie", " ".join(["word Anna Nowak"] * 150)]
MARKUP = ['<a x=">">Anna Nowak<b>u</b></a>', "<p>in  Berlin</p><p> </p>" * 40, "no Markup Here", None, "<p> \nAnna</p><q>Jan @ Kowalski</q>"]


def texts(spark):
    return docs_df(spark, list(enumerate(TEXTS))).unionByName(docs_df(spark, [(100 + i, t) for i, t in enumerate(MARKUP)], "xml"))


def shared(spark):
    """Documents of which some share an id and some have none."""
    return texts(spark).unionByName(docs_df(spark, [(0, "Ewa Lis"), (8, "Jan Kot"), (None, "Iga Mech"), (300, "Ola Kot")]))


def bag(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_model_finds_in_rows(spark):
    for window in (None, (8, 3)):
        found, every = recognize.hosted_model(rule_model_factory, window), lambda p: recognize.model_labels(p, rule_model_factory, window)
        a, b = (fixture_redaction(shared(spark), recognizer=r) for r in (found, every))
        assert bag(a.spans) == bag(b.spans) and a.spans.count() >= 150
    own = plan(fixture_redaction(texts(spark), recognizer=recognize.hosted_model(rule_model_factory)).span_tokens)
    assert "MapInArrow" in own and "posexplode" not in own and "collect_list" not in own


def test_model_of_given_runs_and_officials(spark):
    turns = spark.createDataFrame([(1, 0, "gnu Jan Kowalski", False, True), (1, 1, "to Anna Nowak", False, True), (2, 0, "Ewa Lis", False, False)],
                                  "doc_id long, seg_no int, seg string, is_xml boolean, is_run boolean")
    every, found = lambda p: recognize.model_labels(p, rule_model_factory), recognize.hosted_model(rule_model_factory)
    a, b = (fixture_redaction(None, segments=turns, recognizer=r) for r in (found, every))
    assert bag(a.spans) == bag(b.spans) and a.spans.count() == 2
    docs = docs_df(spark, [(1, "gnu Jan Kowalski and Anna Nowak")])
    clear = fixture_redaction(docs, recognizer=found, config=Config(officials=("gnu",))).spans
    assert [r.text for r in clear.collect()] == ["Anna"]


def test_model_that_raises_ends_the_job(spark):
    def factory():
        def predict(runs):
            raise RuntimeError("broken")
        return predict

    try:
        fixture_redaction(texts(spark), recognizer=recognize.hosted_model(factory)).spans
    except Exception as e:
        assert "broken" in str(e)
    else:
        raise AssertionError("the model's error was lost")


def angry():
    """A factory that workers need no module for."""
    def factory():
        rule = rule_model_factory()

        def predict(runs):
            if any("License" in w for w in runs):
                raise RuntimeError("no licenses")
            return rule(runs)
        return predict
    return factory


def test_failures_found_in_rows(spark):
    for window in (None, (8, 3)):
        good, failures = isolated(shared(spark), rule_lemmas, angry(), window=window)
        every = fixture_redaction(shared(spark).where("coalesce(doc_id, -1) <> 4"), recognizer=lambda p: recognize.model_labels(p, rule_model_factory, window))
        assert bag(good.spans) == bag(every.spans)
        got = outcomes(good.redacted(), failures).select("doc_id", "status", "n_mentions", F.substring_index("error", "\n", 1).alias("error")).collect()
        assert len(got) == len(TEXTS) + len(MARKUP) + 4
        assert {(r.doc_id, r.error) for r in got if r.status == "failed"} == {(4, "no licenses"), (6, "no text"), (103, "no text")}
        # a document without an id is asked for, and gets no label
        assert {(None, 0), (300, 1)} <= {(r.doc_id, r.n_mentions) for r in got if r.status == "done"}
    good, _ = isolated(texts(spark), rule_lemmas, angry())
    assert "regexp_extract_all" not in plan(good.span_tokens)  # what the model found has its place: the text is not cut again


def test_submissions_of_an_id(spark, tmp_path):
    """Only texts of ids that come again are compared."""
    store = Store(spark, str(tmp_path / "s"), {}, {})
    schema = "doc_id long, name string, text string, case_id string"
    once = [(i, f"{i}.txt", f"text {i}", None) for i in range(5)]
    again = [(1, "1.txt", "a text", "c"), (2, None, "z", "c"), (3, "3.txt", "text 3", None)]
    work = store.begin(0)
    assert "Aggregate" not in plan(Lifecycle._first(work, work.keep("a", spark.createDataFrame(once, schema))))
    work = store.begin(1)
    got = Lifecycle._first(work, work.keep("a", spark.createDataFrame(once + again, schema)))
    assert bag(got.select("doc_id", "name", "text", "case_id")) == bag(spark.createDataFrame([once[0], again[0], again[1], *once[3:]], schema))


def test_terms_find_in_rows(spark):
    rnd = random.Random(4)
    words = ["anna", "jan", "nowak", "x-y", "np.", ",", "\U0001F600", "in", "de"]
    terms = {" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(60)}
    table = spark.createDataFrame([(t, rnd.choice(["PERSON", "PRODUCT"]), rnd.choice([0.6, 0.9])) for t in sorted(terms)] + [("", "X", 1.0), (" Anna  Nowak ", "Y", 1.0)],
                                  "term string, label string, confidence double")
    many = docs_df(spark, [(1000 + i, "\t" + "".join(rnd.choice(words) + rnd.choice([" ", "", "\n "]) for _ in range(rnd.choice([0, 5, 40, 400])))) for i in range(40)])
    a, b = (fixture_redaction(shared(spark).unionByName(many), recognizer=r) for r in (recognize.term_list(table), lambda p: recognize.term_labels(p, table)))
    assert bag(a.spans) == bag(b.spans) and a.spans.count() > 1000
    own = plan(a.parts[0].spans)
    assert "MapInArrow" in own and "Window" not in own and "collect_list" not in own
    assert recognize.term_found(a.parts[0].segments, table.limit(0)).isEmpty()
    # the tokens alone, and a list too long for the workers to hold
    of = lambda **how: recognize.term_found(a.parts[0].segments, table, **how)
    assert bag(of().drop("lead")) == bag(of(held=0).drop("lead")) and of().count() > 1000
    assert bag(a.parts[0].spans) == bag(of(threshold=0.7, held=0)) == bag(b.parts[0].spans)


def test_spans_in_a_worker(spark):
    rnd = random.Random(9)
    labels = ["O", "B-A", "I-A", "B-B", "I-B", "MAIL", "I-", "B-", "X"]
    preds = [(d, k, rnd.choice(labels), rnd.choice([0.5, 0.7, 0.9])) for d in range(40) for k in range(60) if rnd.random() < 0.9]
    pcs = fixture_redaction(docs_df(spark, [(d, " ".join(["w", "ab,", "c"] * 15)) for d in range(40)])).pieces
    table = spark.createDataFrame([(d, 0, k, lab, c) for d, k, lab, c in preds], "doc_id long, run_no int, tok_no int, label string, confidence double")
    want = SP.decode_spans(SP.span_tokens(recognize.join_predictions(pcs, table)))
    got = [(s[0], s[1], s[2], s[3], s[4], s[5], s[6]) for s in SP.run_spans([p for p in preds if p[2] != "O"], 0.7)]
    cols = ["doc_id", "span", "first_pos", "last_pos", "label", "confidence", "n_tokens"]
    assert sorted(got) == sorted(tuple(r) for r in want.select(*cols).collect()) and len(got) > 400


def test_matches_of_a_long_run(spark):
    n = 60_000
    docs = docs_df(spark, [(1, "a b " * n)])
    table = spark.createDataFrame([("a b", "X", 1.0), ("b a", "Y", 1.0), ("b a b", "Z", 1.0)], "term string, label string, confidence double")
    spans = fixture_redaction(docs, recognizer=recognize.term_list(table)).spans
    assert spans.where("label = 'X' AND start % 4 = 0 AND end = start + 3").count() == spans.count() == n


def test_examples_leave_no_empty_file(spark, tmp_path):
    one = spark.range(3, numPartitions=3).where("id = 2").selectExpr("'t' AS text", "array('t') AS tokens", "array('O') AS labels")
    C.write_bio(one, str(tmp_path / "one"))
    assert [p.stat().st_size > 0 for p in (tmp_path / "one").iterdir() if p.name.startswith("part")] == [True]
    C.write_bio(one.limit(0), str(tmp_path / "none"))
    assert C.read_bio(spark, str(tmp_path / "none")).isEmpty() and C.read_bio(spark, str(tmp_path / "one")).count() == 1
