"""A loaded lexicon, training examples from tagged documents, term lists of several words."""

import json
import random

from pyspark.sql import functions as F

from conftest import docs_df
from redactum.fixtures.lexicon import rule_lemmas
from redactum.fixtures.model import rule_model_factory
from redactum.fixtures.plan import fixture_redaction
from redactum.fixtures.rules import rule_labels
from redactum.operators import corpus as C
from redactum.operators import markup, recognize, tokens
from redactum.plans.pipeline import Config, Redaction
from redactum.sources.lexicon import bad_lines, ingest_lexicon, read_lexicon

LEXICON = """# form, number, lemma, tag
Hanka\t0\tHanka\tsubst:sg:nom:f
Hanki\t0\tHanka\tsubst:sg:gen:f
Wolska\t0\tWolska:s\tsubst:sg:nom:f
Wolskiej\t0\tWolska\tsubst:sg:gen.dat.loc:f
Wolskiej\t1\twolski\tadj:sg:gen:f:pos

Piotr\t0\tPiotr\tsubst:sg:nom:m1
Piotra\t0\tPiotr\tsubst:sg:gen.acc:m1
Mazur\t0\tMazur\tsubst:sg:nom:m1
Mazura\t0\tMazur\tsubst:sg:gen.acc:m1
Mazura\t0\tMazur\tsubst:sg:gen.acc:m1
no analysis
Mazur\tx\tMazur\tsubst:sg:nom:m1
"""


def test_loaded_lexicon_joins_inflected_names(spark, tmp_path):
    (tmp_path / "lexicon.tsv").write_bytes(LEXICON.replace("\n", "\r\n").encode())
    lemmas = read_lexicon(spark, str(tmp_path / "lexicon.tsv"))
    assert lemmas.count() == 9 and lemmas.where("ord = 1").count() == 1
    assert sorted(r.line for r in bad_lines(spark, str(tmp_path / "lexicon.tsv")).collect()) == [
        "Mazur\tx\tMazur\tsubst:sg:nom:m1", "no analysis"]
    docs = docs_df(spark, [(1, "Hanka Wolska i Piotr Mazur. Bez Hanki Wolskiej oraz Piotra Mazura.")])
    terms = ["Hanka Wolska", "Hanki Wolskiej", "Piotr Mazur", "Piotra Mazura"]
    terms = spark.createDataFrame([(t, "PERSON", 0.9) for t in terms], "term string, label string, confidence double")
    r = Redaction(docs, lemmas, lambda p: recognize.term_labels(p, terms))
    assert {p.person_key: p.n_mentions for p in r.persons.collect()} == {"hanka wolska": 2, "piotr mazur": 2}
    assert r.redacted().first().text == "H. W. i P. M.. Bez H. W. oraz P. M.."
    ingest_lexicon(lemmas, "lexicon_bucketed", 4, str(tmp_path / "table"))
    again = Redaction(docs, spark.table("lexicon_bucketed"), lambda p: recognize.term_labels(p, terms))
    assert again.persons.count() == 2
    spark.sql("DROP TABLE lexicon_bucketed")


def brute_terms(tokens, terms):
    """Leftmost, then longest."""
    out, i = ["O"] * len(tokens), 0
    while i < len(tokens):
        for n in range(min(5, len(tokens) - i), 0, -1):
            label = terms.get(" ".join(tokens[i:i + n]))
            if label:
                out[i:i + n] = [f"B-{label}"] + [f"I-{label}"] * (n - 1)
                i += n - 1
                break
        i += 1
    return out


def test_terms_of_many_words(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "b", "c", "d", "hot"])
    terms = {" ".join(word() for _ in range(rnd.randint(1, 5))): rnd.choice(["PERSON", "PRODUCT"]) for _ in range(25)}
    terms.pop("hot", None)
    table = spark.createDataFrame([(f" {k.replace(' ', '  ')} ", v, 0.9) for k, v in terms.items()], "term string, label string, confidence double")
    texts = {d: " ".join(word() for _ in range(rnd.choice([0, 1, 5, 60]))) for d in range(40)}
    texts[99] = "hot " * 500
    r = Redaction(docs_df(spark, list(texts.items())), rule_lemmas, lambda p: recognize.term_labels(p, table))
    got = {}
    for row in r.labelled.where("is_tok").select("doc_id", "pos", "label").orderBy("doc_id", "pos").collect():
        got.setdefault(row.doc_id, []).append(row.label)
    assert got == {d: brute_terms(t.split(), terms) for d, t in texts.items() if t.split()}


def test_examples_from_tagged_documents(spark):
    texts = [(1, "Jan Kowalski ma 123456789 < 5, w domu.\nJan Kot, in Berlin."), (2, ""), (3, "nic"), (4, " Jan Kot Jan"), (5, None)]
    r = fixture_redaction(docs_df(spark, texts), config=Config(tags=True))
    tagged = r.redacted()
    labels = r.spans.select("doc_id", F.expr("row_number() over (partition by doc_id order by run_no, start)").alias("mention"), "label")
    got = {x.doc_id: x for x in C.tagged_examples(tagged, labels).collect()}
    assert {d: x.text for d, x in got.items()} == dict(texts)
    spans = {(s.doc_id, s.start, s.end): s.label for s in r.spans.collect()}
    found = {}
    for t in C.tagged_tokens(tagged, labels).orderBy("doc_id", "tok_no").collect():
        assert dict(texts)[t.doc_id][t.start:t.end] == t.token
        if t.tag != "O":
            key = (t.doc_id, t.mention)
            a, _, lab = found.get(key, (t.start, 0, t.tag[2:]))
            assert t.tag == ("I-" if key in found else "B-") + lab
            found[key] = (a, t.end, lab)
    assert {(d, a, b): lab for (d, _), (a, b, lab) in found.items()} == spans and len(spans) >= 4
    assert got[1].tokens[:3] == ["Jan", "Kowalski", "ma"] and got[1].labels[:3] == ["B-PERSON", "I-PERSON", "O"]
    assert got[2].tokens == [] and {x for e in C.tagged_examples(tagged).collect() for x in e.labels} == {"O", "B-ENTITY", "I-ENTITY"}


def test_examples_as_json_lines(spark, tmp_path):
    ex = spark.createDataFrame([("a \"b\"\nż", ["a", "b"], ["O", "B-X"])], C.BIO_SCHEMA)
    C.write_bio(ex, str(tmp_path / "bio"))
    line = next(p for p in (tmp_path / "bio").iterdir() if p.name.startswith("part")).read_text()
    assert json.loads(line) == {"text": "a \"b\"\nż", "tokens": ["a", "b"], "labels": ["O", "B-X"]}
    assert C.read_bio(spark, str(tmp_path / "bio")).collect() == ex.collect()


def test_hosted_rule_model_equals_rules(spark):
    docs = docs_df(spark, [(1, "Jan Kowalski in Berlin"), (2, "GNU License 123456789")])
    spans = lambda rec: sorted(tuple(r) for r in fixture_redaction(docs, recognizer=rec).spans.select("doc_id", "start", "end", "label").collect())
    assert spans(rule_labels) == spans(lambda p: recognize.model_labels(p, rule_model_factory))


def test_terms_of_long_runs_and_many_terms(spark):
    """A run costs its tokens, not its tokens times the terms found in it."""
    words = [f"w{i % 400}" for i in range(12_000)]
    terms = [(f"w{i} w{i + 1} w{i + 2}", "LOCATION", 0.8) for i in range(0, 398, 2)] + [(f"w{i}", "PERSON", 0.9) for i in range(400)]
    table = spark.createDataFrame(terms, "term string, label string, confidence double")
    rec = recognize.term_labels(tokens.pieces(markup.segments(docs_df(spark, [(1, " ".join(words))]))), table)
    got = [r.label for r in rec.where("is_tok").orderBy("pos").collect()]
    want, i = [], 0
    while i < 400:
        n = 3 if i % 2 == 0 and i < 398 else 1
        want += ["B-LOCATION", "I-LOCATION", "I-LOCATION"] if n == 3 else ["B-PERSON"]
        i += n
    assert got == want * 30
