"""Documents and runs whose keys come once are worked in their own rows; the
results are those of the windows over rows that may share a key."""

from __future__ import annotations

from conftest import docs_df
from pyspark.sql import functions as F

from redactum.fixtures.plan import fixture_redaction
from redactum.functions.arrays import BLOCK, running, running_arrow
from redactum.operators import corpus as C
from redactum.operators import evaluate as EV
from redactum.operators import markup, recognize, tokens
from redactum.plans import catalog

TEXTS = ["Anna Nowak in Berlin", "  \t lead and trail \n ", "", "   ", "a\U0001F600b \U0001F600\U0001F600 Jan Kowalski, MIT License 123456789",
         "Ala Ola @ Ewa Iga.", None, "de Paris de Lyon np. tak-nie", " ".join(["word Anna Nowak"] * 150)]
MARKUP = ['<a x=">">Anna Nowak<b>u</b></a>', "<p>in  Berlin</p><p> </p>" * 40, "no markup", None,
          "<xAnon xSubst='A.'>Anna</xAnon><q>Jan Kowalski</q>"]


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda x: sorted(map(repr, (tuple(r) for r in x.select(*sorted(x.columns)).collect())))
    got = rows(a)
    assert got == rows(b)
    return len(got)


def sorts(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Window" in plan or "Sort" in plan


def texts(spark):
    return docs_df(spark, list(enumerate(TEXTS)))


def test_running_sums(spark):
    sizes = [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 3]
    x = spark.createDataFrame([(n, [i % 7 for i in range(n)]) for n in sizes] + [(-1, None)], "n long, w array<int>")
    x = x.select("n", "w", F.when(F.size("w") >= 0, running(F.col("w"))).alias("a"), running_arrow(F.col("w")).alias("b"))
    for r in x.where("n >= 0").collect():
        assert r.a == r.b == [sum(r.w[:i]) for i in range(r.n)]


def test_tokens_in_rows(spark):
    mixed = texts(spark).unionByName(docs_df(spark, [(100 + i, t) for i, t in enumerate(MARKUP)], "xml"))
    alone, over = markup.segments(mixed, alone=True), markup.segments(mixed)
    assert not sorts(alone) and same(alone, over) > 100
    toks = tokens.tokens(alone, alone=True)
    assert not sorts(toks) and same(toks, tokens.tokens(over)) > 400
    for t in tokens.tokens(markup.segments(texts(spark), alone=True), alone=True).collect():
        assert TEXTS[t.doc_id][t.start:t.end] == t.token
    chunks = lambda s, k: tokens.best_window(tokens.chunk_windows(tokens.tokens(s, k), 16, 5), k)
    assert not sorts(chunks(alone, True)) and same(chunks(alone, True), chunks(over, False)) > 400


def test_labels_in_rows(spark):
    own, repeated = texts(spark), texts(spark).unionByName(texts(spark).where("doc_id % 2 = 0"))
    nulls = docs_df(spark, [(None, "Anna Nowak"), (None, "in Berlin Jan Kowalski")])
    x = fixture_redaction(own)
    assert len(x.parts) == 1 and not sorts(x.parts[0].token_labels)
    wide = x.labelled.where("is_tok").select("doc_id", "run_no", F.col("pos").alias("tok_no"), "token", "label", "confidence")
    assert same(x.parts[0].token_labels, wide) > 400
    y = fixture_redaction(repeated.unionByName(nulls))
    assert [p.alone for p in y.parts] == [True, False] and not y.parts[0].source.where("doc_id IS NULL OR doc_id % 2 = 0").count()
    same(y.spans.where("doc_id % 2 = 1"), x.spans.where("doc_id % 2 = 1"))
    assert y.pieces.count() == y.over_parts(lambda p: p.pieces).count() > x.pieces.count()


def test_first_subtoken_of_whole_words(spark):
    rows = [(1, 0, t, s, f"L{t}{s}", 0.5) for t in range(5) for s in range(t + 1)]
    x = spark.createDataFrame(rows, "doc_id long, run_no int, tok_no int, sub_no int, label string, confidence double")
    assert same(recognize.first_subtoken(x, whole=True), recognize.first_subtoken(x)) == 5


def test_predictions_are_hashed(spark):
    x = fixture_redaction(texts(spark))
    preds = x.parts[0].token_labels.where("label <> 'O'")
    j = recognize.join_predictions(tokens.pieces(x.segments, offsets=False).where("is_tok"), preds)
    assert not sorts(j) and j.where("label <> 'O'").count() == preds.count() > 5


def test_examples_in_rows(spark):
    r = fixture_redaction(texts(spark))
    rows = C.run_examples(r.parts[0].segments, r.spans)
    assert not sorts(rows) and same(rows, C.bio_examples(C.bio_tags(r.marked, r.spans))) > 4
    assert rows.where(F.array_contains("labels", "I-PERSON")).count() > 1


def test_accuracy_in_rows(spark):
    g, p = (fixture_redaction(texts(spark), config=catalog.Config(threshold=t)) for t in (0.6, 0.9))
    runs = tokens.run_tokens(g.segments).select("doc_id", F.col("seg_no").alias("run_no"), "tokens")
    rows = EV.run_agreement(C.tag_runs(C.tag_runs(runs, g.spans, "gold"), p.spans, "pred"))
    over = EV.agreement(C.bio_tags(g.marked, g.spans), C.bio_tags(p.marked, p.spans))
    assert not sorts(rows) and same(EV.token_accuracy(rows), EV.token_accuracy(over)) == 1
    n = EV.token_accuracy(rows).first()
    assert 0 < n.n_equal < n.n_tokens
    assert tuple(EV.token_accuracy(rows.where("false")).first()) == (0, 0, None)


def test_tagged_examples_in_rows(spark):
    tag = "<xAnon xSubst='A.'>{}</xAnon>"
    docs = ["x " + tag.format("Anna Nowak") + " y", tag.format("A") + tag.format(" B c "), "</xAnon>a<xAnon>b", "<xAnon>a <xAnon>b</xAnon> c</xAnon> d",
            "a < b <xAnon > c", "", None, "  ", "\U0001F600 " + tag.format("\U0001F600 z") + " e", " ".join(tag.format("Jan K.") for _ in range(70))]
    x = docs_df(spark, list(enumerate(docs)))
    sparse = spark.createDataFrame([(0, 1, "PERSON"), (1, 2, "PLACE"), (8, 1, None), (9, 3, "X"), (9, 70, "Y")], "doc_id long, mention int, label string")
    for labels in (None, sparse):
        rows = C.tagged_examples(x, labels, alone=True)
        assert same(rows, C.tagged_examples(x, labels)) == len(docs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_changes_without_joining_all_pieces(spark):
    r = fixture_redaction(texts(spark))
    part, = r.parts
    own = EV.change_set(r.outputs(part).drop("opens"))
    pieces = r.pieces.select("doc_id", "run_no", "pos", "lead", "token", "trail")
    assert same(own, EV.change_set(r.outputs().drop("opens"), pieces)) > 5
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 3  # segments, pieces and positions, each once
