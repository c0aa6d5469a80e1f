import random

from pyspark.sql import functions as F

from spec import number_persons
from redactum.functions.names import initials as initials_col, strip_titles as strip_col, strip_ws
from redactum.operators import spans, persons


# (labels with confidences, spans as (first, last, type, mean confidence)); worked out by hand
BIO = [
    ("B-PERSON .9, I-PERSON .8, O 1", [(0, 1, "PERSON", 0.85)]),
    ("B-PERSON .9, B-PERSON .8", [(0, 0, "PERSON", 0.9), (1, 1, "PERSON", 0.8)]),
    ("O 1, I-LOCATION .9, I-LOCATION .7", [(1, 2, "LOCATION", 0.8)]),
    ("B-PERSON .9, I-LOCATION .8", [(0, 0, "PERSON", 0.9), (1, 1, "LOCATION", 0.8)]),
    ("B-PERSON .7", [(0, 0, "PERSON", 0.7)]),
    ("B-PERSON .69", []),
    ("B-PERSON .9, I-PERSON .5, I-PERSON .9", [(0, 0, "PERSON", 0.9), (2, 2, "PERSON", 0.9)]),
    ("B-PERSON .9, MISC .9, I-PERSON .9", [(0, 2, "PERSON", 0.9)]),
    ("O 1, O 1, B-LOCATION 1", [(2, 2, "LOCATION", 1.0)]),
    ("O 1", []),
    ("MISC .9, B-PERSON .8, O .2, I-PERSON .8", [(1, 1, "PERSON", 0.8), (3, 3, "PERSON", 0.8)]),
]


def decoded(spark, seqs):
    rows = [(d, 0, i, True, "", f"t{i}", " ", 2 * i, 2 * i + 1, lab, c) for d, seq in enumerate(seqs)
            for i, (lab, c) in enumerate(seq)]
    df = spark.createDataFrame(rows, "doc_id long, run_no int, pos int, is_tok boolean, lead string, token string, "
                                     "trail string, start int, end int, label string, confidence double")
    got = {}
    for r in spans.decode_spans(spans.mark_spans(df)).collect():
        got.setdefault(r.doc_id, []).append((r.first_pos, r.last_pos, r.label, round(r.confidence, 9)))
    return got


def test_bio_decode_worked_cases(spark):
    seqs = [[(x.split()[0], float(x.split()[1])) for x in text.split(", ")] for text, _ in BIO]
    got = decoded(spark, seqs)
    for d, (text, expected) in enumerate(BIO):
        assert sorted(got.get(d, [])) == expected, text


def test_bio_spans_keep_their_properties(spark):
    rnd = random.Random(11)
    labs = ["O", "B-PERSON", "I-PERSON", "B-LOCATION", "I-LOCATION", "MISC"]
    seqs = [[(rnd.choice(labs), rnd.choice([0.5, 0.7, 0.75, 0.9, 1.0])) for _ in range(rnd.randint(1, 25))] for _ in range(300)]
    got = decoded(spark, seqs)
    assert any(len(v) > 2 for v in got.values())
    for d, found in got.items():
        found.sort()
        assert all(a[1] < b[0] for a, b in zip(found, found[1:]))  # no overlap
        for first, last, label, mean in found:
            assert mean >= 0.7 and seqs[d][first][0][2:] == seqs[d][last][0][2:] == label
            assert not any(lab == "O" or c < 0.7 for lab, c in seqs[d][first:last + 1])
    starts = {d: sum(lab.startswith("B-") and c >= 0.7 for lab, c in seq) for d, seq in enumerate(seqs)}
    assert all(len(got.get(d, [])) >= n for d, n in starts.items())


# name, initials without a shift, initials shifted by 2; worked out by hand
INITIALS = [("Jan Kowalski", "J. K.", "L. M."), ("Jan", "J.", "L."), ("", "X.", "X."), ("   ", "X.", "X."),
            ("Anna Maria Nowak", "A. N.", "C. P."), ("Jan Nurek-Bielawski", "J. N.", "L. P."),
            ("Jan -Nowak", "J. X.", "L. X."), ("Anna Nowak - Lis", "A. N.", "C. P."), ("jan kowalski", "J. K.", "L. M."),
            ("Ewa Zet", "E. Z.", "G. B."), ("Jan\u00a0Kowalski", "J. K.", "L. M.")]
TITLES = [("dr hab. Jan Nowak", "Jan Nowak"), ("pan Jan Kowalski", "Jan Kowalski"), ("mał. Olgierd Rybak", "Olgierd Rybak"),
          ("Pani Sędzia Anna", "Anna"), ("Prof. mgr Ewa Lis", "Ewa Lis"), ("Jan Kowalski", "Jan Kowalski"), ("", ""),
          ("  adw. Ewa  ", "Ewa"), ("drab Jan", "drab Jan")]


def test_initials_and_titles_worked_cases(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in INITIALS], "name string")
    got = {r.name: (r.a, r.b, r.c) for r in df.select(
        "name", initials_col(F.col("name")).alias("a"), initials_col(F.col("name"), 2).alias("b"),
        initials_col(F.col("name"), 26).alias("c")).collect()}
    assert {n: got[n][:2] for n, _, _ in INITIALS} == {n: (a, b) for n, a, b in INITIALS}
    assert all(a == c for a, _, c in got.values())  # a shift by 26 changes no unaccented letter
    df = spark.createDataFrame(TITLES, "name string, expected string")
    bad = df.select("name", "expected", strip_ws(strip_col(strip_ws(F.col("name")))).alias("got")).filter("got <> expected")
    assert bad.collect() == []


def test_numbering_matches_sequential(spark):
    rnd = random.Random(2)
    rows, docs = [], {}
    for d in range(200):
        ms = []
        for j in range(rnd.randint(1, 12)):
            key = rnd.choice(["a b", "c d", "e f", "g h", "x"])
            ini = {"a b": "J. K.", "c d": "J. K.", "e f": "A. B.", "g h": "J. K.", "x": "X."}[key]
            ms.append((key, ini, rnd.randint(0, 3), rnd.randint(0, 500) * 10 + j))
        docs[d] = ms
        rows += [(d, run, start, key, ini) for key, ini, run, start in ms]
    df = spark.createDataFrame(rows, "doc_id long, run_no int, start int, person_key string, text string")
    # the text column carries the initials so that initials(text) is known
    df = df.withColumn("text", F.regexp_replace("text", r"\.", ""))
    got = {(r.doc_id, r.person_key): r.substitute for r in persons.persons(df).collect()}
    for d, ms in docs.items():
        order = sorted(ms, key=lambda m: (m[2], -m[3]))
        exp = number_persons([(k, i) for k, i, _, _ in order])
        for k, v in exp.items():
            assert got[(d, k)] == v


def test_fold_letter_option_and_whole_documents(spark):
    from conftest import docs_df
    from redactum.operators import recognize
    from redactum.fixtures.plan import fixture_redaction
    from redactum.plans.pipeline import Config

    df = spark.createDataFrame([("Łukasz Ślęzak",)], "name string")
    assert df.select(initials_col(F.col("name"), 2, "letter").alias("l")).first().l == "N. U."  # L+2, S+2
    docs = docs_df(spark, [(1, "Anna Nowak oraz " * 400 + "Anna Nowak")])
    terms = spark.createDataFrame([("Anna", "B-PERSON", 0.9), ("Nowak", "I-PERSON", 0.9)], "term string, label string, confidence double")
    rec = lambda p: recognize.gazetteer_labels(p, terms)
    full = fixture_redaction(docs, recognizer=rec, config=Config(materialize="none")).redacted().first()
    assert full.text == "A. N. oraz " * 400 + "A. N."


def test_split_rank_equals_row_number_on_a_hot_group(spark):
    from pyspark.sql import Window

    rnd = random.Random(9)
    # one hot (case, initials) group holding most rows, plus small ones
    rows = [("hot", "J. K.", rnd.random()) for _ in range(3000)]
    rows += [(f"c{i % 7}", rnd.choice(["A. B.", "J. K."]), rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "case_id string, initials string, o double")
    got = persons.split_rank(df, ["case_id", "initials"], "o", slices=16)
    assert got.select("_slice" if "_slice" in got.columns else "case_id").count() == len(rows)
    w = Window.partitionBy("case_id", "initials")
    ref = df.withColumn("k_ref", F.row_number().over(w.orderBy("o"))).withColumn("n_ref", F.count(F.lit(1)).over(w))
    j = got.join(ref, ["case_id", "initials", "o"])
    assert j.count() == len(rows)
    assert j.where("k <> k_ref OR n_same <> n_ref").count() == 0


def test_split_rank_on_a_large_group_with_its_columns(spark):
    n = 400_000
    df = (spark.range(0, n, 1, 12).select(F.lit("hot").alias("case_id"), F.lit("J. K.").alias("initials"),
                                         F.xxhash64("id").alias("o"), F.concat(F.lit("person "), F.col("id")).alias("person_key")))
    got = persons.split_rank(df, ["case_id", "initials"], "o", slices=8)
    r = got.agg(F.count("*"), F.countDistinct("k"), F.min("k"), F.max("k"), F.min("n_same"), F.countDistinct("person_key"),
                F.countDistinct("substitute")).first()
    assert tuple(r) == (n, n, 1, n, n, n, n)
    slices = got.select(F.floor((F.col("k") - 1) / 1000).alias("g"), "o").groupBy("g").agg(F.min("o").alias("a"), F.max("o").alias("b"))
    rows = sorted(slices.collect())
    assert all(x.b < y.a for x, y in zip(rows, rows[1:]))  # numbers follow the order


def test_span_tokens_equal_marked_spans(spark):
    """The rows in spans are the same with and without windows over the other tokens."""
    import random

    from redactum.operators import spans as SP

    rng = random.Random(5)
    labels = ["O", "B-A", "I-A", "B-B", "I-B", "X", "I-"]
    rows = [(d, r, p, rng.choice(labels), rng.choice([0.6, 0.7, 0.9]), f"t{p}", " ", p * 3, p * 3 + 2)
            for d in range(6) for r in range(2) for p in range(60)]
    x = spark.createDataFrame(rows, "doc_id long, run_no int, pos int, label string, confidence double, token string, trail string, start int, `end` int")
    keys = ["doc_id", "run_no", "pos", "kind", "etype", "span"]
    want = {tuple(r) for r in SP.mark_spans(x).where("span IS NOT NULL").select(keys).collect()}
    plan = SP.span_tokens(x)
    assert want == {tuple(r) for r in plan.select(keys).collect()} and len(want) > 100
    sort = plan._jdf.queryExecution().optimizedPlan().toString()
    assert sort.rindex("Filter") > sort.rindex("Window")  # O tokens leave before the first window
