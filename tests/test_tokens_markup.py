import random

from pyspark.sql import functions as F

from conftest import docs_df
from redactum.operators import markup, tokens as tk


# texts and their tokens; worked out by hand
TOKENS = [("ul. Jana Kowalskiego-Nowak 15,", ["ul.", "Jana", "Kowalskiego-Nowak", "15", ","]),
          ("Sąd dnia 1.2.2023 r.", ["Sąd", "dnia", "1", ".", "2", ".", "2023", "r."]), ("", []), ("   ", []),
          ("a-b-c -d e-", ["a-b-c", "-", "d", "e", "-"]), ("Warszawie.", ["Warszawie", "."]),
          ("ab@x.pl", ["ab", "@", "x.", "pl"]), ("\u0106ma ąę.", ["Ćma", "ąę."])]


def test_tokens_worked_cases_and_offsets(spark):
    rnd = random.Random(7)
    alphabet = "abcAB ąŁ.-,\n\t 😀1_"
    texts = [t for t, _ in TOKENS] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    got = {}
    for r in tk.tokens(markup.segments(docs_df(spark, list(enumerate(texts))))).collect():
        got.setdefault(r.doc_id, []).append((r.tok_no, r.token, r.start, r.end))
    for i, t in enumerate(texts):
        found = sorted(got.get(i, []))
        if i < len(TOKENS):
            assert [tok for _, tok, _, _ in found] == TOKENS[i][1], t
        at = 0
        for _, tok, s, e in found:  # a token is its place in the text; only white space lies between tokens
            assert t[s:e] == tok and not t[at:s].strip()
            at = e
        assert not t[at:].strip()


def test_pieces_concatenate_to_text(spark):
    texts = ["x  y\n", "  lead", "trail  ", "<a>b</a>"]
    df = docs_df(spark, list(enumerate(texts)))
    p = tk.pieces(markup.segments(df))
    out = (p.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("run_no", "pos", F.concat("lead", "token", "trail").alias("s")))).alias("a"))
           .select("doc_id", F.array_join("a.s", "").alias("t")).collect())
    assert {r.doc_id: r.t for r in out} == dict(enumerate(texts))


# markup and its text runs as (text, start); worked out by hand
RUNS = [
    ('<p>Jan Kowalski</p><q a="1">z</q>', [("Jan Kowalski", 3), ("z", 28)]),
    ('<a x=">">t<b>u</b></a>', [("t", 9), ("u", 13)]),          # a bracket in an attribute
    ('<a x=">t<', []),                                           # behind an opened attribute value
    ('<a x="' + " " * 8 + ">t<", []),                            # still within ten characters
    ('<a x="' + " " * 9 + ">t<", [("t", 16)]),                   # and one beyond
    ("<a> </a><b>\n</b>", []), ("no markup", []), ("<a>t", []), ("<>x<>", [("x", 2)]),
    ("<a>x y\nz</a>", [("x y\nz", 3)]),
]


def test_markup_runs_worked_cases(spark):
    rnd = random.Random(3)
    frags = ["<", ">", "a", " ", '="', "tekst", "\n", "b c", '"']
    more = ["".join(rnd.choice(frags) for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    texts = [x for x, _ in RUNS] + more
    got = {}
    for r in markup.text_runs(docs_df(spark, list(enumerate(texts)), fmt="xml"), skip_tagged=False).collect():
        got.setdefault(r.doc_id, []).append((r.run_no, r.text, r.start))
    for i, (x, expected) in enumerate(RUNS):
        assert [(t, s) for _, t, s in sorted(got.get(i, []))] == expected, x
    for i, found in got.items():
        for _, t, s in found:  # a run is its place in the text, between brackets
            assert texts[i][s:s + len(t)] == t and t.strip() and not set("<>") & set(t)
            assert texts[i][s - 1] == ">" and texts[i][s + len(t)] == "<"


def test_blank_attributes(spark):
    df = spark.createDataFrame([('<xPart xEditor="Jan Kowalski" xYear="2023"><a xEditor=\'Ewa\'>t</a></xPart>',)], "t string")
    out = df.select(markup.blank_attributes(F.col("t"), ["xEditor"]).alias("o")).first().o
    assert out == '<xPart xEditor="(...)" xYear="2023"><a xEditor=\'(...)\'>t</a></xPart>'
