"""A rule-made dictionary for the invented names of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.names import words_of_names


def fixture_lemmas(words: DataFrame) -> DataFrame:
    """A rule-made dictionary for tests on the invented corpus: analyses are
    generated from each word's ending (a real one is loaded with
    ``sources.lexicon.read_lexicon``)."""
    w = F.col("word")
    low = F.lower(w)
    stem = F.expr("substring(word, 1, length(word) - 1)")
    rules = [
        (low.endswith("a"), 0, stem, "subst:sg:gen:m1"),
        (low.endswith("a"), 1, F.concat(w, F.lit(":Sf")), "subst:sg:nom:f"),
        (low.endswith("a"), 2, w, "adj:sg:nom:f:pos"),
        (low.endswith("e"), 0, w, "adj:sg:nom:n:pos"),
        (low.endswith("e"), 1, F.concat(stem, F.lit("a")), "subst:sg:loc:f"),
        (low.endswith("e"), 2, stem, "subst:pl:nom:m1"),
        (low.rlike("[nrzh]$"), 0, w, "subst:sg:nom:m1"),
        (low.rlike("[nrzh]$"), 1, F.concat(w, F.lit("a")), "subst:pl:gen:f"),
        (low.rlike("[iy]$"), 0, w, "subst:pl:nom:m1"),
        (low.rlike("[iy]$"), 1, w, "subst:sg:gen:f"),
        (low.endswith("s"), 0, w, "verb:fin:sg:ter"),
    ]
    arr = F.filter(F.array(*[F.when(c, F.struct(F.lit(o).alias("ord"), l.alias("lemma"), F.lit(t).alias("tag")))
                             for c, o, l, t in rules]), lambda s: s.isNotNull())
    d = words.select("word").distinct().select("word", F.explode(arr).alias("e"))
    return d.select(F.col("word").alias("orth"), F.col("e.ord").cast("int").alias("ord"),
                    F.col("e.lemma").alias("lemma"), F.col("e.tag").alias("tag"))


def rule_lemmas(names: DataFrame) -> DataFrame:
    """The dictionary of the words of names(name)."""
    return fixture_lemmas(words_of_names(names))
