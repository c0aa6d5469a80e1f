"""Name normalisation over distinct names (X4: P4, P5, J2, J3, W4, W5) and the
same-person report (X5).

The reference asks a morphological analyser per word, one name at a time, with
an LRU of 500. Here the dictionary is a table ``lemmas(orth, ord, lemma, tag)``
and the job runs once over the *distinct* names of a batch: words are joined to
the dictionary (a shuffle join; AQE broadcasts it only if its measured size is
small), the best single lemma is a ranked window per word, and the best
(first, last) pair is a bounded join: first-word interpretations are joined to
the <= 28 (gender, case, number) classes of the last word's interpretations of
the same gender, never to all interpretation pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import name_parts, split_ws, strip_titles, strip_ws

# --- fixed values ----------------------------------------------------------
CASES = ["nom", "gen", "dat", "acc", "inst", "loc", "voc"]
# what a pair of analyses of first and last word scores: same gender, same case,
# both plural, both singular, first word nominative
SAME_GENDER, SAME_CASE, BOTH_PLURAL, BOTH_SINGULAR, NOMINATIVE = 100, 50, 20, 30, 5
# ---------------------------------------------------------------------------


def clean_name(name):
    """P4 on a stripped name, stripped again."""
    return strip_ws(strip_titles(strip_ws(name)))


def lemma_base(lemma):
    return F.lower(F.substring_index(lemma, ":", 1))


def best_lemmas(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    """W4 + J2: words(word) -> (word, best). Nouns only, +2 ':sg:', +1
    ':nom:', first analysis on ties; no noun -> first analysis; unknown word
    -> the word lower-cased."""
    d = lemmas.select(F.col("orth").alias("word"), "ord", "lemma", "tag")
    x = words.select("word").distinct().join(d, "word", "left")
    noun = F.coalesce(F.col("tag").startswith("subst"), F.lit(False))
    score = F.when(noun, F.col("tag").contains(":sg:").cast("int") * 2 + F.col("tag").contains(":nom:").cast("int")).otherwise(0)
    r = F.row_number().over(Window.partitionBy("word").orderBy(noun.desc(), score.desc(), F.col("ord").asc_nulls_last()))
    x = x.withColumn("r", r).where("r = 1")
    return x.select("word", F.when(F.col("lemma").isNull() & F.col("ord").isNull(), F.lower("word"))
                    .otherwise(lemma_base(F.col("lemma"))).alias("best"))


def interpretations(lemmas: DataFrame) -> DataFrame:
    """W5 input: noun analyses with gender (m1, else f), case (first found of
    nom..voc) and number (sg if ':sg:' else pl)."""
    tag = F.col("tag")
    gender = F.when(tag.contains("m1"), "m1").when(tag.contains(":f"), "f")
    case = F.lit(None).cast("string")
    for c in reversed(CASES):
        case = F.when(tag.contains(":" + c), F.lit(c)).otherwise(case)
    number = F.when(tag.contains(":sg:"), "sg").otherwise("pl")
    return (lemmas.where(tag.startswith("subst"))
            .select(F.col("orth").alias("word"), "ord", lemma_base(F.col("lemma")).alias("lemma"),
                    gender.alias("gender"), case.alias("gcase"), number.alias("number"))
            .where(F.col("gender").isNotNull() & F.col("gcase").isNotNull()))


def name_keys(names: DataFrame, lemmas: DataFrame) -> DataFrame:
    """names(name) -> name_keys(name, first, last, person_key)."""
    n = names.select("name").distinct()
    parts, cnt, p0, plast = name_parts(clean_name(F.col("name")))
    n = n.select("name", p0.alias("w_first"), plast.alias("w_last"), cnt.alias("n_parts"))
    words = (n.select(F.col("w_first").alias("word")).union(n.select(F.col("w_last").alias("word")))
             .where(F.col("word").isNotNull()))
    best = best_lemmas(words, lemmas)
    interps = interpretations(lemmas.join(words.distinct().withColumnRenamed("word", "orth"), "orth", "left_semi"))
    # the <= 2*7*2 classes of last-word interpretations, earliest analysis each
    lclass = (interps.groupBy("word", "gender", "gcase", "number")
              .agg(F.min("ord").alias("l_ord"), F.min_by("lemma", "ord").alias("l_lemma")))
    multi = n.where(F.col("n_parts") >= 2)
    fi = multi.join(interps.select(F.col("word").alias("w_first"), F.col("ord").alias("f_ord"),
                                   F.col("lemma").alias("f_lemma"), F.col("gender"),
                                   F.col("gcase").alias("f_case"), F.col("number").alias("f_number")), "w_first")
    pairs = fi.join(lclass.withColumnRenamed("word", "w_last"), ["w_last", "gender"])
    score = (F.lit(SAME_GENDER) + F.when(F.col("f_case") == F.col("gcase"), SAME_CASE).otherwise(0)
             + F.when(F.col("f_number") == F.col("number"),
                      F.when(F.col("f_number") == "sg", BOTH_SINGULAR).otherwise(BOTH_PLURAL)).otherwise(0)
             + F.when(F.col("f_case") == "nom", NOMINATIVE).otherwise(0))
    best_pair = (pairs.groupBy("name")
                 .agg(F.max_by(F.struct("f_lemma", "l_lemma"), F.struct(score, -F.col("f_ord"), -F.col("l_ord"))).alias("bp")))
    b1 = best.select(F.col("word").alias("w_first"), F.col("best").alias("b_first"))
    b2 = best.select(F.col("word").alias("w_last"), F.col("best").alias("b_last"))
    x = n.join(best_pair, "name", "left").join(b1, "w_first", "left").join(b2, "w_last", "left")
    first = (F.when(F.col("n_parts") == 0, F.lit(""))
             .when(F.col("n_parts") == 1, F.col("b_first"))
             .otherwise(F.coalesce(F.col("bp.f_lemma"), F.col("b_first"))))
    last = (F.when(F.col("n_parts") <= 1, F.lit(""))
            .otherwise(F.coalesce(F.col("bp.l_lemma"), F.col("b_last"))))
    return x.select("name", first.alias("first"), last.alias("last"),
                    strip_ws(F.concat(first, F.lit(" "), last)).alias("person_key"))


def same_person(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """pairs(a, b) -> (a, b, key_a, key_b, same)."""
    ka = keys.select(F.col("name").alias("a"), F.col("person_key").alias("key_a"))
    kb = keys.select(F.col("name").alias("b"), F.col("person_key").alias("key_b"))
    x = pairs.join(ka, "a", "left").join(kb, "b", "left")
    return x.withColumn("same", F.col("key_a").eqNullSafe(F.col("key_b")))


def words_of_names(names: DataFrame) -> DataFrame:
    return names.select(F.explode(split_ws(clean_name(F.col("name")))).alias("word")).distinct()
