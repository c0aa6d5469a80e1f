"""The rule recognizer of the test tables (X1a): label and confidence of each
token by fixed rules, all JVM-side. Production code passes its own recognizer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.tokens import run_window

# --- fixed values of the test-table rule recognizer ------------------------
PREPOSITIONS = ["in", "at", "from", "to", "de", "en", "von", "aus", "nach", "bei", "zu",
                "dans", "sur", "par", "con", "por", "para"]
TRANSPARENT_SYMBOL = "@"
# ---------------------------------------------------------------------------

CAP3 = r"^\p{Lu}\p{Ll}{2,}$"
CAPS = r"^\p{Lu}{3,}$"
DIGITS9 = r"^[0-9]{9,}$"


def rule_prefilter(seg):
    """Run-level superset test for the rule recognizer: a run can only hold
    a span if its text matches one of these (two word tokens are always
    separated by whitespace only, or they would be one token). Runs that
    do not match skip the token pass of recognition."""
    z = P.SPACE_CLASS
    preps = "|".join(PREPOSITIONS)
    pat = (rf"[0-9]{{9,}}|\p{{Lu}}{{3,}}[{z}]*License|\p{{Lu}}\p{{Ll}}{{2,}}[{z}]*\p{{Lu}}\p{{Ll}}{{2,}}"
           rf"|(?:{preps})[{z}]*\p{{Lu}}\p{{Ll}}{{2,}}")
    return seg.rlike(pat)




def rule_confidence(token):
    return F.lit(0.5) + (F.length(token) % F.lit(5)) * F.lit(0.125)


def rule_labels(pcs: DataFrame) -> DataFrame:
    """X1(a): rule recognizer over runs; adds label, confidence.

    Neighbours come with the piece (``before``, ``after``) where runs are worked
    in their own rows; otherwise each token's regex predicates are evaluated once
    and neighbours see them through lag/lead of the booleans."""
    tok = F.col("token")
    x = (pcs.withColumn("_c3", F.col("is_tok") & tok.rlike(CAP3))
         .withColumn("_ca", F.col("is_tok") & tok.rlike(CAPS)))
    if "before" in pcs.columns:
        prev, nxt = F.col("before"), F.col("after")
        p_c3, n_c3, p_ca = prev.rlike(CAP3), nxt.rlike(CAP3), prev.rlike(CAPS)
    else:
        w = run_window()
        prev, nxt = F.lag("token", 1).over(w), F.lead("token", 1).over(w)
        p_c3, n_c3, p_ca = F.lag("_c3", 1).over(w), F.lead("_c3", 1).over(w), F.lag("_ca", 1).over(w)
    c3, ca = F.col("_c3"), F.col("_ca")
    label = (F.when(~F.col("is_tok"), F.lit("O"))
             .when(tok.rlike(DIGITS9), F.lit("B-SENSITIVE"))
             .when(ca & (nxt == "License"), F.lit("B-PRODUCT"))
             .when((tok == "License") & p_ca, F.lit("I-PRODUCT"))
             .when(c3 & p_c3, F.lit("I-PERSON"))
             .when(c3 & n_c3, F.lit("B-PERSON"))
             .when(c3 & prev.isin(PREPOSITIONS), F.lit("B-LOCATION"))
             .when(tok == TRANSPARENT_SYMBOL, F.lit("MAIL"))
             .otherwise(F.lit("O")))
    conf = F.when(F.col("is_tok"), rule_confidence(tok)).otherwise(F.lit(1.0))
    return x.withColumn("label", label).withColumn("confidence", conf).drop("_c3", "_ca")
