"""Golden sentence cases (S7): ``ANONYMIZE("input") = "expected"`` or
``= NO_CHANGE``, whitespace collapsed. Alternatives ``"a" OR "b"`` are
accepted (the reference's lazy group stops at the first quote, Q9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.names import strip_ws
from .files import file_name

# --- fixed values: golden file syntax ----------------------------------------
CASE_PATTERN = r'(?s)ANONYMIZE\("(.*?)"\)\s*=\s*(?:"((?:[^"]|" OR ")*)"|(NO_CHANGE))'
# Java twin: the alternation under a star recurses once a character and ends the
# stack on a long expected text. Stretches without a quote are possessive (what
# they would give back is never a quote), so only separators are tried one by one.
CASE_PATTERN_JAVA = CASE_PATTERN.replace(r'(?:[^"]|" OR ")*', r'[^"]*+(?:" OR "[^"]*+)*', 1)
ALT_SEPARATOR = '" OR "'
# ---------------------------------------------------------------------------


def collapse_ws(c):
    return strip_ws(F.regexp_replace(c, F.lit(P.SPACE_RUN), F.lit(" ")))


def read_cases(files: DataFrame) -> DataFrame:
    """files(file, content) -> cases_gold(file, case_no, input, expected, no_change)."""
    c = F.col("content")
    x = files.select("file",
                     F.regexp_extract_all(c, F.lit(CASE_PATTERN_JAVA), 1).alias("i"),
                     F.regexp_extract_all(c, F.lit(CASE_PATTERN_JAVA), 2).alias("e"),
                     F.regexp_extract_all(c, F.lit(CASE_PATTERN_JAVA), 3).alias("n"))
    x = x.select("file", F.posexplode(F.arrays_zip("i", "e", "n")).alias("k", "m"))
    no_change = F.col("m.n") == F.lit("NO_CHANGE")
    expected = F.when(no_change, F.array(F.lit("NO_CHANGE"))).otherwise(
        F.transform(F.split(F.col("m.e"), ALT_SEPARATOR.replace('"', '\\"'), -1), lambda s: collapse_ws(s)))
    return x.select("file", (F.col("k") + 1).alias("case_no"), collapse_ws(F.col("m.i")).alias("input"),
                    expected.alias("expected"), no_change.alias("no_change"))


def read_case_files(spark, path: str) -> DataFrame:
    """Whole ``*.test`` files of a folder as (file, content)."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.test")
    return df.select(file_name().alias("file"), F.col("value").alias("content"))
