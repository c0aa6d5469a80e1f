"""Column expressions for person names: titles, parts, initials, letter shift.

All of them are built-in Spark expressions (higher-order array functions
included), so they run inside whole-stage code generation or the interpreted
expression evaluator on the executors; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def strip_ws(c: Column) -> Column:
    """Python's ``str.strip()`` (Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(c, F.lit(P.EDGE_SPACE), F.lit(""))


def rstrip_ws(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(P.TRAILING_SPACE), F.lit(""))


def split_ws(c: Column) -> Column:
    """Python's ``str.split()``: whitespace runs, no empty parts."""
    return F.filter(F.split(c, P.SPACE_RUN), lambda x: x != F.lit(""))


def strip_titles(name: Column) -> Column:
    """Two passes of title removal, each title needs following space."""
    once = F.regexp_replace(name, F.lit(P.TITLES_1_JAVA), F.lit(""))
    return F.regexp_replace(once, F.lit(P.TITLES_2_JAVA), F.lit(""))


def letter(part: Column, shift: int, fold: str = "reference") -> Column:
    """Initial letter of one part, optionally Caesar-shifted.

    ``fold="reference"`` reproduces the reference's table (Polish capitals
    land six letters off, Q4); ``fold="letter"`` maps them to their base
    letter first."""
    first = F.upper(F.substring(part, 1, 1))
    if shift <= 0:
        return first
    to = P.FOLD_TO_LETTER if fold == "letter" else P.FOLD_TO
    code = F.ascii(F.translate(first, P.FOLD_FROM, to))
    return F.chr(F.lit(65) + F.pmod(code - F.lit(65) + F.lit(shift), F.lit(26)))


def initials(name: Column, shift: int = 0, fold: str = "reference") -> Column:
    """Initials of a raw mention ("F. L.", "F.", hyphen rule, "X.")."""
    def ini(part):
        return letter(part, shift, fold)

    parts = split_ws(name)
    n = F.size(parts)
    p0 = F.get(parts, 0)
    plast = F.element_at(parts, -1)
    # first part at index >= 1 holding an ASCII hyphen
    tail = F.slice(parts, 2, F.greatest(n - 1, F.lit(1)))
    hyph = F.get(F.filter(tail, lambda x: x.contains("-")), 0)
    before = F.substring_index(hyph, "-", 1)
    idx = F.array_position(parts, hyph)  # 1-based first equal part
    surname = (F.when(before != "", before)
               .when((n > 2) & (idx - 1 > 1), F.get(parts, (idx - 2).cast("int"))))
    sur_letter = F.coalesce(F.when(surname.isNotNull() & (strip_ws(surname) != ""), ini(surname)), F.lit("X"))
    return (F.when(n == 0, F.lit("X."))
            .when(n == 1, F.concat(ini(p0), F.lit(".")))
            .when(hyph.isNotNull(), F.concat(ini(p0), F.lit(". "), sur_letter, F.lit(".")))
            .otherwise(F.concat(ini(p0), F.lit(". "), ini(plast), F.lit("."))))


def name_parts(clean: Column):
    """P5: first and last part of a title-free name (middle names ignored)."""
    parts = split_ws(clean)
    n = F.size(parts)
    first = F.when(n >= 1, F.get(parts, 0))
    last = F.when(n >= 2, F.element_at(parts, -1))
    return parts, n, first, last
