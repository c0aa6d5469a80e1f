"""Markup handling.

A markup document is cut into pieces ``[^<>]+`` and single brackets. A piece is
a *text run* when it sits between ``>`` and ``<``, holds a non-space
character, and the ten characters before that ``>`` do not end (right-trimmed)
in ``="`` (a bracket inside an attribute value). Nothing is parsed: entities,
comments and CDATA stay opaque, exactly as in a regex scan of the raw text.

Plain-text documents are one run each. Both formats share this plan, so a
mixed collection is one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.arrays import bound, running
from ..functions.names import rstrip_ws


def segments(docs: DataFrame, skip_tagged: bool = True, alone: bool = False) -> DataFrame:
    """docs(doc_id, text, fmt) -> segments(doc_id, seg_no, seg, is_xml, is_run, base).

    ``base`` is the code-point offset of the segment in the document.
    Concatenating ``seg`` in ``seg_no`` order gives back ``text`` exactly.
    ``skip_tagged`` leaves runs that are already inside a mention tag alone
    (re-running on redacted output does not nest tags). ``alone``: no two rows
    share a doc_id; then a document is cut in its own row, without windows.
    """
    is_xml = F.col("fmt") == F.lit("xml")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(P.MARKUP_PIECE), 0)
    arr = (F.when(is_xml & (F.size(pieces) > 0), pieces)
           .otherwise(F.array(F.coalesce(F.col("text"), F.lit("")))))
    if alone:
        widths = lambda xs: F.when(F.size(xs) == 1, F.array(F.lit(0))).otherwise(running(F.transform(xs, F.length)))
        rows = bound(arr, lambda xs: bound(widths(xs), lambda at: F.transform(xs, lambda x, i: F.struct(
            i.alias("seg_no"), x.alias("seg"), F.get(xs, i - 1).alias("prev"), F.get(xs, i - 2).alias("prev2"),
            F.get(xs, i + 1).alias("next"), F.get(at, i).alias("at")))))
        s = docs.select("doc_id", is_xml.alias("is_xml"), F.inline(rows))
        prev, prev2, nxt, base = F.col("prev"), F.col("prev2"), F.col("next"), F.col("at")
    else:
        s = docs.select("doc_id", is_xml.alias("is_xml"), F.posexplode(arr).alias("seg_no", "seg"))
        w = Window.partitionBy("doc_id").orderBy("seg_no")
        prev = F.lag("seg", 1).over(w)
        prev2 = F.lag("seg", 2).over(w)
        nxt = F.lead("seg", 1).over(w)
        base = F.coalesce(F.sum(F.length("seg")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # "the ten characters before that '>' end in '=\"' after right-trimming":
    # pieces alternate between brackets and maximal bracket-free stretches,
    # so only the stretch right before the '>' (prev2) can supply both
    # characters, and it does iff its trimmed text ends in '="' and at most
    # eight trailing spaces push them out of the ten-character window.
    trimmed = rstrip_ws(prev2)
    in_attr = ((~prev2.isin("<", ">")) & trimmed.endswith('="')
               & ((F.length(prev2) - F.length(trimmed)) <= F.lit(8)))
    markup_run = ((~F.col("seg").isin("<", ">")) & (prev == ">") & (nxt == "<")
                  & F.col("seg").rlike(P.NOT_SPACE)
                  & ~F.coalesce(in_attr, F.lit(False)))
    if skip_tagged:
        markup_run = markup_run & ~F.coalesce(prev2.rlike(r"^xAnon(\s|$)"), F.lit(False))
    return s.select("doc_id", "seg_no", "seg", "is_xml",
                    F.when(F.col("is_xml"), F.coalesce(markup_run, F.lit(False)))
                    .otherwise(F.lit(True)).alias("is_run"), base.cast("int").alias("base"))


def text_runs(docs: DataFrame, skip_tagged: bool = True) -> DataFrame:
    """runs(doc_id, run_no, start, text) with code-point offsets in the
    raw document."""
    return segments(docs, skip_tagged).where("is_run").select(
        "doc_id", F.col("seg_no").alias("run_no"), F.col("base").alias("start"), F.col("seg").alias("text"))


def blank_attributes(text, names, substitute: str = "(...)"):
    """Q6 option: replace the values of the listed attributes (e.g. editor
    or clerk names on the root element) with a substitute. Both quote
    styles; the markup is otherwise unchanged. A column expression."""
    if not names:
        return text
    alt = "|".join(names)
    dq = rf'(\s(?:{alt})\s*=\s*")[^"]*(")'
    sq = rf"(\s(?:{alt})\s*=\s*')[^']*(')"
    once = F.regexp_replace(text, F.lit(dq), F.lit("$1" + substitute + "$2"))
    return F.regexp_replace(once, F.lit(sq), F.lit("$1" + substitute + "$2"))
