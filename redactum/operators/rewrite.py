"""Rewriting (P13, P14, P15, F3), tagged output parsing (P16, P18) and the
cleaned text view (P17).

A document is rewritten in its own row: its mentions come as one array of
(start, end, substitute) and ``spliced`` puts the replacements between the
stretches that stay. Nothing is exploded or collected but the mentions, a
document without mentions passes as it is, and everything outside the mentions
comes back byte-identical. ``emit`` is the piece-wise form of the same rewrite,
for reports that need the pieces (U3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.substitutes import ELLIPSIS, TAG_CLOSE, TAG_MID, TAG_OPEN, escape_attr


#: code points of a block of a text that is spliced
BLOCK = 1024


def document_spans(subs: DataFrame) -> DataFrame:
    """Mentions with substitutes -> (doc_id, spans), one array a document of
    (start, end, substitute) in the document's own code-point offsets."""
    at = F.struct((F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), "substitute")
    return subs.groupBy("doc_id").agg(F.sort_array(F.collect_list(at)).alias("spans"))


def spliced(text, blocks, spans, tags):
    """The text with its spans (sorted, disjoint) replaced, or tagged where ``tags``.

    ``blocks`` are the text's stretches of ``BLOCK`` code points: a substring
    of a long text is counted from its start, one of a block is not, so the
    whole is linear in the text."""
    block = F.lit(BLOCK)

    def between(a, b):
        i, j = F.floor(a / block).cast("int"), F.floor(b / block).cast("int")
        piece = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
        first, last = a % block + 1, b % block
        inner = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        return F.when(i == j, F.substring(piece(i), first, b - a)).otherwise(
            F.concat(F.substring(piece(i), first, block), inner, F.substring(piece(j), F.lit(1), last)))

    n = F.size(spans)

    def part(i):
        own, before = F.get(spans, i), F.get(spans, i - 1)
        start = F.when(i == n, F.length(text)).otherwise(own["start"])
        kept = between(F.when(i == 0, F.lit(0)).otherwise(before["end"]), start)
        tagged = F.concat(F.lit(TAG_OPEN), escape_attr(own["substitute"]), F.lit(TAG_MID), between(start, own["end"]), F.lit(TAG_CLOSE))
        return F.concat(kept, F.when(i == n, F.lit("")).when(tags, tagged).otherwise(own["substitute"]))

    return F.array_join(F.transform(F.sequence(F.lit(0), n), part), "")


def rewritten(docs: DataFrame, spans: DataFrame, tags) -> DataFrame:
    """docs(doc_id, text, ...) and document_spans -> (doc_id, text, n_mentions).

    One left join; documents without mentions keep their row untouched (F3)."""
    x = docs.join(spans, "doc_id", "left")
    x = x.withColumn("blocks", F.when(F.col("spans").isNotNull(), F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), 0)))
    new = spliced(F.col("text"), F.col("blocks"), F.col("spans"), tags)
    return x.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(new).alias("text"),
                    F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_mentions"))


def span_positions(subs: DataFrame) -> DataFrame:
    """Kept spans -> one row per token position they cover (small: only
    tokens inside mentions)."""
    return subs.select("doc_id", "run_no", "substitute", "first_pos", "last_pos",
                       F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))


def emit(pcs: DataFrame, positions: DataFrame, tags) -> DataFrame:
    """pieces + span positions -> piece outputs (doc_id, run_no, pos, out, opens, before).

    ``tags`` is a boolean column: tag form for markup, plain replacement for
    text (P13); ``before`` is the piece as it was. The positions are few: they are
    the hashed side, the pieces are not sorted for the join."""
    x = pcs.join(positions.hint("shuffle_hash"), ["doc_id", "run_no", "pos"], "left")
    inside = F.col("substitute").isNotNull()
    first = inside & (F.col("pos") == F.col("first_pos"))
    last = inside & (F.col("pos") == F.col("last_pos"))
    e = lambda c, v: F.when(c, v).otherwise(F.lit(""))
    tagged = F.concat(F.col("lead"), e(first, F.concat(F.lit(TAG_OPEN), escape_attr(F.col("substitute")), F.lit(TAG_MID))),
                      F.col("token"), e(last, F.lit(TAG_CLOSE)), F.col("trail"))
    plain = F.concat(F.col("lead"), e(first, F.col("substitute")), e(~inside, F.col("token")),
                     e(~inside | last, F.col("trail")))
    return x.select("doc_id", "run_no", "pos", F.when(tags, tagged).otherwise(plain).alias("out"),
                    first.cast("int").alias("opens"), F.concat("lead", "token", "trail").alias("before"))


def rebuild(outs: DataFrame) -> DataFrame:
    """Piece outputs -> docs'(doc_id, text, n_mentions). The pieces of
    one document are bounded by the admission size cap; the mention count
    (G2) is the number of span openings, summed in the same aggregate."""
    parts = F.sort_array(F.collect_list(F.struct("run_no", "pos", "out")))
    return (outs.groupBy("doc_id").agg(parts.alias("ps"), F.sum("opens").cast("long").alias("n_mentions"))
            .select("doc_id", F.array_join(F.transform("ps", lambda s: s["out"]), "").alias("text"), "n_mentions"))


def parse_mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Tagged output -> mentions(doc_id, n, subst, orig)."""
    t = F.col(text_col)
    q1 = F.regexp_extract_all(t, F.lit(P.MENTION_TAG_JAVA), 1)
    q2 = F.regexp_extract_all(t, F.lit(P.MENTION_TAG_JAVA), 2)
    orig = F.regexp_extract_all(t, F.lit(P.MENTION_TAG_JAVA), 3)
    x = docs.select("doc_id", q1.alias("a"), q2.alias("b"), orig.alias("o"))
    x = x.select("doc_id", F.posexplode(F.arrays_zip("a", "b", "o")).alias("n", "m"))
    # no (or an empty) attribute gives a null substitute
    subst = F.nullif(F.concat(F.col("m.a"), F.col("m.b")), F.lit(""))
    return x.select("doc_id", (F.col("n") + 1).alias("n"), subst.alias("subst"), F.col("m.o").alias("orig"))


def tagged_to_plain(c):
    """Mention elements replaced by their substitute (both quote styles;
    the reference's double-quote-only pattern is a no-op on its own output)."""
    return F.regexp_replace(c, F.lit(r"(?s)<xAnon\s+xSubst=(?:'([^']*)'|\"([^\"]*)\")\s*>.*?</xAnon>"), F.lit("$1$2"))


def clean_text(c):
    """Mentions -> substitute ('(...)' without attribute), other tags ->
    space, runs of spaces/tabs -> one space, 3+ newlines -> 2; the whole text."""
    t = F.regexp_replace(c, F.lit(r"(?s)<xAnon\s+xSubst=(?:'([^']*)'|\"([^\"]*)\")\s*>.*?</xAnon>"), F.lit("$1$2"))
    t = F.regexp_replace(t, F.lit(r"(?s)<xAnon\s*>.*?</xAnon>"), F.lit(ELLIPSIS))
    t = F.regexp_replace(t, F.lit(r"<[^>]+>"), F.lit(" "))
    t = F.regexp_replace(t, F.lit(r"[ \t]{2,}"), F.lit(" "))
    return F.regexp_replace(t, F.lit(r"\n{3,}"), F.lit("\n\n"))
