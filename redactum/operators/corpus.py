"""Training-set preparation.

``tagged_tokens`` goes from tagged documents back to their source: cut at the
mention tags, the stretches between them have running sums of their lengths as
source offsets, and running counts of opening and closing tags say in which
mention they lie. Mentions hold whole tokens, so a stretch is tokenized by itself
and its tokens inherit the mention: no offsets are joined by range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.arrays import bound, running_arrow
from ..session import drop_empty_parts
from . import tokens as TK

# --- fixed values: the mention element of tagged output ---------------------
MENTION_OPEN = r"<xAnon(?:\s+xSubst=(?:'[^']*'|\"[^\"]*\"))?\s*>"
MENTION_CLOSE = "</xAnon>"
# ---------------------------------------------------------------------------
#: label of mentions that come without one
ENTITY = "ENTITY"


def source_text(tagged):
    """The text a tagged document was made from: its mention tags taken out."""
    return F.regexp_replace(tagged, F.lit(f"{MENTION_OPEN}|{MENTION_CLOSE}"), F.lit(""))


def tagged_tokens(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Tagged plain-text documents(doc_id, text) -> (doc_id, tok_no, start, end, token, mention, tag).

    Offsets are those of the source text. ``labels(doc_id, mention, label)``
    names the mentions by their number in the document, from 1 (as P18 counts
    them); without it all are ``ENTITY``. The first token of a mention is ``B-``,
    the others ``I-``, the rest ``O``."""
    cut = F.regexp_extract_all("text", F.lit(f"{MENTION_OPEN}|{MENTION_CLOSE}|[^<]+|<"), F.lit(0))
    x = docs.select("doc_id", F.posexplode(cut).alias("seg_no", "seg"))
    opens = F.col("seg").rlike(f"^{MENTION_OPEN}$")
    x = x.withColumn("opens", opens).withColumn("closes", F.col("seg") == MENTION_CLOSE)
    x = x.withColumn("width", F.when(F.col("opens") | F.col("closes"), F.lit(0)).otherwise(F.length("seg")))
    w = Window.partitionBy("doc_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened, closed = F.count_if("opens").over(w), F.count_if("closes").over(w)
    x = x.select("doc_id", "seg_no", "seg", F.lit(False).alias("is_xml"), (F.col("width") > 0).alias("is_run"),
                 (F.sum("width").over(w) - F.col("width")).cast("int").alias("base"),
                 F.when(opened > closed, opened).alias("mention"))
    toks = TK.pieces(x).where("is_tok").select("doc_id", F.col("run_no").alias("seg_no"), "pos", "token",
                                               (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"))
    inside = x.where("is_run").select("doc_id", "seg_no", "mention")
    toks = toks.join(inside, ["doc_id", "seg_no"])
    order = Window.partitionBy("doc_id").orderBy("seg_no", "pos")
    first = F.row_number().over(Window.partitionBy("doc_id", "mention").orderBy("seg_no", "pos")) == 1
    toks = toks.withColumn("tok_no", F.row_number().over(order) - 1).withColumn("first", first)
    label = F.lit(ENTITY)
    if labels is not None:
        toks = toks.join(labels.select("doc_id", "mention", "label"), ["doc_id", "mention"], "left")
        label = F.coalesce("label", label)
    tag = F.when(F.col("mention").isNull(), F.lit("O")).otherwise(
        F.concat(F.when(F.col("first"), F.lit("B-")).otherwise(F.lit("I-")), label))
    return toks.select("doc_id", F.col("tok_no").cast("int").alias("tok_no"), F.col("start").cast("int").alias("start"),
                       F.col("end").cast("int").alias("end"), "token", "mention", tag.alias("tag"))


def _tagged_rows(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``tagged_examples`` of documents whose ids come once, each made in its own row."""
    x = docs
    named = F.array().cast("array<struct<mention: int, label: string>>")
    if labels is not None:
        each = F.struct(F.col("mention").cast("int").alias("mention"), "label")
        own = labels.groupBy("doc_id").agg(F.sort_array(F.collect_list(each)).alias("named"))
        x = x.join(own.hint("shuffle_hash"), "doc_id", "left")
        named = F.coalesce("named", named)
    # the document as tags and stretches; each tag counts what it opens or closes
    cut = F.coalesce(F.regexp_extract_all("text", F.lit(f"{MENTION_OPEN}|{MENTION_CLOSE}|[^<]+|<"), F.lit(0)), F.array().cast("array<string>"))
    x = x.select("doc_id", "text", cut.alias("segs"), named.alias("named"))
    x = x.withColumn("opens", F.transform("segs", lambda s: s.rlike(f"^{MENTION_OPEN}$").cast("int")))
    x = x.withColumn("closes", F.transform("segs", lambda s: (s == MENTION_CLOSE).cast("int")))
    x = x.withColumn("opened", running_arrow(F.col("opens"))).withColumn("closed", running_arrow(F.col("closes")))

    def stretch(s, i):
        """Its tokens with what lies before and behind them; white space alone is one entry without a token."""
        opened, closed = F.get("opened", i) + F.get("opens", i), F.get("closed", i) + F.get("closes", i)
        entry = lambda lead, token, width, mention: F.struct(
            lead.alias("lead"), token.alias("token"), width.alias("width"), mention.alias("mention"))
        lead = lambda k: F.when(k == 0, F.length(F.regexp_extract(s, P.LEADING_SPACE, 0))).otherwise(F.lit(0))
        nothing = F.array(entry(F.lit(0), F.lit(None).cast("string"), F.length(s), F.lit(None).cast("int")))
        some = lambda ps: F.transform(ps, lambda p, k: bound(lead(k), lambda n: entry(
            n, F.rtrim(p, F.lit(P.WHITESPACE_CHARS)), n + F.length(p), F.when(opened > closed, opened))))
        pieces = bound(F.regexp_extract_all(s, F.lit(P.TOKEN_WITH_TRAIL_JAVA), F.lit(0)), lambda ps: F.when(F.size(ps) > 0, some(ps)).otherwise(nothing))
        return F.when((F.get("opens", i) + F.get("closes", i)) > 0, F.slice(nothing, 1, 0)).otherwise(pieces)

    x = x.select("doc_id", "text", "named", F.flatten(F.transform("segs", stretch)).alias("es"))
    x = x.withColumn("at", running_arrow(F.transform("es", lambda e: e["width"])))
    placed = F.transform(F.arrays_zip("es", "at"), lambda z: F.struct(
        z["es"]["token"].alias("token"), (z["at"] + z["es"]["lead"]).alias("start"), z["es"]["mention"].alias("mention")))
    x = x.select("doc_id", "text", "named", F.filter(placed, lambda t: t["token"].isNotNull()).alias("ts"))

    def label(m):
        # mentions are numbered from 1, so the label is mostly found at its place
        own = bound(F.get("named", m - 1), lambda n: F.when(n["mention"] == m, n["label"]).otherwise(
            F.get(F.filter("named", lambda y: y["mention"] == m), F.lit(0))["label"]))
        return F.coalesce(own, F.lit(ENTITY))

    tag = lambda ts: F.transform(ts, lambda t, i: F.when(t["mention"].isNull(), F.lit("O")).otherwise(F.concat(
        F.when(F.get(ts, i - 1)["mention"].eqNullSafe(t["mention"]), F.lit("I-")).otherwise(F.lit("B-")), label(t["mention"]))))
    return x.select("doc_id", source_text(F.col("text")).alias("text"), F.transform("ts", lambda t: t["token"]).alias("tokens"),
                    F.transform("ts", lambda t: t["start"]).alias("starts"), bound(F.col("ts"), tag).alias("labels"))


def tagged_examples(docs: DataFrame, labels: DataFrame | None = None, alone: bool = False) -> DataFrame:
    """One example a tagged document: (doc_id, text, tokens, starts, labels),
    ``text`` the source text; documents without a token have empty arrays.

    ``alone``: no two documents share a doc_id, and a mention has one label. Then
    an example is made in its document's row, nothing is exploded."""
    if alone:
        return _tagged_rows(docs, labels)
    t = (tagged_tokens(docs, labels).groupBy("doc_id")
         .agg(F.sort_array(F.collect_list(F.struct("tok_no", "token", "start", "tag"))).alias("t")))
    none = F.array().cast("array<struct<tok_no: int, token: string, start: int, tag: string>>")
    x = docs.select("doc_id", source_text(F.col("text")).alias("text")).join(t, "doc_id", "left").withColumn("t", F.coalesce("t", none))
    return x.select("doc_id", "text", F.col("t.token").alias("tokens"), F.col("t.start").alias("starts"), F.col("t.tag").alias("labels"))


def bio_tags(marked: DataFrame, kept: DataFrame) -> DataFrame:
    """Per token: B-<label> on the first token of a kept span, I-<label>
    inside it, O elsewhere. The spans are the hashed side of the join (they are
    few), so the tokens are not sorted again for it."""
    k = kept.select("doc_id", "run_no", "span", "first_pos", F.col("label").alias("span_label")).hint("shuffle_hash")
    x = marked.where("is_tok").join(k, ["doc_id", "run_no", "span"], "left")
    tag = (F.when(F.col("span_label").isNull(), F.lit("O"))
           .when(F.col("pos") == F.col("first_pos"), F.concat(F.lit("B-"), F.col("span_label")))
           .otherwise(F.concat(F.lit("I-"), F.col("span_label"))))
    return x.select("doc_id", "run_no", "pos", "token", tag.alias("tag"))


def bio_examples(tagged: DataFrame) -> DataFrame:
    """One example per run: STRUCT<text, tokens[], labels[]> flattened
    to columns; arrays are ordered by token position. A run is bounded by
    the document size cap."""
    g = tagged.groupBy("doc_id", "run_no").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "tag"))).alias("t"))
    return g.select("doc_id", "run_no", F.array_join(F.col("t.token"), " ").alias("text"),
                    F.col("t.token").alias("tokens"), F.col("t.tag").alias("labels"))


def tag_runs(runs: DataFrame, kept: DataFrame, name: str = "labels") -> DataFrame:
    """``bio_tags`` as arrays: runs(doc_id, run_no, tokens, ...), one row a run, get
    the tags of their tokens. A span covers the tokens from its first to its last,
    and the spans of a run are disjoint."""
    at = F.struct("first_pos", "last_pos", "label")
    own = kept.groupBy("doc_id", "run_no").agg(F.sort_array(F.collect_list(at)).alias("spans")).hint("shuffle_hash")
    outside = lambda a, b: F.array_repeat(F.lit("O"), b - a)
    behind = lambda ss, i: F.when(i < 0, F.lit(0)).otherwise(F.get(ss, i)["last_pos"] + 1)
    tags = lambda ss: F.concat(F.flatten(F.transform(ss, lambda s, i: F.concat(
        outside(behind(ss, i - 1), s["first_pos"]), F.array(F.concat(F.lit("B-"), s["label"])),
        F.array_repeat(F.concat(F.lit("I-"), s["label"]), s["last_pos"] - s["first_pos"])))), outside(behind(ss, F.size(ss) - 1), F.size("tokens")))
    x = runs.join(own, ["doc_id", "run_no"], "left")
    return x.withColumn(name, F.when(F.col("spans").isNull(), outside(F.lit(0), F.size("tokens"))).otherwise(bound(F.col("spans"), tags))).drop("spans")


def run_examples(segs: DataFrame, kept: DataFrame) -> DataFrame:
    """``bio_examples`` of segments that are one row a (doc_id, seg_no), made in that row."""
    runs = TK.run_tokens(segs).select("doc_id", F.col("seg_no").alias("run_no"), "tokens")
    return tag_runs(runs, kept).select("doc_id", "run_no", F.array_join("tokens", " ").alias("text"), "tokens", "labels")


def split_by_document(df: DataFrame, train_pct: int = 80, key: str = "hash") -> DataFrame:
    """Reproducible split by whole document."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(100)) if key == "hash" else F.pmod(F.col("doc_id"), F.lit(100))
    return df.withColumn("split", F.when(bucket < train_pct, F.lit("train")).otherwise(F.lit("val")))


BIO_SCHEMA = "text string, tokens array<string>, labels array<string>"


def write_bio(df: DataFrame, path: str) -> None:
    """JSON lines {text, tokens, labels}. Spark writes a file for its first
    partition even if that has no row: a part without a line is dropped."""
    df.select("text", "tokens", "labels").write.mode("overwrite").json(path)
    drop_empty_parts(df.sparkSession, path)


def read_bio(spark, path: str) -> DataFrame:
    return spark.read.schema(BIO_SCHEMA).json(path)
