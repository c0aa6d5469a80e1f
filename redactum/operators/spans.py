"""Span decoding (G1) with the token and span cuts (F1, F2) and trimming.

BIO decoding is a gaps-and-islands job inside each run: ``B-x`` opens, ``I-x``
continues a span of the same type and otherwise opens, ``O`` (or a token
under the threshold) closes, and any other confident label is transparent.
Spans are numbered with a running count of openings; every window here uses
the same (doc_id, run_no) partitioning and pos ordering, so the plan sorts
once and never shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import strip_ws
from .tokens import Placed, run_window

_O_STATE = "#O#"


def _kinds(labelled: DataFrame, threshold: float) -> DataFrame:
    """Adds kind (O/B/I/T) and etype."""
    lbl, conf = F.col("label"), F.col("confidence")
    eff = F.when((lbl == "O") | (conf < F.lit(threshold)), F.lit("O")).otherwise(lbl)
    kind = (F.when(eff == "O", "O").when(eff.startswith("B-"), "B")
            .when(eff.startswith("I-"), "I").otherwise("T"))
    return labelled.withColumn("kind", kind).withColumn(
        "etype", F.when(F.col("kind").isin("B", "I"), F.expr("substring(label, 3)")))


def mark_spans(labelled: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds kind (O/B/I/T), etype and ``span`` (span number inside the run,
    null outside spans; transparent tokens inside a span get its number).

    Two window operators: (1) the previous and the next non-transparent
    state, (2) the running count of span openings. A transparent token is
    inside a span when the previous state is a span type and the next
    non-transparent token continues that same type."""
    x = _kinds(labelled, threshold)
    state = F.when(F.col("kind") == "O", F.lit(_O_STATE)).otherwise(F.col("etype"))
    tagged = F.when(F.col("kind") == "O", F.lit(_O_STATE)).when(
        F.col("kind").isin("B", "I"), F.concat(F.col("kind"), F.lit(":"), F.col("etype")))
    x = x.withColumn("state", state).withColumn("tstate", tagged)
    x = (x.withColumn("prev_state", F.last("state", ignorenulls=True).over(
            run_window().rowsBetween(Window.unboundedPreceding, -1)))
         .withColumn("next_state", F.expr(
            "lead(tstate) ignore nulls over (partition by doc_id, run_no order by pos)")))
    is_start = (F.col("kind") == "B") | ((F.col("kind") == "I") & (F.col("prev_state").isNull() | (F.col("prev_state") != F.col("etype"))))
    x = x.withColumn("span_no", F.sum(is_start.cast("int")).over(
        run_window().rowsBetween(Window.unboundedPreceding, 0)))
    inside_t = ((F.col("kind") == "T") & F.col("prev_state").isNotNull() & (F.col("prev_state") != F.lit(_O_STATE))
                & (F.col("next_state") == F.concat(F.lit("I:"), F.col("prev_state"))))
    span = F.when(F.col("kind").isin("B", "I") | inside_t, F.col("span_no"))
    return x.withColumn("span", span.cast("int")).drop("state", "tstate", "prev_state", "next_state", "span_no")


def span_tokens(labelled: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``mark_spans`` that can lie in a span, marked the same, without
    a window over the others.

    O tokens only part the rest, and a gap in ``pos`` tells that one was there:
    the state before and behind a token is looked for in its stretch of following
    positions, the openings are counted over the run."""
    x = _kinds(labelled, threshold).where("kind <> 'O'")
    # rows of a repeated id share positions, not starts
    run = Window.partitionBy("doc_id", "run_no").orderBy("pos", "start")
    gap = F.coalesce(F.col("pos") - F.lag("pos", 1).over(run) > 1, F.lit(True))
    to_here = run.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("gap", gap).withColumn("stretch", F.count_if("gap").over(to_here))
    tagged = F.when(F.col("kind").isin("B", "I"), F.concat(F.col("kind"), F.lit(":"), F.col("etype")))
    w = Window.partitionBy("doc_id", "run_no", "stretch").orderBy("pos", "start")
    x = x.withColumn("tstate", tagged).withColumn("prev_state", F.last("etype", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("next_state", F.expr("lead(tstate) ignore nulls over (partition by doc_id, run_no, stretch order by pos, start)"))
    is_start = (F.col("kind") == "B") | ((F.col("kind") == "I") & (F.col("prev_state").isNull() | (F.col("prev_state") != F.col("etype"))))
    x = x.withColumn("span_no", F.sum(is_start.cast("int")).over(
        Window.partitionBy("doc_id", "run_no").orderBy("stretch", "pos", "start").rowsBetween(Window.unboundedPreceding, 0)))
    inside_t = (F.col("kind") == "T") & F.col("prev_state").isNotNull() & (F.col("next_state") == F.concat(F.lit("I:"), F.col("prev_state")))
    span = F.when(F.col("kind").isin("B", "I") | inside_t, F.col("span_no"))
    x = x.withColumn("span", span.cast("int")).where("span IS NOT NULL")
    return x.drop("gap", "stretch", "tstate", "prev_state", "next_state", "span_no")


def decode_spans(marked: DataFrame, threshold: float = 0.7) -> DataFrame:
    """marked pieces -> spans(doc_id, run_no, span, start, end, label,
    confidence, n_tokens, first_pos, last_pos, base, text).

    F2: a span is kept when its mean confidence is at least the threshold;
    spans of an empty type are dropped (the reference never emits them).
    """
    bi = F.col("kind").isin("B", "I")
    base = F.col("base") if "base" in marked.columns else F.lit(0)
    piece = F.concat("token", "trail")
    agg = (marked.where(F.col("span").isNotNull())
           .groupBy("doc_id", "run_no", "span")
           .agg(F.min("start").alias("start"), F.max("end").alias("end"),
                F.max("etype").alias("label"),
                F.avg(F.when(bi, F.col("confidence"))).alias("confidence"),
                F.count(F.when(bi, 1)).alias("n_tokens"),
                F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min(base).alias("base"),
                F.sort_array(F.collect_list(F.struct(F.col("pos"), piece.alias("p")))).alias("ps")))
    text = F.left(F.array_join(F.transform("ps", lambda s: s["p"]), ""), F.col("end") - F.col("start"))
    return (agg.where((F.col("confidence") >= F.lit(threshold)) & (F.col("label") != ""))
            .withColumn("text", text).drop("ps"))


#: columns of ``decode_spans`` besides the run's
SPAN = "span int, start int, end int, label string, confidence double, n_tokens long, first_pos int, last_pos int, text string"


def run_spans(found: list[tuple], threshold: float) -> list[tuple]:
    """``span_tokens`` and ``decode_spans`` in a worker: (run, at, label, confidence)
    of the labelled tokens of whole runs, in order -> (run, span, first, last, type, confidence,
    n_tokens), with ``at`` counted over all tokens of all runs."""
    out: list[list] = []
    open_, run, at, number = None, None, None, 0
    for r, i, label, conf in found:
        if label == "O" or conf < threshold:
            continue
        if r != run:
            number = 0
        if r != run or i != at + 1:
            open_ = None
        run, at = r, i
        if not label.startswith(("B-", "I-")):
            continue  # transparent: inside if the next one continues the span
        etype = label[2:]
        if label[0] == "I" and open_ is not None and open_[4] == etype:
            open_[3], open_[5], open_[6] = i, open_[5] + conf, open_[6] + 1
        else:
            number += 1
            open_ = [r, number, i, i, etype, conf, 1]
            out.append(open_)
    # a NaN is above every threshold, as in Spark
    return [(*s[:5], s[5] / s[6], s[6]) for s in out if s[4] != "" and not s[5] / s[6] < threshold]


def span_columns(x: Placed, spans: list[tuple]) -> dict:
    """Columns of ``decode_spans`` from ``run_spans`` of the tokens of a batch."""
    run, number, first, last, label, conf, n = [list(c) for c in zip(*spans)] if spans else [[]] * 7
    run, first, last = (pa.array(v, pa.int64()) for v in (run, first, last))
    ends, where = x.words.take(last), pa.array(x.first).take(run)
    long_ = np.flatnonzero(pc.not_equal(first, last).to_numpy(zero_copy_only=False))
    text = ends.to_numpy(zero_copy_only=False)
    for k in long_.tolist():
        text[k] = "".join(x.pieces.slice(first[k].as_py(), last[k].as_py() - first[k].as_py()).to_pylist()) + text[k]
    text = pa.array(text, pa.string())
    start = pa.array(x.starts).take(first)
    return {c: x.batch.column(c).take(run) for c in ("doc_id", "run_no", "base")} | {
        "span": pa.array(number, pa.int32()), "start": start, "end": pc.add(start, pc.utf8_length(text)), "label": pa.array(label, pa.string()),
        "confidence": pa.array(conf, pa.float64()), "n_tokens": pa.array(n, pa.int64()), "first_pos": pc.subtract(first, where),
        "last_pos": pc.subtract(last, where), "text": text}


def trim_spans(spans: DataFrame) -> DataFrame:
    """Move span edges past whitespace (for external spans with text)."""
    t = F.col("text")
    lt = F.length(t) - F.length(F.regexp_replace(t, r"^[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]+", ""))
    rt = F.length(t) - F.length(F.regexp_replace(t, r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]+$", ""))
    both = F.length(t) - F.length(strip_ws(t))
    return (spans.withColumn("start", (F.col("start") + F.when(both == F.length(t), both).otherwise(lt)).cast("int"))
            .withColumn("end", (F.col("end") - F.when(both == F.length(t), 0).otherwise(rt)).cast("int"))
            .withColumn("text", strip_ws(t)))
