"""Evaluation: golden verdicts (G12, P19), totals (G11), span metrics (G13),
change sets (U3) and the residual-leak audit (X8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def comparison_form(c):
    """Keep only word characters."""
    return F.regexp_replace(c, F.lit(P.NOT_WORD), F.lit(""))


def verdicts(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """cases(file, case_no, expected, no_change) + outputs(file, case_no,
    text, n_mentions) -> passed. NO_CHANGE passes iff nothing was found;
    otherwise any expected alternative must equal the output on word chars."""
    x = cases.join(outputs, ["file", "case_no"])
    act = comparison_form(F.col("text"))
    hit = F.exists("expected", lambda e: comparison_form(e) == act)
    return x.select("file", "case_no", "n_mentions",
                    F.when(F.col("no_change"), F.col("n_mentions") == 0).otherwise(hit).alias("passed"))


def totals(v: DataFrame) -> DataFrame:
    """Per file and overall (rollup): total, passed, failed, pass rate %."""
    g = (v.rollup("file").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
                              F.grouping_id().alias("gid")))
    return g.select("file", "total", "passed", (F.col("total") - F.col("passed")).alias("failed"),
                    F.round(F.col("passed") * 100.0 / F.col("total"), 1).alias("pass_rate"),
                    F.col("gid").cast("long").alias("gid"))


def span_metrics(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Exact-span precision, recall and F1 per label plus the total."""
    k = ["doc_id", "run_no", "start", "end", "label"]
    g = gold.select(*k).withColumn("g", F.lit(1))
    p = pred.select(*k).withColumn("p", F.lit(1))
    x = g.join(p, k, "full_outer")
    agg = (x.rollup("label").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"),
                                 F.count_if(F.col("g").isNull()).alias("fp"),
                                 F.count_if(F.col("p").isNull()).alias("fn"),
                                 F.grouping_id().alias("gid")))
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn"))
    return agg.select("label", "tp", "fp", "fn", F.round(prec, 6).alias("precision"),
                      F.round(rec, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.col("gid").cast("long").alias("gid"))


def change_set(outs: DataFrame, pcs: DataFrame | None = None) -> DataFrame:
    """Pieces whose text changed: (doc_id, run_no, pos, before, after).

    ``outs`` holds each piece as it was; where pieces share a position (those of
    repeated ids) an output is compared with all of ``pcs`` there."""
    x = outs
    if pcs is not None:
        before = pcs.select("doc_id", "run_no", "pos", F.concat("lead", "token", "trail").alias("before"))
        x = before.join(outs.drop("before"), ["doc_id", "run_no", "pos"])
    return x.where(F.col("before") != F.col("out")).select("doc_id", "run_no", "pos", "before", F.col("out").alias("after"))


def leak_audit(span_tokens: DataFrame, output_tokens: DataFrame) -> DataFrame:
    """Surface tokens of redacted spans still present in the output,
    per document (a join on (doc_id, token), never a scan per span)."""
    a = span_tokens.select("doc_id", "token").distinct()
    b = output_tokens.select("doc_id", "token").distinct()
    return a.join(b, ["doc_id", "token"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_leaks"))


def agreement(gold_tags: DataFrame, pred_tags: DataFrame) -> DataFrame:
    """(n_tokens, n_equal) of tokens with their tags, joined by position."""
    k = ["doc_id", "run_no", "pos"]
    x = gold_tags.select(*k, F.col("tag").alias("g")).join(pred_tags.select(*k, F.col("tag").alias("p")), k)
    return x.agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("g") == F.col("p")).alias("n_equal"))


def run_agreement(runs: DataFrame) -> DataFrame:
    """(n_tokens, n_equal) of runs(gold, pred), the tags of a run's tokens as two arrays."""
    same = F.filter(F.arrays_zip("gold", "pred"), lambda z: z["gold"] == z["pred"])
    return runs.select(F.size("gold").cast("long").alias("n_tokens"), F.size(same).cast("long").alias("n_equal"))


def token_accuracy(counts: DataFrame) -> DataFrame:
    """Share of tokens whose BIO tag agrees (one row), of counts(n_tokens, n_equal)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return counts.agg(total("n_tokens"), total("n_equal")).select(
        "n_tokens", "n_equal", F.round(F.try_divide(F.col("n_equal"), F.col("n_tokens")), 6).alias("accuracy"))
