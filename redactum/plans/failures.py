"""Failure isolation (T9): a document that cannot be worked becomes a ``failed``
row with its message and trace; the batch goes on.

What can fail is the recognizer: a hosted model that raises on a run gives an
error row for that run (``recognize.model_predictions``), which fails the run's
document and no other. The predictions are written once, so the model is not
asked again when results and failures are read. A document without text fails
too. Any other text, whatever characters it holds, is worked.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Callable, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import recognize
from ..session import scratch_path
from .pipeline import Config, Redaction, kept_table

NO_TEXT = "no text"


def isolated(docs: DataFrame, lemmas, model_factory: Callable, config: Optional[Config] = None,
             window=None, model_id: Optional[str] = None) -> tuple[Redaction, DataFrame]:
    """(the redaction of the documents that can be worked, failures(doc_id, error)).

    The failed documents are left in the redaction without mentions, so its
    documents are read and dealt once; ``outcomes`` tells them apart."""
    none = docs.where(F.col("text").isNull()).select("doc_id", F.lit(NO_TEXT).alias("error"))
    folder = scratch_path(docs.sparkSession, f"run-{uuid.uuid4().hex}")
    keys = ["doc_id", "run_no"]
    good = Redaction(docs, lemmas, recognize.Recognizer(
        lambda p: recognize.join_predictions(p, reduce(DataFrame.unionByName, labels)), lambda _: recognize.labelled_pieces(found)), config, folder=folder)
    preds, found = [], None
    for part in good.parts:
        if part.alone:
            found = kept_table(recognize.model_found(part.segments, model_factory, window, model_id), f"{folder}/found")
            preds.append(found.select(*keys, F.col("pos").alias("tok_no"), "label", "confidence", "error"))
        else:
            preds.append(kept_table(recognize.model_predictions(part.pieces, model_factory, window, model_id), f"{folder}/predictions"))
    errors = reduce(DataFrame.unionByName, [p.where("error IS NOT NULL").select(*keys, "error") for p in preds])
    failed = errors.groupBy("doc_id").agg(F.min_by("error", "run_no").alias("error"))
    kept = lambda p: p.where("error IS NULL").join(failed.select("doc_id"), "doc_id", "left_anti")
    labels = [kept(p).drop("error") for p in preds]
    found = kept(found)
    return good, none.unionByName(failed)


def outcomes(redacted: DataFrame, failures: DataFrame) -> DataFrame:
    """(doc_id, status, error, n_mentions, text); a failed document has no text and no mentions."""
    # only ids of failures are told to the texts: messages and traces are long
    done = redacted.join(failures.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"), F.col("n_mentions").cast("long").alias("n_mentions"), "text")
    failed = redacted.select("doc_id").join(failures, "doc_id").select(
        "doc_id", F.lit("failed").alias("status"), "error", F.lit(0).cast("long").alias("n_mentions"), F.lit(None).cast("string").alias("text"))
    return done.unionByName(failed)


def redact_isolated(docs: DataFrame, lemmas, model_factory: Callable, config: Optional[Config] = None,
                    **options) -> DataFrame:
    """-> (doc_id, status, error, n_mentions, text) of every document."""
    good, failures = isolated(docs, lemmas, model_factory, config, **options)
    return outcomes(good.redacted(), failures)
