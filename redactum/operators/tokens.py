"""Tokenization with exact code-point offsets (P2) and long-run windows.

Each match of the token pattern carries the whitespace that follows it, so the
pieces of a run concatenate back to the run and every token keeps its exact
offset: ``start`` is a running sum of piece lengths (regex offsets are never used
because Java counts UTF-16 units). The sum is taken inside the run's row; only
where several rows share a (doc_id, seg_no) it is a window over them.

Output ``pieces`` has one row per token of a run and one row per non-run
markup segment (``is_tok`` false), so the same table drives recognition,
decoding and the rebuild of the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.arrays import running_arrow


def run_window():
    return Window.partitionBy("doc_id", "run_no").orderBy("pos")


def pieces(segs: DataFrame, offsets: bool = True, alone: bool = False) -> DataFrame:
    """segments -> pieces(doc_id, run_no, pos, is_xml, is_tok, lead, token, trail, start, end, base).

    ``base`` is the run's offset in the document (0 where the segments have none).
    ``offsets=False`` skips the running-sum window (the rewrite pass needs
    positions, not offsets), so no sort is needed.

    ``alone``: each (doc_id, seg_no) is one row. Then offsets are summed in the
    row, nothing is sorted, and the token's neighbours in the run come as
    ``before`` and ``after``; only without offsets the rows keep the
    partitioning of the segments."""
    seg = F.col("seg")
    base = F.col("base") if "base" in segs.columns else F.lit(0)
    # one regex pass per run: each match is a token with its trailing space
    x = segs.select("doc_id", "seg_no", "is_xml", "is_run", "seg", base.alias("base"),
                    F.regexp_extract_all(seg, F.lit(P.TOKEN_WITH_TRAIL_JAVA), 0).alias("ps"))
    tokenized = F.col("is_run") & (F.size("ps") > 0)
    arr = F.when(tokenized, F.col("ps")).otherwise(F.array(seg))
    lead = F.when(tokenized, F.regexp_extract(seg, P.LEADING_SPACE, 0)).otherwise(F.lit(""))
    # everything per segment is computed before the explode, so the exploded
    # rows carry only small columns (never the segment text or its arrays)
    x = x.select("doc_id", F.col("seg_no").alias("run_no"), "is_xml", "base", tokenized.alias("is_tok"),
                 lead.alias("lead0"), arr.alias("arr"))
    if alone:
        return _placed(x, offsets)
    x = x.select("doc_id", "run_no", "is_xml", "base", "is_tok", "lead0", F.posexplode("arr").alias("pos", "p"))
    # a token never ends in whitespace, so right-trimming the match splits it
    token = F.when(F.col("is_tok"), F.rtrim(F.col("p"), F.lit(P.WHITESPACE_CHARS))).otherwise(F.col("p"))
    x = x.withColumn("token", token).withColumn("trail", F.expr("substring(p, length(token) + 1)"))
    if not offsets:
        return x.select("doc_id", "run_no", "pos", "is_xml", "is_tok",
                        F.when(F.col("pos") == 0, F.col("lead0")).otherwise(F.lit("")).alias("lead"), "token", "trail")
    width = F.length("p")
    run_sum = F.sum(width).over(run_window().rowsBetween(Window.unboundedPreceding, 0))
    start = F.length("lead0") + run_sum - width
    return x.select(
        "doc_id", "run_no", "pos", "is_xml", "is_tok",
        F.when(F.col("pos") == 0, F.col("lead0")).otherwise(F.lit("")).alias("lead"),
        "token", "trail", start.cast("int").alias("start"), (start + F.length("token")).cast("int").alias("end"), "base")


def _placed(x: DataFrame, offsets: bool) -> DataFrame:
    """The pieces of segments(..., lead0, arr) with neighbours and offsets, made in the segment's row."""
    n = F.size("arr")
    sides = [F.concat(F.array(F.lit(None).cast("string")), F.slice("arr", F.lit(1), n - 1)).alias("b"), F.slice("arr", F.lit(2), n).alias("a")]
    if offsets:
        x = x.withColumn("at", running_arrow(F.transform("arr", F.length)))
        sides.append(F.col("at"))
    x = x.select("doc_id", "run_no", "is_xml", "base", "is_tok", "lead0", F.posexplode(F.arrays_zip(F.col("arr").alias("p"), *sides)).alias("pos", "z"))
    x = x.select("doc_id", "run_no", "pos", "is_xml", "is_tok", "base", "lead0", "z.*")
    trim = lambda c: F.when(F.col("is_tok"), F.rtrim(c, F.lit(P.WHITESPACE_CHARS))).otherwise(F.col(c))
    x = x.withColumn("token", trim("p")).withColumn("trail", F.expr("substring(p, length(token) + 1)"))
    columns = ["doc_id", "run_no", "pos", "is_xml", "is_tok", F.when(F.col("pos") == 0, F.col("lead0")).otherwise(F.lit("")).alias("lead"), "token", "trail"]
    if offsets:
        start = F.length("lead0") + F.col("at")
        columns += [start.alias("start"), (start + F.length("token")).alias("end"), "base"]
    return x.select(*columns, trim("b").alias("before"), trim("a").alias("after"))


def piece_runs(segs: DataFrame) -> DataFrame:
    """segments -> (doc_id, run_no, is_xml, base, lead, ps), a row a run: what
    looks for few tokens reads the arrays in Arrow batches (``Placed``), and no
    token becomes a row that is not found. ``ps`` are the tokens with the
    whitespace behind them (none in a run without a token)."""
    base = F.col("base") if "base" in segs.columns else F.lit(0)
    return segs.where("is_run").select(
        "doc_id", F.col("seg_no").alias("run_no"), "is_xml", base.alias("base"), F.regexp_extract("seg", P.LEADING_SPACE, 0).alias("lead"),
        F.regexp_extract_all("seg", F.lit(P.TOKEN_WITH_TRAIL_JAVA), F.lit(0)).alias("ps"))


class Placed:
    """The tokens of a batch of ``piece_runs``, one after the other: ``pieces``,
    ``words`` (without trailing whitespace) and their ``starts`` in the run;
    those of run i lie from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, lists = batch, batch.column("ps")
        self.sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        self.first = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))
        self.pieces = lists.flatten()
        self.words = pc.utf8_rtrim(self.pieces, characters=P.WHITESPACE_CHARS)
        sums = np.concatenate(([0], np.cumsum(pc.utf8_length(self.pieces).to_numpy(zero_copy_only=False), dtype=np.int64)))
        lead = pc.fill_null(pc.utf8_length(batch.column("lead")), 0).to_numpy(zero_copy_only=False)
        self.starts = sums[:-1] + np.repeat(lead - sums[self.first[:-1]], self.sizes)

    def rows(self, runs, at, **more) -> dict:
        """Columns of found tokens: what their ``runs`` have, ``pos``, piece ``p`` and
        ``start`` of the tokens ``at`` (null where that is), and others."""
        runs, at = pa.array(runs, pa.int64()), pa.array(at, pa.int64())
        keys = {c: self.batch.column(c).take(runs) for c in RUN}
        pos = pc.subtract(at, pa.array(self.first).take(runs))
        return keys | {"pos": pos, "p": self.pieces.take(at), "start": pa.array(self.starts).take(at)} | more


#: columns of a run that its found tokens keep, and those of ``Placed.rows`` besides them
RUN = ("doc_id", "run_no", "is_xml", "base", "lead")
FOUND = "pos int, p string, start int"
KEYED = "doc_id IS NOT NULL AND run_no IS NOT NULL"


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def found_pieces(found: DataFrame) -> DataFrame:
    """Tokens of ``Placed.rows`` as rows of ``pieces``; other columns stay. Rows
    without a key are left out, as predictions without one are by a join."""
    x = found.where(KEYED).withColumn("token", F.rtrim("p", F.lit(P.WHITESPACE_CHARS)))
    own = ("doc_id", "run_no", "pos", "is_xml", "lead", "p", "token", "start", "base")
    return x.select("doc_id", "run_no", "pos", "is_xml", F.lit(True).alias("is_tok"),
                    F.when(F.col("pos") == 0, F.col("lead")).otherwise(F.lit("")).alias("lead"), "token",
                    F.expr("substring(p, length(token) + 1)").alias("trail"), "start",
                    (F.col("start") + F.length("token")).alias("end"), "base", *[c for c in x.columns if c not in own])


def run_tokens(segs: DataFrame) -> DataFrame:
    """The same tokens as one array a run: segments(doc_id, seg_no, seg, is_run, ...) ->
    (..., tokens), for runs with a token."""
    cut = F.regexp_extract_all("seg", F.lit(P.TOKEN_WITH_TRAIL_JAVA), F.lit(0))
    x = segs.where("is_run").withColumn("tokens", F.transform(cut, lambda p: F.rtrim(p, F.lit(P.WHITESPACE_CHARS))))
    return x.where("size(tokens) > 0")


def tokens(segs: DataFrame, alone: bool = False) -> DataFrame:
    """tokens(doc_id, run_no, tok_no, start, end, token)."""
    return (pieces(segs, alone=alone).where("is_tok")
            .select("doc_id", "run_no", F.col("pos").alias("tok_no"), "start", "end", "token"))


def chunk_windows(toks: DataFrame, size: int = 512, overlap: int = 128) -> DataFrame:
    """Overlapping token windows of a run for a length-limited model.

    Window k covers tokens [k*step, k*step+size). A token lies in at most
    ceil(size/step) windows; it is later taken from the window where it is
    furthest from an edge, so no token is left unlabelled (the reference
    truncates and leaves the tail in clear).
    """
    step = size - overlap
    k_hi = F.floor(F.col("tok_no") / F.lit(step))
    k_lo = F.greatest(F.ceil((F.col("tok_no") - F.lit(size) + 1) / F.lit(step)), F.lit(0))
    x = toks.withColumn("chunk", F.explode(F.sequence(k_lo.cast("int"), k_hi.cast("int"))))
    off = lambda k: F.col("tok_no") - k * F.lit(step)
    edge = lambda k: F.least(off(k), F.lit(size - 1) - off(k))
    furthest = F.array_max(F.transform(F.sequence(k_lo.cast("int"), k_hi.cast("int")), lambda k: F.struct(edge(k).alias("edge"), (-k).alias("k"))))
    return (x.withColumn("offset", off(F.col("chunk")).cast("int")).withColumn("edge_dist", edge(F.col("chunk")).cast("int"))
            .withColumn("best", F.col("chunk") == -furthest["k"]))


def best_window(chunked: DataFrame, alone: bool = False) -> DataFrame:
    """One chunk per token, the one where it is furthest from an edge
    (earliest chunk on ties).

    ``alone``: all chunks that ``chunk_windows`` gives a token are there and no two
    tokens share a key. Then its mark tells that chunk, and nothing is grouped."""
    if alone:
        return chunked.where("best").select("doc_id", "run_no", "tok_no", "chunk")
    return (chunked.groupBy("doc_id", "run_no", "tok_no")
            .agg(F.max_by("chunk", F.struct(F.col("edge_dist"), -F.col("chunk"))).alias("chunk")))
