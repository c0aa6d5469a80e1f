"""Best-fit packing of documents into sequences of a fixed token capacity.

Lengths are whole numbers up to the capacity, so packing needs only how many
pieces there are of each length: a table of ``capacity`` rows at most, whatever
the input. The plan is made on those counts. Large items (over a third of the
capacity) are matched greedily, the longest first with the longest large one
that still fits, at most two a bin; the small ones, longest first, go to the
bin with the least sufficient gap, and open a bin only if no gap holds them.
Bins that are filled alike are planned together, so the plan has few rows. Each
piece then finds its bin by its rank among the pieces of its length. Ranks are
counted in slices by a hash of the key, so a length that very many pieces share
is still numbered by many tasks.

Documents longer than the capacity are cut into pieces of full capacity, the
first one shorter. Null text counts as empty (the end id alone). Rows that
repeat are packed each.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from redactum.llm.common import prepare, stored
from redactum.llm.tokens import Encoder

CAPACITY = 1024
SLICE_ROWS = 50_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def _pieces(path: str, end_id: int, capacity: int):
    def pieces(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc, tokens in zip(ids, Encoder.of(path).encode_all(batch.column(1).to_pylist()), strict=True):
                tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                out += [(doc, k, s, n, zlib.crc32(tokens[s:s + n].tobytes()))
                        for k, (s, n) in enumerate(cut(len(tokens), capacity))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return pieces


def cut_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""
    prepare(spark)
    return (docs.select(F.col(id_col).cast("long"), F.col(text_col))
            .mapInArrow(_pieces(tokenizer, end_id, capacity), PIECE_SCHEMA))


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces a bin, first bin, offset), by first rank.

    A row says: from that rank on, each next group of so many pieces goes to
    the next bin, side by side from that offset.
    """
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    ranks, runs = defaultdict(int), defaultdict(list)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first bin, bins)
    n_bins = 0

    def place(length, each, bins, first, offset):
        runs[length].append((ranks[length], each, first, offset))
        ranks[length] += each * bins
        left[length] -= each * bins

    def open_bins(bins, *items):
        nonlocal n_bins
        first, offset = n_bins, 0
        n_bins += bins
        for length, each in items:
            place(length, each, bins, first, offset)
            offset += length * each
        if offset < capacity:
            gaps[capacity - offset].append((first, bins))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        for other in (n for n in large if n <= min(length, capacity - length)):
            if other == length and left[length] > 1:
                open_bins(left[length] // 2, (length, 2))
            elif other < length and left[length] and left[other]:
                open_bins(min(left[length], left[other]), (length, 1), (other, 1))
        if left[length]:
            open_bins(left[length], (length, 1))
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            gap = next((g for g in range(length, capacity + 1) if gaps.get(g)), None)
            if gap is None:
                each = min(capacity // length, left[length])
                open_bins(left[length] // each, (length, each))
                continue
            first, bins = gaps[gap].pop()
            each = min(gap // length, left[length])
            used = min(bins, left[length] // each)
            if used < bins:
                gaps[gap].append((first + used, bins - used))
            place(length, each, used, first, capacity - gap)
            if gap > each * length:
                gaps[gap - each * length].append((first, used))
    return {n: np.array(r, np.int64) for n, r in runs.items()}


def _placed(plan: dict[int, np.ndarray]):
    def placed(batches):
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("_rank")).to_numpy()
            bin_, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                runs = plan[int(n)]
                from_, each, first, base = runs[np.searchsorted(runs[:, 0], rank[at], "right") - 1].T
                nth, slot = np.divmod(rank[at] - from_, each)
                bin_[at], offset[at] = first + nth, base + slot * n
            keep = [i for i, c in enumerate(names) if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(bin_), pa.array(offset)],
                                             [*(names[i] for i in keep), "sequence_id", "offset"])
    return placed


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, keys=("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to rows with a long ``length`` and given keys.

    ``pieces`` is read twice and should be stored. The counts by length, at
    most ``capacity`` rows, come to the driver and the plan goes to the tasks.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(counts, capacity)
    slices = max(8, sum(counts.values()) // SLICE_ROWS)
    rows = pieces.withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(slices)))
    w = W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = (rows.groupBy("length", "_slice").agg(F.count("*").alias("n"))
              .select("length", "_slice", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before")))
    own = F.row_number().over(W.partitionBy("length", "_slice").orderBy(*keys)) - 1
    ranked = (rows.withColumn("_own", own).join(before, ["length", "_slice"])
              .select(*[F.col(c) for c in pieces.columns], (F.col("_own") + F.col("_before")).alias("_rank")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(_placed(plan), schema + ", sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int,
                   capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document with their sequence and their place in it."""
    pieces = stored(spark, cut_documents(spark, docs, tokenizer, end_id, capacity), "pieces")
    return pack(spark, pieces, capacity)
