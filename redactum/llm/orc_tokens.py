"""Token ids of documents as ORC files.

Documents are dealt to parts by ranges of doc_id, sorted, encoded and written:
one ORC file a part, with the integer run-length encoding of ORC for the ids,
row indexes every ``INDEX_ROWS`` rows, stripes of ``STRIPE_BYTES`` and Bloom
filters on ``doc_id``. Readers take stripes in parallel, and a filter on doc_id
is answered from file, stripe and row-group metadata and the Bloom filters.

Columns of the files: doc_id, part, start (ids of the part before this
document), n_tokens, ids. A part's place among all ids is the sum of the parts
before it, so nothing is numbered by one task.

The number of parts follows the bytes of text. Null text counts as empty and
has the end id alone; null doc_ids come first; rows that repeat a doc_id are
written each, next to each other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from redactum.llm.common import fresh_path, prepare
from redactum.llm.tokens import Encoder

PART_BYTES = 32 << 20
STRIPE_BYTES = 4 << 20
INDEX_ROWS = 1000
FILE_SCHEMA = "doc_id long, part int, start long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int):
    def encode(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [np.append(x, np.uint32(end_id)) for x in Encoder.of(path).encode_all(batch.column(1).to_pylist())]
            if not ids:
                continue
            size = np.array([len(x) for x in ids], np.int64)
            after = start + np.cumsum(size)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32),
                                             pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.full(len(ids), part, np.int32)),
                 pa.array(after - size), pa.array(size), lists], ["doc_id", "part", "start", "n_tokens", "ids"])
            start = int(after[-1])
    return encode


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    (rows.repartitionByRange(max(1, -(-total // PART_BYTES)), "doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(_encode(tokenizer, end_id), FILE_SCHEMA)
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.row.index.stride", str(INDEX_ROWS))
     .option("orc.create.index", "true").option("compression", "zstd").orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; a list of ids is pushed down to the ORC metadata."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def part_starts(rows: DataFrame) -> DataFrame:
    """(part, before): ids of all parts before each one; a row per part."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def _digest(batches):
    for batch in batches:
        lists = batch.column(3)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
            ["doc_id", "part", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    prepare(spark)
    rows = read_tokens(spark, path)
    own = rows.select("doc_id", "part", "start", "ids").mapInArrow(
        _digest, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return (own.join(part_starts(rows), "part")
            .select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def store_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int,
                 path: str | None = None) -> tuple[str, DataFrame]:
    path = path or fresh_path(spark, "orc-tokens")
    write_tokens(spark, docs, path, tokenizer, end_id)
    return path, digests(spark, path)
