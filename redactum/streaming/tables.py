"""Tables that a stream writes batch by batch and readers see whole.

A ``Store`` holds append tables (one folder a batch) and state tables (current
rows by key, in hash buckets). A batch writes its files under a token of its own
and then one manifest, a single small file; readers go through the manifests, so
files of a batch that was cut off are never seen, and a batch that is replayed
after its manifest was written changes nothing. One writer at a time.

A state table's manifest entries say which folder holds each bucket. A batch
reads and rewrites only the buckets its keys fall into; the others keep their
folder, and no history is read again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_scratch

MANIFEST = "entry string, bucket int, folder string, batch_id long"


@dataclass(frozen=True)
class State:
    """A state table: its columns, its key and the number of its buckets."""

    schema: str
    keys: tuple
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, path: str, appends: dict[str, str], states: dict[str, State]):
        self.spark, self.path, self.appends, self.states = spark, path.rstrip("/"), appends, states
        if not self._exists():
            self._write_manifest([("created", None, "")], -1)

    def _exists(self) -> bool:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/batch_id=-1/_SUCCESS")
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root)

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")

    def _write_manifest(self, entries: list[tuple], batch_id: int) -> None:
        rows = self.spark.createDataFrame(entries, "entry string, bucket int, folder string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch_id={batch_id}")

    def last_batch(self) -> int:
        """The newest committed batch, -1 before the first."""
        return self._manifests().agg(F.max("batch_id")).first()[0]

    def committed(self, batch_id: int) -> bool:
        return bool(self._manifests().where(F.col("batch_id") == batch_id).limit(1).count())

    def folders(self, entry: str) -> dict[int | None, str]:
        """Where the buckets of a state table are now."""
        now = self._manifests().where((F.col("batch_id") == self.last_batch()) & (F.col("entry") == entry))
        return {r.bucket: f"{self.path}/{r.folder}" for r in now.collect()}  # at most a row a bucket

    def read(self, entry: str) -> DataFrame:
        """All rows of an append table, with their batch_id, or the current rows of a state table."""
        if entry in self.states:
            return self._load(self.states[entry].schema, list(self.folders(entry).values()))
        rows = self._manifests().where(F.col("entry") == entry).select("folder").collect()  # a row a batch
        return self._load(self.appends[entry] + ", batch_id long", [f"{self.path}/{r.folder}" for r in rows],
                          f"{self.path}/{entry}")

    def _load(self, schema: str, folders: list[str], base: str | None = None) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        return (reader.option("basePath", base) if base else reader).parquet(*folders)

    def begin(self, batch_id: int) -> Batch:
        return Batch(self, batch_id)


class Batch:
    """What one batch has written and will show at once."""

    def __init__(self, store: Store, batch_id: int):
        self.store, self.batch_id, self.token = store, batch_id, uuid.uuid4().hex[:12]
        self.entries: list[tuple] = []
        self.pointers = {entry: store.folders(entry) for entry in store.states}
        self.done_states: set[str] = set()
        self.read_folders: list[str] = []

    def append(self, entry: str, rows: DataFrame) -> None:
        folder = f"{entry}/batch_id={self.batch_id}/try={self.token}"
        rows.write.parquet(f"{self.store.path}/{folder}")
        self.entries.append((entry, None, folder))

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """A table of this batch alone: written and read back, so every later step sees the same rows."""
        path = f"{self.store.path}/work/{self.token}/{name}"
        rows.write.parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def _buckets(self, entry: str, changed: DataFrame) -> list[int]:
        bucket = self.store.states[entry].bucket().alias("bucket")
        return sorted(r.bucket for r in changed.select(bucket).distinct().collect())  # at most the number of buckets

    def _current(self, entry: str, buckets: list[int]) -> DataFrame:
        found = [self.pointers[entry][b] for b in buckets if b in self.pointers[entry]]
        self.read_folders += found
        return self.store._load(self.store.states[entry].schema, found)

    def current(self, entry: str, changed: DataFrame) -> DataFrame:
        """Current rows of the buckets that the keys of ``changed`` fall into."""
        return self._current(entry, self._buckets(entry, changed))

    def upsert(self, entry: str, changed: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Write ``merge(current rows, changed)`` for the buckets of ``changed``, a table of ``keep``."""
        touched = self._buckets(entry, changed)
        rows = merge(self._current(entry, touched), changed).withColumn("bucket", self.store.states[entry].bucket())
        folder = f"{entry}/try={self.token}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.store.path}/{folder}")
        now = self._kept(entry) | {b: f"{folder}/bucket={b}" for b in touched}
        self.entries += [(entry, b, f) for b, f in now.items()]
        self.done_states.add(entry)

    def _kept(self, entry: str) -> dict[int, str]:
        return {b: f[len(self.store.path) + 1:] for b, f in self.pointers[entry].items()}

    def commit(self) -> None:
        """Show everything: from here on the batch has happened."""
        for entry in self.store.states:
            if entry not in self.done_states:  # untouched states stay where they are
                self.entries += [(entry, b, f) for b, f in self._kept(entry).items()]
        self.store._write_manifest(self.entries or [("empty", None, "")], self.batch_id)


    def discard(self) -> None:
        """Drop the tables of ``keep``, after the commit."""
        drop_scratch(self.store.spark, f"{self.store.path}/work/{self.token}")


def newest(keys: list[str], order: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps, for each key, the row with the greatest order."""
    def merge(old: DataFrame, changed: DataFrame) -> DataFrame:
        rest = [c for c in old.columns if c not in keys]
        both = old.unionByName(changed.select(*old.columns))
        return (both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
                .select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest]).select(*old.columns))
    return merge
