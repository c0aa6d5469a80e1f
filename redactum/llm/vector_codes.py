"""Vector codes by product quantisation with active-entry Lloyd rounds.

Every component becomes floor(256 x), vectors are cut into ``PARTS`` equal parts,
and each part position has a codebook of up to ``ENTRIES`` entries: at first that
part of the vectors with the least ids. A round assigns every part to its
nearest entry (squared distance, ties to the lower index) and replaces each entry
by the componentwise floor of its parts' mean; unused entries stay.

The state of a vector, its entry and the exact distance to it for each part, is a
written table. After a round only the entries that moved are active: a part whose
own entry did not move compares the stored distance with the active entries
alone, as the others are no nearer than before; any other part looks at all
entries again. Both give the entry a full scan would.

Codebooks (``PARTS`` x ``ENTRIES`` entries, whatever the input) go to the tasks;
each task adds up its parts by position and entry, and at most as many sums as
there are entries come to the driver after a shuffle.

Vectors that are null or hold a null or non-finite component take no part, nor do
those whose length is not that of the first kept vector or is not a multiple of
``PARTS``. Repeated rows are coded each; among equal ids the smaller vector comes
first, null ids come last. Arithmetic is exact: 64-bit where it fits, else with
unbounded integers. Integers that pass 2^60 (components above 2^52) are refused
with an error, as are distances that pass 64 bits. Null labels are one label.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm.common import prepare, stored

PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256
#: magnitude up to which squared distances and sums of a batch fit 64 bits
PLAIN = 1 << 24
WIDEST = 1 << 60
STATE = "vec_id long, label {label}, v array<long>, code binary, distance array<long>"


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def scaled(vector: Column) -> Column:
    """floor(FACTOR x) of every component, exact, as 64-bit integers."""
    def whole(x: Column) -> Column:
        fits = F.abs(x) < float(WIDEST // FACTOR)
        return F.when(fits, F.floor(x * float(FACTOR)).cast("long")).otherwise(
            F.raise_error(F.lit("vector component too large to code")).cast("long"))

    return F.transform(vector, lambda x: whole(x.cast("double")))


def _exact(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as they are, or as unbounded integers where 64 bits may not do."""
    small = all(np.abs(a).max(initial=0) <= PLAIN for a in arrays)
    return arrays if small else tuple(a.astype(object) for a in arrays)


def _nearest(distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of the least of every row, the first of equal ones."""
    at = distance.argmin(1)
    return at, distance[np.arange(len(at)), at]


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)


def assign(x: np.ndarray, book: np.ndarray, code: np.ndarray | None = None, distance: np.ndarray | None = None,
           moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(code, distance) of parts x(n, d) in a book(entries, d).

    code and distance are those before the entries ``moved`` changed.
    """
    x, book = _exact(x, book)
    if code is None:
        return _nearest(_distances(x, book))
    code, distance = code.copy(), distance.copy()
    stays = ~moved[code]
    again = np.flatnonzero(~stays)
    if len(again):
        code[again], distance[again] = _nearest(_distances(x[again], book))
    active, kept = np.flatnonzero(moved), np.flatnonzero(stays)
    if len(active) and len(kept):
        at, near = _nearest(_distances(x[kept], book[active]))
        index, old = active[at], distance[kept]
        better = ((near < old) | ((near == old) & (index < code[kept]))).astype(bool)
        code[kept[better]], distance[kept[better]] = index[better], near[better]
    return code, distance


def _matrix(column: pa.Array, dtype=np.int64) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(n, -1)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(values.ravel()))


def _coding(books: np.ndarray, moved: np.ndarray | None):
    """Batches of the state with codes for the books(part, entry, component)."""
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v")).reshape(-1, parts, width)
            code, distance = np.zeros((len(v), parts), np.uint8), np.zeros((len(v), parts), np.int64)
            if moved is not None:
                old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                was = _matrix(batch.column("distance"))
            for p in range(parts):
                before = () if moved is None else (old[:, p].astype(np.int64), was[:, p], moved[p])
                code[:, p], distance[:, p] = assign(v[:, p], books[p], *before)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("v"),
                 pa.array([c.tobytes() for c in code], pa.binary()), _lists(distance)],
                ["vec_id", "label", "v", "code", "distance"])
    return run


def _sums(parts: int, entries: int, width: int):
    """One row (part, entry, many, total) for every entry that a task's parts use."""
    def run(batches):
        many, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for batch in batches:
            v = _matrix(batch.column("v")).reshape(-1, parts, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            v, = _exact(v)
            for p in range(parts):
                many[p] += np.bincount(code[:, p], minlength=entries)
                own = np.zeros((entries, width), v.dtype)
                np.add.at(own, code[:, p], v[:, p])
                total[p] += own
        used = np.argwhere(many)
        if len(used):
            p, e = used.T
            yield pa.RecordBatch.from_arrays(
                [pa.array(p), pa.array(e), pa.array(many[p, e]),
                 pa.array([list(map(str, t)) for t in total[p, e]], pa.list_(pa.string()))],
                ["part", "entry", "many", "total"])
    return run


def means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books with every used entry replaced by the floor of its parts' mean."""
    parts, entries, width = books.shape
    own = state.select("v", "code").mapInArrow(_sums(parts, entries, width),
                                               "part long, entry long, many long, total array<string>")
    sums = own.groupBy("part", "entry").agg(F.sum("many").alias("many"), *[
        F.sum(F.get("total", F.lit(k)).cast("decimal(38,0)")).alias(f"t{k}") for k in range(width)])
    books = books.copy()
    for row in sums.collect():  # one row an entry
        books[row.part, row.entry] = [int(row[f"t{k}"]) // row.many for k in range(width)]
    return books


def first_books(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """Parts of the vectors with the least ids, from rows(vec_id, v)."""
    least = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    v = np.array([r.v for r in least], np.int64).reshape(len(least), parts, -1)
    return np.ascontiguousarray(v.transpose(1, 0, 2))


def train(spark: SparkSession, rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """(state, books) after the rounds and a last assignment of rows(vec_id, label, v)."""
    books = first_books(rows, entries, parts)
    schema = STATE.format(label=rows.schema["label"].dataType.simpleString())
    state = stored(spark, rows.mapInArrow(_coding(books, None), schema), "vector-codes")
    for _ in range(rounds):
        new = means(state, books)
        moved = (new != books).any(2)
        state = stored(spark, state.mapInArrow(_coding(new, moved), schema), "vector-codes")
        books = new
    return state, books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    prepare(spark)
    kept = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                           F.col(vector_col).alias("x")).filter(finite(F.col("x")))
            .filter((F.size("x") > 0) & (F.size("x") % parts == 0))
            .select("vec_id", "label", scaled(F.col("x")).alias("v")))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    if not first:  # nothing to code
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    state, books = train(spark, kept.filter(F.size("v") == first.n), parts, entries, rounds)
    # the sum is exact; one past 64 bits is an error of the cast
    error = F.aggregate("distance", F.lit(0).cast("decimal(38,0)"),
                        lambda s, d: (s + d).cast("decimal(38,0)")).cast("long")
    coded = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), error.alias("error"))
    labels = stored(spark, coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long")
                                                      .alias("label_error")), "label-errors")
    same = coded.label.eqNullSafe(labels.label)
    return coded.join(labels, same).select("vec_id", "code", "error", "label_error",
                                           F.lit(books_sha256(books)).alias("codebooks_sha256"))
