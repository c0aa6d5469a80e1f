"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are dealt to blocks by a hash of the row; every block meets every block
of queries once (a stated query set against all rows). In a block each
dimension has its list of vectors sorted by value. A query reads all lists of
its non-zero components in step, from the top for positive components and from
the bottom for negative ones; vectors met for the first time get their full
score. It stops when the bound for vectors not met yet, the sum of the products
at the current depth, is below its k-th score (a tie may still win by a smaller
id, so equality goes on). The best k of each block are then ranked per query;
Spark ranks them in part before the shuffle.

Vectors that are null or hold a null or non-finite component take no part;
vectors meet only those of equal length. Rows that repeat are rows of their own:
a query meets every row but its own, and each query row has its own ranks. Null
ids take no part. Scores are exact: where a product might pass 64 bits, unbounded
integers are used; components of 2^52 or more and scores past 64 bits end the
job with an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from redactum.llm.common import stored

BLOCK_ROWS = 8192
QUERY_ROWS = 4096
FIRST_DEPTH = 16


def scaled(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of every component; null if one is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    large = F.raise_error(F.lit("vector component too large to search")).cast("long")
    whole = lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v * float(factor)).cast("long")).otherwise(large)
    return F.when(fine, F.transform(x, whole))


def threshold_search(vectors: np.ndarray, ids: np.ndarray, order: np.ndarray, query: np.ndarray, own: np.ndarray, k: int):
    """(ids, scores, depth) of the best k by the threshold algorithm, without the rows ``own``."""
    used = np.flatnonzero(query)
    n = len(ids)
    weight = query[used]
    met = own.copy()
    best_id = best = np.zeros(0, np.int64)
    depth, step = 0, FIRST_DEPTH
    if not len(used):  # every score is zero: the smallest ids
        rest = np.sort(ids[~met])[:k]
        return rest, np.zeros(len(rest), np.int64), 0
    while depth < n:
        to = min(n, depth + step)
        down = order[n - to:n - depth, used[weight > 0]]
        up = order[depth:to, used[weight < 0]]
        fresh = np.unique(np.concatenate([down.ravel(), up.ravel()]))
        fresh = fresh[~met[fresh]]
        met[fresh] = True
        best = np.concatenate([best, vectors[fresh] @ query])
        best_id = np.concatenate([best_id, ids[fresh]])
        first = np.lexsort((best_id, -best))[:k]
        best, best_id = best[first], best_id[first]
        depth, step = to, 2 * step
        edge = np.where(weight > 0, vectors[order[n - depth, used], used], vectors[order[depth - 1, used], used])
        if len(best) == k and int(edge @ weight) < best[-1]:
            break
    return best_id, best, depth


def search_block(data: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(data) and len(queries):
        vectors = np.stack(data.v.to_numpy()).astype(np.int64).reshape(len(data), -1)
        asked = np.stack(queries.v.to_numpy()).astype(np.int64).reshape(len(queries), -1)
        ids, row = data.vec_id.to_numpy(np.int64), data.row.to_numpy(np.int64)
        order = np.argsort(vectors, axis=0, kind="stable")
        largest = [float(np.abs(x).max(initial=0)) for x in (vectors, asked)]
        bound = largest[0] * largest[1] * vectors.shape[1]
        if bound < 2.0**53:  # exact in doubles, and much faster
            vectors, asked = vectors.astype(float), asked.astype(float)
        elif bound >= 2.0**62:
            vectors, asked = vectors.astype(object), asked.astype(object)
        for own, own_id, query in zip(queries.row.to_numpy(np.int64), queries.vec_id.to_numpy(np.int64), asked, strict=True):
            got, scores, _ = threshold_search(vectors, ids, order, query, row == own, k)
            out.append(pd.DataFrame({"query": own, "query_id": own_id, "vec_id": got, "score": scores.astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every query."""
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col)).alias("v"),
                           is_query.alias("q"))
            .filter("vec_id IS NOT NULL AND v IS NOT NULL")
            .withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()}))
    rows = stored(spark, rows, "vectors")  # row numbers that stay
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    blocks, parts = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    key = F.xxhash64("row")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = rows.select("row", "vec_id", "v", "dim", F.pmod(key, F.lit(blocks)).cast("int").alias("block"),
                       every(parts).alias("part"))
    queries = rows.filter("q").select("row", "vec_id", "v", "dim", every(blocks).alias("block"),
                                      F.pmod(key, F.lit(parts)).cast("int").alias("part"))
    cell = ["dim", "block", "part"]
    near = data.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInPandas(
        lambda d, q: search_block(d, q, k), "query long, query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
