"""Nearest vectors by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
#: Queries of a block that are compared at once.
TILE = 256


def _block_top(k: int):
    def run(batches):
        for batch in batches:
            for q_ids, q_rows, ids, rows in zip(*(batch.column(n) for n in ("q_ids", "q_rows", "ids", "rows"))):
                q_ids, ids = (x.values.to_numpy(zero_copy_only=False) for x in (q_ids, ids))
                b = _unit(_matrix(rows))
                # a few queries at a time: what a task holds does not grow with the pairs of blocks that it gets
                for at in range(0, len(q_ids), TILE):
                    yield _tile_top(k, q_ids[at : at + TILE], _unit(_matrix(q_rows, at, TILE)), ids, b)

    return run


def _tile_top(k: int, q_ids: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    sims, n = a @ b.T, len(ids)
    # the query itself may be among its first; all that equal the last of k + 1 take part, so ties go by id
    known = np.where(np.isnan(sims), -np.inf, sims)  # what is no number comes last
    least = np.partition(known, n - k - 1, axis=1)[:, n - k - 1] if n > k + 1 else np.full(len(a), -np.inf)
    queries, found, values = [], [], []
    for q, s, order, low in zip(q_ids, sims, known, least):
        at = np.flatnonzero(order >= low)
        at = at[np.lexsort((ids[at], -order[at]))[: k + 1]]
        at = at[ids[at] != q][:k]
        queries.append(np.full(len(at), q, dtype=np.int64))
        found.append(ids[at])
        values.append(s[at])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (queries, found, values)], names=["query_id", "id", "similarity"])


def _matrix(rows: pa.ListScalar, at: int = 0, n: int | None = None) -> np.ndarray:
    """Vectors of one length as a matrix; a null component is not a number."""
    part = rows.values.slice(at, n) if n else rows.values
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)


def _unit(rows) -> np.ndarray:
    m = rows if isinstance(rows, np.ndarray) and rows.ndim == 2 else np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def nearest(queries: DataFrame, base: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank): each query's k nearest other rows, ties by id; both sides have (id long, v array).

    Rows of either side are packed into blocks of about `block`; every block of queries meets every block of rows once,
    in a task that holds those two only, and hands on k rows a query. Vectors must be of one length; null and empty
    ones are left out; a zero vector is 0 to all.
    """
    kept = lambda df: df.filter("id is not null and v is not null and size(v) > 0").select("id", "v")
    base, queries = kept(base), kept(queries)
    blocks = lambda df: max(1, -(-df.count() // block))
    nb, nq = blocks(base), blocks(queries)
    packed = lambda df, n, a, b: df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("g")).agg(F.collect_list(F.struct("id", "v")).alias("x")).select("g", F.col("x.id").alias(a), F.col("x.v").alias(b))
    rows = packed(base, nb, "ids", "rows")
    asked = packed(queries, nq, "q_ids", "q_rows").withColumnRenamed("g", "q").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))))
    met = asked.join(rows.hint("merge"), "g").select("q_ids", "q_rows", "ids", "rows")
    some = met.mapInArrow(_block_top(k), "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return some.withColumn("rank", rank).filter(F.col("rank") <= k)
