"""Nearest vectors by an inverted file: lists of rows around centroids, of which a query reads a few.

Centroids are fitted on a sample of bounded size; every row is in a list, and lists of many rows are split, so that no task
holds more than a block of rows and a block of queries. How many lists a query reads is measured: as many as give the wanted
recall against the exact search for some of the queries. `vectors.nearest` is the exact way beside it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.operators import vectors
from regolith.operators.graph import cut

#: Rows that centroids are fitted on at most, and queries that recall is measured on at most, by a hash of their ids.
SAMPLE, MEASURED = 20_000, 200
#: Lists at most (their centroids go to every task) and rounds of fitting.
MOST_LISTS, ROUNDS = 4096, 12
RECALL = 0.95


class Index(NamedTuple):
    centroids: np.ndarray
    blocks: DataFrame  # list, part, ids, rows
    places: DataFrame  # id, list
    probes: int


def _kept(df: DataFrame) -> DataFrame:
    return df.filter("id is not null and v is not null and size(v) > 0").select("id", "v")


def fit(rows: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit length of unit rows; a list without rows takes the row that is farthest from its own centroid."""
    centroids = rows[:lists].copy()
    for _ in range(rounds):
        near = rows @ centroids.T
        at = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, rows)
        empty = np.flatnonzero(np.bincount(at, minlength=lists) == 0)
        sums[empty] = rows[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.divide(sums, length, out=centroids, where=length > 0)
    return centroids


def _listed(df: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """(id, v, lists): the numbers of the n nearest centroids, nearest first."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(frames):
        for f in frames:
            for at in range(0, len(f), vectors.TILE):
                part = f.iloc[at : at + vectors.TILE]
                near = vectors._unit(part["v"]) @ shared.value.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "v": list(part["v"]), "lists": list(order)})

    return df.mapInPandas(run, f"id long, v {df.schema['v'].dataType.simpleString()}, lists array<int>")


def build(base: DataFrame, lists: int | None = None, block: int = vectors.BLOCK, sample: int = SAMPLE) -> Index:
    """An index of (id long, v array) with about the square root of the rows' number of lists. Reads all of them until `measured`."""
    base = _kept(base)
    some = base.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(some):
        empty = base.select(F.lit(0).alias("list"), F.lit(0).alias("part"), F.array("id").alias("ids"), F.array("v").alias("rows")).limit(0)
        return Index(np.zeros((0, 0)), empty, base.select("id", F.lit(0).alias("list")), 0)
    rows = vectors._unit(some["v"])
    lists = max(1, min(lists or int(base.count() ** 0.5), MOST_LISTS, len(rows)))
    centroids = fit(rows, lists)
    placed = cut(_listed(base, centroids, 1).select("id", "v", F.col("lists")[0].alias("list")))
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))  # a row a list
    parts = placed.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    packed = parts.groupBy("list", "part").agg(F.collect_list(F.struct("id", "v")).alias("x"))
    blocks = cut(packed.select("list", "part", F.col("x.id").alias("ids"), F.col("x.v").alias("rows")))
    return Index(centroids, blocks, placed.select("id", "list"), lists)


def measured(index: Index, base: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL) -> Index:
    """The index with the least number of lists to read that finds `recall` of the exact neighbours of some queries."""
    some = cut(_kept(queries).orderBy(F.xxhash64("id"), "id").limit(MEASURED))
    true = vectors.nearest(some, base, k).select("query_id", "id").join(index.places.hint("merge"), "id")
    order = _listed(some, index.centroids, len(index.centroids)).select(F.col("id").alias("query_id"), F.col("lists").alias("order"))
    at = np.sort([r[0] for r in true.join(order, "query_id").select(F.array_position("order", F.col("list"))).collect()])
    need = int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) if len(at) else len(index.centroids)
    return index._replace(probes=max(1, need))


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, block: int = vectors.BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank) as `vectors.nearest` has them, from the lists nearest to each query."""
    queries = _kept(queries)
    n = min(probes or index.probes, len(index.centroids))
    if not n:
        return vectors.nearest(queries, queries.limit(0), k)
    many = max(1, -(-queries.count() // block))
    asked = _listed(queries, index.centroids, n).select("id", "v", F.explode("lists").alias("list"))
    asked = asked.groupBy("list", F.pmod(F.xxhash64("id"), F.lit(many)).alias("q")).agg(F.collect_list(F.struct("id", "v")).alias("x"))
    met = asked.select("list", F.col("x.id").alias("q_ids"), F.col("x.v").alias("q_rows")).join(index.blocks.hint("merge"), "list").select("q_ids", "q_rows", "ids", "rows")
    found = met.mapInArrow(vectors._block_top(k), "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall_of(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: queries and neighbours of the exact search, how many of these were found, and their share."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit")).hint("merge")
    both = true.select("query_id", "id").join(hit, ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("neighbours"))
