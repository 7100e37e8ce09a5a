"""Hard negatives: for each anchor all scores are sorted, and negatives are read below each positive's upper limit.

Scores are integer inner products. Every block of anchors meets every block of rows in a task that holds those two: there
each anchor's scores are sorted by (score, id). A first pass keeps the best rows of the anchor's own label, a second one
finds each positive's upper limit in the sorted scores by binary search and reads on to the lower limit. A block hands on
as many rows as are wanted at most, so what Spark ranks grows with anchors times blocks and never with anchors times rows.

Defined results: rows without a label or a vector, or with a null or non-finite component, take no part. Vectors of unlike
length are compared over the shorter one's components. Components beyond a long's range are clamped to it, and sums wrap
around like a long. A row of the anchor's own id, itself included, is neither its positive nor its negative; every other
row counts, so repeated rows appear as often as they occur. Rows without an id are nobody's anchor and come last among
equal scores. An anchor without positives, or a positive without negatives in its limits, gives no row; so does an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize, pack, release

POSITIVES, NEGATIVES = 5, 10
#: Limits of a negative's score, in hundredths of the positive's.
LOWER, UPPER = 30, 90
#: Rows and anchors of a block, and cells of the matrix of scores that is held at a time.
ROWS, ANCHORS, CELLS = 16384, 512, 4_000_000


def prepared(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id long, label long, v array<long>): rows that take part, with integer components."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")).filter(F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
    # rounded down in double, then cut at the ends of a long
    least, most = F.lit(-(2.0**63)), F.lit(2.0**63)
    whole_number = lambda x: F.when(x >= most, F.lit(2**63 - 1)).when(x < least, F.lit(-(2**63))).otherwise(x.cast("long"))
    return kept.withColumn("v", F.transform("v", lambda x: whole_number(_floor(x * F.lit(256.0)))))


def _floor(x: Column) -> Column:
    """The floor as a double: the cast cuts towards zero, and large doubles are whole."""
    cut = F.when(F.abs(x) < F.lit(2.0**53), x.cast("long").cast("double")).otherwise(x)
    return F.when(cut > x, cut - 1).otherwise(cut)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows, zeros after the shorter ones' ends."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where none of their sums can leave the exact range."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    top = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    if top(a) * top(b) * max(n, 1) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Block:
    """Rows in order of id (none last), so that a stable sort by score leaves ties in that order."""

    def __init__(self, data: bytes):
        table = load(data)
        ids = table.column("id")
        self.missing = ids.is_null().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        order = np.lexsort((self.ids, self.missing))
        self.missing, self.ids = self.missing[order], self.ids[order]
        self.labels = table.column("label").to_numpy()[order]
        self.vectors = _matrix(table.column("v").combine_chunks())[order]

    def sorted(self, anchors: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor (its number) the rows but those of its id, best score first, and their scores."""
        step = max(1, CELLS // max(len(self.ids), 1))
        for at in range(0, len(anchors.ids), step):
            for i, s in enumerate(_scores(anchors.vectors[at : at + step], self.vectors), at):
                order = np.argsort(~s, kind="stable")  # ~s falls as s rises and, unlike -s, exists for every long
                order = order[self.missing[order] | (self.ids[order] != anchors.ids[i])]
                yield i, order, s[order]

    def id(self, i: int) -> int | None:
        return None if self.missing[i] else int(self.ids[i])


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


_BEST = [("q", pa.int64()), ("i", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]
_FOUND = [("q", pa.int64()), ("i", pa.int32()), ("p", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]


def _best_of_label(k: int):
    def run(batches):
        for batch in batches:
            for q, asked, data in zip(*(batch.column(c).to_pylist() for c in ("q", "asked", "data"))):
                anchors, block = Block(asked), Block(data)
                out = []
                for i, order, s in block.sorted(anchors):
                    same = np.flatnonzero(block.labels[order] == anchors.labels[i])[:k]
                    out += [(q, i, block.id(order[j]), int(s[j])) for j in same]
                yield _batch(out, _BEST)
        release()

    return run


def limits(positive: int, lower: int, upper: int) -> tuple[int, int]:
    """The least and greatest score between the limits."""
    return -((-lower * positive) // 100), (upper * positive) // 100


def _below_limits(k: int, lower: int, upper: int):
    def run(batches):
        for batch in batches:
            for q, asked, positives, data in zip(*(batch.column(c).to_pylist() for c in ("q", "asked", "positives", "data"))):
                anchors, block = Block(asked), Block(data)
                wanted: dict[int, list] = {}
                for x in positives:
                    wanted.setdefault(x["i"], []).append((x["p"], x["score"]))
                out = []
                for i, order, s in block.sorted(anchors):
                    if i not in wanted:
                        continue
                    other = order[block.labels[order] != anchors.labels[i]]
                    down = ~s[block.labels[order] != anchors.labels[i]]  # rises, as searches need
                    for p, score in wanted[i]:
                        least, most = (min(max(x, -(2**63)), 2**63 - 1) for x in limits(score, lower, upper))
                        if least > most:
                            continue
                        first, last = np.searchsorted(down, ~np.int64(most), "left"), np.searchsorted(down, ~np.int64(least), "right")
                        out += [(q, i, p, block.id(other[j]), int(~down[j])) for j in range(first, min(last, first + k))]
                yield _batch(out, _FOUND)
        release()

    return run


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows and anchors as `prepared` has them.

    The anchors' best rows of their own label are positives; the best rows of other labels whose score lies between
    `lower` and `upper` hundredths of the positive's are its negatives.
    """
    columns = ["id", "label", "v"]
    dealt = lambda df, most, label: pack(df.repartition(max(1, -(-df.count() // most))), columns, label)
    base = dealt(rows, ROWS, "negatives-rows")
    asked = dealt(anchors.filter("id is not null"), ANCHORS, "negatives-anchors").select(F.col("b").alias("q"), F.col("data").alias("asked"))
    groups = max(1, base.count())
    place = F.pmod(F.xxhash64("b"), F.lit(groups)).alias("g")
    blocks = base.select(place, "data")
    everywhere = lambda df: df.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    ordered = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))

    near = everywhere(asked).join(blocks, "g").select("q", "asked", "data").mapInArrow(_best_of_label(positives), "q long, i int, id long, score long")
    best = materialize(near.withColumn("p", F.row_number().over(ordered("q", "i"))).filter(F.col("p") <= positives), "negatives-positives")
    told = asked.join(best.groupBy("q").agg(F.collect_list(F.struct("i", "p", "score")).alias("positives")), "q")
    found = everywhere(told).join(blocks, "g").select("q", "asked", "positives", "data").mapInArrow(_below_limits(negatives, lower, upper), "q long, i int, p int, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(ordered("q", "i", "p"))).filter(F.col("rank") <= negatives)
    own = asked.mapInArrow(_anchor_ids, "q long, i int, anchor_id long")
    named = best.join(own, ["q", "i"]).select("q", "i", "p", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["q", "i", "p"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _anchor_ids(batches):
    for batch in batches:
        for q, asked in zip(batch.column("q").to_pylist(), batch.column("asked").to_pylist()):
            ids = Block(asked).ids
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["q", "i", "anchor_id"])
