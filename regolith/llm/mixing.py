"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Each source's documents are shuffled by a hash of their id and laid end to end; the resulting line of words is cut into
equal blocks of `block_words` words, whatever the input's size (the last one is shorter). Slot k of the schedule takes the golden-ratio point
frac(k * 0.618...) (in 31-bit integer arithmetic, so that reruns agree), scaled to the sum of the targets; the source
whose stretch of the cumulative targets holds the point gets the slot. A slot's rank within its source names the block
that it takes; the second pass over the blocks starts when the first is over, and no block is taken more than twice.
Ranks and places are sums over buckets and then within buckets, so that a source with most of the rows is still dealt
out over many tasks.

Defined results: null text has size 0; documents of size 0 take 0; null sources form one source, which comes last; empty
tables give no rows; equal rows each have their own place; null ids are shuffled like empty ones; texts of any length are
cut into blocks; further columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RE, few, materialize, rows_with_key

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 64
#: 2**31 / golden ratio, odd.
GOLDEN, TURN = 1327217885, 2**31


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """From (skey, source, source_size): weight, target and the end of its stretch (hi) for each source.

    The excess over `most` x size is shared anew by weight: with the sources in order of cap / weight, one is at its cap
    if the level reached without the earlier caps is at least its own ratio.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("rank", F.row_number().over(order) - 1)
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "rank")
    t = t.withColumn("total", F.sum("source_size").over(every) * float(share))
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("rest", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("full", F.col("ratio") <= (F.col("total") - F.col("before")) / F.col("rest"))
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_w = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(every)
    t = t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("w") / F.when(open_w > 0, open_w)))
    t = t.withColumn("hi", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))).select("skey", "source", "source_size", "rank", "w", "target", "lo", "hi")


def place(rows: DataFrame, group: str, bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Sum of `value` over the rows before each row of its group, in order of bucket, then of `order`."""
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(sums, [group, bucket]).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """One row per document: id, text_key (hash of its text), size, source_size, target, taken (words, with repeats)."""
    spark = documents.sparkSession
    size = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE_RE), "")).cast("long")
    rows = documents.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("text_key"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null")).alias("skey"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
    )
    rows = materialize(rows, "mix-rows")
    sizes = materialize(rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sizes")
    n, total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    goal = materialize(targets(sizes.drop("n"), weights, share, most), "mix-targets")
    slots = math.ceil(total * share / block_words)

    # where each document starts on its source's line of words
    digits = max(1, min(5, math.ceil(math.log(max(n, 1) / 2000, 16)) if n > 2000 else 1))
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    rows = materialize(place(rows, "skey", "bucket", ["key", "text_key", "size"], "size", "start").select("id", "text_key", "size", "skey", "start"), "mix-places")

    # the schedule: slot -> source -> rank -> block
    # (the line of targets is cut into equal cells, each with the few sources whose stretches touch it)
    cells = max(1, 4 * goal.count())
    top = goal.agg(F.coalesce(F.max("hi"), F.lit(0.0))).first()[0] or 1.0
    point = (F.col("slot") % TURN * GOLDEN % TURN).cast("double") / float(TURN)
    line = spark.range(0, slots, 1, max(1, min(2048, slots // 100_000))).select(F.col("id").alias("slot"))
    line = line.withColumn("at", point * F.lit(top)).withColumn("cell", F.floor(F.col("at") / F.lit(top) * cells))
    cell = lambda x: F.floor(x / F.lit(top) * cells)
    stretches = goal.filter(F.col("hi") > F.col("lo")).select("skey", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    line = line.join(few(stretches), "cell").filter((F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi")))
    skey = F.col("skey")
    line = line.select("slot", skey.alias("skey"), F.lit(1).cast("long").alias("one"), F.floor(F.col("slot") / 8192).alias("chunk"))
    ranks = place(line, "skey", "chunk", ["slot"], "one", "slot_rank")
    count = F.ceil(F.col("source_size") / block_words)
    taken = ranks.join(goal.select("skey", count.alias("blocks")), "skey").filter(F.col("slot_rank") < F.col("blocks") * int(most))
    taken = taken.groupBy("skey", (F.col("slot_rank") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))

    # pieces of documents, by block
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = rows.filter("size > 0").select("skey", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    got = pieces.join(taken, ["skey", "block"]).groupBy("skey", "start").agg(F.sum(words * F.col("times")).alias("taken"))
    out = rows.join(got.withColumn("some", F.lit(True)), ["skey", "start"], "left").join(few(goal.select("skey", "source_size", "target")), "skey")
    return out.select(F.col("id").alias(id_col), "text_key", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def mix_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents themselves, each as often as its share of taken words says (0, 1 or 2 times, to the nearest)."""
    plan = mix(documents, id_col=id_col, text_col=text_col, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    plan = plan.groupBy(F.col(id_col).alias("id"), "text_key").agg(F.max(times).cast("int").alias("times")).filter("times > 0")
    whole = rows_with_key(documents, id_col, text_col)
    joined = whole.join(plan, whole["id"].eqNullSafe(plan["id"]) & (whole["text_key"] == plan["text_key"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("row.*")
