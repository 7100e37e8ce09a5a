"""Events as they arrive: duplicates, late identities, decayed sums that stay current."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators.activity import status
from regolith.operators.graph import shared_root


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """With a watermark, which takes times of the session's zone only."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """One row per key within the watermark; state older than `delay` is dropped by the engine."""
    return _timed(stream, time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts per window (tumbling, or sliding with `slide`) and keys."""
    return _timed(stream, time, delay).groupBy(F.window(time, width, slide).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


def bind(batch: DataFrame, pending: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and those that waited, against (ubid): what is bound now, and what waits on with one more attempt."""
    every = batch.withColumn("retry_count", F.lit(0)).unionByName(pending)
    known = identities.select("ubid").distinct()
    return every.join(known, "ubid", "left_semi"), every.join(known, "ubid", "left_anti").withColumn("retry_count", F.col("retry_count") + 1)


def _growth(days: Column, half_life: Column) -> Column:
    return F.when(half_life <= 0, 1.0).otherwise(F.exp(F.log(F.lit(2.0)) * days / half_life))


def decayed_sums(events: DataFrame, taxonomy: DataFrame, epoch: str) -> DataFrame:
    """(ubid, event_type, sum, n): weights as they stand at `epoch`, for a stream or a table.

    Decay is a factor per type, so a sum at one date gives it at any other: an ordinary partly pre-aggregated sum is all
    the state. Events dated after the date that is asked for later count with a factor above 1, where the batch
    classification would count them undecayed; ask for a date no earlier than the newest event. The epoch should lie
    within about 1000 half-lives of the events.
    """
    days = F.datediff(F.col("event_date"), F.lit(epoch).cast("date"))
    e = events.filter("event_date is not null").withColumn("event_type", F.lower("event_type")).join(taxonomy.filter("is_active"), "event_type")
    return e.groupBy("ubid", "event_type").agg(F.sum(F.col("weight") * _growth(days, F.col("half_life"))).alias("sum"), F.count(F.lit(1)).alias("n"))


def classify_sums(sums: DataFrame, identities: DataFrame, taxonomy: DataFrame, epoch: str, reference_date: str) -> DataFrame:
    """ubid, score, status, n_events at a date, as the batch classification has them."""
    days = F.datediff(F.lit(epoch).cast("date"), F.lit(reference_date).cast("date"))
    s = sums.join(taxonomy.select("event_type", "half_life"), "event_type")
    per = s.groupBy("ubid").agg(F.sum(F.col("sum") * _growth(days, F.col("half_life"))).alias("s"), F.sum("n").alias("n_events"))
    score = F.coalesce("s", F.lit(0.0))
    return identities.select("ubid").join(per, "ubid", "left").select("ubid", F.round(score, 4).alias("score"), status(score).alias("status"), F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"))


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there now, in complete mode; each batch replaces a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    at = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    schema = stream.schema

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{number}")
        last[0] = number

    last = [-1]
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/{last[0]}") if last[0] >= 0 else spark.createDataFrame([], schema)
