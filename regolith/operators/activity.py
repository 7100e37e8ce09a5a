"""Activity of an identity from time-decayed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions import values

ACTIVE_FROM, DORMANT_FROM = 1.5, 0.0


def decayed(weight: Column, days: Column, half_life: Column) -> Column:
    return F.when(half_life <= 0, weight).otherwise(weight * F.exp(-F.log(F.lit(2.0)) * days / half_life))


def status(score: Column) -> Column:
    return F.when(score >= ACTIVE_FROM, "Active").when(score >= DORMANT_FROM, "Dormant").otherwise("Closed")


def _counted(events: DataFrame, taxonomy: DataFrame, reference_date: str) -> DataFrame:
    """Events of known and active types with a readable date, their age in days and decayed weight.

    Types are compared in lower case; a date may be text. The taxonomy is a dictionary of a few rows, which
    Spark broadcasts by its known size.
    """
    kind = dict(events.dtypes)["event_date"]
    date = values.to_date(F.col("event_date")) if kind == "string" else F.to_date("event_date")
    e = events.withColumns({"event_date": date, "event_type": F.lower("event_type")}).filter("event_date is not null").join(taxonomy.filter("is_active"), "event_type")
    e = e.withColumn("days_old", F.greatest(F.lit(0), F.datediff(F.lit(reference_date).cast("date"), F.col("event_date"))))
    return e.withColumn("decay", decayed(F.col("weight"), F.col("days_old"), F.col("half_life")))


def classify(identities: DataFrame, events: DataFrame, taxonomy: DataFrame, reference_date: str, overrides: DataFrame | None = None) -> DataFrame:
    """ubid, score (4 places), status, n_events: known and active types only; identities without events are Dormant.

    overrides: (ubid, override), a status that wins over the computed one, which then comes too; the score stays computed.
    Sums are partly done before the shuffle.
    """
    sums = _counted(events, taxonomy, reference_date).groupBy("ubid").agg(F.sum("decay").alias("sum"), F.count(F.lit(1)).alias("n_events"))
    out = identities.select("ubid").join(sums, "ubid", "left")
    score = F.coalesce("sum", F.lit(0.0))
    n = F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events")
    if overrides is None:
        return out.select("ubid", F.round(score, 4).alias("score"), status(score).alias("status"), n)
    out = out.join(overrides.select("ubid", "override"), "ubid", "left")
    return out.select("ubid", F.round(score, 4).alias("score"), F.coalesce("override", status(score)).alias("status"), n, status(score).alias("computed_status"), "override")


def timeline(events: DataFrame, taxonomy: DataFrame, reference_date: str) -> DataFrame:
    """Per identity the counted events, newest first."""
    row = F.struct(F.col("event_date"), F.col("event_id"), F.col("event_type"), F.round("weight", 3).alias("weight"), F.col("days_old"), F.round("decay", 4).alias("decayed"))
    return _counted(events, taxonomy, reference_date).groupBy("ubid").agg(F.sort_array(F.collect_list(row), asc=False).alias("timeline"))


def newest(events: DataFrame, taxonomy: DataFrame, reference_date: str, most: int = 20) -> DataFrame:
    """Per identity its newest counted events, newest first, and how many there are in all (n_total).

    Each part of an identity's events hands on its newest ones only, so that one of millions of events is held nowhere.
    """
    counted = _counted(events, taxonomy, reference_date).select("ubid", "event_date", "event_id", "event_type", F.round("weight", 3).alias("weight"), "days_old", F.round("decay", 4).alias("decayed"))
    total = counted.groupBy("ubid").agg(F.count(F.lit(1)).alias("n_total"))
    some, part = counted, F.pmod(F.xxhash64("event_id"), F.lit(16))
    for keys in (["ubid", part], ["ubid"]):
        some = some.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("event_date"), F.desc("event_id")))).filter(F.col("place") <= most)
    row = F.struct("event_date", "event_id", "event_type", "weight", "days_old", "decayed")
    return some.groupBy("ubid").agg(F.sort_array(F.collect_list(row), asc=False).alias("timeline")).join(total, "ubid")
