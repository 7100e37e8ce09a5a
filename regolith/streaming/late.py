"""Late binding as a stream: events wait for the identity that they name, are tried again, and expire."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.operators.graph import shared_root

REASON = "identity not known"


def bound(events: DataFrame, identities: DataFrame, wait_days: int, retry_days: int, delay: str) -> DataFrame:
    """From streams of events (event_id, ubid, ts) and identities (ubid, arrived_at) to (event_id, ubid, is_bound, retry_count, reason).

    An event is bound to an identity that arrived before it or up to `wait_days` after it; its retry_count is how often it
    had been tried in vain by then, once every `retry_days`. Events whose identity does not come in time are given up when
    the watermark passes the end of their wait, with all tries counted. The first arrival of an identity counts. Events that wait and identities
    are the state; events leave it when they expire, so it grows with the identities and not with the events.
    """
    first = identities.filter("ubid is not null").select(F.col("ubid").alias("_ubid"), F.col("arrived_at").cast("timestamp").alias("arrived_at")).withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["_ubid"])
    e = events.select("event_id", "ubid", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    wait = F.expr(f"INTERVAL {int(wait_days)} DAYS")
    met = e.join(first, (F.col("ubid") == F.col("_ubid")) & (F.col("arrived_at") <= F.col("ts") + wait), "leftOuter")
    is_bound = F.col("_ubid").isNotNull()
    waited = F.greatest(F.lit(0.0), (F.col("arrived_at").cast("double") - F.col("ts").cast("double")) / 86400.0)
    tries = F.when(is_bound, F.ceil(waited / retry_days)).otherwise(F.lit(-(-int(wait_days) // int(retry_days))))
    return met.select("event_id", "ubid", is_bound.alias("is_bound"), tries.cast("int").alias("retry_count"), F.when(~is_bound, REASON).alias("reason"))


def collected(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there now in append mode, into a table in the shared folder; each row is written once."""
    at = f"{shared_root(stream.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    schema = stream.schema
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{at}/rows")
