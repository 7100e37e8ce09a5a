"""Where results go: tables that appear at once, event topics, queues of micro-batches."""

from __future__ import annotations

import logging
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from regolith.operators.graph import cut
from regolith.sources.buckets import Store

log = logging.getLogger(__name__)


def commit(tables: dict[str, DataFrame], root: str) -> None:
    """All tables or none: each is written aside, and one manifest names them all when they are whole.

    Tables that are not among them stay as they were; `table` reads what the newest manifest names.
    """
    store = Store(next(iter(tables.values())).sparkSession, root)
    change = store.begin()
    for name, df in tables.items():
        change.put(name, df)
    change.commit()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return Store(spark, root).read(name)


def publish(events: DataFrame, to: str, options: dict[str, str] | None = None) -> bool:
    """Events (topic, key, value) to Kafka ("kafka" with its options) or to a folder of JSON, partitioned by topic.

    Best effort as to the sink: the tables stay the truth, so a sink that is not there is logged and not raised. What the
    events are computed from is not the sink's: they are computed first, and errors there are raised.
    """
    ready = cut(events)
    try:
        if to == "kafka":
            ready.write.format("kafka").options(**(options or {})).save()
        else:
            ready.write.mode("append").partitionBy("topic").json(to)
        return True
    except (PySparkException, Py4JJavaError) as e:  # the connector's: the rows are there
        log.warning("events were not sent to %s: %s", to, e)
        return False


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], progress: str, once: bool = True):
    """A queue's worker: batches are acknowledged when `work` has ended, so a lost one comes again under its number."""
    writer = stream.writeStream.option("checkpointLocation", progress).foreachBatch(work)
    return (writer.trigger(availableNow=True) if once else writer).start()
