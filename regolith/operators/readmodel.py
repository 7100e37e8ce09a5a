"""The read model as stored tables that follow changes: only what a change touches is computed again.

Stored, in hash buckets under one manifest (`sources.buckets`):

    places      raw_id -> version and identity: where a record was, which a change does not say
    facts       the records of each identity, in the identity's bucket
    partials    by identity and source: least names, sectors and PIN code, greatest confidence, number of records
    days        by identity, event type and day: number of events, so that decay can be reckoned at any date
    identities  tax numbers, dates and whether canonical

A least value cannot be taken back, so an identity that loses or changes a record is summed up again from its facts, and
one that only gains records is merged with the new ones' sums. What is read and written are the touched identities' buckets.
What a table holds and what changes it are moved once, to where they are put together and written.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.operators import activity, views
from regolith.operators.graph import cut, shared_root
from regolith.sources.buckets import PLACE, Conflict, Store, newest
from regolith.sources.registry import INDUSTRIAL, Registry

FIELDS = ("source_system", "payload_name", "plain_name", "sector", "pin_code", "confidence")
MINIMA = ("payload_name", "plain_name", "industrial", "any_sector", "pin_code")
PART = ["ubid", "source_system"]
DAY = ["ubid", "event_type", "event_date"]
IDENTITY = ("ubid", "pan", "gstin", "is_canonical", "created_on", "updated_on")


def records(r: Registry) -> DataFrame:
    """(raw_id, ubid, *FIELDS) of the current links, as changes have them."""
    links = r.links().filter("unlinked_at is null").select("raw_id", "ubid", "confidence")
    raw = r.raw_records().select("raw_id", "source_system", F.get_json_object("raw_payload", "$.name").alias("payload_name"))
    known = r.normalized().select("raw_id", F.col("normalized_name").alias("plain_name"), "sector", F.col("pincode").alias("pin_code"))
    return links.join(raw, "raw_id").join(known, "raw_id", "left").select("raw_id", "ubid", *FIELDS)


def _each(facts: DataFrame) -> DataFrame:
    """Every record as the sums of itself alone."""
    industrial = F.when(F.col("sector").isin(*INDUSTRIAL), F.col("sector"))
    return facts.select(*PART, "payload_name", "plain_name", industrial.alias("industrial"), F.col("sector").alias("any_sector"), "pin_code", F.col("confidence").alias("confidence_score"), F.lit(1).cast("long").alias("record_count"))


def _summed(facts: DataFrame) -> DataFrame:
    return _together(_each(facts))


def _together(partials: DataFrame, *by: str, more: Iterable[Column] = ()) -> DataFrame:
    return partials.groupBy(*by, *PART).agg(*[F.min(c).alias(c) for c in MINIMA], F.max("confidence_score").alias("confidence_score"), F.sum("record_count").alias("record_count"), *more)


def _days(events: DataFrame) -> DataFrame:
    return events.filter("ubid is not null and event_date is not null").select("ubid", F.lower("event_type").alias("event_type"), F.to_date("event_date").alias("event_date")).groupBy(*DAY).agg(F.count(F.lit(1)).alias("n"))


def refresh(store: Store, changes: DataFrame | None = None, events: DataFrame | None = None, identities: DataFrame | None = None, token: tuple[str, int] | None = None, buckets: int = 32) -> dict[str, list[int]]:
    """Bring the model up to date with one batch of changes; returns the buckets that were written, by table.

    changes: (raw_id, version, ubid, *FIELDS), ubid null for records that have no link now; of several changes of a record
    the greatest version counts, also where it came before. events: (ubid, event_type, event_date), new ones. identities:
    IDENTITY and version. A batch whose token is known changes nothing. All tables appear together.
    """
    change = store.begin()
    wrote: dict[str, list[int]] = {}
    if change.done(token):
        return wrote

    def put(table: str, rows: DataFrame, where: Iterable[int]) -> None:
        where = list(where)
        if where:
            change.replace(table, rows, where)
            wrote[table] = where

    if changes is not None:
        _records(change, changes, put, buckets)
    if events is not None:
        fresh = cut(_days(events))
        change.create("days", fresh.schema, "ubid", buckets)
        where = change.touched("days", fresh)
        put("days", change.place("days", change.read("days", where).unionByName(fresh), *DAY).groupBy(*PLACE, *DAY).agg(F.sum("n").alias("n")), where)
    if identities is not None:
        rows = cut(newest(identities.select(*IDENTITY, "version"), "ubid"))
        change.create("identities", rows.schema, "ubid", buckets)
        where = change.touched("identities", rows)
        put("identities", newest(change.read("identities", where).unionByName(rows), "ubid"), where)
    if wrote or token is not None:
        change.commit(token)
    return wrote


def _records(change, changes: DataFrame, put, buckets: int) -> None:
    if change.has("partials") and not change.has("facts"):
        raise ValueError("a model without facts cannot follow changes of records")
    rows = cut(newest(changes.select("raw_id", "version", "ubid", *FIELDS), "raw_id"))
    change.create("places", rows.select("raw_id", "version", "ubid").schema, "raw_id", buckets)
    change.create("facts", rows.select("ubid", "raw_id", *FIELDS).schema, "ubid", buckets)
    change.create("partials", _summed(rows).schema, "ubid", buckets)

    where = change.touched("places", rows)
    held = change.read("places", where)
    if change.holds("places", where):
        before = held.select(F.col("raw_id").alias("_raw_id"), F.col("version").alias("_version"), F.col("ubid").alias("_ubid"))
        # only what is newer than what is held is a change
        won = cut(rows.join(before, F.col("raw_id").eqNullSafe(F.col("_raw_id")), "left").filter("_version is null or version > _version").drop("_raw_id"))
    else:
        won = rows.withColumn("_ubid", F.lit(None).cast(rows.schema["ubid"].dataType))
    if won.isEmpty():
        return
    put("places", _last(change.place("places", held.withColumn("turn", F.lit(0)).unionByName(won.select("raw_id", "version", "ubid", F.lit(1).alias("turn"))), "raw_id"), "raw_id"), where)

    leaving = won.filter("_ubid is not null").select(F.col("_ubid").alias("ubid"), "raw_id")
    coming = won.filter("ubid is not null").select("ubid", "raw_id", *FIELDS)
    touched = cut(leaving.select("ubid", F.lit(True).alias("loses")).unionByName(coming.select("ubid", F.lit(False).alias("loses"))).groupBy("ubid").agg(F.bool_or("loses").alias("loses")))
    where = change.touched("facts", touched)
    turns = change.read("facts", where).withColumn("turn", F.lit(0)).unionByName(leaving.withColumn("turn", F.lit(1)), allowMissingColumns=True).unionByName(coming.withColumn("turn", F.lit(2)))
    put("facts", _last(change.place("facts", turns, "ubid", "raw_id"), "ubid", "raw_id").filter("turn <> 1"), where)

    losing = touched.filter("loses")
    parts = change.read("partials", where).unionByName(_each(coming)).withColumn("again", F.lit(False))
    if not losing.isEmpty():
        facts = change.read("facts", change.touched("facts", losing))
        parts = parts.unionByName(_each(facts).withColumn("again", F.lit(True))).withColumn("loses", F.lit(False)).unionByName(losing.withColumns({"again": F.lit(False), "record_count": F.lit(0).cast("long")}), allowMissingColumns=True)
    else:
        parts = parts.withColumn("loses", F.lit(False))
    summed = _together(change.place("partials", parts, "ubid"), *PLACE, "again", more=[F.bool_or("loses").alias("loses")])
    loses = F.bool_or("loses").over(Window.partitionBy(*PLACE, "ubid"))
    put("partials", summed.withColumn("loses", loses).filter("again = loses and record_count > 0"), where)


def _last(placed: DataFrame, *keys: str) -> DataFrame:
    """Of each key's rows the one of the greatest turn."""
    w = Window.partitionBy(*PLACE, *keys).orderBy(F.desc("turn"))
    return placed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def statuses(store: Store, taxonomy: DataFrame, reference_date: str, manifest: dict | None = None) -> DataFrame:
    """(ubid, score, status) of the identities with events, at a date."""
    d = store.read("days", manifest=manifest).join(taxonomy.filter("is_active"), "event_type")
    age = F.greatest(F.lit(0), F.datediff(F.lit(reference_date).cast("date"), F.col("event_date")))
    sums = d.groupBy("ubid").agg(F.sum(F.col("n") * activity.decayed(F.col("weight"), age, F.col("half_life"))).alias("sum"))
    return sums.select("ubid", F.round("sum", 4).alias("score"), activity.status(F.col("sum")).alias("status"))


def registry(store: Store, taxonomy: DataFrame, reference_date: str) -> DataFrame:
    """What `views.ubid_registry` computes from all records, from the stored sums: one version of all tables is read."""
    m = store.manifest()
    ids = store.read("identities", manifest=m).drop("version")
    # identities without events are known to be dormant
    known = ids.select("ubid").join(statuses(store, taxonomy, reference_date, m), "ubid", "left")
    known = known.select("ubid", F.coalesce("status", activity.status(F.lit(0.0))).alias("status"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return views.registry_rows(ids, known, views.per_identity(store.read("partials", manifest=m)))


def build(store: Store, r: Registry, buckets: int = 32, follows: bool = True) -> None:
    """The model of all that the tables hold, as one change. One that is not to follow changes of records, as it is thrown
    away when they change, has their sums but neither places nor facts."""
    if not follows:
        rows = newest(records(r).withColumn("version", F.lit(1).cast("long")), "raw_id").drop("version")
        tables = {"partials": _summed(rows), "days": _days(r.events()), "identities": newest(r.ubids().select(*IDENTITY, F.lit(1).cast("long").alias("version")), "ubid")}
        change = store.begin()
        for table, df in tables.items():
            change.create(table, df.schema, "ubid", buckets)
            change.replace(table, df, range(buckets))
        change.commit()
        return
    rows = records(r).withColumn("version", F.lit(1).cast("long"))
    refresh(store, rows, r.events().select("ubid", "event_type", "event_date"), r.ubids().select(*IDENTITY, F.lit(1).cast("long").alias("version")), buckets=buckets)


def fingerprint(r: Registry) -> str:
    """Of the files that the model is made of: their names, sizes and times, not their contents."""
    files = r.spark.read.format("binaryFile").load([f"{r.dir}/{name}.parquet" for name in ("customer", "orders", "events")])
    one = files.agg(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return f"{one['n']}-{hex(int(one['h']) & (2**64 - 1))[2:]}"


def stored(r: Registry) -> DataFrame:
    """The businesses from the model in the shared folder, which is built where there is none for the files as they are."""
    store = Store(r.spark, f"{shared_root(r.spark).rstrip('/')}/read-model-{fingerprint(r)}")
    if not store.versions():
        try:
            build(store, r, max(4, min(4096, -(-r.table("orders").count() // 1_000_000))), follows=False)
        except Conflict:  # another session was faster
            pass
    return registry(store, r.taxonomy(), views.REFERENCE_DATE)
