"""Read-model views."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions import identifiers
from regolith.operators import activity, review
from regolith.sources.registry import INDUSTRIAL, Registry

REFERENCE_DATE = "2024-01-31"


def ubid_activity(r: Registry) -> DataFrame:
    return activity.classify(r.ubids(), r.events(), r.taxonomy(), REFERENCE_DATE)


def code(ubid: Column) -> Column:
    return identifiers.ubid_code(ubid)


def base_ubids(r: Registry) -> DataFrame:
    """Identities with their activity: status (a reviewer's override wins), score, tax numbers."""
    a = activity.classify(r.ubids(), r.events(), r.taxonomy(), REFERENCE_DATE, r.overrides())
    return r.ubids().select("ubid", F.col("pan").alias("anchor_pan"), F.col("gstin").alias("anchor_gstin")).join(a.select("ubid", "status", "score", "override"), "ubid", "left")


def wide_records(r: Registry) -> DataFrame:
    """Raw records with what is known of them and, where they have one, their current link."""
    links = r.links().filter("unlinked_at is null").select("raw_id", "ubid", "confidence", "decision_type", "linked_at")
    raw = r.raw_records().select("raw_id", "source_system", "source_record_id", F.get_json_object("raw_payload", "$.name").alias("raw_name"), F.get_json_object("raw_payload", "$.address").alias("raw_address"), "extracted_at")
    return raw.join(r.normalized(), "raw_id", "left").join(r.identifiers(), "raw_id", "left").join(links, "raw_id", "left")


def ubid_registry(r: Registry) -> DataFrame:
    """One row per canonical identity: as it is stored, if it is, else computed."""
    return r.stored(r) if r.stored else computed_registry(r)


def computed_registry(r: Registry) -> DataFrame:
    """One row per canonical identity. Links are summed up per identity before they meet it, so each distinct count is a count."""
    links = r.links().filter("unlinked_at is null").select("raw_id", "ubid", "confidence")
    rows = links.join(r.raw_records().select("raw_id", "source_system", "raw_payload"), "raw_id").join(r.normalized(), "raw_id", "left")
    industrial = F.col("sector").isin(*INDUSTRIAL)
    # first per source, then over sources: a record has one current link to an identity, so records are counted as rows
    least = {"payload_name": F.get_json_object("raw_payload", "$.name"), "plain_name": F.col("normalized_name"), "industrial": F.when(industrial, F.col("sector")), "any_sector": F.col("sector"), "pin_code": F.col("pincode")}
    by_source = rows.groupBy("ubid", "source_system").agg(*[F.min(c).alias(n) for n, c in least.items()], F.max("confidence").alias("confidence_score"), F.count(F.lit(1)).alias("record_count"))
    return registry_rows(r.ubids(), ubid_activity(r).select("ubid", "status", "score"), per_identity(by_source))


def per_identity(by_source: DataFrame) -> DataFrame:
    """One row per identity from one per identity and source."""
    least = ("payload_name", "plain_name", "industrial", "any_sector", "pin_code")
    return by_source.groupBy("ubid").agg(*[F.min(n).alias(n) for n in least], F.max("confidence_score").alias("confidence_score"), F.sum("record_count").alias("record_count"), F.count(F.lit(1)).alias("source_count"))


def registry_rows(identities: DataFrame, activity_rows: DataFrame, per: DataFrame) -> DataFrame:
    out = identities.filter("is_canonical").join(activity_rows, "ubid", "left").join(per, "ubid", "left")
    return out.select(
        "ubid", F.coalesce("payload_name", "plain_name", F.lit("Unknown Business")).alias("business_name"), F.coalesce("industrial", "any_sector", F.lit("Unknown")).alias("sector"), "pin_code", "pan", "gstin",
        F.coalesce("status", F.lit("Unknown")).alias("status"), F.col("score").alias("activity_score"), "confidence_score", F.coalesce("record_count", F.lit(0)).alias("record_count"), F.coalesce("source_count", F.lit(0)).alias("source_count"), "created_on", "updated_on",
    )


def source_records(r: Registry) -> DataFrame:
    links = r.links().filter("unlinked_at is null").select("raw_id", "ubid", "confidence")
    out = r.raw_records().join(r.normalized(), "raw_id", "left").join(links, "raw_id", "left")
    return out.select("raw_id", "source_system", F.coalesce(F.get_json_object("raw_payload", "$.name"), "normalized_name").alias("raw_name"), "pincode", "sector", "ubid", "confidence", "extracted_at")


def activity_events(r: Registry) -> DataFrame:
    u = r.ubids().select("ubid", F.lit(True).alias("known"))
    return r.events().join(u, "ubid", "left").select("event_id", "ubid", "event_type", "event_date", "outcome", F.coalesce("known", F.lit(False)).alias("is_known"), "ingested_at")


def audit_log(r: Registry) -> DataFrame:
    return review.audit(r.review_actions(), r.review_queue())


def published(r: Registry, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The read model under its published column names, which governed SQL is written against: all views or those named.
    Only the registry is read from (and needs) the stored model."""
    c, e, q = F.col, activity_events(r), r.review_queue()
    views = {
        "ubid_registry": lambda: ubid_registry(r).select("ubid", "business_name", c("pan").alias("pan_anchor"), c("gstin").alias("gstin_anchor"), "status", "sector", "pin_code", F.lit(None).cast("string").alias("district"), "confidence_score", c("record_count").alias("source_record_count"), c("source_count").alias("department_count"), c("created_on").alias("assigned_on"), c("updated_on").alias("last_updated")),
        "source_records": lambda: wide_records(r).select(c("raw_id").alias("id"), "ubid", "source_system", "source_record_id", F.coalesce("raw_name", "normalized_name", F.lit("Unknown Business")).alias("raw_name"), "raw_address", c("pincode").alias("pin_code"), "sector", "pan", "gstin", c("confidence").alias("link_confidence"), c("decision_type").alias("link_type"), "linked_at", "extracted_at"),
        "activity_events": lambda: e.select(c("event_id").alias("id"), F.when(c("is_known"), c("ubid")).alias("ubid"), F.lit("events").alias("source_system"), "event_type", "event_date", c("outcome").alias("event_outcome"), "ingested_at"),
        "audit_log": lambda: r.audits().select("id", "ubid", "action", "actor", "entity_type", "created_at"),
        "review_queue": lambda: q.select("id", "record_a", "record_b", c("confidence").alias("confidence_score"), "priority", "status", "queued_at"),
    }
    return {name: views[name]() for name in (views if names is None else names)}


def create_views(r: Registry) -> dict[str, str]:
    """Register the published views; returns the error of each that failed."""
    failed = {}
    try:
        found = published(r)
    except Exception as e:
        return {"*": str(e)}
    for name, df in found.items():
        try:
            df.createOrReplaceTempView(name)
        except Exception as e:  # one broken view leaves the others usable
            failed[name] = str(e)
    return failed
