"""One business as its records, pairs and events show it: trace, profile and timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions import text as T
from regolith.functions import values as V
from regolith.operators import views
from regolith.sources.registry import Registry

UNNAMED = "Unknown Business"


def _asked(query: str) -> dict[str, Column]:
    q = query.strip().upper()
    up = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    return {"exact_id": up("source_record_id") == q, "exact": (up("source_record_id") == q) | (up("pan") == q) | (up("gstin") == q), "name": up("normalized_name").contains(q), "payload": up("raw_name").contains(q) | up("raw_address").contains(q)}


def raw_matches(r: Registry, query: str, limit: int = 25) -> DataFrame:
    """Records that the text names by number, name or address, those of that very record number first."""
    w = views.wide_records(r)
    asked = _asked(query)
    found = w.filter(asked["exact"] | asked["name"] | asked["payload"])
    return found.orderBy(F.when(asked["exact_id"], 0).otherwise(1), F.desc("extracted_at"), "raw_id").limit(limit)


def matched_ubid(r: Registry, query: str) -> DataFrame:
    """The identity that the text means (none or one row): by its code, or by a linked record's number or name."""
    w, q = views.wide_records(r).filter("ubid is not null"), query.strip().upper()
    asked = _asked(query)
    found = w.filter(asked["exact"] | asked["name"]).select("ubid")
    by_code = r.ubids().filter(F.upper(views.code(F.col("ubid"))) == q).select("ubid")
    return found.unionByName(by_code).distinct().orderBy("ubid").limit(1)


def pairs_of(r: Registry, records: DataFrame, limit: int = 20) -> DataFrame:
    """Pairs with one of the records on either side, the best scored first, with what reviewers said.

    The sides are two equi-joins, not one join on either; `records` is a screenful.
    """
    ids = records.select(F.col("raw_id").alias("x"))
    p = r.pairs()
    some = p.withColumn("side", F.explode(F.array("a", "b"))).join(ids, F.col("side") == F.col("x"), "left_semi").drop("side").dropDuplicates(["pair_id"])
    return some.orderBy(F.desc("score"), "pair_id").limit(limit).select("pair_id", "strategy", F.bround(F.col("score") * 100).cast("int").alias("confidence"), "a", "b", "review_status", "reviewer_decision")


def linked_records(r: Registry, ubids: DataFrame) -> DataFrame:
    w = views.wide_records(r).join(ubids.select("ubid"), "ubid", "left_semi")
    return w.select(
        "ubid", "raw_id", "source_system", "source_record_id", F.coalesce("raw_name", "normalized_name", F.lit(UNNAMED)).alias("name"), V.first_value(F.col("raw_address"), F.col("pincode")).alias("address"), "pincode", "sector", "pan", "gstin",
        F.bround(F.col("confidence") * 100).cast("int").alias("confidence"), "decision_type", V.date_text(F.col("linked_at")).alias("linked_at"), V.date_text(F.col("extracted_at")).alias("extracted_at"),
    )


def trace(r: Registry, query: str) -> dict[str, DataFrame]:
    """raw_records, candidate_pairs, linked_records and a one-row summary with the trace's status."""
    ubid = matched_ubid(r, query)
    raw = raw_matches(r, query)
    pairs = pairs_of(r, raw)
    linked = linked_records(r, ubid)
    n = lambda c: F.count_if(c)
    said = pairs.agg(F.count(F.lit(1)).alias("candidate_pairs"), n(F.col("reviewer_decision") == "confirm_match").alias("confirmed_pairs"), n(F.col("review_status").isin("pending", "locked")).alias("pending_reviews"))
    held = linked.agg(F.count(F.lit(1)).alias("linked_records"), F.countDistinct("source_system").alias("departments"))
    seen = raw.agg(F.count(F.lit(1)).alias("raw_matches"))
    one = ubid.agg(F.max("ubid").alias("ubid"))
    summary = one.join(seen, F.lit(True)).join(said, F.lit(True)).join(held, F.lit(True))  # one row each
    status = F.when(F.col("ubid").isNotNull(), "canonical_ubid_found").when(F.col("confirmed_pairs") > 0, "review_confirmed_linkage_pending").otherwise("raw_record_unlinked")
    shown = F.when(F.col("ubid").isNotNull(), F.lit("Linked")).when(F.col("raw_matches") > 0, "Linkage Pending").otherwise("Not Found")
    summary = summary.select(F.lit(query.strip()).alias("searched_query"), ((F.col("raw_matches") > 0) | F.col("ubid").isNotNull()).alias("found"), status.alias("trace_status"), shown.alias("shown_status"), "ubid", "raw_matches", "candidate_pairs", "confirmed_pairs", "pending_reviews", "linked_records", "departments")
    return {"raw_records": raw, "candidate_pairs": pairs, "linked_records": linked, "summary": summary}


def first_seen(rows: DataFrame, key: str, column: str, order: list[Column], out: str) -> DataFrame:
    """Per key the distinct non-empty values, in the order in which they come first (array). Values are made distinct
    before they are collected, so an entity of very many records is no large row."""
    spot = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("at")
    one = rows.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(key, F.col(column).alias("value")).agg(spot)
    return one.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias(out))


def profile(r: Registry, ubids: DataFrame | None = None) -> DataFrame:
    """One row per identity: names, tax numbers, sectors and PIN codes as its records have them, and where they disagree."""
    u = views.base_ubids(r)
    u = u.join(ubids.select("ubid"), "ubid", "left_semi") if ubids is not None else u
    w = views.wide_records(r).filter("ubid is not null")
    w = w.join(ubids.select("ubid"), "ubid", "left_semi") if ubids is not None else w
    w = w.withColumns({"name": F.coalesce("raw_name", "normalized_name", F.lit(UNNAMED)), "address": V.first_value(F.col("raw_address"), F.col("pincode"))})
    order = [-F.col("confidence"), -F.unix_timestamp("extracted_at"), F.col("raw_id")]
    out = u.join(w.groupBy("ubid").agg(F.count(F.lit(1)).alias("source_records"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lng")), "ubid", "left")
    lists = {"names": "name", "addresses": "address", "sectors": "sector", "pincodes": "pincode", "pans": "pan", "gstins": "gstin", "departments": "source_system"}
    for many, one in lists.items():
        out = out.join(first_seen(w, "ubid", one, order, many), "ubid", "left")
    head = lambda c, other=None: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(other))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return out.select(
        "ubid", head("names", UNNAMED).alias("name"), F.coalesce("status", F.lit("Unknown")).alias("status"), F.round(F.coalesce("score", F.lit(0.0)), 3).alias("score"), F.coalesce("source_records", F.lit(0)).alias("source_records"),
        head("addresses", "N/A").alias("address"), F.coalesce("anchor_pan", head("pans")).alias("pan"), F.coalesce("anchor_gstin", head("gstins")).alias("gstin"), head("sectors", "Unknown").alias("sector"),
        F.array_join("pincodes", " ").alias("pincodes"), F.array_join("pans", " ").alias("pan_values"), F.array_join("departments", " ").alias("source_systems"), size("departments").alias("linked_departments"),
        (size("pans") > 1).alias("pan_conflict"), (size("gstins") > 1).alias("gstin_conflict"), "override", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"),
    )


def timeline(r: Registry, ubids: DataFrame | None = None, computed_on: str = views.REFERENCE_DATE) -> DataFrame:
    """(ubid, type, on_date, title, description, source): the computed status, its signals, events and links, as one list.

    The score in a description has two places, halves rounded away from zero.
    """
    u = views.base_ubids(r)
    only = (lambda df: df.join(ubids.select("ubid"), "ubid", "left_semi")) if ubids is not None else (lambda df: df)
    status = F.coalesce("status", F.lit("Unknown"))
    two = F.coalesce("score", F.lit(0.0)).cast("decimal(18,4)").cast("decimal(18,2)").cast("string")
    computed = only(u).select("ubid", F.lit("computed").alias("type"), F.lit(computed_on).alias("on_date"), F.lit("Status computed").alias("title"), F.concat(F.lit("Activity status is "), status, F.lit(" with score "), two, F.lit(".")).alias("description"), F.lit("activity_classifier").alias("source"))
    ev = only(r.events())
    events = ev.select("ubid", F.lit("signal").alias("type"), F.col("event_date").cast("string").alias("on_date"), T.title(F.coalesce("event_type", F.lit("Activity event"))).alias("title"), F.coalesce("outcome", F.concat(F.lit("Event "), F.col("event_id").cast("string"), F.lit(" was reported."))).alias("description"), F.lit("events").alias("source"))
    known = r.taxonomy().filter("is_active").select("event_type")  # a dictionary of a few rows
    signals = ev.join(known, "event_type").join(u.select("ubid", "status"), "ubid").select("ubid", F.when(F.lower("event_type").contains("review"), "review").otherwise("signal").alias("type"), F.col("event_date").cast("string").alias("on_date"), F.col("event_type").alias("title"), F.concat(F.lit("Evidence used in the "), status, F.lit(" activity decision.")).alias("description"), F.lit("registry").alias("source"))
    l = only(views.wide_records(r).filter("ubid is not null"))
    said = F.concat(F.col("source_system"), F.lit(" record "), F.col("source_record_id"), F.lit(" is linked by "), F.coalesce("decision_type", F.lit("matching")), F.lit(" at "), F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("% confidence."))
    links = l.select("ubid", F.lit("link").alias("type"), V.date_text(F.col("linked_at")).alias("on_date"), F.lit("Department record linked").alias("title"), said.alias("description"), F.col("source_system").alias("source"))
    return computed.unionByName(signals).unionByName(events).unionByName(links)


def newest(entries: DataFrame, per_entity: int = 50) -> DataFrame:
    """The latest entries of each identity, newest first, with their place."""
    order = Window.partitionBy("ubid").orderBy(F.desc("on_date"), "type", "title", "description", "source")
    return entries.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_entity)


def explanation(r: Registry, ubid: int, limit: int = 50) -> DataFrame:
    """What a written explanation of a status is given: the status and the events, newest first; nothing personal."""
    u = views.base_ubids(r).filter(F.col("ubid") == ubid).select("ubid", F.coalesce("status", F.lit("Unknown")).alias("status"))
    e = r.events().filter(F.col("ubid") == ubid).select("ubid", "event_id", "event_type", "event_date", "outcome")
    return u.join(e, "ubid", "left").orderBy(F.desc_nulls_last("event_date"), "event_id").limit(limit)


def parse_explanation(text: str) -> dict[str, str]:
    """The explanation and the last significant event of a written answer; the whole of it where it has no such lines."""
    out = {"explanation": text or "", "last_event": "Unknown"}
    for mark, name in (("Explanation:", "explanation"), ("Last significant event:", "last_event")):
        for line in (text or "").split("\n"):
            if line.startswith(mark):
                out[name] = line.replace(mark, "").strip()
    return out
