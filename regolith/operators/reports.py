"""Dashboards, question templates and screens over the read-model views."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions import values as V
from regolith.operators import vectors, views
from regolith.sources.registry import INDUSTRIAL, Registry

LIST_COLUMNS = ("ubid", "business_name", "sector", "pin_code", "status", "confidence_score")


def business_list(registry: DataFrame, where, order: list, limit: int) -> DataFrame:
    return registry.filter(where).select(*LIST_COLUMNS, "pan", "gstin").orderBy(*order, "ubid").limit(limit)


def q1_pan(r: Registry, pan: str) -> DataFrame:
    return business_list(views.ubid_registry(r), F.col("pan") == pan, [F.asc("business_name")], 50)


def q2_gstin(r: Registry, gstin: str) -> DataFrame:
    return business_list(views.ubid_registry(r), F.col("gstin") == gstin, [F.asc("business_name")], 50)


def q3_stale_inspections(r: Registry, cutoff: str, statuses: tuple[str, ...], pin: str | None = None) -> DataFrame:
    """Industrial businesses whose last inspection is before the cutoff, or that have none."""
    u = views.ubid_registry(r).filter(F.col("sector").isin(*INDUSTRIAL) & F.col("status").isin(*statuses))
    if pin:
        u = u.filter(F.col("pin_code") == pin)
    last = r.events().filter("event_type = 'inspection'").groupBy("ubid").agg(F.max("event_date").alias("last_inspection"))
    return u.join(last, "ubid", "left").filter(F.col("last_inspection").isNull() | (F.col("last_inspection") < F.lit(cutoff).cast("date"))).select("ubid", "business_name", "sector", "pin_code", "status", "last_inspection")


def q4_pan_without_gstin(r: Registry) -> DataFrame:
    u = views.ubid_registry(r)
    return u.filter("pan is not null and pan <> '' and (gstin is null or gstin = '')").select("ubid", "business_name", "pan", "pin_code")


def status_summary(r: Registry, keys: tuple[str, ...], statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Counts and mean confidence (of the links' best) by keys."""
    u = views.ubid_registry(r)
    if statuses:
        u = u.filter(F.col("status").isin(*statuses))
    return u.groupBy(*keys).agg(F.count(F.lit(1)).alias("businesses"), F.round(F.avg("confidence_score"), 3).alias("avg_confidence"))


def q9_departments(r: Registry) -> DataFrame:
    """Per source: records, businesses and mean confidence of the links, most records first."""
    s = views.source_records(r)
    out = s.groupBy("source_system").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("ubid").alias("businesses"), F.count("ubid").alias("linked"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))
    return out.orderBy(F.desc("records"), "source_system")


def q10_list(r: Registry, statuses: tuple[str, ...], pin: str | None = None, limit: int = 25) -> DataFrame:
    where = F.col("status").isin(*statuses)
    if pin:
        where &= F.col("pin_code") == pin
    return business_list(views.ubid_registry(r), where, [F.desc_nulls_last("confidence_score")], limit)


def metrics(r: Registry) -> DataFrame:
    """One row; one pass over each table."""
    u = views.ubid_registry(r).agg(
        F.count(F.lit(1)).alias("ubids"), F.count_if(F.col("status") == "Active").alias("active"), F.count_if(F.col("status") == "Dormant").alias("dormant"), F.count_if(F.col("status") == "Closed").alias("closed"),
        F.count("pan").alias("with_pan"), F.count("gstin").alias("with_gstin"), F.count_if(F.col("sector").isin(*INDUSTRIAL)).alias("industrial"),
    )
    n = r.links().agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("unlinked_at").isNull()).alias("linked"))
    waiting = r.review_queue().agg(F.count_if(F.col("status").isin("pending", "locked")).alias("pending_review"))
    late = r.events().join(r.ubids().select("ubid"), "ubid", "left_anti").agg(F.count(F.lit(1)).alias("pending_events"))
    rate = F.round((1 - F.col("ubids") / F.greatest(F.col("records"), F.lit(1))) * 100, 1).alias("dedupe_rate")
    share = lambda c: F.round(V.share_of(F.col(c), F.col("ubids")), 1).alias(f"{c}_percent")
    return u.join(n, F.lit(True)).join(waiting, F.lit(True)).join(late, F.lit(True)).select("*", rate, share("active"), share("dormant"), share("closed"))


def sector_chart(r: Registry, top: int = 8) -> DataFrame:
    """Per sector: businesses by status, PIN codes, linked records and mean confidence; the largest sectors."""
    u = views.ubid_registry(r)
    cases = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Active", "Dormant", "Closed")]
    out = u.groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.count(F.lit(1)).alias("businesses"), *cases, F.countDistinct("pin_code").alias("pin_codes"), F.round(F.avg("confidence_score"), 3).alias("avg_confidence"), F.sum("record_count").alias("linked_records"))
    return out.orderBy(F.desc("businesses"), "sector").limit(top)


def cards(r: Registry, cutoff: str, default_pin: str = "560058") -> DataFrame:
    """The dashboard's three questions: (card, subject, value)."""
    u = views.ubid_registry(r).select("ubid", "pin_code", "status", "sector", "pan", "gstin")
    top = u.filter("pin_code is not null").groupBy("pin_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pin_code").limit(1).agg(F.coalesce(F.max("pin_code"), F.lit(default_pin)).alias("pin_code"))
    last = r.events().filter("event_type = 'inspection'").groupBy("ubid").agg(F.max("event_date").alias("last"))
    mine = u.filter(F.col("sector").isin(*INDUSTRIAL) & (F.col("status") == "Active")).join(top, "pin_code").join(last, "ubid", "left")
    stale = mine.agg(F.count_if(F.col("last").isNull() | (F.col("last") < F.lit(cutoff).cast("date"))).alias("value")).join(top, F.lit(True))
    gap = u.agg((F.count("pan") - F.count("gstin")).alias("value"))
    waiting = r.review_queue().agg(F.count_if(F.col("status").isin("pending", "locked")).alias("value"))
    parts = [stale.select(F.lit("stale_inspections").alias("card"), F.col("pin_code").alias("subject"), "value"), gap.select(F.lit("identifier_gap").alias("card"), F.lit("pan without gstin").alias("subject"), "value"), waiting.select(F.lit("review_queue").alias("card"), F.lit("pending").alias("subject"), "value")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def confidence_bands(r: Registry) -> DataFrame:
    band = F.when(F.col("confidence") >= 0.95, "Auto-link ready").when(F.col("confidence") >= 0.75, "Human review band").otherwise("Keep separate")
    return r.links().filter("unlinked_at is null").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("links"))


def coverage(r: Registry) -> DataFrame:
    """Per source: records, linked records and mean confidence."""
    s = views.source_records(r)
    return s.groupBy("source_system").agg(F.count(F.lit(1)).alias("records"), F.count("ubid").alias("linked"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))


def hotspots(r: Registry) -> DataFrame:
    u = views.ubid_registry(r)
    cases = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Active", "Dormant", "Closed")]
    return u.groupBy("pin_code").agg(F.count(F.lit(1)).alias("businesses"), *cases).orderBy(F.desc("businesses"), F.asc_nulls_first("pin_code")).limit(8)


def raw_page(r: Registry, source: str | None = None, sector: str | None = None, linked: bool | None = None, q: str | None = None, limit: int = 25, offset: int = 0) -> DataFrame:
    s = views.source_records(r)
    tests = [
        F.col("source_system") == source if source else None, F.col("sector") == sector if sector else None,
        None if linked is None else F.col("ubid").isNotNull() if linked else F.col("ubid").isNull(),
        F.col("raw_name").ilike(f"%{q}%") if q else None,
    ]
    for t in tests:
        s = s if t is None else s.filter(t)
    return s.orderBy(F.desc("extracted_at"), "raw_id").offset(offset).limit(limit)


#: Other names of sources.
SOURCE_ALIASES = {"labour": "labor", "kspcb": "pollution", "commercial_tax": "tax"}
SORTS = {"newest": (F.desc, "extracted_at"), "oldest": (F.asc, "extracted_at"), "confidence": (F.desc, "known_confidence", "extracted_at"), "name": (F.asc, "shown_name")}


def screen(r: Registry, source: str | None = None, sector: str | None = None, status: str | None = None, linked: bool | None = None, identifier: str | None = None, pincode: str | None = None, q: str | None = None) -> DataFrame:
    """The raw records that all given filters leave. identifier: pan, gstin, missing_pan or missing_gstin; q is looked for
    in six columns, whatever its case, with % and _ as wildcards; a status of Unlinked means records without one."""
    w = views.wide_records(r).join(views.ubid_activity(r).select("ubid", "status"), "ubid", "left")
    c = F.col
    w = w.withColumns({"shown_name": F.coalesce("raw_name", "normalized_name", F.lit("")), "known_confidence": F.coalesce("confidence", F.lit(0.0)), "ubid_code": F.when(c("ubid").isNotNull(), views.code(c("ubid")))})
    held = lambda n: c(n).isNotNull() & (c(n) != "")
    tests = []
    if source:
        tests.append(c("source_system") == SOURCE_ALIASES.get(source, source))
    if sector:
        tests.append(F.coalesce("sector", F.lit("Unknown")) == sector)
    if status:
        tests.append(F.coalesce("status", F.lit("Unlinked")) == status)
    if linked is not None:
        tests.append(c("ubid").isNotNull() if linked else c("ubid").isNull())
    if identifier:
        name = identifier.removeprefix("missing_")
        if name not in ("pan", "gstin"):
            raise ValueError(f"unknown identifier filter: {identifier}")
        tests.append(~F.coalesce(held(name), F.lit(False)) if identifier.startswith("missing_") else held(name))
    if pincode:
        tests.append(c("pincode") == pincode)
    if q:
        like = f"%{q.strip()}%"
        columns = ("source_record_id", "shown_name", "raw_address", "pan", "gstin", "ubid_code")
        tests.append(reduce(or_, [F.coalesce(c(n), F.lit("")).ilike(like) for n in columns]))
    return reduce(lambda df, t: df.filter(t), tests, w)


def screen_page(records: DataFrame, sort: str = "newest", limit: int = 25, offset: int = 0) -> DataFrame:
    """A page as it is shown; unknown sort modes mean newest. 200 rows at most."""
    way, *keys = SORTS.get(sort, SORTS["newest"])
    page = records.orderBy(*[way(k) for k in keys], "raw_id").offset(max(0, offset)).limit(max(1, min(200, limit)))
    c = F.col
    return page.select(
        c("source_record_id").alias("id"), c("source_system").alias("source"), F.when(c("shown_name") != "", c("shown_name")).otherwise("Unknown").alias("name"), F.coalesce(V.first_value(c("raw_address"), c("pincode")), F.lit("N/A")).alias("address"),
        F.coalesce("pan", F.lit("N/A")).alias("pan"), F.coalesce("gstin", F.lit("N/A")).alias("gstin"), F.coalesce("sector", F.lit("Unknown")).alias("sector"), F.coalesce("pincode", F.lit("N/A")).alias("pincode"), c("ubid_code").alias("ubid"),
        F.coalesce("status", F.lit("Unlinked")).alias("status"), c("ubid").isNotNull().alias("linked"), F.bround(c("confidence") * 100).cast("int").alias("confidence"), F.coalesce("decision_type", F.lit("Unlinked")).alias("decision_type"), V.date_text(c("extracted_at")).alias("date"),
    )


def screen_summary(records: DataFrame) -> DataFrame:
    """Total and counts of what the filters leave; records without a link count with confidence 0 in the mean."""
    n = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return records.agg(F.count(F.lit(1)).alias("total"), n("ubid").alias("linked"), F.count_if(F.col("ubid").isNull()).alias("unlinked"), n("pan").alias("with_pan"), n("gstin").alias("with_gstin"), F.bround(F.round(F.avg("known_confidence"), 3) * 100).cast("int").alias("avg_confidence"))


def facets(r: Registry, top_pins: int = 25) -> DataFrame:
    """Counts of each value of four columns over all records, in one pass: (facet, value, records); the 25 largest PIN codes."""
    s = views.source_records(r).join(views.ubid_activity(r).select("ubid", "status"), "ubid", "left")
    unknown = lambda c: F.coalesce(c, F.lit("Unknown"))
    value = {"source": F.col("source_system"), "sector": unknown("sector"), "pincode": unknown("pincode"), "status": F.coalesce("status", F.lit("Unlinked"))}
    rows = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in value.items()])).alias("f")).select("f.*")
    counts = rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("records"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("records"), "value"))
    return counts.withColumn("place", place).filter((F.col("facet") != "pincode") | (F.col("place") <= top_pins)).drop("place")


DIRECTORY_SORTS = ("business_name", "status", "sector", "confidence_score", "created_on")


def directory(r: Registry, search: str | None = None, status: str | None = None, sector: str | None = None, has_pan: bool | None = None, has_gstin: bool | None = None, sort: str = "business_name", descending: bool = False) -> DataFrame:
    """The businesses that all given filters leave, in order; unknown sort columns mean the name."""
    u = views.ubid_registry(r)
    held = lambda n: F.coalesce(F.col(n) != "", F.lit(False))
    if search:
        u = u.filter(reduce(or_, [F.coalesce(c, F.lit("")).ilike(f"%{search}%") for c in (F.col("business_name"), views.code(F.col("ubid")), F.col("pan"), F.col("gstin"))]))
    if status:
        u = u.filter(F.col("status") == status)
    if sector:
        u = u.filter(F.col("sector") == sector)
    for name, want in (("pan", has_pan), ("gstin", has_gstin)):
        if want is not None:
            u = u.filter(held(name) if want else ~held(name))
    key = F.col(sort if sort in DIRECTORY_SORTS else "business_name")
    return u.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "ubid")


def directory_page(found: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """A page of 100 rows at most, with its number."""
    limit = max(1, min(100, limit))
    page = found.offset(max(0, offset)).limit(limit)
    return page.select("ubid", "business_name", "status", "sector", "pin_code", F.col("pan").alias("pan_anchor"), F.col("gstin").alias("gstin_anchor"), "confidence_score", F.col("created_on").cast("string").alias("assigned_on"), F.col("record_count").alias("linked_record_count"), F.lit(max(0, offset) // limit + 1).alias("page"))


def export_csv(businesses: DataFrame, path: str) -> None:
    """The directory as CSV with the screen's nine headings; values with commas or quotes are quoted."""
    known = lambda n: F.coalesce(V.first_value(F.col(n)), F.lit("N/A"))
    out = businesses.select(
        F.col("ubid").alias("UBID"), F.col("business_name").alias("Business Name"), F.col("status").alias("Status"), F.col("sector").alias("Sector"), known("pan_anchor").alias("PAN"), known("gstin_anchor").alias("GSTIN"), known("pin_code").alias("Pin Code"),
        F.col("linked_record_count").alias("Linked Records"), F.col("confidence_score").alias("Confidence"),
    )
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def unlinked(r: Registry) -> DataFrame:
    """Why records have no link: one row of counts.

    single_pan: tax numbers that exactly one of the unlinked records has; no_pan: unlinked records without one; separated:
    unlinked records of a pair that was decided to be two businesses (either side of it); other: the rest, 0 at least.
    """
    current = r.links().filter("unlinked_at is null").select("raw_id")
    lost = r.identifiers().select("raw_id", "pan").join(current, "raw_id", "left_anti")
    has = F.coalesce(F.col("pan") != "", F.lit(False))
    n = lost.agg(F.count(F.lit(1)).alias("total"), F.count_if(~has).alias("no_pan"))
    single = lost.filter(has).groupBy("pan").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") == 1).alias("single_pan"))
    sides = r.pairs().filter("decision_type = 'separate'").select(F.explode(F.array("a", "b")).alias("raw_id")).distinct()
    apart = lost.join(sides, "raw_id", "left_semi").agg(F.count(F.lit(1)).alias("separated"))
    rest = F.greatest(F.lit(0), F.col("total") - F.col("single_pan") - F.col("no_pan") - F.col("separated")).alias("other")
    return n.join(single, F.lit(True)).join(apart, F.lit(True)).select("total", "single_pan", "no_pan", "separated", rest)  # one row each


def map_points(r: Registry, centroids: DataFrame, limit: int = 500) -> DataFrame:
    """Points of linked businesses: the mean place of their records, else their PIN's centroid (without either, no point),
    moved on a small grid so that points don't lie on each other. `centroids` is a fixed dictionary of a few dozen rows."""
    w = views.wide_records(r).filter("ubid is not null").groupBy("ubid").agg(F.min("normalized_name").alias("name"), F.min("pincode").alias("pin_code"), F.avg("latitude").alias("own_lat"), F.avg("longitude").alias("own_lng"))
    u = views.ubid_activity(r).select("ubid", "status").join(w, "ubid").orderBy("ubid").limit(limit)
    u = u.withColumn("i", F.row_number().over(Window.orderBy("ubid")) - 1).join(centroids, "pin_code", "left")  # limited rows
    own = F.col("own_lat").isNotNull() & F.col("own_lng").isNotNull()
    lat, lng = (F.when(own, F.col(f"own_{c}")).otherwise(F.col(c)) for c in ("lat", "lng"))
    u = u.withColumns({"lat": lat + (F.col("i") % 9 - 4) * F.lit(0.0015), "lng": lng + (F.floor(F.col("i") / 9) % 9 - 4) * F.lit(0.0015)}).filter("lat is not null and lng is not null")
    return u.select("ubid", F.coalesce("name", F.lit("Unknown Business")).alias("business_name"), F.coalesce("status", F.lit("Unknown")).alias("status"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def identity_timeline(r: Registry) -> DataFrame:
    """Events and links of each identity as one stream of entries."""
    e = r.events().select("ubid", F.col("event_date").alias("on_date"), F.col("event_type").alias("what"), F.col("event_id").alias("ref"))
    k = r.links().filter("unlinked_at is null").select("ubid", F.to_date("linked_at").alias("on_date"), F.lit("record_linked").alias("what"), F.col("raw_id").alias("ref"))
    return e.unionByName(k)


def lookup(r: Registry, text: str, limit: int = 25) -> DataFrame:
    """Records whose identifier is the text, then those whose name has it."""
    s = views.source_records(r)
    exact = F.col("raw_id").cast("string") == text
    found = s.filter(exact | F.col("raw_name").ilike(f"%{text}%"))
    return found.orderBy(F.when(exact, 0).otherwise(1), F.desc("extracted_at"), "raw_id").limit(limit).select("raw_id", "source_system", "raw_name", "ubid", "confidence")


def record_summary(r: Registry) -> DataFrame:
    s = views.source_records(r).join(r.ubids().select("ubid", "pan", "gstin"), "ubid", "left")
    return s.agg(F.count(F.lit(1)).alias("total"), F.count("ubid").alias("linked"), F.count_if(F.col("ubid").isNull()).alias("unlinked"), F.count("pan").alias("with_pan"), F.count("gstin").alias("with_gstin"), F.round(F.avg("confidence") * 100, 2).alias("avg_confidence"))


def semantic_search(query: DataFrame, base: DataFrame, k: int = 10, above: float = 0.75) -> DataFrame:
    """The k nearest, and of them those above the threshold: in this order."""
    return vectors.nearest(query, base, k).filter(F.col("similarity") > above)
