"""Pairs under review: queue, evidence, summary, and reviewers' decisions applied as a batch."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions import values
from regolith.operators.graph import resolve_first

OPEN = ("pending", "locked")
# Bands by least score, and the decisions that a reviewer may take.
BANDS = ((0.85, "Good match"), (0.70, "Needs officer check"), (0.55, "Needs more proof"))
DECISIONS = ("confirm_match", "confirm_non_match", "defer")
LOWEST_BAND, SAME_BAND = "Likely separate", "Likely same, verify"
ACTIVE_FROM = 0.9


def band(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return reduce(lambda out, b: F.when(s >= b[0], b[1]).otherwise(out), reversed(BANDS), F.lit(LOWEST_BAND))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]+"), lambda t: t != ""))


def overlap(a: Column, b: Column) -> Column:
    """Shared of all words, in whole per cent."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.bround(F.size(F.array_intersect(a, b)) / every * 100)).otherwise(0.0).cast("int")


def _present(c: Column, missing: str = "N/A") -> Column:
    return F.coalesce(~c.isin("", missing), F.lit(False))


def _same(name: str, missing: str = "N/A") -> Column:
    a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
    return F.coalesce(_present(a, missing) & (a == b), F.lit(False))


def _said(*choices: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in choices]), lambda x: x.isNotNull())


def evidence(pairs: DataFrame) -> DataFrame:
    """From name, address, pan, gstin, pincode and sector of both sides (suffix _a, _b) and confidence to the reviewer's evidence.

    Adds name_overlap, address_overlap, shared_tokens, the four matches, band, signals, cautions, recommendation, summary.
    """
    words = {f"_{n}{s}": token_set(F.col(f"{n}{s}")) for n in ("name", "address") for s in ("_a", "_b")}
    out = pairs.withColumns(words).withColumns({
        "name_overlap": overlap(F.col("_name_a"), F.col("_name_b")), "address_overlap": overlap(F.col("_address_a"), F.col("_address_b")),
        "shared_tokens": F.array_sort(F.array_intersect("_name_a", "_name_b")),
        "same_pan": _same("pan"), "same_gstin": _same("gstin"), "same_pincode": _same("pincode"), "same_sector": _same("sector", "Unknown"),
    }).drop(*words)
    pan, gstin, pin, sector, name, address = (F.col(c) for c in ("same_pan", "same_gstin", "same_pincode", "same_sector", "name_overlap", "address_overlap"))
    both = lambda n: _present(F.col(f"{n}_a")) & _present(F.col(f"{n}_b"))
    strong = pan & pin & (name >= 70)
    # The sentences of the reviewers' screen, as its readers know them.
    signals = _said(
        (pan, "Same PAN is present in both records."), (gstin, "Same GSTIN is present in both records."), (name >= 70, "Business names look very similar."), (pin, "PIN code matches."), (sector, "Business type matches."),
    )
    cautions = _said(
        (~pan & both("pan"), "PAN values are different. Keep separate unless a senior officer approves."), (~pan & ~both("pan"), "PAN is missing on at least one record."),
        (~gstin & both("gstin"), "GSTIN values differ."), (~gstin & ~both("gstin"), "GSTIN is missing, so verify using other documents."),
        (name < 70, "Business names are not very similar."), (address < 40, "Addresses are not a strong match."), (~pin, "PIN code does not match or is missing."), (~sector, "Business type differs or is unavailable."),
    )
    for_it = _said((pan, "same PAN"), (pin, "same PIN code"), (sector, "same business type"), (name >= 80, "very similar business name"), ((name >= 50) & (name < 80), "partly similar business name"))
    against = _said((address < 40, "addresses do not fully match"), (~both("gstin"), "GSTIN is missing"))
    listed = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(none)
    action = F.when(strong & (F.coalesce("confidence", F.lit(0.0)) >= 0.6), "approve if documents look genuine").otherwise("keep separate unless more proof is available")
    return out.withColumns({
        "band": F.when(strong, SAME_BAND).otherwise(band(F.col("confidence"))), "signals": signals, "cautions": cautions, "recommendation": F.when(strong, "approve").otherwise("separate"),
        "summary": F.concat(F.lit("These records show "), listed(for_it, "limited matching information"), F.lit(". Please note: "), listed(against, "no major warning sign is visible"), F.lit(". Recommended action: "), action, F.lit(".")),
    })


def feature_scores(e: DataFrame) -> DataFrame:
    """Adds the scores that the reviewer sees, as (label, value, tone), without those that have no value.

    e: evidence's rows; columns name_score and address_score, if there, are the model's and come before the words' overlap.
    """
    score = lambda c, words: values.percent(F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.col(words)) if c in e.columns else F.col(words))
    tone = lambda words, least: F.when(F.col(words) >= least, "success").otherwise("warning")
    rows = [("Model confidence", values.percent(F.col("confidence")), F.lit("warning")), ("Name model score", score("name_score", "name_overlap"), tone("name_overlap", 70)), ("Address overlap", score("address_score", "address_overlap"), tone("address_overlap", 50))]
    shown = F.array(*[F.struct(F.lit(label).alias("label"), value.alias("value"), t.alias("tone")) for label, value, t in rows])
    return e.withColumn("feature_scores", F.filter(shown, lambda x: x["value"].isNotNull()))


def screen(pairs: DataFrame, status: str = "pending", limit: int = 100) -> DataFrame:
    """The reviewer's list: pending items with their evidence, the most urgent first, then the oldest."""
    first = pairs.filter(F.col("status") == status).orderBy(F.desc("priority"), F.asc_nulls_first("queued_at"), "id").limit(limit)
    recommended = F.when(F.col("same_pan") & F.col("same_pincode") & (F.col("name_overlap") >= 70), "approve").otherwise("keep_separate")
    return feature_scores(evidence(first)).withColumns({"confidence_percent": values.percent(F.col("confidence")), "recommendation": recommended, "queued_at": values.date_text(F.col("queued_at"))})


def item(pairs: DataFrame, queue_id, written: str | None = None) -> DataFrame:
    """One item's summary and recommendation (no row for an unknown id): the rules', or a text written elsewhere, which may
    itself recommend to approve."""
    e = evidence(pairs.filter(F.col("id") == queue_id).limit(1))
    strong = F.col("same_pan") & F.col("same_pincode") & (F.col("name_overlap") >= 70)
    summary = F.lit(written) if written else F.col("summary")
    approve = (F.lower(summary).contains("approve") | strong) if written else strong
    return e.select("id", summary.alias("summary"), F.when(approve, "approve").otherwise("keep_separate").alias("recommendation"), F.lit("written" if written else "rule_summary").alias("source"))


def context(pairs: DataFrame) -> DataFrame:
    """What a reviewer gets of a pair: both records, the scores, the matches. pairs has an embedding evidence's columns."""
    side = lambda s: F.struct(*[F.col(f"{n}_{s}").alias(n) for n in ("name", "pan", "gstin", "pincode", "address") if f"{n}_{s}" in pairs.columns])
    return pairs.select(
        side("a").alias("record_a"), side("b").alias("record_b"),
        F.struct(F.col("semantic_similarity").alias("semantic_embedding"), "token_overlap", F.col("fuzzy_name_similarity").alias("fuzzy_name"), "address_overlap").alias("similarity_scores"), F.struct("pan_match", "gstin_match", "pincode_match").alias("identifier_matches"), "matched_tokens",
    )


def training_examples(pairs: DataFrame, decided: DataFrame) -> DataFrame:
    """Evidence of decided pairs with the label for training: (id, the features, reviewer_decision, label)."""
    d = pairs.join(latest(decided).filter("decision <> 'defer'"), "id")
    return d.select("id", "semantic_similarity", "token_overlap", "fuzzy_name_similarity", "address_overlap", "pan_match", "gstin_match", "pincode_match", F.col("decision").alias("reviewer_decision"), (F.col("decision") == "confirm_match").cast("int").alias("label"))


def lock(queue: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items that reviewers take: (id, reviewer, at); a pending item is locked by the first of them, others stay."""
    first = wanted.groupBy("id").agg(F.min(F.struct("at", "reviewer")).alias("by"))
    out = queue.join(first, "id", "left")
    taken = (F.col("status") == "pending") & F.col("by").isNotNull()
    return out.withColumns({"status": F.when(taken, "locked").otherwise(F.col("status")), "locked_by": F.when(taken, F.col("by.reviewer"))}).drop("by")


def unlinked_by(links: DataFrame, after: DataFrame, on_date: str) -> DataFrame:
    """Links that a review ends: those of its records to another entity than they have now, with the date."""
    now = after.filter("decision_type = 'reviewer_approved'").select("record", F.col("entity").alias("_now"))
    return links.join(now, "record").filter(F.col("entity") != F.col("_now")).select("record", "entity", F.lit(on_date).alias("unlinked_at"))


def decision_rows(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """The decisions table after a batch: one row per item, whatever was decided before."""
    d = queue.join(latest(actions), "id")
    kind = F.when(F.col("decision") == "confirm_match", "auto_link").when(F.col("decision") == "confirm_non_match", "separate").otherwise("review_queue")
    return d.select("id", "record_a", "record_b", kind.alias("decision_type"), "decision", "confidence")


def open_items(queue: DataFrame, limit: int = 50) -> DataFrame:
    return queue.filter(F.col("status").isin(*OPEN)).select("id", "confidence", "priority", "status", "queued_at").orderBy(F.desc("priority"), F.asc_nulls_first("queued_at"), "id").limit(limit)


def latest(actions: DataFrame) -> DataFrame:
    """One valid decision per item: the last one (seq, then decision)."""
    known = actions.filter(F.col("decision").isin(*DECISIONS))
    return known.groupBy("id").agg(F.max_by("decision", F.struct("seq", "decision")).alias("decision"))


def decided_queue(queue: DataFrame, actions: DataFrame) -> DataFrame:
    out = queue.join(latest(actions), "id", "left")
    status = F.when(F.col("decision") == "defer", "deferred").when(F.col("decision").isNotNull(), "resolved").otherwise(F.col("status"))
    return out.withColumn("status", status)


def labels(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """Training labels of the decided pairs."""
    d = queue.join(latest(actions).filter("decision <> 'defer'"), "id")
    match = F.col("decision") == "confirm_match"
    return d.select("id", F.col("record_a"), F.col("record_b"), match.cast("int").alias("label"), F.when(match, "auto_link").otherwise("separate").alias("decision_type"))


def apply(queue: DataFrame, actions: DataFrame, links: DataFrame) -> DataFrame:
    """Links after a batch of decisions: (record, entity, decision_type, confidence); links: record, entity, linked_at.

    Confirmed pairs join the entity of their earliest linked record; without one, a new entity is named after the
    smallest record. Confirmed pairs that share a record are one group, whose entity is that of its smallest linked
    record. Records of pairs kept apart get an entity of their own if they have none. Others stay as they are.
    """
    d = queue.join(latest(actions), "id")
    merged = d.filter("decision = 'confirm_match'")
    groups = resolve_first(merged.select(F.col("record_a").alias("a"), F.col("record_b").alias("b")))
    conf = merged.select(F.explode(F.array("record_a", "record_b")).alias("record"), "confidence").groupBy("record").agg(F.max("confidence").alias("confidence"))
    held = groups.join(links.select("record", "entity", "linked_at"), "record", "left")
    entity = held.groupBy("group").agg(F.min(F.when(F.col("entity").isNotNull(), F.struct("linked_at", "record", "entity"))).alias("first"))
    entity = entity.select("group", F.coalesce(F.col("first.entity"), F.concat(F.lit("new:"), F.col("group").cast("string"))).alias("entity"))
    joined = groups.join(entity, "group").join(conf, "record").select("record", "entity", F.lit("reviewer_approved").alias("decision_type"), "confidence")
    apart = d.filter("decision = 'confirm_non_match'").select(F.explode(F.array("record_a", "record_b")).alias("record")).distinct()
    apart = apart.join(links.select("record"), "record", "left_anti").join(groups.select("record"), "record", "left_anti")
    single = apart.select("record", F.concat(F.lit("new:"), F.col("record").cast("string")).alias("entity"), F.lit("reviewer_separate").alias("decision_type"), F.lit(1.0).alias("confidence"))
    kept = links.join(groups.select("record"), "record", "left_anti").select("record", "entity", F.lit("kept").alias("decision_type"), F.lit(None).cast("double").alias("confidence"))
    return joined.unionByName(single).unionByName(kept)


def activity_after(activity: DataFrame, merged: DataFrame, keep_status: bool = False) -> DataFrame:
    """Status and score of entities that a review touched: the score is the larger, Active from 0.9 (keep_status: an existing status stays)."""
    top = merged.groupBy("entity").agg(F.max("confidence").alias("c"))
    out = activity.join(top, "entity", "full")
    score = F.when(F.col("c").isNull(), F.col("score")).otherwise(F.greatest(F.coalesce("score", F.lit(0.0)), "c"))
    fresh = F.when(score >= ACTIVE_FROM, "Active").otherwise("Dormant")
    status = F.when(F.col("c").isNull() | (F.lit(keep_status) & F.col("status").isNotNull()), F.col("status")).otherwise(fresh)
    return out.select("entity", status.alias("status"), score.alias("score"))


def audit(actions: DataFrame, queue: DataFrame) -> DataFrame:
    """An entry per decision that counts, in the shape of the audit log."""
    d = queue.join(latest(actions).filter("decision <> 'defer'"), "id")
    match = F.col("decision") == "confirm_match"
    return d.select(
        F.when(match, "review_merge_approved").otherwise("review_pair_kept_separate").alias("action"), F.when(match, "ubid").otherwise("candidate_pair").alias("entity_type"), F.col("id").cast("string").alias("entity_id"),
        F.to_json(F.struct("record_a", "record_b", "decision")).alias("after_state"),
    )


def reviewer(value: Column) -> Column:
    name = F.trim(value)
    return F.substring(F.when(F.coalesce(name, F.lit("")) == "", "system").otherwise(name), 1, 100)


def parse_verdict(text: str) -> dict:
    """Confidence and verdict of a written review; null where it has none."""
    number = re.search(r"confidence\D{0,20}(\d+(?:\.\d+)?)", text or "", re.I)
    kind = re.search(r"\bnon[- ]match\b|\bmatch\b", text or "", re.I)
    return {"confidence": float(number[1]) if number else None, "verdict": None if not kind else "NON-MATCH" if kind[0].lower().startswith("non") else "MATCH"}


def verdict(text: Column) -> Column:
    """struct(confidence, verdict) of written reviews, as parse_verdict has them of one."""
    number = F.regexp_extract(text, r"(?i)confidence\D{0,20}(\d+(?:\.\d+)?)", 1)
    kind = F.upper(F.regexp_extract(text, r"(?i)\b(non)[- ]match\b|\bmatch\b", 0))
    return F.struct(F.when(number != "", number).cast("double").alias("confidence"), F.when(kind == "", None).when(kind.startswith("NON"), "NON-MATCH").otherwise(F.when(kind.isNotNull(), "MATCH")).alias("verdict"))
