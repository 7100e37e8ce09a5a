"""What a resolution run writes: evidence, pairs, scores, decisions, new identities, links, activity, reviews, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions import identifiers
from regolith.functions import similarity as S
from regolith.operators import audit
from regolith.operators.order import numbered

STRATEGY, VERSION, ENGINE = "business_embedding", "embedding-primary-v1", "cosine_similarity"
#: Items that an officer has not settled yet.
UNSETTLED = ("pending", "locked", "deferred", "escalated")
NOTE = "Embedding-primary ambiguous match. Requires officer decision."
FEATURES = ("semantic_similarity", "pan_match", "gstin_match", "address_overlap", "token_overlap", "phonetic_similarity", "fuzzy_name_similarity", "pincode_match")


def evidence(pairs: DataFrame, similarity: str = "similarity", name_variant: str = "jaccard") -> DataFrame:
    """From both sides' columns (suffix _a the new record, _b the candidate: id, name, phonetic, pincode, pan, gstin, parsed
    address) to the eight features, matched_tokens, the two conflicts and, where one holds, the guardrail's name."""
    c = F.col
    four = lambda x: F.round(x, 4)
    out = pairs.withColumns({
        "semantic_similarity": four(c(similarity)), "pan_match": S.exact(c("pan_a"), c("pan_b")), "gstin_match": S.exact(c("gstin_a"), c("gstin_b")), "pan_conflict": S.conflict(c("pan_a"), c("pan_b")), "gstin_conflict": S.conflict(c("gstin_a"), c("gstin_b")),
        "address_overlap": four(S.address_overlap(c("address_a"), c("address_b"), "jaccard")), "token_overlap": four(S.jaccard(S.tokens(c("name_a")), S.tokens(c("name_b")))), "phonetic_similarity": four(S.jaccard(S.phonetic_tokens(c("phonetic_a")), S.phonetic_tokens(c("phonetic_b")))),
        "fuzzy_name_similarity": four(S.name_similarity(c("name_a"), c("name_b"), name_variant)), "pincode_match": S.exact(c("pincode_a"), c("pincode_b")), "matched_tokens": S.shared_tokens(c("name_a"), c("name_b")),
    })
    return out.withColumn("guardrail", F.when(c("pan_conflict") | c("gstin_conflict"), "identifier_conflict_blocks_auto_match"))


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    """Both orders of a pair have one key."""
    return F.least(a, b), F.greatest(a, b)


def merge_pairs(scored: DataFrame, held: DataFrame) -> DataFrame:
    """scored: (new_id, best_id, ...); held: (pair_id, a, b). Each pair's id: the held one in either order, else a new one.

    Adds pair_id and is_new; a pair that is scored twice has one id.
    """
    low, high = pair_key(F.col("a"), F.col("b"))
    known = held.select(low.alias("_low"), high.alias("_high"), "pair_id").groupBy("_low", "_high").agg(F.min("pair_id").cast("string").alias("_held"))
    low, high = pair_key(F.col("new_id"), F.col("best_id"))
    out = scored.withColumns({"_low": low, "_high": high}).join(known.hint("merge"), ["_low", "_high"], "left")
    made = F.concat(F.lit("new:"), F.col("_low").cast("string"), F.lit("-"), F.col("_high").cast("string"))
    return out.withColumns({"pair_id": F.coalesce("_held", made), "is_new": F.col("_held").isNull()}).drop("_low", "_high", "_held")


def scores(merged: DataFrame) -> DataFrame:
    vector = F.struct(*[F.col(f).cast("double").alias(f) for f in FEATURES])
    return merged.select("pair_id", F.col("new_id").alias("record_a"), F.col("best_id").alias("record_b"), vector.alias("feature_vector"), F.col("semantic_similarity").alias("confidence_score"), F.lit(VERSION).alias("weight_version"))


def decisions(merged: DataFrame) -> DataFrame:
    kind = F.when(F.col("decision") == "auto_match", "auto_link").when(F.col("decision") == "new_ubid", "separate").otherwise(F.col("decision"))
    return merged.select("pair_id", kind.alias("decision_type"), F.lit(VERSION).alias("threshold_version"), F.col("semantic_similarity").alias("confidence_score"))


def enqueue(queue: DataFrame, merged: DataFrame) -> DataFrame:
    """The review queue (pair_id, confidence, priority, status, notes) after a run: unsettled items are refreshed (their
    priority never falls), pairs without one get a pending item, others stay."""
    fresh = merged.filter("decision = 'review_queue'").groupBy("pair_id").agg(F.max("semantic_similarity").alias("_score"))
    score = F.col("_score")
    level = F.floor(score * 100).cast("int")
    open_ = F.col("status").isin(*UNSETTLED)
    touched = queue.join(fresh.hint("merge"), "pair_id", "left")
    hit = open_ & score.isNotNull()
    kept = touched.select("pair_id", F.when(hit, score).otherwise(F.col("confidence")).alias("confidence"), F.when(hit, F.greatest(F.coalesce("priority", F.lit(0)), level)).otherwise(F.col("priority")).cast("int").alias("priority"), "status", "notes")
    new = fresh.join(queue.filter(open_).select("pair_id"), "pair_id", "left_anti").select("pair_id", score.alias("confidence"), level.alias("priority"), F.lit("pending").alias("status"), F.lit(NOTE).alias("notes"))
    return kept.unionByName(new)


def new_identities(resolved: DataFrame, records: DataFrame, issued: int, year: int = 2024) -> DataFrame:
    """(entity, ubid, pan, gstin) for each entity that a run made.

    Codes go on from the number issued, in order of the entities' names. The tax numbers are the first valid ones among
    the entity's records, in order of id. resolved: (id, entity, ...); records: (id, pan, pan_valid, gstin, gstin_valid).
    """
    own = resolved.filter("entity like 'new:%'").select("entity", "id").join(records.hint("merge"), "id", "left")
    first = lambda n: F.upper(F.min(F.when(F.col(f"{n}_valid") & (F.col(n) != ""), F.struct("id", n)))[n])
    made = own.groupBy("entity").agg(first("pan").alias("pan"), first("gstin").alias("gstin"))
    return numbered(made, ["entity"]).select("entity", identifiers.ubid_code(F.col("place") + 1 + issued, year).alias("ubid"), "pan", "gstin")


def links(resolved: DataFrame, identities: DataFrame, confidence: DataFrame, held: DataFrame) -> DataFrame:
    """(id, ubid, confidence, decision_type) for the records that a run linked: those with an entity now and no link before.

    confidence: (id, similarity); a record that another one's match linked has that match's.
    """
    named = resolved.filter("entity is not null").join(held.select("id").hint("merge"), "id", "left_anti").join(identities.select("entity", "ubid").hint("merge"), "entity", "left")
    kind = F.when(F.col("outcome") == "new_ubid", "new_ubid").otherwise("embedding_auto_match")
    return named.join(confidence.hint("merge"), "id", "left").select("id", F.coalesce("ubid", "entity").alias("ubid"), F.when(F.col("outcome") == "new_ubid", 1.0).otherwise(F.round("similarity", 4)).alias("confidence"), kind.alias("decision_type"))


def first_activity(identities: DataFrame, on_date: str) -> DataFrame:
    """New identities are Dormant with score 0 and one entry that says when they were made."""
    entry = F.struct(F.lit("system").alias("event_id"), F.lit("ubid_created").alias("event_type"), F.lit(on_date).alias("event_date"), F.lit("system").alias("source_system"), F.lit(0.0).alias("decay_weight"))
    return identities.select("ubid", F.lit("Dormant").alias("status"), F.lit(0.0).alias("score"), F.array(entry).alias("evidence_timeline"))


def audit_entries(identities: DataFrame, decided: DataFrame) -> DataFrame:
    return audit.ubid_created(identities).unionByName(audit.decision_made(decided))


def decision_events(merged: DataFrame, topic: str = "entity_resolution") -> DataFrame:
    """(topic, key, value): what a run tells other systems, as JSON."""
    body = F.to_json(F.struct("pair_id", "new_id", "best_id", "decision", "semantic_similarity"))
    return merged.select(F.lit(topic).alias("topic"), F.col("pair_id").alias("key"), body.alias("value"))


def oldest_unlinked(records: DataFrame, held: DataFrame, by: list[str], limit: int = 100) -> DataFrame:
    """The batch that a run takes: the oldest records without a link, 500 at most."""
    return records.join(held.select("id"), "id", "left_anti").orderBy(*by).limit(max(1, min(500, limit)))


def latest(records: DataFrame, by: str, limit: int = 1000) -> DataFrame:
    """The newest records: the bound of a search without an index."""
    return records.orderBy(F.desc(by), "id").limit(limit)
