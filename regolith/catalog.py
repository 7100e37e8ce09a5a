"""Registered queries of the registry engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from regolith import catalog_records, oracles, oracles_records
from regolith.functions import embedding, identifiers, similarity, text
from regolith.operators import graph, linkage, readmodel, reports, review, training, vectors, views
from regolith.plans import gate, questions
from regolith.sources.registry import INDUSTRIAL, Registry
from regolith.streaming import activity as stream_activity


def _registry(build):
    def run(spark, sf_dir):
        df = build(Registry(spark, sf_dir, stored=readmodel.stored))
        return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

    return run


def pseudonyms(r: Registry):
    return r.table("customer").select("c_custkey", identifiers.pseudonym_name(F.col("c_name")).alias("biz"))


def codes(r: Registry):
    return r.table("customer").select("c_custkey", identifiers.ubid_code(F.col("c_custkey")).alias("code"))


def token_similarity(r: Registry):
    """Parts against the part of the same brand 25 keys on."""
    p = r.table("part").select("p_partkey", "p_brand", similarity.tokens(F.col("p_name")).alias("t"))
    a = p.select(F.col("p_partkey").alias("a"), F.col("p_brand"), F.col("t").alias("x"), (F.col("p_partkey") + 25).alias("b"))
    b = p.select(F.col("p_partkey").alias("b"), F.col("p_brand"), F.col("t").alias("y"))
    return a.join(b, ["b", "p_brand"]).select("a", "b", similarity.jaccard(F.col("x"), F.col("y")).alias("jaccard"), similarity.dice(F.col("x"), F.col("y")).alias("dice"))


def part_records(r: Registry):
    """Parts as records to link: names recur, brands stand for areas. Each is normalised once; what follows reads the result."""
    k = F.col("p_partkey")
    pan = F.concat(F.lit("ABCPK"), F.lpad((k % 700).cast("string"), 4, "0"), F.lit("F"))
    p = r.table("part").select(
        F.lpad(k.cast("string"), 12, "0").alias("id"), text.normalize_name(F.concat_ws(" ", "p_name", "p_brand")).alias("name"), F.concat(F.lit("5600"), F.lpad((k % 40).cast("string"), 2, "0")).alias("pincode"),
        F.when(k % 3 == 0, pan).alias("pan"), F.lit(None).cast("string").alias("gstin"), text.parse_address(F.concat(F.lit("Plot "), (k % 30).cast("string"), F.lit(", "), F.col("p_type"), F.lit(" Road"))).alias("address"),
    )
    p = p.withColumns({"phonetic": text.phonetic(F.col("name")), "pan_valid": identifiers.pan_ok(F.col("pan")), "gstin_valid": F.lit(False), "embedding": embedding.hashed(F.col("name"), 16)})
    return graph.cut(p)


def blocking(r: Registry):
    return linkage.candidate_pairs(part_records(r))


def left_out(r: Registry):
    """Records beyond their buckets' caps, which are part of the blocking."""
    return linkage.left_out(part_records(r), linkage.strategies())


def scores(r: Registry):
    p = part_records(r)
    one = graph.cut(linkage.prepared(p.drop("pan_valid", "gstin_valid")))
    side = lambda s: one.select([F.col(c).alias(f"{c}_{s}") for c in one.columns])
    pairs = linkage.candidate_pairs(p).join(side("a").hint("merge"), F.col("a") == F.col("id_a")).join(side("b").hint("merge"), F.col("b") == F.col("id_b"))
    out = linkage.score_pairs(pairs).withColumn("name_share", F.col("evidence.contributions.name_similarity"))
    return out.select("a", "b", "strategy", F.round("embedding_similarity", 4).alias("embedding_similarity"), "name_similarity", F.round("phonetic_match", 6).alias("phonetic_match"), "address_overlap", "name_share", "score", "conflict", "decision", "reason")


def evidence(r: Registry):
    e = review.evidence(catalog_records.review_pairs(r).filter(F.col("status").isin(*review.OPEN)))
    text = {c: F.array_join(c, " ") for c in ("signals", "cautions", "shared_tokens")}
    return e.withColumns(text).select("id", "name_overlap", "address_overlap", "shared_tokens", "same_pan", "same_gstin", "same_pincode", "same_sector", "band", "signals", "cautions", "recommendation", "summary")


def trained_weights(r: Registry):
    """Weights of the evidence for what reviewers decided, here by a rule on the pair."""
    names = ("name_overlap", "address_overlap", "same_pan", "same_gstin", "same_pincode")
    e = review.evidence(catalog_records.review_pairs(r)).withColumn("label", (F.col("same_pan") & (F.col("id") % 10 > 0)).cast("int"))
    found = training.train(e.select("id", "label", *names), names, least=50)
    rows = [(n, w, found["precision"], found["recall"]) for n, w in found["weights"].items()] if found else []
    return r.spark.createDataFrame(rows, "feature string, weight double, precision double, recall double")


def asked_vectors(r: Registry):
    return r.vectors().filter("id % 20 = 0")


def cosine_top(r: Registry):
    return vectors.nearest(asked_vectors(r), r.vectors()).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def routing(r: Registry):
    best = vectors.nearest(asked_vectors(r), r.vectors(), 1)
    return best.select("query_id", F.col("id").alias("best_id"), graph.route(F.col("similarity"), F.col("query_id") % 7 == 0, 0.40, 0.30).alias("decision"))


def resolution(r: Registry):
    """Every twentieth vector in turn; every other tenth has an entity before."""
    best = routing(r).select(F.col("query_id").alias("seq"), F.col("query_id").alias("id"), "best_id", "decision")
    linked = r.vectors().filter("id % 20 = 10").select("id", F.concat(F.lit("E"), F.col("id").cast("string")).alias("entity"))
    return graph.resolve(best, linked)


def streamed_activity(r: Registry):
    """The events table as a stream, classified from decayed sums."""
    stream = r.spark.readStream.schema(r.table("events").schema).parquet(f"{r.dir}/event[s].parquet")  # a pattern, as a stream's plain path must be a folder
    sums = stream_activity.drain(stream_activity.decayed_sums(r.events(stream), r.taxonomy(), "2024-01-01"), "activity")
    return stream_activity.classify_sums(sums, r.ubids(), r.taxonomy(), "2024-01-01", views.REFERENCE_DATE)


def map_points(r: Registry):
    n = F.col("n_nationkey")
    centroids = r.table("nation").select((n + 560000).cast("string").alias("pin_code"), (F.lit(12.9) + n * F.lit(0.01)).alias("lat"), (F.lit(77.5) + n * F.lit(0.01)).alias("lng"))
    return reports.map_points(r, centroids)


def governed(r: Registry):
    views.create_views(r)
    return gate.run(r.spark, "SELECT u.pincode AS pin_code, COUNT(*) AS businesses FROM ubid_registry u WHERE u.sector LIKE '%factory%' GROUP BY u.pincode;", INDUSTRIAL)


def queries() -> dict:
    found = {
        "v_registry": views.computed_registry, "v_source_records": views.source_records, "v_activity_events": views.activity_events, "d14_activity": views.ubid_activity,
        "q1_pan": lambda r: reports.q1_pan(r, "ABCPK0042F"), "q2_gstin": lambda r: reports.q2_gstin(r, "29ABCPK0042F1Z5"), "q3_stale_inspections": lambda r: reports.q3_stale_inspections(r, "2024-01-25", ("Active", "Dormant")),
        "q4_pan_without_gstin": reports.q4_pan_without_gstin, "q6_status_by_pin": lambda r: reports.status_summary(r, ("pin_code",), ("Active",)), "q7_status_by_sector": lambda r: reports.status_summary(r, ("sector",), ("Closed", "Dormant")),
        "q8_sector_status": lambda r: reports.status_summary(r, ("sector", "status")), "q9_departments": reports.q9_departments, "q10_list": lambda r: reports.q10_list(r, ("Active",)),
        "r1_metrics": reports.metrics, "r1_bands": reports.confidence_bands, "r1_coverage": reports.coverage, "r1_hotspots": reports.hotspots,
        "r3_page": lambda r: reports.raw_page(r, source="tax", linked=True, q="customer 1", limit=25, offset=25), "r3_facets": reports.facets,
        "r9_unlinked": reports.unlinked,
        "f_pseudonym": pseudonyms, "f_ubid_code": codes, "s_jaccard": token_similarity, "d1_blocking": blocking, "d1_left_out": left_out, "d2_scores": scores,
        "q5_review": lambda r: review.open_items(r.review_queue()), "d15_evidence": evidence, "d17_queue": lambda r: review.decided_queue(r.review_queue(), r.review_actions()).select("id", "status"),
        "d17_links": lambda r: review.apply(r.review_queue(), r.review_actions(), r.review_links()), "d17_audit": lambda r: review.audit(r.review_actions(), r.review_queue()).drop("after_state"), "d19_weights": trained_weights, "d20_labels": lambda r: review.labels(r.review_queue(), r.review_actions()),
        "s_cosine_topk": cosine_top, "d5_routing": routing, "d7_resolution": resolution, "q14_hints": questions.hints, "q20_governed": governed, "r2_map": map_points, "r3_summary": reports.record_summary,
        "r6_lookup": lambda r: reports.lookup(r, "42"), "t7_streamed_activity": streamed_activity,
        "q21_answer": lambda r: questions.Engine(r, views.REFERENCE_DATE).rows("How many active businesses are there in each area?")[1],
    }
    return {k: _registry(f) for k, f in (found | catalog_records.queries()).items()}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | oracles_records.oracle_sql()
