"""Blocking, scoring and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions import similarity as S
from regolith.functions import text as T
from regolith.operators.graph import cut
from regolith.operators.order import numbered

#: Strategy, bucket cap; the first strategy to emit a pair names it.
CAPS = (("pan_exact", 100), ("gstin_exact", 100), ("pincode_name", 30), ("phonetic", 25))
NEIGHBOURS = 5
#: Parts of a bucket that are looked through apart.
SALTS = 16
#: Fixed weights and thresholds.
WEIGHTS = {"pan_gstin_match": 0.5, "embedding_similarity": 0.2, "name_similarity": 0.1, "address_overlap": 0.1, "phonetic_match": 0.05, "pincode_match": 0.05}
AUTO_LINK, REVIEW, CONFLICT_CAP = 0.92, 0.75, 0.40


def bucket_pairs(records: DataFrame, keys: dict[str, tuple[Column, int]]) -> DataFrame:
    """Pairs within the first `cap` records (in order of id) of each bucket: the cap is part of the operator.

    keys: for each strategy its key and cap. All strategies share one explode and one grouping. A bucket's first records
    are found in two phases, so that a bucket of half of all records is no large task: each part of the rows, and then
    each of SALTS parts of a bucket, hands on its first ones only. The kept ids are one array of at most `cap` entries,
    so pairs come from it without a self-join.
    """
    most = max(cap for _, cap in keys.values())
    r = _entries(records, keys)
    # a fixed bound lets Spark keep the first ones before it shuffles
    for parts in (["rank", "key", F.pmod(F.xxhash64("id"), F.lit(SALTS))], ["rank", "key"]):
        r = r.withColumn("rn", F.row_number().over(Window.partitionBy(*parts).orderBy("id"))).filter(F.col("rn") <= most)
    r = r.filter("rn <= cap")
    ids = r.groupBy("rank", "key").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
    pairs = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice(F.col("ids"), i + 2, F.lit(most)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return ids.select("rank", F.explode(pairs).alias("p")).select("p.a", "p.b", "rank")


def left_out(records: DataFrame, keys: dict[str, tuple[Column, int]]) -> DataFrame:
    """(strategy, buckets, records): by strategy, the buckets larger than its cap and the records beyond it."""
    sizes = _entries(records, keys).groupBy("rank", "key", "cap").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > F.col("cap"))
    name = F.element_at(F.array(*map(F.lit, keys)), F.col("rank") + 1).alias("strategy")
    return sizes.groupBy(name).agg(F.count(F.lit(1)).alias("buckets"), F.sum(F.col("n") - F.col("cap")).alias("records"))


def _entries(records: DataFrame, keys: dict[str, tuple[Column, int]]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(i).alias("rank"), key.alias("key"), F.lit(cap).alias("cap")) for i, (key, cap) in enumerate(keys.values())])
    return records.select("id", F.explode(entries).alias("e")).select("id", "e.*").filter("key is not null and key <> ''")


def neighbour_pairs(records: DataFrame, name: Column, window: int = NEIGHBOURS) -> DataFrame:
    """Pairs within `window` places of each other in the order of all names that share a 4-letter prefix.

    The prefix leaves blanks out and the order does not, so the places of all records count, whatever their prefix.
    """
    r = records.select("id", T.plain_key(name).alias("key")).withColumn("prefix", T.name_prefix(F.col("key"), 4))
    r = cut(numbered(r, ["key", "id"])).filter("prefix <> ''")
    later = r.select(F.col("id").alias("y"), "prefix", "place")
    near = r.select(F.col("id").alias("x"), "prefix", F.explode(F.sequence(F.col("place") + 1, F.col("place") + window)).alias("place"))
    return near.join(later, ["prefix", "place"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def candidate_pairs(records: DataFrame) -> DataFrame:
    """a < b once each, with the first strategy that emits the pair.

    records: id, name, phonetic, pincode, pan, pan_valid, gstin, gstin_valid, all as columns that are computed once.
    """
    names = [*(s for s, _ in CAPS), "sorted_neighborhood"]
    found = bucket_pairs(records, strategies()).unionByName(neighbour_pairs(records, F.col("name")).withColumn("rank", F.lit(len(CAPS))))
    first = found.groupBy("a", "b").agg(F.min("rank").alias("rank"))
    return first.select("a", "b", F.element_at(F.array(*map(F.lit, names)), F.col("rank") + 1).alias("strategy"))


def strategies() -> dict[str, tuple[Column, int]]:
    """Each strategy's key and cap."""
    prefix = T.name_prefix(T.plain_key(F.col("name")), 6)
    keys = {
        "pan_exact": F.when(F.col("pan_valid"), F.col("pan")), "gstin_exact": F.when(F.col("gstin_valid"), F.col("gstin")),
        "pincode_name": F.when((F.col("pincode") != "") & (prefix != ""), F.concat("pincode", F.lit("::"), prefix)), "phonetic": F.col("phonetic"),
    }
    return {s: (keys[s], cap) for s, cap in CAPS}


def prepared(records: DataFrame, address_variant: str = "dice") -> DataFrame:
    """Records with what scoring makes of each side alone (sets of words, the vector's length), once a record and not once a
    pair, in place of the texts: name_words, phonetic_words, address_words and, if there are vectors, embedding_norm."""
    made = {"name_words": S.tokens(F.col("name")), "phonetic_words": S.phonetic_tokens(F.col("phonetic")), "address_words": S.address_tokens(F.col("address"), address_variant)}
    if "embedding" in records.columns:
        made["embedding_norm"] = S.norm(F.col("embedding"))
    return records.withColumns(made).drop("name", "phonetic", "address")


def score_pairs(pairs: DataFrame, weights: dict[str, float] | None = None, name_variant: str = "dice", address_variant: str = "dice", conflict_cap: float = CONFLICT_CAP, version: str = "v1.0") -> DataFrame:
    """From columns of both sides (suffix _a, _b) to features, score, conflict, decision, reason and evidence.

    The sides have name, phonetic, pincode, pan, gstin, a parsed address and, if there are vectors, embedding. weights may
    come from training. Sides may be `prepared` (for the same variants, which go by words). Where neither side has a tax number, that feature's weight is shared out among the others.
    """
    c, w = F.col, dict(weights or WEIGHTS)
    anchor = F.greatest(S.exact(c("pan_a"), c("pan_b")).cast("double"), S.exact(c("gstin_a"), c("gstin_b")).cast("double"))
    has = set(pairs.columns)
    if {"embedding_norm_a", "embedding_norm_b"} <= has:
        alike = S.cosine_of(c("embedding_a"), c("embedding_norm_a"), c("embedding_b"), c("embedding_norm_b"))
    else:
        alike = S.cosine(c("embedding_a"), c("embedding_b")) if {"embedding_a", "embedding_b"} <= has else F.lit(0.0)
    if "name_words_a" in has:
        names, codes, places = (f(c(f"{n}_words_a"), c(f"{n}_words_b")) for n, f in (("name", S.BY_WORDS[name_variant]), ("phonetic", S.jaccard), ("address", S.BY_WORDS[address_variant])))
    else:
        names, codes, places = S.name_similarity(c("name_a"), c("name_b"), name_variant), S.jaccard(S.phonetic_tokens(c("phonetic_a")), S.phonetic_tokens(c("phonetic_b"))), S.address_overlap(c("address_a"), c("address_b"), address_variant)
    features = {
        "pan_gstin_match": anchor, "embedding_similarity": F.round(alike, 4), "name_similarity": F.round(names, 4),
        "phonetic_match": codes, "pincode_match": S.exact(c("pincode_a"), c("pincode_b")).cast("double"),
        "address_overlap": F.round(places, 4),
    }
    empty = lambda n: (F.coalesce(c(f"{n}_a"), F.lit("")) == "") & (F.coalesce(c(f"{n}_b"), F.lit("")) == "")
    out = pairs.withColumns({**features, "redistributed": empty("pan") & empty("gstin"), "conflicting_pan": S.conflict(c("pan_a"), c("pan_b")), "conflicting_gstin": S.conflict(c("gstin_a"), c("gstin_b"))})
    spare = w.get("pan_gstin_match", 0.0)
    rest = sum(x for n, x in w.items() if n != "pan_gstin_match") or 1.0
    weight = lambda n: F.when(c("redistributed"), 0.0 if n == "pan_gstin_match" else w.get(n, 0.0) * (1 + spare / rest)).otherwise(w.get(n, 0.0))
    parts = {n: c(n) * weight(n) for n in features}
    raw = sum(parts.values(), F.lit(0.0))
    clash = c("conflicting_pan") | c("conflicting_gstin")
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(clash, F.least(raw, F.lit(conflict_cap))).otherwise(raw))), 4)
    told = F.struct(
        F.struct(*features).alias("features"), F.struct(*[weight(n).alias(n) for n in features]).alias("weights"), F.struct(*[F.round(x, 4).alias(n) for n, x in parts.items()]).alias("contributions"), F.lit(version).alias("weight_version"),
        "redistributed", "conflicting_pan", "conflicting_gstin",
    )
    out = out.withColumns({"score": score, "conflict": clash, "evidence": told}).drop("redistributed", "conflicting_pan", "conflicting_gstin")
    return out.withColumns({"decision": decide(c("score"), c("conflict")), "reason": reason(c("score"), c("conflict"))})


def decide(score: Column, conflict: Column, auto: float = AUTO_LINK, review: float = REVIEW) -> Column:
    return F.when(conflict, "separate").when(score >= auto, "auto_link").when(score >= review, "review_queue").otherwise("separate")


def reason(score: Column, conflict: Column, auto: float = AUTO_LINK, review: float = REVIEW) -> Column:
    return F.when(conflict, "conflicting_anchor_identifier").when(score >= auto, "above_auto_threshold").when(score >= review, "in_review_band").otherwise("below_review_threshold")
