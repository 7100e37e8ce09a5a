"""Lineage cuts, groups of linked records, and records resolved in order."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset and all of Spark is one process (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local.setdefault("root", "file://" + tempfile.mkdtemp(prefix="regolith-"))
    return root


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here: a table written to the shared folder. Unlike a checkpoint it is computed once, and its size is
    known from its files, where estimates multiplied round after round would grow beyond all bounds. What is joined in rounds
    is merged: a broadcast would bring a table through the driver every round."""
    at = f"{shared_root(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def resolve_first(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """From pairs (a, b) to (record, group), the group being named after its smallest record.

    Labels sink to the smallest neighbour's and then follow the label's own label, so rounds grow with the logarithm
    of a chain's length. Raises if `rounds` do not do.
    """
    edges = cut(pairs.filter("a is not null and b is not null").select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a is not null and b is not null")).distinct())
    now = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("group")).withColumnRenamed("a", "record")
    for _ in range(rounds):
        now = cut(now)
        near = edges.join(now.select(F.col("record").alias("b"), F.col("group").alias("g")).hint("merge"), "b").groupBy(F.col("a").alias("record")).agg(F.min("g").alias("g"))
        lower = now.join(near.hint("merge"), "record").select("record", F.least("group", "g").alias("group"), F.col("group").alias("before"))
        up = now.select(F.col("record").alias("group"), F.col("group").alias("further"))
        after = cut(lower.join(up.hint("merge"), "group").select("record", F.least("group", "further").alias("group"), "before"))
        now = after.select("record", "group")
        if after.filter(F.col("group") != F.col("before")).isEmpty():
            return now
    raise RuntimeError(f"groups did not settle in {rounds} rounds")


def route(similarity: Column, conflict: Column, auto: float = 0.92, review: float = 0.75) -> Column:
    """Where a record goes by its best candidate; a conflict of identifiers is never linked without a review."""
    return F.when(F.coalesce(similarity < review, F.lit(True)), "new_ubid").when(conflict | (similarity < auto), "review_queue").otherwise("auto_match")


def route_anchored(similarity: Column, conflict: Column, same_identifier: Column, auto: float = 0.92, review: float = 0.75) -> Column:
    """The variant in which a shared identifier lowers the bar and a conflict always makes a new identity."""
    bar = F.when(same_identifier, review).otherwise(auto)
    return F.when(conflict | F.coalesce(similarity < review, F.lit(True)), "new_ubid").when(similarity >= bar, "auto_match").otherwise("review_queue")


def unmatched(nodes: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, acts) for a forest of (id, parent): a node acts iff none of its children does.

    By contraction: a node whose children are all known, or one of which acts, is known (rake). A node with one unknown child
    and no acting one is the child's negation, and so, along a chain of such nodes, a function of the chain's end, which is
    the negation or the identity: such a node points to the end and composes what it skips, twice as far each round
    (compress). Leaves and chains go together, so rounds grow with the logarithm of the number of nodes, however long the
    chains are. Nodes whose parent is not a node are roots.
    """
    nothing = F.lit(None).cast(nodes.schema["id"].dataType)
    nodes = cut(nodes.select("id", "parent", F.lit(None).cast("boolean").alias("acts"), nothing.alias("end"), F.lit(False).alias("negated")))
    known: list[DataFrame] = []
    for _ in range(rounds):
        if nodes.isEmpty():
            break
        # what became known in the last round is heard by parents and chains in this one, and then leaves the table
        known.append(nodes.filter("acts is not null").select("id", "acts"))
        unknown = F.col("acts").isNull()
        children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.coalesce(F.bool_or("acts"), F.lit(False)).alias("taken"), F.count_if(unknown).alias("unknown"), F.max(F.when(unknown, F.col("id"))).alias("child"))
        ends = nodes.filter("acts is not null").select(F.col("id").alias("end"), F.col("acts").alias("end_acts"))
        now = nodes.filter("acts is null").drop("acts").join(children.hint("merge"), "id", "left").join(ends.hint("merge"), "end", "left")
        chained, left = F.col("end").isNotNull(), F.coalesce("unknown", F.lit(0))
        acts = F.when(chained, F.col("end_acts") != F.col("negated")).when(F.coalesce("taken", F.lit(False)), F.lit(False)).when(left == 0, F.lit(True))
        # a node that was found to have one unknown child is that child's negation for good
        end, negated = F.when(chained, F.col("end")).when(left == 1, F.col("child")), F.when(chained, F.col("negated")).otherwise(left == 1)
        now = cut(now.select("id", "parent", acts.alias("acts"), F.when(acts.isNull(), end).alias("end"), negated.alias("negated")))
        far = now.filter("acts is null and end is not null").select(F.col("id").alias("end"), F.col("end").alias("further"), F.col("negated").alias("more"))
        now = now.join(far.hint("merge"), "end", "left").select("id", "parent", "acts", F.coalesce("further", "end").alias("end"), (F.col("negated") != F.coalesce("more", F.lit(False))).alias("negated"))
        nodes = cut(now)
    else:
        raise RuntimeError(f"the forest did not settle in {rounds} rounds")
    return reduce(DataFrame.unionByName, known) if known else nodes.select("id", "acts")


def resolve(best: DataFrame, linked: DataFrame, rounds: int = 200) -> DataFrame:
    """Records resolved one after another, computed without going through them one by one.

    best: (seq, id, best_id, decision), seq unique in order of turns, one row per record; linked: (id, entity) that
    hold before. Sequential meaning: at its turn a record that is linked is skipped; new_ubid makes an entity of its
    own; auto_match joins the candidate's entity, or makes one for both if the candidate has none; review_queue links
    nothing. Returns (id, outcome, entity, maker): outcome skipped or the decision (linked_by_other for candidates that had
    no turn), entity null if none, maker whether this record's turn made the entity ("new:" and the maker's id).

    A record is skipped iff it was linked before or an earlier record that was not skipped itself auto-matched to it. Each
    record has one candidate, so the suitors form a forest, which `unmatched` contracts. Entities then follow pointers to
    earlier records, doubled each round. Rounds grow with the logarithm of the number of records in both.
    """
    held = linked.groupBy("id").agg(F.min("entity").alias("held"))
    turns = best.select("seq", "id", "best_id", "decision").join(held.hint("merge"), "id", "left")
    auto = turns.filter("decision = 'auto_match' and held is null and best_id is not null").select(F.col("id").alias("suitor"), F.col("seq").alias("suitor_seq"), F.col("best_id").alias("id"))
    suits = cut(auto.join(turns.filter("held is null").select("id", "seq").hint("merge"), "id").filter("suitor_seq < seq").select("id", "suitor"))
    free = turns.filter("held is null").select("id").join(suits.select(F.col("suitor").alias("id"), F.col("id").alias("parent")).hint("merge"), "id", "left")
    acting = unmatched(free, rounds)
    state = cut(turns.join(acting.hint("merge"), "id", "left").select("id", "seq", "best_id", "decision", "held", (F.col("held").isNotNull() | ~F.col("acts")).alias("skipped")))
    acts = state.filter("not skipped")
    links = acts.filter("decision = 'auto_match'").select("seq", "id", F.col("best_id").alias("target"))
    makes = acts.filter("decision = 'new_ubid'").select("seq", "id", F.col("id").alias("target"))
    # who links a record first: itself, or the first record that matches to it
    by = links.select("seq", F.col("target").alias("id"), F.col("id").alias("by")).unionByName(links.select("seq", "id", F.col("id").alias("by"))).unionByName(makes.select("seq", "id", F.col("id").alias("by")))
    # at equal turns the record's own entry stands for the match
    first = by.groupBy("id").agg(F.min_by("by", "seq").alias("by"))
    target = acts.filter("decision = 'auto_match'").select(F.col("id").alias("by"), F.col("best_id").alias("target"))
    pointers = first.join(target.hint("merge"), "by", "left").join(held.hint("merge"), "id", "left_anti")
    # a record points to the one that made or joined for it; a match points on to its candidate unless it was the first to link it
    lead = first.select(F.col("id").alias("target"), F.col("by").alias("target_by"))
    held_target = held.select(F.col("id").alias("target"), F.col("held").alias("target_held"))
    p = pointers.join(lead.hint("merge"), "target", "left").join(held_target.hint("merge"), "target", "left")
    makes_it = F.col("target").isNull() | (F.col("target_held").isNull() & (F.col("target_by") == F.col("by")))
    entity = F.when(F.col("target_held").isNotNull(), F.col("target_held").cast("string")).when(makes_it, F.concat(F.lit("new:"), F.col("by").cast("string")))
    at = cut(p.select("id", entity.alias("entity"), F.when(entity.isNull(), F.col("target")).alias("next"), "by", makes_it.alias("makes")))
    for _ in range(rounds):
        if at.filter("next is not null").isEmpty():
            break
        far = at.select(F.col("id").alias("next"), F.col("entity").alias("e"), F.col("next").alias("n"))
        at = cut(at.join(far.hint("merge"), "next", "left").select("id", F.coalesce("entity", "e").alias("entity"), "n", "by", "makes").withColumnRenamed("n", "next"))
    else:
        raise RuntimeError(f"entities did not settle in {rounds} rounds")
    out = state.join(at, "id", "full")
    return out.select("id", F.when(F.col("skipped"), "skipped").otherwise(F.coalesce("decision", F.lit("linked_by_other"))).alias("outcome"), F.coalesce(F.col("held").cast("string"), "entity").alias("entity"), F.coalesce(F.col("makes") & (F.col("by") == F.col("id")) & ~F.coalesce("skipped", F.lit(True)), F.lit(False)).alias("maker"))


def counts(resolved: DataFrame) -> DataFrame:
    """What a batch did: one row."""
    n = lambda c: F.count_if(c)
    o = F.col("outcome")
    return resolved.agg(n(~o.isin("skipped", "linked_by_other")).alias("processed"), n(F.col("maker")).alias("new_entities"), n((o == "auto_match") & ~F.col("maker")).alias("linked_to_existing"), n(o == "review_queue").alias("added_to_review"))
