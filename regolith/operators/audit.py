"""Entries of the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(rows: DataFrame, action: str, entity_type: str, entity_id: Column, actor: Column | None = None, before: Column | None = None, after: Column | None = None, extra: Column | None = None) -> DataFrame:
    """(action, entity_type, entity_id, actor, before_state, after_state, extra_data); states and extra are JSON."""
    state = lambda c: F.lit(None).cast("string") if c is None else F.to_json(c)
    return rows.select(
        F.lit(action).alias("action"), F.lit(entity_type).alias("entity_type"), entity_id.cast("string").alias("entity_id"), (F.lit("system") if actor is None else actor).alias("actor"),
        state(before).alias("before_state"), state(after).alias("after_state"), (F.lit("{}") if extra is None else F.to_json(extra)).alias("extra_data"),
    )


def decision_made(rows: DataFrame) -> DataFrame:
    return entries(rows, "decision_made", "candidate_pair", F.col("pair_id"), after=F.struct("decision_type", "confidence_score"))


def ubid_created(rows: DataFrame) -> DataFrame:
    return entries(rows, "ubid_created", "ubid", F.col("ubid"), after=F.struct(F.col("ubid").alias("ubid_code")))


def review_decided(rows: DataFrame, reviewer: Column) -> DataFrame:
    return entries(rows, "review_decision", "review_queue", F.col("id"), actor=reviewer, after=F.struct("decision"))


def threshold_changed(rows: DataFrame, actor: Column) -> DataFrame:
    """rows: old and new, each a struct with a version."""
    return entries(rows, "threshold_config_changed", "threshold_config", F.coalesce("new.version", F.lit("unknown")), actor=actor, before=F.col("old"), after=F.col("new"))


def weights_deployed(rows: DataFrame, actor: Column) -> DataFrame:
    return entries(rows, "ml_weights_deployed", "ml_model_weights", F.col("version"), actor=actor)
