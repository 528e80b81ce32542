"""Recorded model usage on calls that a proposed tool could remove: repeated exact plans, and empty polls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import BUNDLE
from ..functions.scalar import hash_text

PLAN = ["session", "start", "end"]
#: Reasons of exposure, in order of precedence.
REASONS = ("fixed_validation_plan", "empty_process_polling")
COUNTERS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens")


def relevant_sessions(occurrences: DataFrame, chosen: DataFrame) -> DataFrame:
    """Sessions with an occurrence of a bundle or of awaited completion."""
    kinds = chosen.where((F.col("opportunity_type") == BUNDLE) | (F.col("family") == "await_completion")).select("id")
    return occurrences.join(kinds, "id", "left_semi").select("session").distinct()


def members_of(plans: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions inside each plan: hashed on the session, with the range as a condition."""
    a = actions.select(F.col("session").alias("s"), "position", "turn", "success", "linked_to", F.col("operations.exact").alias("exact"))
    return plans.join(a, (F.col("session") == F.col("s")) & F.col("position").between(F.col("start"), F.col("end"))).drop("s")


def exact_plans(occurrences: DataFrame, actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Validation occurrences all of whose unlinked actions succeeded: signature of their exact operations, first turn, logical."""
    plans = occurrences.where("family = 'validation_report'").select(*PLAN)
    inside = members_of(plans, actions).where(F.coalesce("linked_to", F.lit("")) == "")
    rows = inside.groupBy(*PLAN).agg(
        F.bool_and(F.coalesce("success", F.lit(False))).alias("good"), F.min("turn").alias("first_turn"),
        F.array_sort(F.collect_list(F.struct("position", "exact"))).alias("steps"))
    rows = rows.where("good").withColumn("signature", hash_text(F.array_join(F.flatten("steps.exact"), "|")))
    return rows.drop("steps", "good").join(sessions.select("session", "logical"), "session")


def repeated_plans(plans: DataFrame) -> DataFrame:
    """Plans whose signature two or more logical sessions have."""
    again = plans.groupBy("signature").agg(F.count_distinct("logical").alias("k")).where("k >= 2")
    return plans.join(again, "signature", "left_semi")


def removable_turns(plans: DataFrame, actions: DataFrame) -> DataFrame:
    """Turns of a plan after its first that have no action outside the plan."""
    turns = members_of(plans, actions).where(F.col("turn") > F.col("first_turn")).select(*PLAN, "turn").distinct()
    others = actions.select(F.col("session").alias("s"), F.col("turn").alias("t"), F.col("position").alias("p"))
    outside = (F.col("session") == F.col("s")) & (F.col("turn") == F.col("t")) & ((F.col("p") < F.col("start")) | (F.col("p") > F.col("end")))
    return turns.join(others, outside, "left_anti")


def exposure(plans: DataFrame, actions: DataFrame, usage: DataFrame, relevant: DataFrame) -> DataFrame:
    """Each usage key once: fixed plans before empty polls, then in order."""
    silent = usage.where("trusted and not visible_text")
    fixed = removable_turns(plans, actions).join(silent, ["session", "turn"]).withColumn("reason", F.lit(REASONS[0]))
    polls = silent.where("empty_poll").join(relevant, "session", "left_semi").withColumn("reason", F.lit(REASONS[1]))
    polls = polls.withColumns({"start": F.lit(None).cast("int"), "end": F.lit(None).cast("int")})
    rows = fixed.unionByName(polls.select(*fixed.columns))
    first = W.partitionBy("usage_key").orderBy(F.col("reason") != REASONS[0], "session", "start", "turn")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").select("usage_key", "reason", *COUNTERS)


def by_reason(found: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    rows = found.groupBy("reason").agg(F.count("*").alias("model_calls"), *sums)
    return rows.withColumn("uncached_input_tokens", F.col("input_tokens") - F.col("cached_input_tokens") - F.col("cache_write_input_tokens"))
