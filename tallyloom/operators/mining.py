"""Episodes, families, scores: DataFrame operators over the tables of actions and sessions.

Input columns. actions: session, position, event_key, request, turn, operations (array of structs with label, template and
exact), output_tokens, assistant_tokens, success, compact_output_tokens, linked_to, poll_reduction_tokens,
repeat_output_reduction_tokens. sessions: session, logical, project, project_key, project_kind.
An action is known by (session, position).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import BUNDLE, MECHANISMS, OPPORTUNITY, TITLES, VALIDATION, WORKFLOW
from ..functions.scalar import budgeted, candidate_id, hash_text, saved


@dataclass(frozen=True)
class Options:
    min_length: int = 2
    max_length: int = 10
    min_occurrences: int = 2
    min_sessions: int = 2
    result_budget: int = 200
    include_exploratory: bool = False

    def __post_init__(self):
        if not 2 <= self.min_length <= self.max_length <= 10:
            raise ValueError("sequence lengths must satisfy 2 <= min <= max <= 10")
        if self.min_occurrences < 2 or self.min_sessions < 1 or self.result_budget < 0:
            raise ValueError("invalid occurrence, session or result-budget setting")


ID = ["session", "position"]
#: Columns of an action that mining reads; others never leave the scan.
HOT = [*ID, "event_key", "request", "turn", "output_tokens", "assistant_tokens", "success", "compact_output_tokens", "linked_to", "poll_reduction_tokens", "repeat_output_reduction_tokens"]


def compact(actions: DataFrame) -> DataFrame:
    ops = F.transform("operations", lambda o: F.struct(o["label"].alias("label"), o["template"].alias("template"), o["exact"].alias("exact")))
    return actions.select(*HOT, ops.alias("operations"))


def with_replay_flag(actions: DataFrame) -> DataFrame:
    """One winner per event key: known outcome first, then most output, then first in order; the others are replays."""
    best = W.partitionBy("event_key").orderBy(F.col("success").isNotNull().desc(), F.col("output_tokens").desc(), "session", "position")
    return actions.withColumn("replayed", F.row_number().over(best) > 1)


def with_boundaries(actions: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds: folded, opaque, and new_request (against the last action before that is no replay)."""
    order = W.partitionBy("session").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    before = F.last(F.when(~F.col("replayed"), F.col("request")), ignorenulls=True).over(order)
    labels = F.col("operations.label")
    folded = ~F.col("replayed") & (F.coalesce("linked_to", F.lit("")) != "") & F.forall(labels, lambda x: x == "poll")
    opaque = ~F.col("replayed") & ~folded & ((F.size("operations") > options.max_length) | F.exists(labels, lambda x: x == "unknown"))
    kept = F.col("compact_output_tokens").isNotNull()
    return actions.withColumns({
        "new_request": ~F.col("replayed") & F.coalesce(before != F.col("request"), F.lit(False)), "folded": folded, "opaque": opaque,
        "compact_output_tokens": F.when(kept, budgeted(F.col("compact_output_tokens"), options.result_budget)),
    })


def islands(marked: DataFrame) -> DataFrame:
    """One row for each workflow operation, with the number of its island: no boundary lies inside an island.

    Boundaries: a replayed or opaque action, an operation that is no workflow, and a new request (before it, folded or not).
    """
    whole = F.col("replayed") | F.col("opaque") | F.col("folded")
    rows = marked.withColumn("n_ops", F.size("operations")).withColumn(
        "op", F.explode(F.when(whole | (F.size("operations") == 0), F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("template"), F.lit(None).cast("string").alias("exact"))))
                        .otherwise(F.transform("operations", lambda o, i: F.struct(i.alias("i"), o["label"].alias("label"), o["template"].alias("template"), o["exact"].alias("exact"))))))
    rows = rows.drop("operations").select("*", "op.*").drop("op").withColumn("whole", whole)
    member = ~F.col("whole") & F.coalesce(F.col("label").isin(*WORKFLOW), F.lit(False))
    breaks = F.col("replayed") | F.col("opaque") | (~F.col("whole") & ~member)
    breaks = breaks.cast("int") + (F.col("new_request") & (F.col("i") <= 0)).cast("int")
    order = W.partitionBy("session").orderBy("position", "i")
    return rows.withColumn("member", member).withColumn("island", F.sum(breaks).over(order)).where("member").drop("member", "whole")


def packed(rows: DataFrame, max_length: int) -> DataFrame:
    """Adds ``pack``: an island is filled greedily; an action that would not fit whole begins a new pack, and so does what follows a full one.

    Islands of one-operation actions are cut by position alone. The others are folded in order inside one
    row (as long as a session at most).
    """
    one = W.partitionBy("session", "island")
    place = F.row_number().over(one.orderBy("position", "i"))
    rows = rows.withColumn("place", place).withColumn("simple", F.max("n_ops").over(one) <= 1)
    simple = rows.where("simple").withColumn("pack", F.floor((F.col("place") - 1) / max_length).cast("int"))
    rest = rows.where(~F.col("simple"))
    first = F.min("i").over(W.partitionBy("session", "island", "position"))
    rest = rest.withColumn("starts", (F.col("i") == first) & (first == 0))
    steps = rest.groupBy("session", "island").agg(F.array_sort(F.collect_list(F.struct("place", "starts", "n_ops"))).alias("steps"))
    zero = F.struct(F.lit(0).alias("length"), F.array().cast("array<int>").alias("cuts"))

    def step(a, s):
        full = (a["length"] >= max_length) | (s["starts"] & (a["length"] > 0) & (a["length"] + s["n_ops"] > max_length))
        return F.struct((F.when(full, 0).otherwise(a["length"]) + 1).alias("length"), F.when(full, F.concat(a["cuts"], F.array(s["place"]))).otherwise(a["cuts"]).alias("cuts"))

    # Only the places where packs begin leave the fold; a pack's number is how many lie up to it.
    cuts = steps.select("session", "island", F.explode(F.aggregate("steps", zero, step, lambda a: a["cuts"])).alias("place")).withColumn("cut", F.lit(1))
    rest = rest.drop("starts").join(cuts, ["session", "island", "place"], "left")
    rest = rest.withColumn("pack", F.sum(F.coalesce("cut", F.lit(0))).over(one.orderBy("place")).cast("int")).drop("cut")
    return simple.unionByName(rest.select(*simple.columns)).drop("place", "simple")


def family_of(labels: Column) -> Column:
    return (
        F.when(F.exists(labels, lambda x: x.isin(*VALIDATION)), "validation_report")
        .when(F.exists(labels, lambda x: x.startswith("github_")), "ci_report")
        .otherwise("repository_report")
    )


def sequence_json(labels: Column) -> Column:
    return F.concat(F.lit('["'), F.array_join(labels, '", "'), F.lit('"]'))


@dataclass(frozen=True)
class Mined:
    """episodes; members: (family, session, position, mechanism, reduction); dropped: counts by reason; marked: actions with their flags."""

    episodes: DataFrame
    members: DataFrame
    dropped: DataFrame
    marked: DataFrame
    islands: DataFrame


EPISODE = ["family", "session", "start", "end", "sequence", "signature", "exact", "turns", "output", "reduction", "known", "failed", "assistant"]


def _reductions(family: Column) -> dict[str, Column]:
    """Tokens saved on an action by each mechanism, as the family allows."""
    status = F.coalesce(saved(F.col("output_tokens"), F.col("compact_output_tokens")), F.lit(0))
    zero = F.lit(0).cast("long")
    return {
        "validation_status": F.when(family.isin("await_completion", "reuse_results") | F.col("compact_output_tokens").isNull(), zero).otherwise(status),
        "empty_poll": F.when(family.isin("validation_output", "reuse_results"), zero).otherwise(F.coalesce("poll_reduction_tokens", zero)),
        "unchanged_result": F.when(family == "reuse_results", F.coalesce("repeat_output_reduction_tokens", zero)).otherwise(zero),
    }


def mine(actions: DataFrame, options: Options = Options(), keep=lambda df, name: df) -> Mined:
    """``keep(df, name)`` may write a table that several plans read, and return what it reads back."""
    marked = keep(with_boundaries(with_replay_flag(compact(actions)), options), "marked")
    packs = keep(packed(islands(marked), options.max_length), "packs")

    # Bundles: operations are gathered in order; sums are over distinct actions of the pack.
    ordered = F.array_sort(F.collect_list(F.struct("position", "i", "label", "template", "exact")))
    runs = packs.groupBy("session", "island", "pack").agg(ordered.alias("ops"), F.count_distinct("position").alias("n_actions"), F.count_distinct("turn").alias("turns"))
    runs = runs.where(F.size("ops") >= options.min_length).withColumn("family", family_of(F.col("ops.label")))
    batched = (F.col("n_actions") < 2) | (F.col("turns") < 2)
    uniform = F.size(F.array_distinct("ops.label")) < 2
    runs = runs.withColumn("drop", F.when(batched, "already_batched_episodes").when(uniform, "homogeneous_episodes"))
    dropped = runs.where(F.col("drop").isNotNull()).groupBy(F.col("drop").alias("reason")).agg(F.count("*").alias("n"))
    kept = runs.where(F.col("drop").isNull()).select("session", "island", "pack", "family", "turns", "ops")
    of_bundles = packs.where("i >= 0").dropDuplicates(["session", "island", "pack", "position"]).join(kept.select("session", "island", "pack", "family"), ["session", "island", "pack"])
    of_bundles = of_bundles.withColumns(_reductions(F.col("family")))
    sums = of_bundles.groupBy("session", "island", "pack").agg(
        F.min("position").alias("start"), F.max("position").alias("end"), F.sum("output_tokens").alias("output"), F.sum("assistant_tokens").alias("assistant"),
        F.sum(sum((F.col(m) for m in MECHANISMS[1:]), F.col(MECHANISMS[0]))).alias("reduction"), F.bool_and(F.col("success").isNotNull()).alias("known"),
        F.coalesce(F.bool_or(~F.col("success")), F.lit(False)).alias("failed"))
    bundles = kept.join(sums, ["session", "island", "pack"]).select(
        "family", "session", "start", "end", sequence_json(F.col("ops.label")).alias("sequence"), hash_text(F.array_join("ops.template", "|")).alias("signature"),
        hash_text(F.array_join("ops.exact", "|")).alias("exact"), "turns", "output", "reduction", "known", "failed", "assistant")

    # Single actions: each reducer looks at an action by itself.
    live = marked.where(~F.col("replayed"))
    op = F.get("operations", F.lit(0))
    logs = live.where(~F.col("folded") & ~F.col("opaque") & (F.size("operations") == 1) & (F.col("output_tokens") > F.col("compact_output_tokens")))
    singles = logs.withColumns({"family": F.lit("validation_output"), "label": op["label"], "template": op["template"], "exact": op["exact"]})
    for family, amount, label, constant in (("await_completion", "poll_reduction_tokens", "await_completion", "linked-process-completion"), ("reuse_results", "repeat_output_reduction_tokens", "reuse_unchanged_result", "identical-read-result")):
        found = live.where(F.coalesce(amount, F.lit(0)) > 0)
        singles = singles.unionByName(found.withColumns({"family": F.lit(family), "label": F.lit(label), "template": F.lit(constant), "exact": F.lit(constant)}))
    singles = singles.withColumns(_reductions(F.col("family")))
    alone = singles.select(
        "family", "session", F.col("position").alias("start"), F.col("position").alias("end"), sequence_json(F.array("label")).alias("sequence"), hash_text(F.col("template")).alias("signature"),
        hash_text(F.col("exact")).alias("exact"), F.lit(1).cast("long").alias("turns"), F.col("output_tokens").alias("output"), sum((F.col(m) for m in MECHANISMS[1:]), F.col(MECHANISMS[0])).alias("reduction"),
        F.col("success").isNotNull().alias("known"), F.coalesce(~F.col("success"), F.lit(False)).alias("failed"), F.col("assistant_tokens").alias("assistant"))

    each = of_bundles.select("family", *ID, *MECHANISMS).unionByName(singles.select("family", *ID, *MECHANISMS))
    amounts = each.select("family", *ID, F.explode(F.array(*[F.struct(F.lit(m).alias("mechanism"), F.col(m).alias("reduction")) for m in MECHANISMS])).alias("m")).select("family", *ID, "m.*")
    members = amounts.where("reduction > 0").groupBy("family", *ID, "mechanism").agg(F.max("reduction").alias("reduction"))
    return Mined(keep(bundles.unionByName(alone.select(*bundles.columns)), "episodes"), members, dropped, marked, packs)


def located(episodes: DataFrame, sessions: DataFrame) -> DataFrame:
    return episodes.join(sessions.select("session", "logical", "project", "project_key", "project_kind"), "session")


def family_stats(episodes: DataFrame) -> DataFrame:
    """Per family: counts and sums; averages are left to the reader as sums over ``n``."""
    return episodes.groupBy("family").agg(
        F.count("*").alias("n"), F.count_distinct("logical").alias("sessions"), F.sum("turns").alias("turns"), F.sum("output").alias("output"), F.sum("reduction").alias("reduction"),
        F.sum(F.col("known").cast("long")).alias("known"), F.sum(F.col("failed").cast("long")).alias("failed"), F.sum((F.col("known") & ~F.col("failed")).cast("long")).alias("success"),
        F.count_distinct(F.when(F.col("project_kind") == "git", F.col("project_key"))).alias("repos"), F.count_distinct(F.when(F.col("project_kind") != "git", F.col("project_key"))).alias("unresolved"))


def recurrence(episodes: DataFrame) -> DataFrame:
    """Per family: episodes whose interface signature occurs in two or more logical sessions."""
    groups = episodes.groupBy("family", "signature").agg(F.count("*").alias("n"), F.count_distinct("logical").alias("k"))
    return groups.groupBy("family").agg(F.coalesce(F.sum(F.when(F.col("k") >= 2, F.col("n"))), F.lit(0)).alias("recurring"))


def variants(episodes: DataFrame, most: int = 8) -> DataFrame:
    """The most frequent label sequences of each family: family, rank, sequence, n."""
    counted = episodes.groupBy("family", "sequence").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("family").orderBy(F.desc("n"), "sequence"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most)


def projects(episodes: DataFrame, most: int = 50) -> DataFrame:
    """The first project names of each family: family, projects."""
    each = episodes.select("family", "project").distinct()
    rank = F.row_number().over(W.partitionBy("family").orderBy("project"))
    return each.withColumn("r", rank).where(F.col("r") <= most).groupBy("family").agg(F.array_sort(F.collect_list("project")).alias("projects"))


def scores(episodes: DataFrame, options: Options = Options()) -> DataFrame:
    """Families with enough support: stats, recurring, id, opportunity_type, score (reduction times the recurring share)."""
    stats = family_stats(episodes).where((F.col("n") >= options.min_occurrences) & (F.col("sessions") >= options.min_sessions))
    rows = stats.join(recurrence(episodes), "family").withColumn("score", F.col("reduction") * (F.col("recurring") / F.col("n")))
    if not options.include_exploratory:
        rows = rows.where("score > 0")
    kind, title = F.lit(BUNDLE), F.lit(None).cast("string")
    for f, k in OPPORTUNITY.items():
        kind = F.when(F.col("family") == f, k).otherwise(kind)
    for f, t in TITLES.items():
        title = F.when(F.col("family") == f, t).otherwise(title)
    return rows.withColumns({"id": candidate_id(F.col("family")), "opportunity_type": kind, "name": title})


def candidates(mined: Mined, sessions: DataFrame, options: Options = Options()) -> DataFrame:
    episodes = located(mined.episodes, sessions)
    listed = variants(episodes).groupBy("family").agg(F.array_sort(F.collect_list(F.struct("rank", "sequence", "n"))).alias("variants"))
    return scores(episodes, options).join(listed, "family").join(projects(episodes), "family")


def occurrences(mined: Mined, chosen: DataFrame) -> DataFrame:
    """(id, session, start, end): of episodes with one start, the one that was found first, which ends first."""
    rows = mined.episodes.join(chosen.select("family", "id"), "family")
    return rows.groupBy("id", "family", "session", "start").agg(F.min("end").alias("end"))


def ranked(chosen: DataFrame, order: str = "result") -> DataFrame:
    """Orders: ``result`` (score, bundles first, id), ``list`` (score, type descending, id), ``report`` (bundles first, score, id)."""
    bundle, score = (F.col("opportunity_type") == BUNDLE).desc(), F.col("score").desc()
    keys = {"result": [score, bundle, "id"], "list": [score, F.col("opportunity_type").desc(), "id"], "report": [bundle, score, "id"]}
    return chosen.orderBy(*keys[order])


def credits(mined: Mined, chosen: DataFrame) -> DataFrame:
    """Each (action, mechanism) credited once: to bundles first, then by score and id."""
    rows = mined.members.join(chosen.select("family", "id", "score", "opportunity_type"), "family")
    first = W.partitionBy(*ID, "mechanism").orderBy((F.col("opportunity_type") == BUNDLE).desc(), F.desc("score"), "id")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").select("id", *ID, "mechanism", "reduction")


def credit_by_tool(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """All candidates, also those without credit."""
    sums = found.groupBy("id").agg(F.count_distinct(F.struct(*ID)).alias("credited"), F.sum("reduction").alias("avoided"))
    rows = chosen.select("id", "name", "opportunity_type", F.col("n").alias("occurrences"), "score").join(sums, "id", "left")
    return rows.withColumns({"credited": F.coalesce("credited", F.lit(0)), "avoided": F.coalesce("avoided", F.lit(0))})


def credit_by_mechanism(found: DataFrame) -> DataFrame:
    return found.groupBy("mechanism").agg(F.sum("reduction").alias("avoided"))


def credit_totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count_distinct(F.struct(*ID)).alias("credited_results"), F.coalesce(F.sum("reduction"), F.lit(0)).alias("avoided"), F.count("*").alias("credited_mechanisms"))


def diagnostics(mined: Mined) -> DataFrame:
    """One row of counters over the corpus."""
    m = mined.marked
    live = ~F.col("replayed")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    boundary = F.size(F.filter("operations", lambda o: ~o["label"].isin(*WORKFLOW)))
    base = m.agg(
        count(F.col("replayed")).alias("replayed_actions_excluded"), count(live).alias("unique_actions"), F.coalesce(F.sum(F.when(live, F.col("output_tokens"))), F.lit(0)).alias("observed_tool_output_tokens"),
        count(F.col("folded")).alias("linked_polls_folded"), count(F.col("opaque")).alias("opaque_or_oversized_batches"),
        count(F.when(live & ~F.col("folded") & ~F.col("opaque"), boundary)).alias("content_or_unknown_boundaries"))
    names = ("already_batched_episodes", "homogeneous_episodes")
    lost = mined.dropped.agg(*[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0)).alias(r) for r in names])
    return base.withColumn("one", F.lit(1)).join(F.broadcast(lost.withColumn("one", F.lit(1))), "one").drop("one")


def examples(found: DataFrame, sessions: DataFrame, most: int = 3) -> DataFrame:
    """The first occurrences of each candidate, one for each logical session."""
    rows = found.join(sessions.select("session", "logical"), "session")
    one = F.row_number().over(W.partitionBy("id", "logical").orderBy("session", "start"))
    rows = rows.withColumn("one", one).where("one = 1").drop("one")
    rank = F.row_number().over(W.partitionBy("id").orderBy("session", "start"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)
