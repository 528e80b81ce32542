"""From events to linked sessions: numbering, carrying, turns, links, repeats and recorded usage, as windows over event tables.

Every window is partitioned by the session or by a finer key, so one shuffle by session serves them all. Only the link of polls to
processes is recursive (a poll that found no process may start the next one) and runs as a grouped function, over the
few events that name a process.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import READ_ONLY, REUSE_FLOOR, REUSE_KEYS, REUSE_TURNS, STATUS_OUTPUT
from ..functions.scalar import hash_text


def _past(keys, order, including: bool = True):
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if including else -1)


# --- general forms ----------------------------------------------------------------------------------------------------


def request_number(is_request: Column, keys, order) -> Column:
    """Running number of requests."""
    return F.sum(is_request.cast("int")).over(_past(keys, order))


def carried_tokens(rows: DataFrame, tokens: str, reset: Column, keys, order) -> DataFrame:
    """Adds ``carried``: tokens gathered before the row since the last row that resets."""
    none, before = F.lit(0), _past(keys, order, including=False)
    counted = F.when(~reset, F.col(tokens))
    rows = rows.withColumns({"__sum": F.coalesce(F.sum(counted).over(_past(keys, order)), none), "__till": F.coalesce(F.sum(counted).over(before), none)})
    left = F.coalesce(F.last(F.when(reset, F.col("__sum")), ignorenulls=True).over(before), none)
    return rows.withColumn("carried", (F.col("__till") - left).cast("long")).drop("__sum", "__till")


def stream_turn(speaks: Column, closes: Column, keys, order) -> Column:
    """Turn of a stream: a row that speaks begins a new turn if the last row that spoke or closed had closed, or there was none."""
    before = F.last(F.when(speaks | closes, closes), ignorenulls=True).over(_past(keys, order, including=False))
    return F.sum((speaks & F.coalesce(before, F.lit(True))).cast("int")).over(_past(keys, order))


def message_turn(rows: DataFrame, key: str, keys, order) -> DataFrame:
    """Adds ``turn``: the rank of a key's first appearance; null without a key."""
    first = F.min(F.when(F.col(key).isNotNull(), F.struct(*order))).over(W.partitionBy(*keys, key))
    return rows.withColumn("__first", first).withColumn("turn", appearance_rank("__first", keys)).drop("__first")


def appearance_rank(first: str, keys) -> Column:
    """Rank of ``first``, the place where a row's key first appears; null where that is null."""
    return F.when(F.col(first).isNotNull(), F.dense_rank().over(W.partitionBy(*keys).orderBy(F.col(first).asc_nulls_last()))).cast("int")


def sticky_outcome(success: Column) -> Column:
    """False if any is false, else true if any is true, else null."""
    return F.bool_and(success)


def latest_origin(rows: DataFrame, is_origin: Column, is_poll: Column, key: str, request: str, keys, order, identity: str) -> DataFrame:
    """As-of link of polls: the latest origin of the key before the poll, only if it has the poll's request. Adds ``linked_to``."""
    held = F.when(is_origin, F.struct(F.col(identity).alias("id"), F.col(request).alias("request")))
    latest = F.last(held, ignorenulls=True).over(_past([*keys, key], order, including=False))
    return rows.withColumn("__o", latest).withColumn("linked_to", F.when(is_poll & (F.col("__o.request") == F.col(request)), F.col("__o.id"))).drop("__o")


def empty_poll_reduction(rows: DataFrame, keys, order: str, tokens: str, empty: str, complete: str) -> DataFrame:
    """Tokens of empty polls up to the last completion of each key; 0 without one."""
    last = F.max(F.when(F.col(complete), F.col(order))).over(W.partitionBy(*keys))
    return rows.withColumn("__last", last).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col(empty) & (F.col(order) <= F.col("__last")), F.col(tokens))), F.lit(0)).cast("long").alias("poll_reduction_tokens"))


def identical_results(rows: DataFrame, session: str, order: str, epoch: str, content: str, turn: str, identity: str, tokens: str, window: int = REUSE_TURNS, kept: int = REUSE_KEYS, cost: Column | None = None) -> DataFrame:
    """Reuse of an equal result of the same epoch within ``window`` turns, if fewer than ``kept`` other contents came between: repeat_of, reduction.

    ``cost``: tokens of the reference, over a column ``earlier``; ``REUSE_FLOOR`` at least.
    """
    here = [session, epoch]
    rows = rows.withColumn("__n", F.row_number().over(W.partitionBy(*here).orderBy(order)))
    mine = W.partitionBy(*here, content).orderBy(order)
    before = F.lag(F.struct(F.col(identity).alias("id"), F.col(turn).alias("turn"), F.col("__n").alias("n"))).over(mine)
    rows = rows.withColumns({"__b": before, "__next": F.lead("__n").over(mine)})
    gap = F.col(turn) - F.col("__b.turn")
    rows = rows.withColumn("__hit", F.coalesce((gap > 0) & (gap <= window), F.lit(False)))
    # Only where ``kept`` rows lie between can so many contents: those few rows count the last occurrences between.
    far = rows.where(F.col("__hit") & (F.col("__n") - F.col("__b.n") > kept)).select(*[F.col(c).alias(f"__{c}") for c in here], F.col("__n").alias("__at"), F.col("__b.n").alias("__from"))
    last = rows.select(*here, "__n", "__next").withColumnRenamed("__n", "__m")
    between = last.join(far, (F.col(session) == F.col(f"__{session}")) & (F.col(epoch) == F.col(f"__{epoch}")) & (F.col("__m") > F.col("__from")) & (F.col("__m") < F.col("__at")) & (F.coalesce("__next", F.col("__at")) >= F.col("__at")))
    gone = between.groupBy(f"__{session}", f"__{epoch}", "__at").agg(F.count("*").alias("__k")).where(F.col("__k") >= kept)
    rows = rows.join(gone, (F.col(session) == F.col(f"__{session}")) & (F.col(epoch) == F.col(f"__{epoch}")) & (F.col("__n") == F.col("__at")), "left")
    rows = rows.withColumn("earlier", F.when(F.col("__hit") & F.col("__k").isNull(), F.col("__b.id")))
    least = F.lit(REUSE_FLOOR) if cost is None else F.greatest(F.lit(REUSE_FLOOR), cost)
    reduction = F.when(F.col("earlier").isNotNull(), F.greatest(F.lit(0), F.col(tokens) - least)).otherwise(0).cast("long")
    return rows.withColumns({"repeat_of": F.col("earlier"), "reduction": reduction}).drop("__n", "__b", "__next", "__hit", "__k", "__at", "earlier", f"__{session}", f"__{epoch}")


def counter_changes(rows: DataFrame, session: str, order: str, turn: str, totals: str) -> DataFrame:
    """Changes of cumulative counters (an array): equal snapshots drop out; ``delta`` is the change, ``trusted`` if it is the only one of its turn."""
    before = F.lag(totals).over(W.partitionBy(session).orderBy(order))
    rows = rows.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col(totals)))
    start = F.coalesce("__b", F.transform(totals, lambda x: x * 0))
    return rows.withColumns({"delta": F.zip_with(totals, start, lambda a, b: a - b), "trusted": F.count("*").over(W.partitionBy(session, turn)) == 1}).drop("__b")


def first_of(rows: DataFrame, keys, order) -> DataFrame:
    """The first row of each key (first wins)."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


# --- sessions ---------------------------------------------------------------------------------------------------------

BY, AT = ["path"], ["at"]


def _last(value: Column, order=AT) -> Column:
    return F.last(value, ignorenulls=True).over(_past(BY, order))


#: Bytes of events that one task sorts, as reckoned by ``tasks_for``; a file's events stay together.
TASK_BYTES = 64 << 20
#: Bytes of an event besides its texts, as Spark's sorts hold it.
EVENT_BYTES = 512


def tasks_for(events: DataFrame) -> int:
    """Tasks among which events are divided by file. The session's own number of partitions doesn't grow with the input, and what a task sorts then would."""
    texts = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("path", "text", "raw")), F.lit(EVENT_BYTES))
    held = events.agg(F.sum(texts.cast("long"))).first()[0] or 0
    return max(math.ceil(held / TASK_BYTES), min(events.sparkSession.sparkContext.defaultParallelism, math.ceil(held / (TASK_BYTES >> 3))), 1)


def sequenced(events: DataFrame, source: str | None = None, tasks: int | None = None) -> DataFrame:
    """Events of each file that its provider has, without repeats, with source, cwd, request, epoch, turn and carried tokens.

    Each sort of a task holds all its events, so there are four: by record id, by key, by a key's first place, and by place.
    """
    kind = F.col("kind")
    whole = W.partitionBy(*BY)
    e = events.repartition(tasks or tasks_for(events), *BY).sortWithinPartitions(*BY, "uid")
    first = F.min(F.when(kind == "start", F.struct("at", F.col("text").alias("log")))).over(whole)
    e = e.withColumn("__s", first)
    e = e.withColumns({"source": F.lit(source) if source else F.coalesce("__s.log", F.lit("unknown")), "__from": F.lit(-1) if source else F.coalesce("__s.at", F.lit(0))})
    e = e.where((F.col("log") == "") | ((F.col("log") == F.col("source")) & (F.col("at") >= F.col("__from"))))
    # A record that comes again under its id is left out (what it says of session and folder stays).
    again = F.col("uid").isNotNull() & (F.col("rec") > F.min("rec").over(W.partitionBy(*BY, "uid")))
    e = e.withColumn("__again", again).where(~F.col("__again"))
    # A call under a known id is only speech; a message's turn is its key's.
    own = F.when(kind == "call", F.concat(F.lit("c"), "key")).when(kind == "turn", F.coalesce(F.concat(F.lit("k"), F.nullif("key", F.lit(""))), F.concat(F.lit("r"), F.col("rec").cast("string"))))
    e = e.withColumn("__slot", own)
    mine = W.partitionBy(*BY, "__slot").orderBy(*AT)
    e = e.withColumns({"__nth": F.row_number().over(mine), "__first": F.when(kind == "turn", F.first("at").over(mine))})
    e = e.withColumn("turn", appearance_rank("__first", BY))
    twice = (kind == "call") & (F.col("key") != "") & (F.col("__nth") > 1)
    # A user item that says what the event before it said is its echo.
    said = F.last(F.when(kind == "ask", F.struct("tool", "text")), ignorenulls=True).over(_past(BY, AT, including=False))
    e = e.withColumns({"__said": said, "__twice": twice})
    echo = (kind == "ask") & (F.col("tool") == "item") & (F.col("__said.tool") == "event") & (F.col("__said.text") == F.col("text"))
    e = e.withColumn("__echo", F.coalesce(echo, F.lit(False))).withColumn("kind", F.when(F.col("__twice"), "repeat").otherwise(kind))
    e = e.withColumn("asks", (F.col("kind") == "ask") & ~F.col("__echo") & (F.length("text") > 0))
    speaks = F.col("kind").isin("say", "think", "call", "repeat")
    streamed = stream_turn(speaks, F.col("kind").isin("ask", "result"), BY, AT)
    e = e.withColumn("__streamed", streamed)
    e = e.withColumn("turn", F.when(F.col("source") == "codex", F.col("__streamed")).otherwise(F.coalesce(_last(F.col("turn")), F.lit(0))).cast("int"))
    resets = F.col("asks") | (F.col("kind") == "call")
    e = e.withColumn("__thought", F.when(F.col("kind") == "think", F.col("size")).otherwise(0))
    e = carried_tokens(e, "__thought", resets, BY, AT)
    return e.withColumns({
        "request": request_number(F.col("asks"), BY, AT).cast("int"), "epoch": request_number(F.col("asks") | (F.col("kind") == "compact"), BY, AT),
        "cwd": F.coalesce(_last(F.when(F.col("kind") == "meta", F.col("raw"))), F.lit("unknown")),
    }).drop("__s", "__from", "__again", "__slot", "__nth", "__first", "__said", "__twice", "__echo", "__streamed", "__thought")


def file_rows(e: DataFrame) -> DataFrame:
    """One row a file: digest, session name, project, first time stamp, requests, warnings and error."""
    kind = F.col("kind")
    of = lambda k, v, f=F.max: f(F.when(kind == k, F.struct("at", F.col(v).alias("v"))))[F.lit("v")]
    latest = lambda v: F.max(F.when((kind == "meta") & F.col(v).isNotNull(), F.struct("at", F.col(v).alias("v"))))["v"]
    gathered = lambda c, v: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", v.alias("v"))))), lambda x: x["v"])
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    out = e.groupBy("path").agg(
        F.max("mtime").alias("mtime"), F.max("bytes").alias("size"), of("file", "digest").alias("digest"), latest("text").alias("named"), latest("raw").alias("project"), of("stamp", "text", F.min).alias("timestamp"),
        gathered(F.col("asks"), F.substring("text", 1, 1000)).alias("requests"), gathered(kind == "warning", F.col("text")).alias("warnings"), of("error", "text").alias("error"), F.max("source").alias("source"))
    return out.withColumns({"session_id": F.coalesce("named", stem), "project": F.coalesce("project", F.lit("unknown")), "timestamp": F.coalesce("timestamp", F.lit(""))}).drop("named")


def link_polls(acts: DataFrame) -> DataFrame:
    """(path, key, linked_to) of polls that belong to a process of the same request.

    ``acts``: path, at, key, request, poll (the process that a call polls; null for other calls), process (that a result names; null in calls).
    """
    def run(rows: pa.Table) -> pa.Table:
        linked, origin = {}, {}
        for r in rows.sort_by("at").to_pylist():
            if r["poll"]:
                known = origin.get(r["poll"])
                if known and known[1] == r["request"]:
                    linked[r["key"]] = known[0]
            elif r["process"] and r["key"] not in linked:
                origin[r["process"]] = (r["key"], r["own"])
        path = rows.column("path")[0].as_py() if linked else None
        return pa.table({"path": pa.array([path] * len(linked), pa.string()), "key": pa.array(linked, pa.string()), "linked_to": pa.array(linked.values(), pa.string())})

    # Sessions without a poll or without a named process have no link.
    both = W.partitionBy("path")
    acts = acts.withColumns({"__p": F.max(F.col("poll").isNotNull()).over(both), "__o": F.max(F.col("process").isNotNull()).over(both)}).where("__p and __o")
    return acts.select("path", "at", "key", "request", "own", "poll", "process").groupBy("path").applyInArrow(run, "path string, key string, linked_to string")


def calls_of(e: DataFrame, read_call) -> DataFrame:
    """One row a call: its place, what it runs (``read_call``: column function of tool, arguments and folder), and what led to it."""
    calls = e.where(F.col("kind") == "call").withColumn("r", read_call(F.col("tool"), F.col("raw"), F.col("cwd")))
    one = F.when(F.size("r.operations") == 1, F.col("r.operations")[0])
    calls = calls.withColumn("one", one).select(
        "path", "at", "line", "tool", "key", F.col("text").alias("timestamp"), "request", "turn", "source", F.col("raw").alias("raw_arguments"), (F.col("carried") + F.col("size")).alias("assistant_tokens"),
        F.col("r.command").alias("command"), F.col("r.operations").alias("operations"), F.coalesce("one.kind", F.lit("compound")).alias("category"),
        F.when(F.col("one.kind") == "poll", F.col("one.process_id")).alias("poll"), F.coalesce(~F.col("one.kind").isin("unknown", "poll"), F.lit(False)).alias("single"), F.col("one.label").alias("label"))
    return calls.withColumn("position", F.row_number().over(W.partitionBy("path").orderBy("at")) - 1)


def results_of(e: DataFrame, calls: DataFrame) -> DataFrame:
    """Results of known calls, each once, with what the call is."""
    own = calls.where(F.col("key") != "").select(F.col("path").alias("p"), F.col("key").alias("k"), F.col("at").alias("called"), F.col("request").alias("own"), "poll", "single", "label", "tool", "operations")
    rows = e.where((F.col("kind") == "result") & F.col("key").isNotNull()).select("path", "at", "line", "key", "turn", "epoch", "size", "flag", "digest", F.col("raw").alias("given"), "inner", "short", "success", "process", "complete", "blank")
    rows = rows.join(own, (F.col("path") == F.col("p")) & (F.col("key") == F.col("k")) & (F.col("at") > F.col("called"))).drop("p", "k")
    return first_of(rows, ["path", "key", "flag", "digest"], ["at"])


def linked_actions(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with all that their results, and those of polls that belong to them, say."""
    named = results.where(F.col("process") != "").select("path", "at", "key", F.lit(None).cast("int").alias("request"), "own", F.lit(None).cast("string").alias("poll"), "process")
    polled = calls.where(F.coalesce(F.col("poll") != "", F.lit(False))).select("path", "at", "key", "request", F.lit(None).cast("int").alias("own"), "poll", F.lit(None).cast("string").alias("process"))
    links = link_polls(polled.unionByName(named))
    r = results.join(links.withColumnsRenamed({"path": "lp", "key": "lk"}), (F.col("path") == F.col("lp")) & (F.col("key") == F.col("lk")), "left").drop("lp", "lk")
    linked = F.col("linked_to").isNotNull()
    r = r.withColumns({"target": F.coalesce("linked_to", "key"), "empty": linked & ~F.col("complete") & F.col("blank")})
    aim = calls.where(F.col("key") != "").select(F.col("path").alias("tp"), F.col("key").alias("tk"), F.col("single").alias("t_single"), F.col("label").alias("t_label"))
    r = r.join(aim, (F.col("path") == F.col("tp")) & (F.col("target") == F.col("tk"))).drop("tp", "tk")
    there = _past(["path", "target"], AT)
    r = r.withColumns({"__total": F.sum("size").over(there), "__so_far": sticky_outcome(F.col("success")).over(there), "__nth": F.count("*").over(there)})
    short = F.when(F.col("t_single") & F.col("t_label").isin(*STATUS_OUTPUT) & F.col("__so_far") & F.col("complete"), F.col("__total") - F.col("size") + F.col("short"))
    r = r.withColumn("compact", short)

    whole = r.groupBy("path", "target").agg(
        F.sum("size").alias("output_tokens"), sticky_outcome(F.col("success")).alias("outcome"), F.bool_or("complete").alias("completion_observed"),
        F.array_sort(F.collect_list(F.struct("at", "line"))).alias("at_lines"), F.max_by("compact", F.when(F.col("compact").isNotNull(), F.col("at"))).alias("compact_output_tokens"))
    polls = empty_poll_reduction(r, ["path", "target"], "at", "size", "empty", "complete")
    own = r.groupBy("path", "key").agg(F.bool_or("empty").alias("empty_poll"), F.max_by("success", "at").alias("last_success"), F.max_by("process", F.when((F.col("process") != "") & ~linked, F.col("at"))).alias("named"))

    shell = F.lower(F.element_at(F.split("tool", r"\."), -1)).isin("exec_command", "shell", "shell_command")
    labels = F.transform("operations", lambda o: o["label"])
    reads = (F.size(labels) > 0) & (F.size(F.array_except(labels, F.array(*map(F.lit, READ_ONLY)))) == 0)
    reused = r.where(~linked & (F.col("process") == "") & (F.col("__nth") == 1) & reads & F.coalesce("__so_far", F.lit(True)))
    content = F.when(shell, F.col("inner")).otherwise(F.col("given"))
    reused = reused.withColumn("content", F.when(content.isNotNull(), F.concat_ws("|", F.array_join(F.transform("operations", lambda o: o["exact"]), ","), content))).where(F.col("content").isNotNull())
    # The form of a reference to an earlier result, whose length counts.
    reference = F.ceil(F.length(F.concat(F.lit('{"unchanged": true, "previous_result": '), F.expr("regexp_extract(to_json(struct(earlier)), '(?s)^.[^:]*:(.*).$', 1)"), F.lit(', "full_result_available": true}'))) / 4)
    reused = identical_results(reused.select("path", "at", "epoch", "content", "turn", "key", "size"), "path", "at", "epoch", "content", "turn", "key", "size", cost=reference)
    reused = reused.select("path", F.col("key").alias("target"), "repeat_of", F.col("reduction").alias("repeat_output_reduction_tokens"))

    a = calls
    for df, at in ((links, "key"), (own, "key"), (whole, "target"), (polls, "target"), (reused, "target")):
        other = df.withColumnsRenamed({"path": "__path", at: "__key"})
        a = a.join(other, (F.col("path") == F.col("__path")) & (F.col("key") == F.col("__key")) & (F.col("key") != ""), "left").drop("__path", "__key")
    none = lambda name, value: F.coalesce(name, F.lit(value))
    linked = F.col("linked_to").isNotNull()
    return a.select(
        "path", "at", "position", "tool", "command", "raw_arguments", F.col("key").alias("call_id"), "line", "timestamp", "request", "turn", "source", "assistant_tokens",
        none("output_tokens", 0).alias("output_tokens"), F.when(linked, F.col("last_success")).otherwise(F.col("outcome")).alias("success"), "category", "operations",
        none("linked_to", "").alias("linked_to"), F.coalesce("named", "poll", F.lit("")).alias("process_id"), F.when(F.col("single"), "single_operation").otherwise("unattributed_batch").alias("output_attribution"),
        "compact_output_tokens", F.when(F.col("compact_output_tokens").isNotNull(), "validation_status_contract").otherwise("").alias("reduction_reason"),
        F.coalesce(F.transform("at_lines", lambda x: x["line"]), F.array().cast("array<int>")).alias("result_lines"), none("poll_reduction_tokens", 0).alias("poll_reduction_tokens"),
        none("completion_observed", False).alias("completion_observed"), none("repeat_output_reduction_tokens", 0).alias("repeat_output_reduction_tokens"), none("repeat_of", "").alias("repeat_of"),
        none("empty_poll", False).alias("empty_poll"))


def recorded_usage(e: DataFrame, actions: DataFrame) -> DataFrame:
    """One row for each turn with calls and whole counters. Counters of a message must agree within its turn; of a stream, a change must be the last call's."""
    uses = e.where((F.col("kind") == "use") & (F.col("turn") > 0)).select("path", "at", "turn", "source", "key", "counts", "totals")
    stream = counter_changes(uses.where("source = 'codex'"), "path", "at", "turn", "totals")
    given = F.array(F.col("counts")[0], F.col("counts")[1], F.col("counts")[3])
    right = F.col("trusted") & (F.col("delta") == given) & F.col("counts")[1].between(0, F.col("counts")[0])
    stream = stream.groupBy("path", "turn").agg(F.max_by("counts", "at").alias("counts"), F.max_by(right, "at").alias("trusted"), F.lit("codex").alias("provider"), F.lit("").alias("response"))
    talk = uses.where("source = 'claude'").groupBy("path", "turn").agg(
        F.max_by("counts", "at").alias("c"), F.max(F.col("counts")[3]).alias("most"), (F.count_distinct(F.slice("counts", 1, 3)) == 1).alias("trusted"), F.lit("claude").alias("provider"), F.max_by("key", "at").alias("response"))
    talk = talk.withColumn("counts", F.concat(F.slice("c", 1, 3), F.array("most"))).drop("c", "most")
    whole = F.forall("counts", lambda x: x >= 0) & (F.col("counts")[1] + F.col("counts")[2] <= F.col("counts")[0])
    counted = stream.unionByName(talk).where(whole)
    done = actions.where("completion_observed").select(F.col("path").alias("dp"), F.col("call_id").alias("dk"), F.lit(True).alias("done"))
    polled = actions.join(done, (F.col("path") == F.col("dp")) & (F.col("linked_to") == F.col("dk")) & (F.col("linked_to") != ""), "left")
    turns = polled.groupBy(F.col("path").alias("ap"), F.col("turn").alias("aturn")).agg(
        F.array_join(F.array_sort(F.collect_list("call_id")), "|").alias("ids"), F.bool_and(F.col("empty_poll") & F.coalesce("done", F.lit(False))).alias("empty_poll"))
    seen = e.where((F.col("kind") == "say") & ~F.col("blank")).select(F.col("path").alias("vp"), F.col("turn").alias("vturn")).distinct().withColumn("visible_text", F.lit(True))
    rows = counted.join(turns, (F.col("path") == F.col("ap")) & (F.col("turn") == F.col("aturn")))
    rows = rows.join(seen, (F.col("path") == F.col("vp")) & (F.col("turn") == F.col("vturn")), "left")
    identity = F.concat_ws("|", "provider", F.coalesce(F.nullif("response", F.lit("")), "ids"))
    return rows.select(
        "path", "turn", hash_text(identity).alias("usage_key"), F.col("counts")[0].alias("input_tokens"), F.col("counts")[1].alias("cached_input_tokens"), F.col("counts")[2].alias("cache_write_input_tokens"),
        F.col("counts")[3].alias("output_tokens"), F.coalesce("visible_text", F.lit(False)).alias("visible_text"), "trusted", "empty_poll")
