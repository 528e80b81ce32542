"""Queries over the driver's tables and their SQL twins.

The tables hold no tool calls, so an action log is derived from ``events``: a user is a session, an event an action of one
operation. The same operators run on it as on parsed transcripts; each query has a DuckDB statement beside it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import READ_ONLY, STATUS_OUTPUT, WORKFLOW
from ..functions.scalar import estimate_tokens, hash_text
from ..operators import audit, linking, mining
from ..shared import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with its SQL twin if it has one."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the action log ---------------------------------------------------------------------------------------------------


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of events, with the columns that mining reads and a few more."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    even = F.col("k") % 2 == 0
    kind = F.col("event_type")
    label = (
        F.when(kind == "click", "run_tests")
        .when(kind == "purchase", F.when(even, "github_pr_checks").otherwise("github_ci_status"))
        .when(kind == "view", F.when(even, "git_status").otherwise("git_log"))
        .when(kind == "signup", F.when(even, "git_diff_stat").otherwise("read_file"))
        .otherwise(F.when(even, "unknown").otherwise("build"))
    )
    by_user = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.withColumn("label", label).withColumns({
        "session": F.col("user_id"), "position": F.row_number().over(by_user) - 1,
        "event_key": F.concat_ws("|", "user_id", "event_type", "k"), "request": F.floor((F.unix_timestamp("ts") + 3 * 86400) / 604800).cast("long"),
        "turn": F.dense_rank().over(W.partitionBy("user_id").orderBy(F.date_trunc("hour", "ts"))), "output_tokens": F.floor(F.col("value") * 100).cast("long"),
        "success": F.when(F.col("k") % 10 == 0, F.lit(None)).when(F.col("k") % 7 == 0, F.lit(False)).otherwise(F.lit(True)),
    })
    short = F.greatest(F.lit(200).cast("long"), F.floor(F.col("output_tokens") / 4).cast("long"))
    return rows.withColumns({
        "assistant_tokens": F.col("k").cast("long"), "linked_to": F.lit(""),
        "compact_output_tokens": F.when(F.col("success") & F.col("label").isin(*STATUS_OUTPUT), short),
        "poll_reduction_tokens": F.when(F.col("k") % 13 == 0, F.floor(F.col("output_tokens") / 8).cast("long")).otherwise(F.lit(0).cast("long")),
        "repeat_output_reduction_tokens": F.when((F.col("k") % 17 == 0) & F.col("label").isin(*READ_ONLY), F.floor(F.col("output_tokens") / 2).cast("long")).otherwise(F.lit(0).cast("long")),
        "operations": F.array(F.struct("label", hash_text(F.col("label")).alias("template"), hash_text(F.concat_ws("|", "label", F.col("k") % 3)).alias("exact"))),
    })


def session_table(log: DataFrame) -> DataFrame:
    rows = log.select("session").distinct()
    return rows.select(
        "session", F.concat_ws(":", F.col("session") % 2, "session").alias("logical"), F.concat(F.lit("p"), F.col("session") % 10).alias("project"),
        F.concat(F.lit("p"), F.col("session") % 10).alias("project_key"), F.when(F.col("session") % 3 == 0, "cwd").otherwise("git").alias("project_kind"))


def mined(spark, sf_dir, options=mining.Options()):
    log = action_log(spark, sf_dir).drop("event_id", "ts", "user_id", "event_type", "value", "k")
    return mining.mine(log, options, written), session_table(log)


def _in(labels) -> str:
    return ", ".join(f"'{x}'" for x in labels)


#: SQL twin of the action log and of the operators above it, as common table expressions.
LOG = f"""
e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
lab AS (SELECT *, CASE event_type WHEN 'click' THEN 'run_tests' WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'github_pr_checks' ELSE 'github_ci_status' END
   WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'git_status' ELSE 'git_log' END WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'git_diff_stat' ELSE 'read_file' END
   ELSE CASE WHEN k % 2 = 0 THEN 'unknown' ELSE 'build' END END AS label FROM e),
a0 AS (SELECT *, user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position,
   user_id || '|' || event_type || '|' || k AS event_key, CAST(floor((epoch(ts) + 3 * 86400) / 604800) AS BIGINT) AS request,
   dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts)) AS turn, CAST(floor(value * 100) AS BIGINT) AS output_tokens,
   CASE WHEN k % 10 = 0 THEN NULL WHEN k % 7 = 0 THEN false ELSE true END AS success FROM lab),
log AS (SELECT *, CAST(k AS BIGINT) AS assistant_tokens,
   CASE WHEN success AND label IN ({_in(STATUS_OUTPUT)}) THEN greatest(200, CAST(floor(output_tokens / 4) AS BIGINT)) END AS compact_output_tokens,
   CASE WHEN k % 13 = 0 THEN CAST(floor(output_tokens / 8) AS BIGINT) ELSE 0 END AS poll_reduction_tokens,
   CASE WHEN k % 17 = 0 AND label IN ({_in(READ_ONLY)}) THEN CAST(floor(output_tokens / 2) AS BIGINT) ELSE 0 END AS repeat_output_reduction_tokens,
   substr(sha256(label), 1, 24) AS template, substr(sha256(label || '|' || (k % 3)), 1, 24) AS exact FROM a0),
sess AS (SELECT DISTINCT session, (session % 2) || ':' || session AS logical, 'p' || (session % 10) AS project, CASE WHEN session % 3 = 0 THEN 'cwd' ELSE 'git' END AS project_kind FROM log),
rep AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY (success IS NOT NULL) DESC, output_tokens DESC, session, position) > 1 AS replayed FROM log),
mark AS (SELECT *, label = 'unknown' AND NOT replayed AS opaque,
   coalesce(NOT replayed AND request <> last_value(CASE WHEN NOT replayed THEN request END IGNORE NULLS) OVER (PARTITION BY session ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS new_request FROM rep),
isl AS (SELECT *, NOT replayed AND NOT opaque AND label IN ({_in(WORKFLOW)}) AS member,
   sum(CAST(replayed OR opaque OR label NOT IN ({_in(WORKFLOW)}) AS INT) + CAST(new_request AS INT)) OVER (PARTITION BY session ORDER BY position) AS island FROM mark),
packs AS (SELECT *, (row_number() OVER (PARTITION BY session, island ORDER BY position) - 1) // 10 AS pack FROM isl WHERE member),
runs AS (SELECT session, island, pack, count(*) AS n, count(DISTINCT turn) AS turns, count(DISTINCT label) AS labels,
   CASE WHEN bool_or(label IN ('run_tests', 'build', 'lint', 'git_diff_check')) THEN 'validation_report' WHEN bool_or(label LIKE 'github\\_%' ESCAPE '\\') THEN 'ci_report' ELSE 'repository_report' END AS family,
   min(position) AS start_, max(position) AS end_, '["' || string_agg(label, '", "' ORDER BY position) || '"]' AS sequence,
   substr(sha256(string_agg(template, '|' ORDER BY position)), 1, 24) AS signature, substr(sha256(string_agg(exact, '|' ORDER BY position)), 1, 24) AS exact,
   sum(output_tokens) AS output, sum(CASE WHEN compact_output_tokens IS NULL THEN 0 ELSE greatest(0, output_tokens - compact_output_tokens) END + poll_reduction_tokens) AS reduction,
   bool_and(success IS NOT NULL) AS known, coalesce(bool_or(NOT success), false) AS failed, sum(assistant_tokens) AS assistant FROM packs GROUP BY ALL HAVING count(*) >= 2),
bundles AS (SELECT * FROM runs WHERE n >= 2 AND turns >= 2 AND labels >= 2),
single AS (
   SELECT 'validation_output' AS family, label AS l, template AS t, exact AS x, greatest(0, output_tokens - compact_output_tokens) AS status, 0 AS poll, 0 AS reuse, * FROM mark
     WHERE NOT replayed AND NOT opaque AND output_tokens > compact_output_tokens
   UNION ALL SELECT 'await_completion', 'await_completion', 'linked-process-completion', 'linked-process-completion', 0, poll_reduction_tokens, 0, * FROM mark WHERE NOT replayed AND poll_reduction_tokens > 0
   UNION ALL SELECT 'reuse_results', 'reuse_unchanged_result', 'identical-read-result', 'identical-read-result', 0, 0, repeat_output_reduction_tokens, * FROM mark WHERE NOT replayed AND repeat_output_reduction_tokens > 0),
eps AS (
   SELECT family, session, start_, end_, sequence, signature, exact, turns, output, reduction, known, failed, assistant FROM bundles
   UNION ALL SELECT family, session, position, position, '["' || l || '"]', substr(sha256(t), 1, 24), substr(sha256(x), 1, 24), 1, output_tokens, status + poll + reuse, success IS NOT NULL, coalesce(NOT success, false), assistant_tokens FROM single),
ep AS (SELECT eps.*, logical, project, project_kind FROM eps JOIN sess USING (session)),
each_ AS (
   SELECT b.family, p.session, p.position, CASE WHEN p.compact_output_tokens IS NULL THEN 0 ELSE greatest(0, p.output_tokens - p.compact_output_tokens) END AS status, p.poll_reduction_tokens AS poll, 0 AS reuse
     FROM packs p JOIN bundles b ON p.session = b.session AND p.island = b.island AND p.pack = b.pack
   UNION ALL SELECT family, session, position, status, poll, reuse FROM single),
members AS (
   SELECT family, session, position, mechanism, max(reduction) AS reduction FROM (
     SELECT family, session, position, 'validation_status' AS mechanism, status AS reduction FROM each_ UNION ALL SELECT family, session, position, 'empty_poll', poll FROM each_
     UNION ALL SELECT family, session, position, 'unchanged_result', reuse FROM each_) WHERE reduction > 0 GROUP BY ALL),
stats AS (SELECT family, count(*) AS n, count(DISTINCT logical) AS sessions, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(output) AS BIGINT) AS output, CAST(sum(reduction) AS BIGINT) AS reduction,
   CAST(sum(CAST(known AS INT)) AS BIGINT) AS known, CAST(sum(CAST(failed AS INT)) AS BIGINT) AS failed, CAST(sum(CAST(known AND NOT failed AS INT)) AS BIGINT) AS success,
   count(DISTINCT CASE WHEN project_kind = 'git' THEN project END) AS repos, count(DISTINCT CASE WHEN project_kind <> 'git' THEN project END) AS unresolved FROM ep GROUP BY family),
rec AS (SELECT family, CAST(coalesce(sum(CASE WHEN k >= 2 THEN n END), 0) AS BIGINT) AS recurring FROM (SELECT family, signature, count(*) AS n, count(DISTINCT logical) AS k FROM ep GROUP BY ALL) GROUP BY family),
score AS (SELECT s.*, r.recurring, s.reduction * (r.recurring / s.n) AS score, substr(sha256('v2:' || family), 1, 12) AS id,
   CASE family WHEN 'reuse_results' THEN 'result_reuse' WHEN 'await_completion' THEN 'polling_reducer' WHEN 'validation_output' THEN 'result_reducer' ELSE 'workflow_bundle' END AS opportunity_type,
   CASE family WHEN 'reuse_results' THEN 'reuse_unchanged_results' WHEN 'await_completion' THEN 'await_process_completion' WHEN 'validation_report' THEN 'validate_and_report'
     WHEN 'validation_output' THEN 'summarize_validation_results' WHEN 'ci_report' THEN 'collect_ci_status' WHEN 'repository_report' THEN 'summarize_repository_state' END AS name
   FROM stats s JOIN rec r USING (family) WHERE n >= 2 AND sessions >= 2 AND s.reduction * (r.recurring / s.n) > 0),
cred AS (SELECT * FROM (SELECT m.*, s.id, row_number() OVER (PARTITION BY m.session, m.position, mechanism ORDER BY opportunity_type = 'workflow_bundle' DESC, score DESC, id) AS r FROM members m JOIN score s USING (family)) WHERE r = 1),
occ AS (SELECT s.id, ep.family, session, start_, min(end_) AS end_ FROM ep JOIN score s USING (family) GROUP BY ALL)
"""


def sql(body: str) -> str:
    return f"WITH {LOG}\n{body}"


STATS = ["family", "n", "sessions", "turns", "output", "reduction", "known", "failed", "success", "repos", "unresolved"]


@query(sql("SELECT family, n, sessions, turns, output, reduction, known, failed, success, repos, unresolved, recurring, score, id, opportunity_type, name FROM score"))
def family_scores(spark, sf_dir):
    """Families of the log with their scores."""
    m, sessions = mined(spark, sf_dir)
    return mining.scores(mining.located(m.episodes, sessions)).select(*STATS, "recurring", "score", "id", "opportunity_type", "name")


@query(sql("SELECT session, position, label, replayed FROM rep"))
def replay_flag(spark, sf_dir):
    """W1 with J4: every action with its flag."""
    return mining.with_replay_flag(action_log(spark, sf_dir)).select("session", "position", "label", "replayed")


@query(sql("SELECT session, position, event_key, output_tokens FROM rep WHERE NOT replayed"))
def replay_dedup(spark, sf_dir):
    """The winners alone."""
    return mining.with_replay_flag(action_log(spark, sf_dir)).where("not replayed").select("session", "position", "event_key", "output_tokens")


@query(sql("SELECT session, position, label, CAST(dense_rank() OVER (PARTITION BY session ORDER BY island) AS BIGINT) AS island, CAST(pack AS BIGINT) AS pack FROM packs"))
def episode_segments(spark, sf_dir):
    """Islands between boundaries, packed."""
    marked = mining.with_boundaries(mining.with_replay_flag(mining.compact(action_log(spark, sf_dir))))
    rows = mining.packed(mining.islands(marked), 10)
    island = F.dense_rank().over(W.partitionBy("session").orderBy("island")).cast("long")
    return rows.select("session", "position", "label", island.alias("island"), F.col("pack").cast("long").alias("pack"))


@query(sql("SELECT family, session, start_ AS start, end_ AS end, sequence, signature, exact, CAST(turns AS BIGINT) AS turns, CAST(output AS BIGINT) AS output, CAST(reduction AS BIGINT) AS reduction, known, failed, CAST(assistant AS BIGINT) AS assistant FROM eps"))
def episode_rollup(spark, sf_dir):
    """All episodes."""
    return mined(spark, sf_dir)[0].episodes.select(*mining.EPISODE)


@query(sql(f"SELECT {', '.join(STATS)} FROM stats"))
def family_stats(spark, sf_dir):
    m, sessions = mined(spark, sf_dir)
    return mining.family_stats(mining.located(m.episodes, sessions)).select(*STATS)


@query(sql("SELECT family, recurring FROM rec"))
def family_recurrence(spark, sf_dir):
    m, sessions = mined(spark, sf_dir)
    return mining.recurrence(mining.located(m.episodes, sessions))


@query(sql("SELECT * FROM (SELECT family, row_number() OVER (PARTITION BY family ORDER BY n DESC, sequence) AS rank, sequence, n FROM (SELECT family, sequence, count(*) AS n FROM ep GROUP BY ALL)) WHERE rank <= 8"))
def variants_topk(spark, sf_dir):
    """The eight most frequent sequences of each family."""
    return mining.variants(mined(spark, sf_dir)[0].episodes)


@query(sql("SELECT family, string_agg(project, ',' ORDER BY project) AS projects FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY project) AS r FROM (SELECT DISTINCT family, project FROM ep)) WHERE r <= 50 GROUP BY family"))
def project_names(spark, sf_dir):
    """J5, O6."""
    m, sessions = mined(spark, sf_dir)
    return mining.projects(mining.located(m.episodes, sessions)).select("family", F.array_join("projects", ",").alias("projects"))


@query(sql("SELECT family, repos, unresolved FROM stats"))
def project_counts(spark, sf_dir):
    """A10: distinct projects by kind."""
    m, sessions = mined(spark, sf_dir)
    return mining.family_stats(mining.located(m.episodes, sessions)).select("family", "repos", "unresolved")


@query(sql("SELECT family, session, position, mechanism, CAST(reduction AS BIGINT) AS reduction FROM members"))
def member_credit(spark, sf_dir):
    """The largest reduction of each action by mechanism and family."""
    return mined(spark, sf_dir)[0].members.select("family", "session", "position", "mechanism", "reduction")


def _credited(spark, sf_dir):
    m, sessions = mined(spark, sf_dir)
    # Each of these is read several times by what follows.
    m = replace(m, members=written(m.members, "members"))
    chosen = written(mining.scores(mining.located(m.episodes, sessions)), "scores")
    return mining.credits(m, chosen), chosen, m, sessions


@query(sql("SELECT id, session, position, mechanism, CAST(reduction AS BIGINT) AS reduction FROM cred"))
def portfolio_credit(spark, sf_dir):
    """Each action's mechanism credited once."""
    return _credited(spark, sf_dir)[0]


@query(sql("SELECT s.id, s.name, s.opportunity_type, s.n AS occurrences, coalesce(c.credited, 0) AS credited, CAST(coalesce(c.avoided, 0) AS BIGINT) AS avoided FROM score s LEFT JOIN (SELECT id, count(DISTINCT (session, position)) AS credited, sum(reduction) AS avoided FROM cred GROUP BY id) c USING (id)"))
def credit_by_tool(spark, sf_dir):
    found, chosen, *_ = _credited(spark, sf_dir)
    return mining.credit_by_tool(found, chosen).drop("score")


@query(sql("SELECT mechanism, CAST(sum(reduction) AS BIGINT) AS avoided FROM cred GROUP BY mechanism"))
def credit_by_mechanism(spark, sf_dir):
    return mining.credit_by_mechanism(_credited(spark, sf_dir)[0])


@query(sql("SELECT count(DISTINCT (session, position)) AS credited_results, CAST(coalesce(sum(reduction), 0) AS BIGINT) AS avoided, count(*) AS credited_mechanisms FROM cred"))
def corpus_report(spark, sf_dir):
    """Totals of the report."""
    return mining.credit_totals(_credited(spark, sf_dir)[0])


@query(sql(f"""SELECT CAST(sum(CAST(replayed AS INT)) AS BIGINT) AS replayed_actions_excluded, CAST(sum(CAST(NOT replayed AS INT)) AS BIGINT) AS unique_actions, CAST(sum(CASE WHEN NOT replayed THEN output_tokens ELSE 0 END) AS BIGINT) AS observed_tool_output_tokens,
  CAST(0 AS BIGINT) AS linked_polls_folded, CAST(sum(CAST(opaque AS INT)) AS BIGINT) AS opaque_or_oversized_batches, CAST(sum(CAST(NOT replayed AND NOT opaque AND label NOT IN ({_in(WORKFLOW)}) AS INT)) AS BIGINT) AS content_or_unknown_boundaries,
  (SELECT count(*) FROM runs WHERE turns < 2) AS already_batched_episodes, (SELECT count(*) FROM runs WHERE turns >= 2 AND labels < 2) AS homogeneous_episodes FROM mark"""))
def diagnostics(spark, sf_dir):
    """A13."""
    return mining.diagnostics(mined(spark, sf_dir)[0])


@query(sql("SELECT id, family, CAST(row_number() OVER (ORDER BY score DESC, opportunity_type = 'workflow_bundle' DESC, id) AS BIGINT) AS by_result, CAST(row_number() OVER (ORDER BY score DESC, opportunity_type DESC, id) AS BIGINT) AS by_list, CAST(row_number() OVER (ORDER BY opportunity_type = 'workflow_bundle' DESC, score DESC, id) AS BIGINT) AS by_report FROM score"))
def candidate_rank(spark, sf_dir):
    """O1-O3: places in the three orders (a handful of families)."""
    chosen = _credited(spark, sf_dir)[1]
    bundle, score = (F.col("opportunity_type") == "workflow_bundle").desc(), F.desc("score")
    place = lambda *keys: F.row_number().over(W.orderBy(*keys)).cast("long")
    return chosen.select("id", "family", place(score, bundle, "id").alias("by_result"), place(score, F.desc("opportunity_type"), "id").alias("by_list"), place(bundle, score, "id").alias("by_report"))


@query(sql("SELECT id, family FROM score ORDER BY score DESC, opportunity_type DESC, id LIMIT 3"))
def limit_n(spark, sf_dir):
    """The listing's first candidates."""
    return mining.ranked(_credited(spark, sf_dir)[1], "list").limit(3).select("id", "family")


@query(sql("SELECT id, rank, session, start_ AS start, end_ AS end FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY session, start_) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id, logical ORDER BY session, start_) AS one FROM occ JOIN sess USING (session)) WHERE one = 1) WHERE rank <= 3"))
def representative_examples(spark, sf_dir):
    """Three examples of each candidate."""
    _, chosen, m, sessions = _credited(spark, sf_dir)
    return mining.examples(mining.occurrences(m, chosen), sessions).select("id", "rank", "session", "start", "end")


@query(sql("SELECT o.id, o.session, o.start_ AS start, count(*) AS actions, CAST(sum(l.output_tokens) AS BIGINT) AS output FROM occ o JOIN log l ON l.session = o.session AND l.position BETWEEN o.start_ AND o.end_ GROUP BY ALL"))
def occurrence_actions(spark, sf_dir):
    """Range join of occurrences with their actions."""
    _, chosen, m, _ = _credited(spark, sf_dir)
    found = mining.occurrences(m, chosen)
    a = action_log(spark, sf_dir).select(F.col("session").alias("s"), "position", "output_tokens")
    rows = found.join(a, (F.col("session") == F.col("s")) & F.col("position").between(F.col("start"), F.col("end")))
    return rows.groupBy("id", "session", "start").agg(F.count("*").alias("actions"), F.sum("output_tokens").alias("output"))


#: SQL twin of the audit on the log.
PLANS = """,
plan AS (SELECT session, start_, end_ FROM occ WHERE family = 'validation_report'),
inside AS (SELECT p.*, l.position, l.turn, l.success, l.exact FROM plan p JOIN log l ON l.session = p.session AND l.position BETWEEN p.start_ AND p.end_),
exactp AS (SELECT i.session, i.start_, i.end_, min(turn) AS first_turn, substr(sha256(string_agg(exact, '|' ORDER BY position)), 1, 24) AS signature FROM inside i GROUP BY ALL HAVING bool_and(coalesce(success, false))),
repeated AS (SELECT * FROM exactp WHERE signature IN (SELECT signature FROM exactp JOIN sess USING (session) GROUP BY signature HAVING count(DISTINCT logical) >= 2)),
turns_ AS (SELECT DISTINCT r.session, r.start_, r.end_, i.turn FROM repeated r JOIN inside i ON r.session = i.session AND r.start_ = i.start_ AND r.end_ = i.end_ WHERE i.turn > r.first_turn),
free AS (SELECT * FROM turns_ t WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.session = t.session AND l.turn = t.turn AND (l.position < t.start_ OR l.position > t.end_))),
use_ AS (SELECT session, turn, session || ':' || turn AS usage_key, sum(output_tokens) AS input_tokens, sum(output_tokens // 2) AS cached_input_tokens, sum(output_tokens // 4) AS cache_write_input_tokens, sum(k) AS output_tokens,
   bool_and(k % 11 <> 0) AS trusted, bool_or(k % 19 = 0) AS visible_text, bool_and(k % 5 = 0) AS empty_poll FROM log GROUP BY session, turn),
relevant AS (SELECT DISTINCT session FROM occ JOIN score USING (id) WHERE opportunity_type = 'workflow_bundle' OR score.family = 'await_completion'),
rows_ AS (SELECT u.*, 0 AS p, 'fixed_validation_plan' AS reason, f.start_ FROM free f JOIN use_ u ON f.session = u.session AND f.turn = u.turn WHERE trusted AND NOT visible_text
  UNION ALL SELECT u.*, 1, 'empty_process_polling', NULL FROM use_ u WHERE trusted AND NOT visible_text AND empty_poll AND session IN (SELECT session FROM relevant)),
expo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY usage_key ORDER BY p, session, start_ NULLS FIRST, turn) AS r FROM rows_) WHERE r = 1)
"""


def sql_plans(body: str) -> str:
    return f"WITH {LOG}{PLANS}\n{body}"


def _usage(log: DataFrame) -> DataFrame:
    """Counters of each turn of the log, made up from its columns."""
    half = lambda n: F.sum(F.floor(F.col("output_tokens") / n).cast("long"))
    return log.groupBy("session", "turn").agg(
        F.concat_ws(":", F.first("session"), F.first("turn")).alias("usage_key"), F.sum("output_tokens").alias("input_tokens"), half(2).alias("cached_input_tokens"), half(4).alias("cache_write_input_tokens"),
        F.sum("k").alias("output_tokens"), F.bool_and(F.col("k") % 11 != 0).alias("trusted"), F.bool_or(F.col("k") % 19 == 0).alias("visible_text"), F.bool_and(F.col("k") % 5 == 0).alias("empty_poll"))


def _plans(spark, sf_dir):
    _, chosen, m, sessions = _credited(spark, sf_dir)
    found, log = written(mining.occurrences(m, chosen), "occurrences"), action_log(spark, sf_dir)
    plans = written(audit.exact_plans(found, log, sessions), "plans")
    return audit.repeated_plans(plans), found, chosen, log


@query(sql_plans("SELECT session, start_ AS start, end_ AS end, signature, first_turn FROM repeated"))
def plan_repeat_semi(spark, sf_dir):
    """Repeated exact plans."""
    return _plans(spark, sf_dir)[0].select("session", "start", "end", "signature", "first_turn")


@query(sql_plans("SELECT session, start_ AS start, end_ AS end, turn FROM free"))
def outside_turn_anti(spark, sf_dir):
    """Turns of a plan without actions outside it."""
    plans, _, _, log = _plans(spark, sf_dir)
    return audit.removable_turns(plans, log)


def _exposure(spark, sf_dir):
    plans, found, chosen, log = _plans(spark, sf_dir)
    return audit.exposure(plans, log, _usage(log), audit.relevant_sessions(found, chosen))


@query(sql_plans("SELECT usage_key, reason, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(cached_input_tokens AS BIGINT) AS cached_input_tokens, CAST(cache_write_input_tokens AS BIGINT) AS cache_write_input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens FROM expo"))
def exposure_first_wins(spark, sf_dir):
    """W16, T4, J8, J11."""
    return _exposure(spark, sf_dir)


@query(sql_plans("SELECT reason, count(*) AS model_calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens, CAST(sum(cache_write_input_tokens) AS BIGINT) AS cache_write_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens - cached_input_tokens - cache_write_input_tokens) AS BIGINT) AS uncached_input_tokens FROM expo GROUP BY reason"))
def usage_by_reason(spark, sf_dir):
    """A17, A18."""
    return audit.by_reason(_exposure(spark, sf_dir))


# --- ordered operators ------------------------------------------------------------------------------------------------

TALK = "SELECT *, role = 'user' AND text <> '' AS asks, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations"


def _talk(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return rows.withColumns({"asks": (F.col("role") == "user") & (F.col("text") != ""), "tokens": estimate_tokens(F.col("text"))})


@query("SELECT role, count(*) AS n, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def token_estimate(spark, sf_dir):
    """F2, A1."""
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(estimate_tokens(F.col("text"))).alias("tokens"))


@query(f"WITH t AS ({TALK}) SELECT conv_id, turn, CAST(sum(CAST(asks AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS request, CASE WHEN asks THEN substr(text, 1, 1000) END AS snippet FROM t")
def request_numbering(spark, sf_dir):
    """W4, P8."""
    number = linking.request_number(F.col("asks"), ["conv_id"], ["turn"])
    return _talk(spark, sf_dir).select("conv_id", "turn", number.alias("request"), F.when(F.col("asks"), F.substring("text", 1, 1000)).alias("snippet"))


@query(f"""WITH t AS ({TALK}), g AS (SELECT *, coalesce(sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM t)
SELECT conv_id, turn, CAST(coalesce(sum(CASE WHEN role <> 'user' THEN tokens END) OVER (PARTITION BY conv_id, g ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS carried FROM g""")
def assistant_carry(spark, sf_dir):
    """Tokens since the last reset."""
    return linking.carried_tokens(_talk(spark, sf_dir), "tokens", F.col("role") == "user", ["conv_id"], ["turn"]).select("conv_id", "turn", "carried")


@query("""SELECT conv_id, turn, CAST(sum(CAST(NOT closes AND before AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS model_turn
FROM (SELECT *, role <> 'assistant' AS closes, coalesce(lag(role <> 'assistant') OVER (PARTITION BY conv_id ORDER BY turn), true) AS before FROM conversations)""")
def stream_turns(spark, sf_dir):
    """Gaps and islands."""
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", linking.stream_turn(F.col("role") == "assistant", F.col("role") != "assistant", ["conv_id"], ["turn"]).alias("model_turn"))


@query(sql("SELECT session, position, dense_rank() OVER (PARTITION BY session ORDER BY first_) AS turn FROM (SELECT *, min(position) OVER (PARTITION BY session, k) AS first_ FROM log)"))
def message_turns(spark, sf_dir):
    """Rank of a key's first appearance."""
    return linking.message_turn(action_log(spark, sf_dir).drop("turn"), "k", ["session"], ["position"]).select("session", "position", "turn")


@query(sql("SELECT session, label, bool_and(success) AS outcome, coalesce(bool_or(success IS NOT NULL), false) AS observed FROM log GROUP BY ALL"))
def sticky_outcome(spark, sf_dir):
    """A2, A3."""
    rows = action_log(spark, sf_dir).groupBy("session", "label")
    return rows.agg(linking.sticky_outcome(F.col("success")).alias("outcome"), F.bool_or(F.col("success").isNotNull()).alias("observed"))


@query(sql("""SELECT session, position, CASE WHEN label <> 'run_tests' AND o.request = request THEN o.position END AS linked_to FROM (
  SELECT *, last_value(CASE WHEN label = 'run_tests' THEN {'position': position, 'request': request} END IGNORE NULLS) OVER (PARTITION BY session, k % 8 ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM log)"""))
def asof_process_link(spark, sf_dir):
    """J2 without recursion: the latest launch of a process, if of the same request."""
    rows = action_log(spark, sf_dir).withColumn("process", F.col("k") % 8).drop("linked_to")
    launch = F.col("label") == "run_tests"
    return linking.latest_origin(rows, launch, ~launch, "process", "request", ["session"], ["position"], "position").select("session", "position", "linked_to")


@query(sql("SELECT session, label, CAST(coalesce(sum(CASE WHEN k % 3 = 0 AND position <= last_ THEN output_tokens END), 0) AS BIGINT) AS poll_reduction_tokens FROM (SELECT *, max(CASE WHEN k % 5 = 0 THEN position END) OVER (PARTITION BY session, label) AS last_ FROM log) GROUP BY session, label"))
def empty_poll_running_sum(spark, sf_dir):
    """A4."""
    rows = action_log(spark, sf_dir).withColumns({"empty": F.col("k") % 3 == 0, "complete": F.col("k") % 5 == 0})
    return linking.empty_poll_reduction(rows, ["session", "label"], "position", "output_tokens", "empty", "complete")


@query(sql("""SELECT session, position, CASE WHEN hit THEN b.position END AS repeat_of, CAST(CASE WHEN hit THEN greatest(0, output_tokens - 200) ELSE 0 END AS BIGINT) AS reduction FROM (
  SELECT *, coalesce(turn - b.turn > 0 AND turn - b.turn <= 5, false) AS hit FROM (
    SELECT *, lag({'position': position, 'turn': turn}) OVER (PARTITION BY session, epoch_, event_type ORDER BY position) AS b FROM (
      SELECT *, sum(CAST(k % 29 = 0 AS INT)) OVER (PARTITION BY session ORDER BY position) AS epoch_ FROM log)))"""))
def identical_result_reuse(spark, sf_dir):
    """W10, W11."""
    epoch = linking.request_number(F.col("k") % 29 == 0, ["session"], ["position"])
    return linking.identical_results(action_log(spark, sf_dir).withColumn("epoch", epoch), "session", "position", "epoch", "event_type", "turn", "position", "output_tokens").select("session", "position", "repeat_of", "reduction")


@query(sql("""SELECT session, position, CAST(total - coalesce(b, 0) AS BIGINT) AS delta, count(*) OVER (PARTITION BY session, turn) = 1 AS trusted FROM (
  SELECT *, lag(total) OVER (PARTITION BY session ORDER BY position) AS b FROM (SELECT *, sum(CASE WHEN k % 2 = 0 THEN output_tokens ELSE 0 END) OVER (PARTITION BY session ORDER BY position) AS total FROM log)) WHERE b IS NULL OR b <> total"""))
def counter_delta(spark, sf_dir):
    """W8, A22."""
    total = F.sum(F.when(F.col("k") % 2 == 0, F.col("output_tokens")).otherwise(0)).over(W.partitionBy("session").orderBy("position").rowsBetween(W.unboundedPreceding, 0))
    rows = linking.counter_changes(action_log(spark, sf_dir).withColumn("totals", F.array(total)), "session", "position", "turn", "totals")
    return rows.select("session", "position", F.col("delta")[0].alias("delta"), "trusted")


@query(sql("SELECT session, label, success, position, output_tokens FROM (SELECT *, row_number() OVER (PARTITION BY session, label, success ORDER BY position) AS r FROM log) WHERE r = 1"))
def result_dedup(spark, sf_dir):
    """The first row of each key."""
    return linking.first_of(action_log(spark, sf_dir), ["session", "label", "success"], ["position"]).select("session", "label", "success", "position", "output_tokens")


# --- scalar operators -------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 24) AS short FROM documents")
def content_digest(spark, sf_dir):
    """S6, F3."""
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), hash_text(F.col("text")).alias("short"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'imported' ELSE 'duplicate' END AS status FROM documents")
def duplicate_files(spark, sf_dir):
    """The first of equal contents is imported."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    first = F.row_number().over(W.partitionBy("digest").orderBy("doc_id"))
    return rows.select("doc_id", F.when(first == 1, "imported").otherwise("duplicate").alias("status"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'imported' ELSE 'duplicate' END AS status FROM documents) GROUP BY status")
def scan_summary(spark, sf_dir):
    """A21."""
    return duplicate_files(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(greatest(200, ceil(length(text) / 4.0)) AS BIGINT) AS compact, CAST(greatest(0, n_chars - greatest(200, ceil(length(text) / 4.0))) AS BIGINT) AS reduction FROM documents WHERE text IS NOT NULL")
def budget_clamp(spark, sf_dir):
    """F29, F30."""
    from ..functions.scalar import budgeted, saved

    short = budgeted(estimate_tokens(F.col("text")), 200)
    return read(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", short.alias("compact"), saved(F.col("n_chars"), short).alias("reduction"))
