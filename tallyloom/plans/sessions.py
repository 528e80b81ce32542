"""Queries that run the parser: transcripts of both providers are rendered from ``events``, parsed, and compared with SQL over ``events``.

A user is a session of one file, an event a step of it: a request (signup), a test run (click), a read (view), the launch of a process
(purchase) or a poll of one (error). Even users have a message log, odd ones a rollout.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import REUSE_FLOOR
from ..functions.outcome import read_result, summary_size, summary_tokens
from ..functions.scalar import redact
from ..functions.shell import Reader
from ..operators import mining
from ..shared import written
from ..sources import transcripts
from . import wording
from .catalogue import _credited, _exposure, query, read, sql, sql_plans

# --- rendering --------------------------------------------------------------------------------------------------------


#: Steps that one task renders; a user's steps stay together.
TASK_STEPS = 50_000


def _steps(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"), "ts", "event_id")
    e = e.repartition(max(1, math.ceil(e.count() / TASK_STEPS)), "user_id")
    return e.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))).drop("ts", "event_id")


def _object(**fields) -> Column:
    """A JSON object as text; fields that are null are left out."""
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k.rstrip("_")) for k, v in fields.items()]))


def _nested(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k.rstrip("_")) for k, v in fields.items()])


def rendered(spark, sf_dir) -> DataFrame:
    """path, mtime, size, content of one JSONL file for each user; the last line of some is torn."""
    k, n, user, kind = F.col("k"), F.col("n"), F.col("user_id"), F.col("kind")
    s = _steps(spark, sf_dir).withColumns({
        "p": k % 4 + 1, "call_id": F.when(k % 2 == 0, F.format_string("call-of-user-%d-step-%06d", user, n)).otherwise(F.concat(F.lit("c"), n)),
        "cmd": F.when(kind == "click", F.concat(F.lit("cargo test -p c"), k % 3)).when(kind == "view", F.concat(F.lit("cat f"), k % 5, F.lit(".txt"))).when(kind == "purchase", "go test ./..."),
        "stamp": F.concat(F.lit("t"), n), "text": F.concat(F.lit("ask "), k), "thought": F.expr("repeat('x', k)"), "name": F.concat(F.lit("s"), user), "cwd": F.concat(F.lit("/p/"), user % 10),
    })
    body = F.when(kind == "click", _object(exit_code=F.when(k % 7 == 0, 1).otherwise(0), output=F.expr("repeat('case ok\\n', k % 40)")))
    body = body.when(kind == "view", _object(exit_code=0, output=F.expr("repeat(concat('line of f', k % 5, '\\n'), 50)"))).when(kind == "purchase", _object(session_id=F.col("p"), output=""))
    s = s.withColumn("body", body.when(k % 3 == 0, _object(exit_code=0, output="done")).otherwise(_object(session_id=F.concat(F.lit("x"), k), output="")))
    poll, is_call = kind == "error", kind != "signup"
    none = F.array().cast("array<string>")
    when = lambda c, *rows: F.when(c, F.array(*rows)).otherwise(none)
    item = lambda **f: _object(type="response_item", timestamp=F.when(F.lit("name" in f), F.col("stamp")), payload=_nested(**f))

    # A rollout
    told = lambda role: item(type="message", role=role, content=F.array(_nested(type="input_text", text=F.col("text") if role == "user" else "noted it")))
    arguments = F.when(poll, _object(session_id=F.col("p"), chars="")).otherwise(_object(cmd=F.col("cmd")))
    mine = F.when(is_call, 1).otherwise(0)
    so_far = lambda x: F.sum(mine * x).over(W.partitionBy("user_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    s = s.withColumns({"t_in": so_far(100 + k), "t_cached": so_far(k), "t_out": so_far(F.lit(10))})
    counters = lambda a, b, c: _nested(input_tokens=a, cached_input_tokens=b, output_tokens=c)
    info = _nested(last_token_usage=counters(100 + k + F.when(k % 11 == 0, 1).otherwise(0), k, F.lit(10)), total_token_usage=counters(F.col("t_in"), F.col("t_cached"), F.col("t_out")))
    count = _object(type="event_msg", payload=_nested(type="token_count", info=info))
    stream = F.concat(
        when(~is_call & (k % 2 == 0), _object(type="event_msg", payload=_nested(type="user_message", message=F.col("text")))), when(~is_call, told("user")), when(~is_call & (k % 3 == 0), told("assistant")),
        when(poll & (k % 17 == 0), _object(type="compacted", payload=_nested(reason="full"))),
        when(is_call, item(type="reasoning", summary=F.array(_nested(type="summary_text", text=F.col("thought")))),
             item(type="function_call", name=F.when(poll, "write_stdin").otherwise("functions.exec_command"), call_id=F.col("call_id"), arguments=arguments),
             item(type="function_call_output", call_id=F.col("call_id"), output=F.col("body")), count, count))

    # A message log
    given = _nested(command=F.col("cmd"), task_id=F.when(poll, F.col("p")))
    usage = _nested(input_tokens=100 + k, cache_read_input_tokens=k, cache_creation_input_tokens=1, output_tokens=10 + k % 3)
    message = lambda role, content, **more: _nested(role=role, content=content, **more)
    record = lambda type_, **f: _object(type=type_, sessionId=F.col("name"), cwd=F.col("cwd"), **f)
    parts = F.array(F.struct(F.lit("thinking").alias("type"), F.col("thought").alias("thinking"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name")], F.lit(None).cast("struct<command:string,task_id:int>").alias("input")),
                    F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("thinking"), F.col("call_id").alias("id"), F.when(poll, "TaskOutput").otherwise("Bash").alias("name"), given.alias("input")))
    spoke = record("assistant", uuid=F.concat_ws("/", "user_id", "n"), timestamp=F.col("stamp"), message=message("assistant", parts, id=F.concat(F.lit("m"), k % 6), usage=usage))
    log = F.concat(
        when(~is_call, record("user", message=message("user", F.col("text")))), when(~is_call & (k % 3 == 0), record("assistant", message=message("assistant", F.array(_nested(type="text", text="noted it"))))),
        when(poll & (k % 17 == 0), _object(type="system", subtype="compact_boundary")), when(is_call, spoke), when(is_call & (k % 9 == 0), spoke),
        when(is_call, record("user", message=message("user", F.array(_nested(type="tool_result", tool_use_id=F.col("call_id"), content=F.col("body")))))))

    lines = s.select("user_id", "n", "name", "cwd", F.when(user % 2 == 0, log).otherwise(stream).alias("rows"))
    files = lines.groupBy("user_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "rows"))), lambda x: x["rows"])).alias("rows"), F.max("name").alias("name"), F.max("cwd").alias("cwd"))
    head = F.when(user % 2 == 1, F.array(_object(type="session_meta", payload=_nested(id=F.col("name"), cwd=F.col("cwd"))))).otherwise(none)
    content = F.array_join(F.concat(head, F.col("rows"), when(user % 7 == 0, F.lit('{"torn'))), "\n").cast("binary")
    return files.select(F.format_string("/u/%d.jsonl", "user_id").alias("path"), F.lit(None).cast("timestamp").alias("mtime"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))


def parsed(spark, sf_dir, matchers=None) -> DataFrame:
    return written(transcripts.parsed(written(rendered(spark, sf_dir), "files"), matchers=matchers), "parsed")


def _user() -> Column:
    return F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("long").alias("user_id")


# --- SQL over events --------------------------------------------------------------------------------------------------

_summary = len(json.dumps({"command_completed": True, "exit_code": 0, "diagnostics_and_tail": [], "full_log_available_on_request": True,
                           "contract": "validation status, diagnostics and final output; full log retained locally"}))
_thought = len(json.dumps([{"type": "summary_text", "text": ""}]))
_reference = len(json.dumps({"unchanged": True, "previous_result": "", "full_result_available": True}))

SESSIONS = f"""
s0 AS (SELECT user_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s1 AS (SELECT *, user_id % 2 = 0 AS talk, kind = 'signup' AS ask, kind = 'signup' AND k % 3 = 0 AS note, kind = 'error' AS poll, k % 4 + 1 AS p,
   CASE WHEN k % 2 = 0 THEN 'call-of-user-' || user_id || '-step-' || lpad(CAST(n AS VARCHAR), 6, '0') ELSE 'c' || n END AS call_id,
   CASE kind WHEN 'click' THEN 'cargo test -p c' || (k % 3) WHEN 'view' THEN 'cat f' || (k % 5) || '.txt' WHEN 'purchase' THEN 'go test ./...' END AS cmd FROM s0),
s2 AS (SELECT *, coalesce(lag(note) OVER u, false) AS noted, sum(CAST(ask AS INT)) OVER u AS request, sum(CAST(ask OR (poll AND k % 17 = 0) AS INT)) OVER u AS epoch,
   CASE WHEN talk AND NOT ask THEN 'k' || (k % 6) WHEN note THEN 'n' || n END AS ident,
   CASE WHEN talk AND poll THEN '{{"task_id": ' || p || '}}' WHEN poll THEN '{{"session_id": ' || p || ', "chars": ""}}' ELSE cmd END AS command,
   CASE WHEN talk AND poll THEN '{{"task_id": ' || p || '}}' WHEN talk THEN '{{"command": "' || cmd || '"}}' WHEN poll THEN '{{"session_id":' || p || ',"chars":""}}' ELSE '{{"cmd":"' || cmd || '"}}' END AS raw,
   CASE kind WHEN 'click' THEN 27 + 9 * (k % 40) WHEN 'view' THEN 27 + 50 * 12 WHEN 'purchase' THEN 28 WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN 31 ELSE 30 + length('x' || k) - 1 END END AS body,
   CASE kind WHEN 'click' THEN k % 7 <> 0 WHEN 'view' THEN true WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN true END END AS said, kind IN ('click', 'view') OR (poll AND k % 3 = 0) AS complete
   FROM s1 WINDOW u AS (PARTITION BY user_id ORDER BY n)),
s3 AS (SELECT *, min(CASE WHEN ident IS NOT NULL THEN n END) OVER (PARTITION BY user_id, ident) AS first_ FROM s2),
s4 AS (SELECT *, CAST(ceil(body / 4.0) AS BIGINT) AS size,
   CASE WHEN talk THEN CASE WHEN ident IS NOT NULL THEN dense_rank() OVER (PARTITION BY user_id ORDER BY CASE WHEN ident IS NOT NULL THEN first_ END NULLS LAST) END
     ELSE sum(CAST(note OR (NOT ask AND NOT noted) AS INT)) OVER (PARTITION BY user_id ORDER BY n) END AS turn,
   last_value(CASE WHEN kind = 'purchase' THEN {{'n': n, 'request': request, 'id': call_id}} END IGNORE NULLS) OVER (PARTITION BY user_id, p ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS origin FROM s3),
s5 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) - 1 AS position, coalesce(poll AND origin.request = request, false) AS linked,
   CASE kind WHEN 'click' THEN CAST(ceil(({_summary} + 9 * least(12, k % 40) + 2 * greatest(0, least(12, k % 40) - 1)) / 4.0) AS BIGINT) ELSE CAST(ceil(({_summary} + 6) / 4.0) AS BIGINT) END AS short
   FROM s4 WHERE NOT ask),
s6 AS (SELECT *, CASE WHEN linked THEN origin.id ELSE call_id END AS target, linked AND NOT complete AS empty_poll FROM s5),
s7 AS (SELECT *, sum(size) OVER (PARTITION BY user_id, target ORDER BY n) AS total, max(CASE WHEN complete THEN n END) OVER (PARTITION BY user_id, target) AS last_done,
   lag({{'turn': turn, 'id': call_id}}) OVER (PARTITION BY user_id, epoch, kind = 'view', k % 5 ORDER BY n) AS earlier FROM s6),
g AS (SELECT user_id, target, CAST(sum(size) AS BIGINT) AS output_tokens, bool_and(said) AS outcome, bool_or(complete) AS done, CAST(coalesce(sum(CASE WHEN empty_poll AND n <= last_done THEN size END), 0) AS BIGINT) AS polled,
   CAST(max_by(CASE WHEN said AND complete THEN total - size + short END, CASE WHEN said AND complete THEN n END) AS BIGINT) AS compact FROM s7 GROUP BY ALL),
acts AS (SELECT s.user_id, s.position, s.n, s.k, s.kind, s.talk, s.call_id, s.request, s.turn, s.command, s.linked, s.target, s.empty_poll,
   CAST((CASE WHEN talk THEN ceil(k / 4.0) ELSE ceil(({_thought} + k) / 4.0) END) + ceil(length(raw) / 4.0) + CASE WHEN noted THEN 2 ELSE 0 END AS BIGINT) AS assistant_tokens,
   CASE WHEN linked THEN 0 ELSE g.output_tokens END AS output_tokens, CASE WHEN linked THEN said ELSE g.outcome END AS success,
   CASE kind WHEN 'view' THEN 'read_file' WHEN 'error' THEN 'poll' ELSE 'run_tests' END AS category, CASE WHEN linked THEN s.target ELSE '' END AS linked_to,
   CASE WHEN kind = 'purchase' OR linked THEN CAST(p AS VARCHAR) WHEN poll AND k % 3 <> 0 THEN 'x' || k WHEN poll THEN CAST(p AS VARCHAR) ELSE '' END AS process_id,
   CASE WHEN kind IN ('click', 'purchase') THEN g.compact END AS compact_output_tokens, CASE WHEN linked THEN 0 ELSE g.polled END AS poll_reduction_tokens, CASE WHEN linked THEN false ELSE g.done END AS completion_observed,
   CASE WHEN kind = 'view' AND s.turn - earlier.turn BETWEEN 1 AND 5 THEN earlier.id ELSE '' END AS repeat_of
   FROM s7 s LEFT JOIN g ON g.user_id = s.user_id AND g.target = s.call_id),
named AS (SELECT *, CASE WHEN repeat_of <> '' THEN greatest(0, output_tokens - greatest({REUSE_FLOOR}, CAST(ceil(({_reference} + length(repeat_of)) / 4.0) AS BIGINT))) ELSE 0 END AS repeat_output_reduction_tokens,
   CASE WHEN talk THEN 'claude' ELSE 'codex' END AS source FROM acts)
"""


def over(body: str) -> str:
    return f"WITH {SESSIONS} {body}"


ACTION_COLUMNS = ("position", "call_id", "request", "turn", "assistant_tokens", "output_tokens", "success", "category", "linked_to", "process_id", "compact_output_tokens", "poll_reduction_tokens", "completion_observed",
                  "repeat_of", "repeat_output_reduction_tokens", "empty_poll", "command")
_WHOLE = ("position", "request", "turn")


@query(over(f"""SELECT user_id, {', '.join(f'CAST({c} AS INT) AS {c}' if c in _WHOLE else c for c in ACTION_COLUMNS)},
  substr(sha256(source || '|' || CASE WHEN length(call_id) >= 20 THEN call_id ELSE 's' || user_id || '|' || call_id || '|' || position END || '|' || command), 1, 24) AS event_key FROM named"""))
def parsed_actions(spark, sf_dir):
    """Linked actions of parsed transcripts."""
    rows = parsed(spark, sf_dir).select(_user(), F.explode("actions").alias("a"))
    return rows.select("user_id", *[F.col(f"a.{c}").alias(c) for c in ACTION_COLUMNS], "a.event_key")


@query(over("""SELECT user_id, CAST(position AS INT) AS position, label, substr(sha256('["' || label || '", [' || shape || ']]'), 1, 24) AS template,
  substr(sha256('["' || cwd || '", [' || CASE WHEN argv = '' THEN '' ELSE '"' || replace(argv, ' ', '", "') || '"' END || '], "' || argv || '"]'), 1, 24) AS exact, argv FROM (
  SELECT *, category AS label, CASE WHEN kind = 'error' THEN '' ELSE command END AS argv, CASE WHEN kind = 'error' THEN '' ELSE '/p/' || (user_id % 10) END AS cwd,
    CASE kind WHEN 'click' THEN '"cargo", "test", "-p", "<argument>"' WHEN 'view' THEN '"cat", "<argument>"' WHEN 'purchase' THEN '"go", "test", "<argument>"' ELSE '' END AS shape FROM named)"""))
def parsed_operations(spark, sf_dir):
    """Operations of parsed calls, with their interface and exact hashes."""
    rows = parsed(spark, sf_dir).select(_user(), F.explode("actions").alias("a")).select("user_id", "a.position", F.explode("a.operations").alias("o"))
    return rows.select("user_id", "position", "o.label", "o.template", "o.exact", F.array_join("o.argv", " ").alias("argv"))


_RULES = '[{"action": "lint", "pattern": "^cargo test -p c1$"}]'


@query(over("SELECT label, count(*) AS n FROM (SELECT CASE WHEN command = 'cargo test -p c1' THEN 'lint' ELSE category END AS label FROM named) GROUP BY label"))
def custom_matchers(spark, sf_dir):
    """Labels with a rule of one's own."""
    rows = parsed(spark, sf_dir, _RULES).select(F.explode("actions").alias("a")).select(F.explode("a.operations").alias("o"))
    return rows.groupBy("o.label").agg(F.count("*").alias("n"))


@query(over("""SELECT u.user_id, CAST(u.turn AS INT) AS turn, substr(sha256(CASE WHEN u.talk THEN 'claude|m' || (max_by(u.k, u.n) % 6) ELSE 'codex|' || max(u.call_id) END), 1, 24) AS usage_key,
  CAST(max_by(CASE WHEN u.talk THEN 101 + 2 * u.k ELSE 100 + u.k + CAST(u.k % 11 = 0 AS INT) END, u.n) AS BIGINT) AS input_tokens, CAST(max_by(u.k, u.n) AS BIGINT) AS cached_input_tokens,
  CAST(max(CASE WHEN u.talk THEN 1 ELSE 0 END) AS BIGINT) AS cache_write_input_tokens, CAST(max(CASE WHEN u.talk THEN 10 + u.k % 3 ELSE 10 END) AS BIGINT) AS output_tokens,
  NOT u.talk AND coalesce(bool_or(s.noted), false) AS visible_text, CASE WHEN u.talk THEN count(DISTINCT u.k) = 1 ELSE bool_and(u.k % 11 <> 0) END AS trusted, bool_and(u.empty_poll AND coalesce(t.done, false)) AS empty_poll
  FROM acts u JOIN s7 s ON s.user_id = u.user_id AND s.n = u.n LEFT JOIN g t ON u.linked AND t.user_id = u.user_id AND t.target = u.target GROUP BY u.user_id, u.talk, u.turn"""))
def parsed_usage(spark, sf_dir):
    """Recorded usage of parsed turns."""
    return parsed(spark, sf_dir).select(_user(), F.explode("usage").alias("u")).select("user_id", "u.*")


@query(over("""SELECT user_id, 's' || user_id AS session_id, CASE WHEN user_id % 2 = 0 THEN 'claude' ELSE 'codex' END AS source, '/p/' || (user_id % 10) AS project,
  coalesce('t' || min(CASE WHEN NOT ask THEN n END), '') AS timestamp, coalesce(string_agg(CASE WHEN ask THEN 'ask ' || k END, '|' ORDER BY n), '') AS requests,
  CASE WHEN user_id % 7 = 0 THEN 'Invalid JSON at line ' || CAST(1 + sum(CASE WHEN talk AND ask THEN 1 + CAST(note AS INT) WHEN talk THEN 2 + CAST(k % 9 = 0 AS INT) + CAST(poll AND k % 17 = 0 AS INT)
    WHEN ask THEN 1 + CAST(k % 2 = 0 AS INT) + CAST(note AS INT) ELSE 5 + CAST(poll AND k % 17 = 0 AS INT) END) + CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) || '; skipped' ELSE '' END AS warnings,
  count(*) FILTER (WHERE NOT ask) AS actions FROM s2 GROUP BY user_id"""))
def parsed_files(spark, sf_dir):
    """Files with their session, requests and warnings."""
    rows = parsed(spark, sf_dir)
    return rows.select(_user(), "session_id", "source", "project", "timestamp", F.array_join("requests", "|").alias("requests"), F.array_join("warnings", "|").alias("warnings"), F.size("actions").cast("long").alias("actions"))


@query("""SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'claude' ELSE 'codex' END AS source, CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS requests,
  coalesce(max_by(substr(text, 1, 1000), -turn) FILTER (WHERE role = 'user'), '') AS first_request FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def conversation_files(spark, sf_dir):
    """The three JSON forms of a file (a list of messages, a list of rollout records, the oldest form)."""
    rows = read(spark, sf_dir, "conversations").where("role <> 'system'")
    text, role, form = F.col("text"), F.col("role"), F.col("conv_id") % 3
    item = _nested(type="message", role=role, content=F.array(_nested(type="text", text=text)))
    one = F.when(form == 0, _object(type=role, message=_nested(role=role, content=text))).when(form == 1, _object(type="response_item", payload=item)).otherwise(F.to_json(item))
    files = rows.select("conv_id", "turn", one.alias("one")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "one"))), lambda x: x["one"]), ",").alias("items"))
    listed = F.concat(F.lit("["), F.col("items"), F.lit("]"))
    content = F.when(F.col("conv_id") % 3 == 2, F.concat(F.lit('{"session":{"id":"old"},"items":'), listed, F.lit("}"))).otherwise(listed).cast("binary")
    files = files.select(F.format_string("/c/%d.json", "conv_id").alias("path"), F.lit(None).cast("timestamp").alias("mtime"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))
    out = transcripts.parsed(written(files, "files"))
    number = F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long").alias("conv_id")
    return out.select(number, "source", F.size("requests").cast("long").alias("requests"), F.coalesce(F.get("requests", F.lit(0)), F.lit("")).alias("first_request"))


# --- results ----------------------------------------------------------------------------------------------------------

#: Results of each form, by k % 10; {k} and {e} (0 or 1) are filled in.
_FORMS = ('{{"exit_code": {e}, "output": "said {k}"}}', '{{"session_id": {k}, "output": "more"}}', "Process exited with code {e}\nsaid {k}", "Process running with session ID s{k}.", "plain {k}",
          'Script completed\nOutput:\n{{"exit_code": {e}, "output": "said {k}"}}', '[{{"type": "text", "text": "Exit code: {e}"}}]', '{{"content": [{{"type": "text", "text": "said {k}"}}], "isError": true}}', "null", '{{"exit_code": null, "cell_id": "c{k}"}}')


@query("""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, value < 100 AS bad FROM events), f AS (SELECT *, k % 10 AS form, CASE WHEN bad THEN 1 ELSE 0 END AS e FROM e)
SELECT event_id, CASE WHEN form IN (0, 2, 5, 6) THEN e = 0 WHEN form = 7 THEN false WHEN form IN (4, 8) AND k >= 50 THEN NOT bad END AS success,
  CASE form WHEN 1 THEN CASE WHEN k = 0 THEN '' ELSE CAST(k AS VARCHAR) END WHEN 3 THEN 's' || k || '' WHEN 9 THEN 'c' || k ELSE '' END AS process, form IN (0, 2, 5, 6, 7) OR (form IN (4, 8) AND k >= 50) AS complete,
  CASE form WHEN 0 THEN 'said ' || k WHEN 1 THEN 'more' WHEN 2 THEN 'Process exited with code ' || e || chr(10) || 'said ' || k WHEN 3 THEN '' WHEN 4 THEN 'plain ' || k WHEN 5 THEN 'said ' || k WHEN 6 THEN 'Exit code: ' || e
    WHEN 7 THEN 'said ' || k WHEN 8 THEN 'null' ELSE '{"exit_code": null, "cell_id": "c' || k || '"}' END AS text FROM f""")
def result_outcomes(spark, sf_dir):
    """what results of every form say. Plain results have an error flag for k of 50 and more."""
    @F.arrow_udf("struct<success:boolean,process:string,complete:boolean,text:string>")
    def outcome(k: pa.Array, bad: pa.Array) -> pa.Array:
        out = []
        for x, b in zip(k.to_pylist(), bad.to_pylist(), strict=True):
            flag = b if x % 10 in (4, 8) and x >= 50 else None
            out.append(read_result(_FORMS[x % 10].format(k=x, e=int(b)), flag)._asdict())
        return pa.array(out, pa.struct([("success", pa.bool_()), ("process", pa.string()), ("complete", pa.bool_()), ("text", pa.string())]))

    e = read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("value") < 100).alias("bad"))
    return e.select("event_id", outcome("k", "bad").alias("o")).select("event_id", "o.*")


_ODD = "warning|error|fail|exception|fatal|traceback|security|deprecated|skip|xfail"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '\x1b\[[0-?]*[ -/]*[@-~]', '', 'g') AS text FROM documents WHERE text IS NOT NULL),
ls AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM t),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM ls),
r AS (SELECT *, regexp_matches(line, '[^\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]') AS full_ FROM l),
q AS (SELECT *, full_ AND regexp_matches(line, '(?i){_ODD}') AS odd, regexp_matches(regexp_replace(line, '(?i)\b(?:0|no)\s+(?:failures?|failed|errors?)\b', '', 'g'), '(?i)\b(?:FAILED|FAILURE|ERROR|FATAL|TRACEBACK)\b') AS against,
  row_number() OVER (PARTITION BY doc_id, full_ ORDER BY i DESC) AS tail FROM r),
k AS (SELECT *, (full_ AND tail <= 12) OR bool_or(odd) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS keep, bool_or(against) OVER (PARTITION BY doc_id) AS spoilt FROM q),
m AS (SELECT doc_id, count(*) FILTER (WHERE keep) AS n, coalesce(sum(length(CAST(to_json(line) AS VARCHAR))) FILTER (WHERE keep), 0) AS chars, bool_or(spoilt) AS spoilt FROM k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN NOT coalesce(m.spoilt, false) THEN CAST(ceil(({_summary} + coalesce(m.chars, 0) + 2 * greatest(0, coalesce(m.n, 0) - 1)) / 4.0) AS BIGINT) END AS summary_tokens,
  CASE WHEN NOT coalesce(m.spoilt, false) AND d.doc_id % 5 IN (0, 1) AND d.doc_id % 3 <> 0 THEN CAST(ceil(({_summary} + coalesce(m.chars, 0) + 2 * greatest(0, coalesce(m.n, 0) - 1)) / 4.0) AS BIGINT) END AS allowed
FROM documents d LEFT JOIN m USING (doc_id) WHERE d.text IS NOT NULL""")
def validation_reducer(spark, sf_dir):
    """size of the status summary of a log, and where the contract allows it (by label, success and completion)."""
    labels = ("run_tests", "github_ci_status", "read_file", "git_diff_patch", "poll")

    @F.arrow_udf("struct<summary_tokens:bigint,allowed:bigint>")
    def sizes(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        out = [{"summary_tokens": summary_size(t), "allowed": summary_tokens(t, labels[d % 5], None if d % 3 == 0 and d % 2 else d % 3 != 0, True)} for d, t in zip(doc_id.to_pylist(), text.to_pylist(), strict=True)]
        return pa.array(out, pa.struct([("summary_tokens", pa.int64()), ("allowed", pa.int64())]))

    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", sizes("doc_id", "text").alias("s")).select("doc_id", "s.*")


# --- static reading of tool calls -------------------------------------------------------------------------------------

#: (command or script, its operations as (label, argv, folder)): invented calls; those of event e are number e.k % their count.
COMMANDS = (
    ("cd app && python -m pytest -q tests; git status --short", (("run_tests", "python -m pytest -q tests", "/repo/app"), ("git_status", "git status --short", "/repo/app"))),
    ("git -C lib diff --stat HEAD~1 | head -5", (("git_diff_stat", "git -C lib diff --stat HEAD~1", "/repo/lib"),)),
    ("gh run view 12 --log-failed", (("github_ci_logs", "gh run view 12 --log-failed", "/repo"),)),
    ("gh pr checks 7 || true", (("github_pr_checks", "gh pr checks 7", "/repo"), ("unknown", "", ""))),
    ("npm run build && npm test -- --watch=false", (("build", "npm run build", "/repo"), ("run_tests", "npm test -- --watch=false", "/repo"))),
    ("rg -n todo src | wc -l", (("search_text", "rg -n todo src", "/repo"),)),
    ("rg --files | xargs rm", (("find_related_files", "rg --files", "/repo"), ("unknown", "", ""))),
    ("FOO=1 timeout 30 dotnet test --list-tests", (("inspection", "dotnet test --list-tests", "/repo"),)),
    ("cat a.txt > b.txt", (("unknown", "", "/repo"),)),
    ("echo done", (("unknown", "", "/repo"),)),
    ("ruff check . & eslint src", (("lint", "ruff check .", "/repo"), ("unknown", "", ""), ("lint", "eslint src", "/repo"))),
    ("cargo clippy; go build ./...; sed -n 1,5p x; sed -i s/a/b/ x", (("lint", "cargo clippy", "/repo"), ("build", "go build ./...", "/repo"), ("read_file", "sed -n 1,5p x", "/repo"), ("unknown", "sed -i s/a/b/ x", "/repo"))),
    ("git diff --name-only", (("git_diff_names", "git diff --name-only", "/repo"),)),
    ("git diff --check && git log -2", (("git_diff_check", "git diff --check", "/repo"), ("git_log", "git log -2", "/repo"))),
    ("echo 'open", (("unknown", "", "/repo"),)),
)
SCRIPTS = (
    ("const r = await tools.exec_command({cmd: 'pytest -q', workdir: \"/w\"}); text(r);", (("run_tests", "pytest -q", "/w"),)),
    ("await Promise.all([tools.read_file({path: `a`}), tools.shell({command: ['git', 'log']})]);", (("read_file", "read_file", "/repo"), ("git_log", "git log", "/repo"))),
    ("for (const f of list) { await tools.shell({command: f}); }", (("unknown", "", ""),)),
    ("tools.shell({command: `ls ${dir}`})", (("unknown", "", ""),)),
    ("const a = await tools.shell({command: 'ls -\\x61'}); for (const x of [a]) text(x);", (("find_related_files", "ls -a", "/repo"),)),
    ("tools.exec({code: 'tools.shell({command: 1})'})", (("unknown", "", ""),)),
    ("import('x'); tools.shell({command: 'ls'})", (("unknown", "", ""),)),
)


def _twin(calls) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({c}, {i}, {', '.join(map(quoted, op))})" for c, (_, ops) in enumerate(calls) for i, op in enumerate(ops))
    return f"""SELECT event_id, CAST(i AS INT) AS i, label, argv, cwd FROM (VALUES {rows}) v(c, i, label, argv, cwd)
JOIN (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) % {len(calls)} AS c FROM events) e USING (c)"""


def _operations(spark, sf_dir, tool: str, calls) -> DataFrame:
    texts = [c for c, _ in calls]

    @F.arrow_udf("array<struct<label:string,argv:string,cwd:string>>")
    def read_calls(c: pa.Array) -> pa.Array:
        reader = Reader()
        found = [[{"label": o.label, "argv": " ".join(o.argv), "cwd": o.cwd} for o in reader.operations(tool, {"command": texts[x]}, "/repo")] for x in c.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("argv", pa.string()), ("cwd", pa.string())])))

    e = read(spark, sf_dir, "events").select("event_id", (F.get_json_object("props", "$.k").cast("int") % len(calls)).alias("c"))
    return e.select("event_id", F.posexplode(read_calls("c")).alias("i", "o")).select("event_id", "i", "o.*")


@query(_twin(COMMANDS))
def normalize_commands(spark, sf_dir):
    """Operations of shell commands."""
    return _operations(spark, sf_dir, "bash", COMMANDS)


@query(_twin(SCRIPTS))
def wrapped_calls(spark, sf_dir):
    """Operations of wrapper scripts."""
    return _operations(spark, sf_dir, "functions.exec", SCRIPTS)


# --- reports ----------------------------------------------------------------------------------------------------------


@query(sql("""SELECT CAST(coalesce(o.observed, 0) AS BIGINT) AS observed, CAST(greatest(0, o.observed - c.avoided) AS BIGINT) AS with_tools, CAST(c.avoided AS BIGINT) AS avoided,
  CASE WHEN o.observed > 0 THEN round(100 * CAST(c.avoided AS DOUBLE) / o.observed, 3) ELSE 0.0 END AS percent, CAST(c.status + c.poll AS BIGINT) AS validation_and_polling, CAST(c.reuse AS BIGINT) AS reuse, c.credited
FROM (SELECT sum(CASE WHEN NOT replayed THEN output_tokens END) AS observed FROM rep) o, (SELECT coalesce(sum(reduction), 0) AS avoided, coalesce(sum(CASE WHEN mechanism = 'validation_status' THEN reduction END), 0) AS status,
  coalesce(sum(CASE WHEN mechanism = 'empty_poll' THEN reduction END), 0) AS poll, coalesce(sum(CASE WHEN mechanism = 'unchanged_result' THEN reduction END), 0) AS reuse, count(DISTINCT (session, position)) AS credited FROM cred) c"""))
def report_figures(spark, sf_dir):
    """The report's totals, rounded as it shows them."""
    found, _, done, _ = _credited(spark, sf_dir)
    mechanisms = {r["mechanism"]: r["avoided"] for r in mining.credit_by_mechanism(found).collect()}  # three rows at most
    analysis = {"timestamp": "", "diagnostics": mining.diagnostics(done).first().asDict(), "options": {}}
    r = wording.report(analysis, mining.credit_totals(found).first().asDict(), [], mechanisms, None)
    names = {"observed": "observed_tool_output_tokens", "with_tools": "estimated_tool_output_tokens_with_tools", "avoided": "estimated_tool_output_tokens_avoided", "percent": "reduction_percent",
             "validation_and_polling": "validation_and_polling_scenario_tokens", "reuse": "retained_result_reuse_scenario_tokens", "credited": "credited_results"}
    return spark.createDataFrame([tuple(float(r[v]) if k == "percent" else int(r[v]) for k, v in names.items())], ", ".join(f"{k} {'double' if k == 'percent' else 'bigint'}" for k in names))


@query(sql_plans("""SELECT count(*) AS model_calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS recorded_input_tokens, CAST(coalesce(sum(cached_input_tokens), 0) AS BIGINT) AS cached_input_tokens,
  CAST(coalesce(sum(cache_write_input_tokens), 0) AS BIGINT) AS cache_write_input_tokens, CAST(coalesce(sum(input_tokens - cached_input_tokens - cache_write_input_tokens), 0) AS BIGINT) AS uncached_input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS recorded_output_tokens FROM expo"""))
def usage_totals(spark, sf_dir):
    """Totals of recorded usage over all reasons, as the audit shows them."""
    from ..operators import audit

    rows = [r.asDict() for r in audit.by_reason(_exposure(spark, sf_dir)).collect()]  # a row a reason
    total = wording.usage(rows, 0, 0)["gross_historical_call_exposure"]
    return spark.createDataFrame([tuple(total.values())], ", ".join(f"{k} bigint" for k in total))


def _re2(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")


def redaction_sql(column: str) -> str:
    """All seven redactions. RE2 has no look-behind: a mark goes into home folders that follow a word character, and out at the end."""
    from ..functions.scalar import REDACTIONS

    mark, home = "\ue000", rf"""/(?:Users|home)/[^\s/'"]+|[A-Za-z]:\\Users\\[^\\\s]+"""
    rules = [(p, r.replace("$1", "\\1")) for p, r in REDACTIONS[:6]] + [(r"(\w/)((?:Users|home)/)", rf"\1{mark}\2"), (r"(\w[A-Za-z]:)(\\Users\\)", rf"\1{mark}\2"), (home, "<home>")]
    for pattern, replacement in rules:
        column = "regexp_replace({}, '{}', '{}', 'g')".format(column, _re2(pattern), replacement)
    return f"replace({column}, '{mark}', '')"


@query(f"SELECT doc_id, {redaction_sql('text')} AS redacted FROM documents")
def redact_documents(spark, sf_dir):
    """whole texts redacted by all seven rules."""
    return read(spark, sf_dir, "documents").select("doc_id", redact(F.col("text")).alias("redacted"))


@query(f"SELECT doc_id, 'example-session-1' AS session, CASE WHEN doc_id % 2 = 0 THEN 'project-1' ELSE 'project-unknown' END AS project, substr({redaction_sql('text')}, 1, 2000) AS command FROM documents WHERE text IS NOT NULL")
def export_examples(spark, sf_dir):
    """An example as an export shows it, without names and with its command redacted, then cut (the cut belongs to exports)."""
    @F.arrow_udf("struct<session:string,project:string,command:string>")
    def exported(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        out = []
        for d, t in zip(doc_id.to_pylist(), text.to_pylist(), strict=True):
            action = dict.fromkeys(("category", "tool", "line", "turn", "output_tokens", "success")) | {"command": t}
            bundle = wording.package({"projects": ["/p/0"], "examples": [{"session_id": f"s{d}", "source": "codex", "project": f"/p/{d % 2}", "path": "/u", "actions": [action]}]})
            one = bundle["candidate"]["examples"][0]
            out.append({"session": one["session_id"], "project": one["project"], "command": one["actions"][0]["command"]})
        return pa.array(out, pa.struct([("session", pa.string()), ("project", pa.string()), ("command", pa.string())]))

    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", exported("doc_id", "text").alias("x")).select("doc_id", "x.*")

