"""Queries against their SQL twins on the smallest tables, and packing by brute force."""

import json
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tallyloom.operators import mining
from tallyloom.plans import catalogue, sessions, wording

DATA = Path("/root/testdata/sf0.001")
#: What the others are made of; the whole catalogue is compared by the driver.
CHOSEN = ("family_scores", "episode_rollup", "portfolio_credit", "usage_by_reason", "diagnostics", "request_numbering", "assistant_carry", "stream_turns", "message_turns", "sticky_outcome",
          "asof_process_link", "empty_poll_running_sum", "identical_result_reuse", "counter_delta", "result_dedup", "duplicate_files", "budget_clamp", "parsed_actions", "parsed_operations", "parsed_usage", "parsed_files", "conversation_files", "result_outcomes", "validation_reducer",
          "normalize_commands", "wrapped_calls", "report_figures", "usage_totals", "redact_documents", "export_examples", "custom_matchers")


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", CHOSEN)
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    rows = Counter(str(sorted(dict(zip(columns, r, strict=True)).items())) for r in found.fetchall())
    assert rows == Counter(str(sorted(r.asDict().items())) for r in catalogue.QUERIES[name](spark, str(DATA)).collect())


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_tasks_that_render_grow_with_the_steps(spark, monkeypatch):
    monkeypatch.setattr(sessions, "TASK_STEPS", 50)
    assert sessions.rendered(spark, str(DATA)).rdd.getNumPartitions() == -(-spark.read.parquet(f"{DATA}/events.parquet").count() // 50) > 8


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES) and sessions.parsed


def _segments(actions, most):
    """Islands and packs as lists of (position, op), written as one loop."""
    out, run, request = [], [], None

    def flush():
        if run:
            out.append(tuple(run))
        run.clear()

    for position, (asked, ops) in enumerate(actions):
        if request is not None and asked != request:
            flush()
        request = asked
        if len(ops) > most or "unknown" in ops:
            flush()
            continue
        if run and len(run) + len(ops) > most:
            flush()
        for i, o in enumerate(ops):
            if o == "read_file":
                flush()
                continue
            run.append((position, i))
            if len(run) >= most:
                flush()
    flush()
    return out


def test_packing_of_batches(spark):
    import random

    rng = random.Random(6)
    sessions = {s: [(rng.choice((1, 1, 1, 2)), rng.choices(["run_tests", "git_status", "build", "git_log", "read_file", "unknown"], [9, 9, 9, 9, 2, 1], k=rng.choice((1, 1, 2, 3, 4, 5)))) for _ in range(40)] for s in range(6)}
    rows = [
        (s, p, f"{s}-{p}", asked, p, 100, 0, True, None, "", 0, 0, [(o, o, o) for o in ops]) for s, actions in sessions.items() for p, (asked, ops) in enumerate(actions)
    ]
    schema = ("session long, position int, event_key string, request int, turn int, output_tokens long, assistant_tokens long, success boolean, compact_output_tokens long, linked_to string,"
              "poll_reduction_tokens long, repeat_output_reduction_tokens long, operations array<struct<label:string,template:string,exact:string>>")  # fmt: skip
    options = mining.Options(max_length=5)
    marked = mining.with_boundaries(mining.with_replay_flag(spark.createDataFrame(rows, schema)), options)
    got: dict = {}
    for r in mining.packed(mining.islands(marked), 5).orderBy("session", "position", "i").collect():
        got.setdefault((r["session"], r["island"], r["pack"]), []).append((r["position"], r["i"]))
    for s, actions in sessions.items():
        assert sorted(tuple(v) for k, v in got.items() if k[0] == s) == sorted(_segments(actions, 5))


def test_redaction_is_the_same_in_both_forms(spark):
    from pyspark.sql import functions as F

    from tallyloom.functions.scalar import redact

    texts = ["password=abc", "x sk-abcdefghijklmnop y", "Bearer abc.def", "curl https://u:p@h/x --token 'q r'", "/home/me/x and /Users/you", 'api_key: "k v"', "-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(redact(F.col("t"))).collect()]
    assert got == [wording.redact_text(t) for t in texts] and all(g != t for g, t in zip(got, texts, strict=True))
    assert "abc" not in json.dumps(got[0])


def test_whole_texts_are_redacted_by_all_rules(spark, tmp_path):
    homes = ["/home/me/x", "a/home/me", "/home/a/home/b", "/home/a-/home/b", r"C:\Users\me\x", r"xC:\Users\me", "see '/Users/you' and /home/z", "_/home/q", "/Users/C:\\Users\\d", "/home/"]
    texts = [*homes, "word " * 1000 + "password=abcdefgh /home/me/x", "password=/home/me", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: None if t is None else wording.redact_text(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["redacted"] for r in catalogue.QUERIES["redact_documents"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.execute(catalogue.ORACLES["redact_documents"]).fetchall()) == want
