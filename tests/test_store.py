import hashlib
import json
import os

import pytest
from made import LOG, Talk, four, put, tokens, working

from tallyloom import cli
from tallyloom.operators.mining import Options
from tallyloom.plans import wording
from tallyloom.plans.store import Store

WELL = "a made-up case went well\n" * 300
named = lambda family: hashlib.sha256(f"v2:{family}".encode()).hexdigest()[:12]
REPORT, OUTPUT = named("validation_report"), named("validation_output")


def analysed(spark, tmp_path, files, **options):
    (tmp_path / "in").mkdir(parents=True)
    store = Store(spark, str(tmp_path / "store"))
    summary = store.scan(put(tmp_path / "in", files))
    return store, summary, store.analyse(Options(**options))


def test_the_same_work_four_times(spark, tmp_path):
    store, summary, found = analysed(spark, tmp_path, four())
    sizes = [tokens(LOG), tokens({"exit_code": 0, "output": LOG})]
    saved = 2 * sum(s - 200 for s in sizes)  # the least that a result costs is 200
    small = [tokens("3f2a tidy\n77b0 wider bins\n"), tokens({"exit_code": 0, "output": "3f2a tidy\n77b0 wider bins\n"}), tokens({"exit_code": 0, "output": ""})]
    total = 2 * (sum(sizes) + sum(small))
    assert (summary["imported"], summary["actions"]) == (4, 12)
    assert [(c["name"], c["occurrences"], c["id"]) for c in found] == [("validate_and_report", 4, REPORT), ("summarize_validation_results", 4, OUTPUT)]
    top = found[0]
    assert (top["score"], top["average_tool_output_tokens"], top["average_model_turns"], top["unresolved_project_count"]) == (saved, round(total / 4, 2), 3.0, 2)
    r = store.report()
    assert (r["estimated_tool_output_tokens_avoided"], r["estimated_tool_output_tokens_with_tools"], r["credited_results"]) == (saved, total - saved, 4)
    assert r["reduction_percent"] == round(100 * saved / total, 3)
    assert [(t["tool"], t["estimated_tokens_avoided"]) for t in r["by_tool"]] == [("validate_and_report", saved), ("summarize_validation_results", 0)]
    assert f"{saved:,}" in wording.report_text(r)
    shown = store.candidate(REPORT)
    assert len(shown["examples"]) == 3 and len(shown["examples"][0]["actions"]) == 3
    text = wording.package_text(wording.package(shown))
    assert "/work/" not in text and "example-session-1" in text and str(tmp_path) not in text
    again = store.scan([str(tmp_path / "in")])
    assert (again["unchanged"], again["imported"]) == (4, 0) and store.report() == r
    with pytest.raises(ValueError):
        store.candidate("none")


def test_forks_are_replays(spark, tmp_path):
    rows = working("fork", steps=(("go test ./...", WELL), ("git status", "")), short=False).stream()
    fork = json.loads(json.dumps(rows))
    fork[0]["payload"]["id"] = "other"
    assert analysed(spark, tmp_path, {"a.json": rows, "b.json": fork})[2] == []


def test_boundaries_and_variants(spark, tmp_path):
    kinds = [("cargo build", "git status"), ("cargo test", "git diff --stat")] * 2
    files = {f"v{i}.json": working(f"v{i}", steps=[(c, WELL) for c in k]).stream() for i, k in enumerate(kinds)}
    bundles = [c for c in analysed(spark, tmp_path, files)[2] if c["opportunity_type"] == "workflow_bundle"]
    assert len(bundles) == 1 and bundles[0]["occurrences"] == 4 and len(bundles[0]["variants"]) == 2
    files = {f"p{i}.json": working(f"p{i}", steps=[(c, WELL) for c in ("cargo test", "git push", "git status")]).stream() for i in range(3)}
    assert not [c for c in analysed(spark, tmp_path / "x", files)[2] if c["opportunity_type"] == "workflow_bundle"]


@pytest.mark.parametrize("ends", [False, True])
def test_polls(spark, tmp_path, ends):
    files = {}
    for s in ("warp", "weft"):
        talk = Talk(f"poll-{s}").ask().launch("cargo test", 31)
        for _ in range(4):
            talk.poll(31)
        if ends:
            talk.poll(31, "FAILED: a made-up case", 1)
        files[f"{s}.json"] = talk.stream()
    store, _, found = analysed(spark, tmp_path, files)
    r = store.report()
    avoided = 2 * 4 * tokens({"session_id": 31, "output": ""}) if ends else 0
    assert r["estimated_tool_output_tokens_avoided"] == avoided and [c["name"] for c in found] == (["await_process_completion"] if ends else [])


def test_terminal_and_poll_credit_are_apart(spark, tmp_path):
    files = {f"{s}.json": Talk(f"sum-{s}").ask().launch("cargo test", 11).poll(11).poll(11, WELL, 0).run("git status").stream() for s in ("warp", "weft")}
    store, _, _ = analysed(spark, tmp_path, files)
    r = store.report()
    assert (r["credited_results"], r["credited_mechanisms"]) == (2, 4)
    assert r["estimated_tool_output_tokens_avoided"] == sum(t["estimated_tokens_avoided"] for t in r["by_tool"]) < r["observed_tool_output_tokens"]


def test_repeated_reads(spark, tmp_path):
    page = "a made-up line of source\n" * 500
    files = {f"{s}.json": Talk(f"read-{s}").ask().run("cat same.rs", page).run("cat same.rs", page).stream() for s in ("warp", "weft")}
    store, _, found = analysed(spark, tmp_path, files)
    assert [c["name"] for c in found] == ["reuse_unchanged_results"] and store.report()["estimated_tool_output_tokens_avoided"] == 2 * (tokens({"exit_code": 0, "output": page}) - 200)


@pytest.mark.parametrize("kind,calls", [("plain", 4), ("spoilt", 2), ("varied", 0)])
def test_usage(spark, tmp_path, kind, calls):
    files, fields = {}, ("input_tokens", "cached_input_tokens", "output_tokens")
    for k in range(2):
        talk, total = Talk(f"use-{k}").ask(), (0, 0, 0)
        for turn, (command, out) in enumerate(((f"pytest t{k if kind == 'varied' else 0}.py", WELL), ("git status", ""), ("git diff --check", "")), 1):
            last = (1000 * turn, 1000 * turn - 500, 10 * turn)
            total = tuple(a + b for a, b in zip(total, last, strict=True))
            shown = (last[0] + (kind == "spoilt" and turn == 3), *last[1:])
            talk.run(command, out)
            for _ in range(2):
                talk.count(dict(zip(fields, shown, strict=True)), dict(zip(fields, total, strict=True)))
        files[f"{k}.json"] = talk.stream()
    store, _, _ = analysed(spark, tmp_path, files)
    before = store.report()["estimated_tool_output_tokens_avoided"]
    found = store.audit()["gross_historical_call_exposure"]
    # Of three turns the first is not counted; the last is not trusted where its counters disagree.
    turns = {4: [2, 3] * 2, 2: [2] * 2, 0: []}[calls]
    assert (found["model_calls"], found["recorded_input_tokens"]) == (calls, sum(1000 * t for t in turns))
    assert (found["cached_input_tokens"], found["uncached_input_tokens"], found["recorded_output_tokens"]) == (sum(1000 * t - 500 for t in turns), 500 * calls, sum(10 * t for t in turns))
    assert store.report()["estimated_tool_output_tokens_avoided"] == before


def test_changes_duplicates_and_refusals(spark, tmp_path):
    rows = working("a").messages()
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, {"a.json": rows, "copy.json": rows, "index.jsonl": '{"display": "x"}\n'})
    store = Store(spark, str(tmp_path / "store"))
    s = store.scan([str(folder)])
    assert (s["imported"], s["duplicates"], s["unsupported"]) == (1, 1, 1)
    (folder / "a.json").write_text('{"torn')
    s = store.scan([str(folder)])
    assert s["errors"] == ["a.json: malformed records; previous import retained"] and store.table("sessions").count() == 1
    with pytest.raises(ValueError):
        store.scan([str(tmp_path / "missing")])
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "f").write_text("x")
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "other"))
    with pytest.raises(ValueError):
        Options(min_length=1)


def test_only_changed_files_are_opened_and_unsteady_ones_wait(spark, tmp_path, monkeypatch):
    from tallyloom.sources import transcripts

    folder, opened, read = tmp_path / "in", [], transcripts.read
    folder.mkdir()
    put(folder, {"a.json": working("a").messages(), "b.json": working("b").stream()})
    monkeypatch.setattr(transcripts, "read", lambda spark, names: opened.append([os.path.basename(n) for n in names]) or read(spark, names))
    store = Store(spark, str(tmp_path / "store"))
    assert store.scan([f"{folder}/*.json"])["imported"] == 2  # a glob
    assert store.scan([str(folder)])["unchanged"] == 2 and [sorted(x) for x in opened] == [["a.json", "b.json"]]
    put(folder, {"b.json": working("b2").stream()})
    assert store.scan([str(folder)])["imported"] == 1 and opened[1:] == [["b.json"]]

    def touched(spark, names):
        out = spark.createDataFrame(read(spark, names).collect(), "path string, mtime timestamp, size bigint, content binary")
        (folder / "c.json").write_text((folder / "c.json").read_text() + " ")
        (folder / "d.json").unlink()
        return out

    put(folder, {"c.json": working("c").stream(), "d.json": working("d").stream()})
    monkeypatch.setattr(transcripts, "read", touched)
    s = store.scan([str(folder)])
    assert s["warnings"] == ["c.json: changed while reading; retry later"] and s["errors"] == ["d.json: disappeared while reading"] and s["imported"] == 0
    monkeypatch.setattr(transcripts, "read", read)
    assert store.scan([str(folder)])["imported"] == 1 and store.table("sessions").count() == 3


def test_older_stores_are_brought_up_to_date(spark, tmp_path):
    place = tmp_path / "store"
    Store(spark, str(place))
    meta = json.loads((place / "store.json").read_text())
    (place / "store.json").write_text(json.dumps(meta | {"schema": 1, "analysis": {"old": True}}))
    assert Store(spark, str(place)).meta() | {"version": None} == meta
    (place / "store.json").write_text(json.dumps(meta | {"schema": 9}))
    with pytest.raises(ValueError):
        Store(spark, str(place))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", four())
    store = ["--store", str(tmp_path / "store")]
    assert cli.main([*store, "scan", str(tmp_path / "in")]) == 0
    assert cli.main([*store, "analyse", "--model-usage", "--keep-nested"]) == 0
    assert cli.main([*store, "candidates", "--json", "--limit", "1"]) == 0
    out = tmp_path / "report.md"
    assert cli.main([*store, "report", "-o", str(out)]) == 0 and "%" in out.read_text() and out.stat().st_mode & 0o777 == 0o600
    assert cli.main([*store, "report", "-o", str(out)]) == 2
    assert cli.main([*store, "candidate", "show", REPORT]) == 0
    assert cli.main([*store, "candidates", "--limit", "0"]) == 2
    assert REPORT in capsys.readouterr().out


def test_mining_reads_no_long_columns(spark, tmp_path):
    store, _, _ = analysed(spark, tmp_path, four())
    from tallyloom.operators import mining

    def kept(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        read = [x for x in plan.split("ReadSchema: ")[1:]]
        assert not any(c in r.split("\n")[0] for r in read for c in ("raw_arguments", "command:")), name
        return df

    mining.mine(store.table("actions"), Options(), kept)
