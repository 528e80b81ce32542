"""A store of parsed and derived tables, and the operations of the tool on it.

A store is a folder of Parquet tables in numbered versions; ``current`` names the version in use, so a failed scan leaves the last
one whole. Scans are incremental: files whose time, size and parser version are unchanged are not read again.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions.labels import BUNDLE
from ..operators import audit, mining
from ..sources import transcripts
from . import wording

#: Version of the store's layout; older stores are brought up to it when they are opened.
SCHEMA = 2
#: Messages that a summary shows of each kind; the table ``problems`` has all of them.
SHOWN = 1_000
DERIVED = ("candidates", "occurrences", "members", "credits")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        path = Path(root).expanduser()
        if path.is_symlink():
            raise ValueError("the store must not be a link")
        if path.exists() and (not path.is_dir() or (any(path.iterdir()) and not (path / "store.json").exists())):
            raise ValueError("the path has something else than a store; it is left as it is")
        if not path.exists():
            path.mkdir(parents=True, mode=0o700)
        os.chmod(path, 0o700)
        self.spark, self.root, self._meta = spark, path, path / "store.json"
        if not self._meta.exists():
            self._save({"schema": SCHEMA, "version": None, "analysis": None, "audit": None})
        found = self.meta()["schema"]
        if found not in range(1, SCHEMA + 1):
            raise ValueError(f"unsupported store schema {found}")
        if found < SCHEMA:  # what was derived by older rules goes; files are parsed again when they are scanned next
            self._save(self.meta() | {"schema": SCHEMA, "analysis": None, "audit": None})

    # tables

    def meta(self) -> dict:
        return json.loads(self._meta.read_text())

    def _save(self, meta: dict) -> None:
        part = self.root / f".{uuid.uuid4().hex}"
        with os.fdopen(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            json.dump(meta, f)
        part.replace(self._meta)

    def table(self, name: str, version: str | None = None) -> DataFrame:
        version = version or self.meta()["version"]
        if version is None:
            raise ValueError("nothing has been scanned yet")
        return self.spark.read.parquet(str(self.root / version / name))

    def _write(self, version: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(str(self.root / version / name))

    # scan

    def scan(self, paths, source: str | None = None, matchers: str | None = None) -> dict:
        """Reads what is new or changed; returns counts. ``matchers`` is the text of a JSON array of rules.

        Time and size of every file are compared with the manifest first; only files that differ are opened. One that changes or goes while
        it is read is left for the next scan.
        """
        transcripts.load_matchers(matchers)
        version = transcripts.parser_version(source, matchers)
        there, now = self.meta()["version"] is not None, f"v-{uuid.uuid4().hex}"
        found = transcripts.listed(self.spark, paths)
        old = self.table("parsed") if there else self.spark.createDataFrame([], schemas.PARSED)
        manifest = self.table("sources") if there else self.spark.createDataFrame([], schemas.SOURCES)
        known = manifest.where(F.col("parser_version") == version).select("path", "mtime", "size")
        fresh = found.join(known, ["path", "mtime", "size"], "left_anti")
        self._write(now, "fresh", fresh)
        fresh = self.spark.read.parquet(str(self.root / now / "fresh"))
        summary = {"discovered": found.count(), "imported": 0, "unchanged": 0, "duplicates": 0, "unsupported": 0, "actions": 0, "warnings": [], "errors": []}
        names = [r["path"] for r in fresh.select("path").toLocalIterator()]  # Spark's own reader lists its files on the driver, too
        if not names:
            return summary | {"unchanged": summary["discovered"]}
        rows = transcripts.parsed(transcripts.read(self.spark, names), source, matchers)
        self._write(now, "read", rows)
        rows = self.spark.read.schema(schemas.PARSED).parquet(str(self.root / now / "read"))
        self._write(now, "problems", self._unsteady(fresh, rows, [n for n in names if transcripts.is_plain(n)]))
        problems = self.table("problems", now)
        state = rows.join(problems, "path", "left_anti")

        # A malformed replacement keeps what was imported before; so does a file that can't be read.
        kept = old.select("path", F.col("digest").alias("old_digest"), F.col("parser_version").alias("old_version"))
        state = state.join(kept, "path", "left")
        malformed = F.col("old_digest").isNotNull() & (F.size("warnings") > 0)
        bad = F.col("error").isNotNull() | malformed
        problems = problems.unionByName(state.where(bad).select("path", F.lit("error").alias("kind"), F.coalesce("error", F.lit("malformed records; previous import retained")).alias("what")))
        good = state.where(~bad)
        same = (F.col("old_digest") == F.col("digest")) & (F.col("old_version") == F.col("parser_version"))
        good = good.withColumn("same", F.coalesce(same, F.lit(False)))
        others = old.join(rows.select("path"), "path", "left_anti").select("digest", "parser_version").distinct().withColumn("elsewhere", F.lit(True))
        first = F.row_number().over(W.partitionBy("digest", "parser_version").orderBy(~F.col("same"), "path"))
        good = good.join(others, ["digest", "parser_version"], "left").withColumn("twin", F.coalesce("elsewhere", F.lit(False)) | (first > 1))
        status = F.when(F.col("same"), "imported").when(F.col("twin"), "duplicate").when(F.size("actions") > 0, "imported").otherwise("unsupported")
        good = good.withColumn("status", status)
        self._write(now, "judged", good.select(*rows.columns, "same", "status"))
        judged = self.table("judged", now)
        problems = problems.unionByName(judged.select("path", F.lit("warning").alias("kind"), F.explode("warnings").alias("what")))
        self._write(now, "problems-all", problems)

        imported = judged.where("status = 'imported'").select(*rows.columns)
        self._write(now, "parsed", old.join(judged.select("path"), "path", "left_anti").unionByName(imported))
        manifest = manifest.join(judged.select("path"), "path", "left_anti").unionByName(judged.select(*manifest.columns))
        self._write(now, "sources", manifest)
        sessions, actions, usage = transcripts.tables(self.spark.read.schema(schemas.PARSED).parquet(str(self.root / now / "parsed")))
        for name, df in (("sessions", sessions), ("actions", actions), ("usage", usage)):
            self._write(now, name, df)

        new = judged.where("not same")
        for r in new.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("actions")).alias("a")).collect():
            summary[{"imported": "imported", "duplicate": "duplicates", "unsupported": "unsupported"}[r["status"]]] = r["n"]
            summary["actions"] += (r["a"] or 0) if r["status"] == "imported" else 0
        summary["unchanged"] = summary["discovered"] - len(names) + judged.where("same").count()
        for kind in ("error", "warning"):
            shown = self.table("problems-all", now).where(F.col("kind") == kind).orderBy("path", "what").limit(SHOWN).collect()
            summary[f"{kind}s"] = [f"{Path(r['path']).name}: {r['what']}" for r in shown]
        meta = self.meta()
        changed = bool(summary["imported"]) or (old.join(new.select("path"), "path", "left_semi").limit(1).count() > 0)
        if changed or meta["version"] is None:
            meta |= {"analysis": None, "audit": None}
        else:
            for name in DERIVED:
                if (self.root / meta["version"] / name).exists():
                    self._write(now, name, self.table(name))
        self._save(meta | {"version": now})
        return summary

    def _unsteady(self, fresh: DataFrame, rows: DataFrame, plain: list[str]) -> DataFrame:
        """(path, kind, what) of files that changed or went between listing and now; files in other stores change as wholes and are compared as read."""
        as_read = fresh.join(rows.select("path", F.col("mtime").alias("m"), F.col("size").alias("s")), "path", "left")
        after = transcripts.listed(self.spark, [p for p in plain if Path(p).exists()]).select("path", F.col("mtime").alias("m2"), F.col("size").alias("s2"))
        both = as_read.join(after, "path", "left").withColumn("plain", F.instr("path", "://") == 0)
        gone = F.col("s").isNull() | (F.col("plain") & F.col("s2").isNull())
        moved = (F.col("size") != F.col("s")) | (F.col("mtime") != F.col("m")) | (F.col("plain") & ((F.col("size") != F.col("s2")) | (F.col("mtime") != F.col("m2"))))
        kind, what = F.when(gone, "error").when(moved, "warning"), F.when(gone, "disappeared while reading").otherwise("changed while reading; retry later")
        return both.select("path", kind.alias("kind"), what.alias("what")).where(F.col("kind").isNotNull())

    # analysis

    def _current(self) -> None:
        stale = self.table("sessions").where(~F.col("parser_version").startswith(schemas.PARSER_VERSION + ":"))
        if stale.limit(1).count():
            raise ValueError("the parser has changed; scan the sources again before analysing")

    def analyse(self, options: mining.Options = mining.Options()) -> list[dict]:
        self._current()
        version, sessions = self.meta()["version"], self.table("sessions")
        kept = lambda df, name: self._write(version, f"mined-{name}", df) or self.table(f"mined-{name}")
        mined = mining.mine(self.table("actions"), options, kept)
        chosen = mining.candidates(mined, sessions, options)
        self._write(version, "candidates", chosen)
        chosen = self.table("candidates")
        self._write(version, "occurrences", mining.occurrences(mined, chosen))
        self._write(version, "members", mined.members.join(chosen.select("family", "id"), "family"))
        self._write(version, "credits", mining.credits(mined, chosen))
        counts = mining.diagnostics(mined).first().asDict()
        self._save(self.meta() | {"audit": None, "analysis": {"timestamp": datetime.now(timezone.utc).isoformat(), "diagnostics": counts, "options": options.__dict__}})
        return self.candidates("result")

    def candidates(self, order: str = "list", limit: int | None = None) -> list[dict]:
        if not self.meta()["analysis"]:
            return []
        rows = mining.ranked(self.table("candidates"), order)
        budget = self.meta()["analysis"]["options"]["result_budget"]
        return [wording.candidate(r.asDict(recursive=True), budget) for r in (rows.limit(limit) if limit else rows).collect()]

    def candidate(self, identifier: str) -> dict:
        found = [c for c in self.candidates() if c["id"] == identifier]
        if not found:
            raise ValueError(f"no candidate {identifier}; scan and analyse first")
        sessions, actions = self.table("sessions"), self.table("actions")
        shown = mining.examples(self.table("occurrences").where(F.col("id") == identifier), sessions)
        shown = shown.join(sessions.select("session", "session_id", "source", "project"), "session")
        inside = actions.select(F.col("session").alias("s"), "position", "category", "tool", "command", "line", "turn", "output_tokens", "success")
        rows = shown.join(inside, (F.col("session") == F.col("s")) & F.col("position").between(F.col("start"), F.col("end")))
        rows = rows.groupBy("rank", "session", "session_id", "source", "project", "start", "end").agg(F.array_sort(F.collect_list(F.struct("position", "category", "tool", "command", "line", "turn", "output_tokens", "success"))).alias("actions"))
        examples = [r.asDict(recursive=True) for r in rows.orderBy("rank").collect()]
        return found[0] | {"examples": [{**e, "path": e["session"]} for e in examples]}

    def report(self) -> dict:
        analysis = self.meta()["analysis"]
        if not analysis:
            raise ValueError("analyse before asking for a report")
        chosen, found = self.table("candidates"), self.table("credits")
        totals = mining.credit_totals(found).first()
        tools = mining.credit_by_tool(found, chosen)
        rows = [r.asDict() for r in mining.ranked(tools, "report").collect()]
        mechanisms = {r["mechanism"]: r["avoided"] for r in mining.credit_by_mechanism(found).collect()}
        return wording.report(analysis, totals.asDict(), rows, mechanisms, self.meta()["audit"])

    def audit(self) -> dict:
        if not self.meta()["analysis"]:
            raise ValueError("analyse before auditing usage")
        chosen, found, actions = self.table("candidates"), self.table("occurrences"), self.table("actions")
        relevant = audit.relevant_sessions(found, chosen)
        plans = audit.repeated_plans(audit.exact_plans(found, actions, self.table("sessions")))
        rows = audit.by_reason(audit.exposure(plans, actions, self.table("usage"), relevant)).orderBy("reason").collect()
        n = relevant.count()
        result = wording.usage([r.asDict() for r in rows], n, plans.count())
        self._save(self.meta() | {"audit": result})
        return result


__all__ = ["BUNDLE", "Store"]
