"""Transcript files: which there are, and their bytes."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".json", ".jsonl")


def discover(paths) -> list[str]:
    """Files to read: named files of any suffix; *.json and *.jsonl below named folders, links left out. Sorted, each once."""
    found = set()
    for given in paths:
        path = Path(given).expanduser().resolve()
        if not path.exists():
            raise ValueError(f"no such input: {path}")
        inside = [path] if path.is_file() else (p for p in path.rglob("*") if p.suffix in SUFFIXES and p.is_file() and not p.is_symlink())
        found.update(str(p) for p in inside)
    return sorted(found)


def default_roots(claude: bool = False, codex: bool = False) -> list[str]:
    """Where the providers keep their logs on this machine; both without a choice."""
    home = Path.home()
    both = not (claude or codex)
    places = []
    if claude or both:
        root = Path(os.environ.get("CLAUDE_CONFIG_DIR", home / ".claude"))
        places += [root / "projects", root / "history.jsonl"]
    if codex or both:
        root = Path(os.environ.get("CODEX_HOME", home / ".codex"))
        places += [root / "sessions", root / "archived_sessions", root / "history.jsonl"]
    return [str(p) for p in places if p.exists()]


def is_plain(path) -> bool:
    """Whether a path is a plain local one: neither a glob nor in a store that only Spark reaches."""
    return "://" not in str(path) and not any(c in str(path) for c in "*?[{")


def listed(spark: SparkSession, paths) -> DataFrame:
    """path, mtime, size of all files; no byte of them is read. Globs and paths with a scheme are listed by Spark, others here."""
    here = [p for p in paths if is_plain(p)]
    rows = []
    for name in discover(here):
        try:
            at = os.stat(name)
        except OSError:  # gone since
            continue
        rows.append((name, at.st_mtime_ns // 1_000_000, at.st_size))
    out = spark.createDataFrame(rows, "path string, ms bigint, size bigint").select("path", F.timestamp_millis("ms").alias("mtime"), "size")
    others = [str(p) for p in paths if not is_plain(p)]
    if others:
        found = _rows(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,jsonl}"), others)
        out = out.unionByName(found.select("path", "mtime", "size")).distinct()
    return out


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, mtime, size, content of named files; those that have gone are left out."""
    return _rows(spark.read.option("ignoreMissingFiles", "true"), paths)


def _rows(reader, paths) -> DataFrame:
    rows = reader.format("binaryFile").load(paths)
    return rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
