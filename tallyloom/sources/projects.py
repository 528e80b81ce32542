"""Which project a working directory belongs to."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame


def project_identity(cwd: str | None) -> tuple[str, str]:
    """(key, kind) of a working directory: its repository's store (worktrees share one), else the directory itself."""
    if not cwd or cwd == "unknown":
        return "unknown", "unknown"
    path = Path(cwd)
    for parent in (path, *path.parents) if path.is_dir() else ():
        try:
            store = _store(parent / ".git")
        except (OSError, UnicodeError):
            break
        if store:
            return str(store), "git"
    return str(path), "cwd"


def _store(marker: Path) -> Path | None:
    """The folder that a repository's marker stands for: itself, or what a worktree's file points to."""
    if marker.is_dir():
        return marker.resolve()
    if not marker.is_file() or not (line := marker.read_text().strip()).startswith("gitdir:"):
        return None
    own = (marker.parent / line.removeprefix("gitdir:").strip()).resolve()
    common = own / "commondir"
    return (own / common.read_text().strip()).resolve() if common.is_file() else own


def identities(projects: DataFrame) -> DataFrame:
    """project, project_key, project_kind. Folders are looked at on the driver, the machine that scans: executors' disks may differ.

    One short row for each distinct working directory of the corpus comes to the driver, as many as people have folders.
    """
    found = [(r["project"], *project_identity(r["project"])) for r in projects.toLocalIterator()]
    return projects.sparkSession.createDataFrame(found, "project string, project_key string, project_kind string")
