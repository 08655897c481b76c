"""A log of runs: one JSON line for each, with its code, settings, data and place."""

from __future__ import annotations

import json
import platform
import subprocess
import time
import uuid
from importlib import metadata
from pathlib import Path

LOG = "runs.jsonl"


def _code() -> dict[str, object]:
    """The commit of the working folder and the number of changed files; empty outside a repository."""
    try:
        at = subprocess.run(["git", "describe", "--always", "--abbrev=40", "--match="], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        changed = subprocess.run(["git", "status", "--short"], capture_output=True, text=True, timeout=10, check=True).stdout.splitlines()
    except (OSError, subprocess.SubprocessError):
        return {}
    return {"commit": at, "changed_files": len(changed)}


def _place() -> dict[str, str]:
    versions = {d.metadata["Name"].lower(): d.version for d in metadata.distributions() if d.metadata["Name"]}
    return {"host": platform.node(), "python": platform.python_version(), **{k: versions.get(k, "") for k in ("pyspark", "pyarrow", "pandas", "numpy")}}


def record(folder: str, dataset: str, settings: str, seed: int, files: dict[str, str] | None = None) -> dict:
    """Append a run to the folder's log and return it; ``settings`` is their hash, ``files`` are digests by name."""
    run = {"id": uuid.uuid4().hex, "unix_time": round(time.time(), 3), "data": {"name": dataset, "files": files or {}}, "settings": settings, "seed": seed, "code": _code(), "place": _place()}
    Path(folder).mkdir(parents=True, exist_ok=True)
    with (Path(folder) / LOG).open("a") as f:
        f.write(json.dumps(run) + "\n")
    return run


def recorded(folder: str) -> list[dict]:
    """The folder's runs, oldest first."""
    path = Path(folder) / LOG
    return [json.loads(line) for line in path.read_text().splitlines()] if path.exists() else []
