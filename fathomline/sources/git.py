"""Facts that only version control knows, asked on the driver: one small answer a tree."""

from __future__ import annotations

import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "n_commits long, last_commit timestamp, contact string, env_tracked boolean"


def _asked(root: str, *arguments: str) -> str | None:
    """Output of a git command; null where there is no git, no repository or an error."""
    try:
        done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def log(spark: SparkSession, root: str) -> DataFrame:
    """One row: commits (0 where unknown), time of the last one, the user's name, whether .env is tracked; nulls where unknown."""
    count, last = _asked(root, "rev-list", "--count", "HEAD"), _asked(root, "log", "-1", "--format=%ct")
    tracked = _asked(root, "ls-files", ".env")
    when = datetime.fromtimestamp(int(last), timezone.utc) if last and last.isdigit() else None
    row = (int(count) if count and count.isdigit() else 0, when, _asked(root, "config", "user.name"), None if tracked is None else tracked != "")
    return spark.createDataFrame([row], SCHEMA)
