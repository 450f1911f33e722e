"""Verification of many collections: rows (repo, name, status, detail) over ``files`` (repo, path, content).

One aggregation gathers the few documents that the checks read, and every check becomes an array of
rows of that one line a collection. Documents that the engine writes lie in ``OWN``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .profile import UNSET, any_of, path, text_of
from .structure import OWN

#: Documents that are checked: the guide, the agents' guide, the rules of editors, the manifest and the index.
GUIDE, AGENTS, RULES, MANIFEST, INDEX = "GUIDE.md", "AGENTS.md", ".cursorrules", OWN + "manifest.json", OWN + "index.json"
#: Names and folders whose times are compared with the manifest's.
WATCHED, FOLDERS = (GUIDE, AGENTS, RULES, "Makefile"), ("bin", "lib", "src", "tools")


def _row(name: str, status: Column | str, detail: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(name).alias("name"), lit(status).alias("status"), lit(detail).alias("detail"))


def _cases(name: str, *cases: tuple[Column | None, str, Column | str]) -> Column:
    """A row by the first case that holds; the last has no condition."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    status, detail = F.lit(cases[-1][1]), lit(cases[-1][2])
    for test, s, d in reversed(cases[:-1]):
        status, detail = F.when(test, s).otherwise(status), F.when(test, d).otherwise(detail)
    return _row(name, status, detail)


def exists(name: str, document: Column) -> Column:
    """V1: whether a document is there, and its lines."""
    return _cases(name, (document.isNull(), "FAIL", "missing"), (None, "PASS", F.format_string("exists, %d lines", F.size(text.lines(document)))))


def well_formed(document: Column) -> Column:
    """V2: whether the guide has its commands."""
    return _cases("guide structure", (document.isNull(), "FAIL", "file not found"), (document.contains("## Commands"), "PASS", "has ## Commands section"), (None, "WARN", "missing ## Commands section"))


def valid_json(name: str, document: Column) -> Column:
    """V3: whether the manifest is JSON."""
    return _cases(name, (document.isNull(), "WARN", "not found"), (F.try_parse_json(document).isNotNull(), "PASS", "valid JSON"), (None, "FAIL", "invalid JSON"))


def hooks(folder: Column, commit: Column, push: Column) -> Column:
    """V4: the two hook files."""
    return _cases(".githooks/", (~folder, "WARN", "directory missing"), (commit & push, "PASS", "pre-commit + pre-push present"), (commit, "WARN", "pre-push missing"), (push, "WARN", "pre-commit missing"), (None, "WARN", "both hooks missing"))


def command_of(manifest: Column, name: str) -> Column:
    """A command of the manifest; null where it is not set."""
    return F.nullif(F.get_json_object(manifest, f"$.commands.{name}"), F.lit(UNSET))


def configured(manifest: Column) -> Column:
    """V5: whether lint and test are set."""
    lint, test = command_of(manifest, "lint"), command_of(manifest, "test")
    open_ = F.concat_ws(", ", F.when(lint.isNull(), "lint"), F.when(test.isNull(), "test"))
    return _cases("commands", (F.try_parse_json(manifest).isNull(), "WARN", "manifest not found or invalid"), (open_ == "", "PASS", "lint + test configured"), (None, "WARN", F.concat(open_, F.lit(" not configured"))))


def consistency(guide: Column, commit: Column, push: Column, manifest: Column) -> Column:
    """V6: an array of warnings where guide, hooks and manifest name different commands, else one row that they agree."""
    guide = F.coalesce(guide, F.lit(""))
    found = {
        "consistency-lint": (F.coalesce(text.fenced_command(guide, "shellcheck"), text.fenced_command(guide, "lint")), F.coalesce(commit, F.lit(""))),
        "consistency-test": (F.coalesce(text.fenced_command(guide, "make test"), text.fenced_command(guide, "test")), F.coalesce(push, F.lit(""))),
    }
    rows = [F.when(c.isNotNull() & (hook != "") & ~hook.contains(c), _row(name, "WARN", F.concat(F.lit("not in the hook: "), c))) for name, (c, hook) in found.items()]
    rows += [F.when(command_of(manifest, k).isNotNull() & ~guide.contains(command_of(manifest, k)), _row(f"consistency-manifest-{k}", "WARN", F.concat(F.lit("not in the guide: "), command_of(manifest, k)))) for k in ("lint", "test")]
    warnings = F.array_compact(F.array(*rows))
    return F.when(F.size(warnings) == 0, F.array(_row("consistency", "PASS", "commands agree"))).otherwise(warnings)


def security(ignores: Column, leaks: Column, tracked: Column) -> list[Column]:
    """V7: ignored environment, secrets in generated documents (their names, joined), a tracked environment."""
    return [
        _cases("security-gitignore", (ignores.isNull(), "WARN", ".gitignore missing"), (ignores.rlike(r"(?m)^\s*\.env\*?\s*$"), "PASS", ".gitignore includes .env"), (None, "WARN", ".gitignore has no .env entry")),
        _cases("security-secrets", (leaks == "", "PASS", "no secret patterns in generated files"), (None, "FAIL", F.concat(F.lit("potential secrets in: "), leaks))),
        _cases("security-env-tracked", (tracked, "FAIL", ".env is tracked"), (None, "PASS", ".env not tracked")),
    ]


def freshness(made: Column, latest: Column, index: Column) -> list[Column]:
    """V8: the manifest's time against the watched files', and whether there is an index."""
    return [
        _cases("freshness-manifest", (made.isNull(), "WARN", "manifest missing"), (F.coalesce(latest > made, F.lit(False)), "WARN", "manifest may be stale"), (None, "PASS", "manifest is up to date")),
        _cases("freshness-index", (index, "PASS", "index present"), (None, "WARN", "no index")),
    ]


def gate(manifest: Column) -> Column:
    """V9: an array with one row that both commands are set, else one for each that is not."""
    lint, test = command_of(manifest, "lint"), command_of(manifest, "test")
    rows = [
        F.when(lint.isNull(), _row("quality-gate-lint", "WARN", "lint command not configured")),
        F.when(test.isNull(), _row("quality-gate-test", "WARN", "test command not configured")),
        F.when(lint.isNotNull() & test.isNotNull(), _row("quality-gate", "PASS", F.concat(F.lit("lint: "), lint, F.lit(", test: "), test))),
    ]
    return F.when(F.try_parse_json(manifest).isNull(), F.array(_row("quality-gate", "WARN", "manifest not available"))).otherwise(F.array_compact(F.array(*rows)))


def checks(files: DataFrame, tracked: bool = True) -> DataFrame:
    """(repo, name, status, detail): all checks. ``files`` may have ``mtime``; with ``tracked`` every listed file counts as tracked."""
    timed = "mtime" in files.columns
    time = F.col("mtime") if timed else F.lit(None).cast("timestamp")
    watched = path().isin(*WATCHED) | path().rlike(f"^({'|'.join(FOLDERS)})/[^/]+$")
    own = (GUIDE, AGENTS, MANIFEST, RULES)
    secret = text.secrets(F.coalesce(F.col("content"), F.lit("")))
    f = files.groupBy("repo").agg(
        text_of(GUIDE).alias("guide"), text_of(AGENTS).alias("agents"), text_of(MANIFEST).alias("manifest"), text_of(".githooks/pre-commit").alias("commit"), text_of(".githooks/pre-push").alias("push"), text_of(".gitignore").alias("ignores"),
        any_of(path().startswith(".githooks/")).alias("folder"), any_of(path() == ".env").alias("env"), any_of(path() == INDEX).alias("index"),
        F.max(F.when(path() == MANIFEST, time)).alias("made"), F.max(F.when(watched, time)).alias("latest"), *(any_of((path() == x) & secret).alias(f"leak{i}") for i, x in enumerate(own)),
    )
    c = F.col
    leaks = F.concat_ws(", ", *(F.when(c(f"leak{i}"), x) for i, x in enumerate(own)))
    manifest = F.when(F.try_parse_json("manifest").isNotNull(), c("manifest"))
    single = [
        exists(GUIDE, c("guide")), exists(AGENTS, c("agents")), well_formed(c("guide")), valid_json("manifest.json", c("manifest")), hooks(c("folder"), c("commit").isNotNull(), c("push").isNotNull()), configured(c("manifest")),
        *security(c("ignores"), leaks, c("env") & F.lit(tracked)), *(freshness(c("made"), c("latest"), c("index")) if timed else [freshness(c("made"), c("latest"), c("index"))[1]]),
    ]
    rows = F.concat(F.array(*single), consistency(c("guide"), c("commit"), c("push"), manifest), gate(manifest))
    return f.select("repo", F.explode(rows).alias("r")).select("repo", "r.*")


def failed(rows: DataFrame) -> bool:
    """Whether any check failed: the exit status of a verification."""
    return not rows.where("status = 'FAIL'").isEmpty()


def summary(rows: DataFrame) -> DataFrame:
    """(status, n, width): rows by status, and the longest name."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.max(F.length("name")).cast("long").alias("width"))
