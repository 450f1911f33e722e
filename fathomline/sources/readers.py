"""Line readers of configuration files over ``lines`` (path, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import sensitive_name


def env_entries(lines: DataFrame) -> DataFrame:
    """(path, name, value) of KEY=VALUE lines; comments and blanks go."""
    t = F.trim("line")
    hits = lines.where(~t.startswith("#") & t.contains("="))
    name = F.trim(F.substring_index("line", "=", 1))
    return hits.select("path", "line_no", name.alias("name"), F.expr("substring(line, instr(line, '=') + 1)").alias("value")).where(F.col("name").rlike("^[A-Z_][A-Z0-9_]*$"))


def docker_env(lines: DataFrame) -> DataFrame:
    """(path, name) of ENV and ARG instructions."""
    name = F.regexp_extract("line", r"^\s*(?:ENV|ARG)\s+([A-Z_][A-Z0-9_]*)", 1)
    return lines.select("path", name.alias("name")).where("name <> ''")


def make_targets(lines: DataFrame) -> DataFrame:
    """(path, target) of rule lines; hidden, indented, variable and pattern rules go."""
    name = F.regexp_extract("line", r"^([^.\t$%:#\s][^:]*):(?:\s|$)", 1)
    return lines.select("path", "line_no", F.trim(name).alias("target")).where("target <> ''")


def requirements(lines: DataFrame, most: int = 20) -> DataFrame:
    """(path, name) of a requirements file's first lines."""
    hits = lines.where((F.col("line_no") < most) & (F.trim("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("-"))
    return hits.select("path", F.trim(F.regexp_extract("line", r"^[^=<>\[;]*", 0)).alias("name"))


def package_dependencies(content: Column, most: int = 20) -> Column:
    """The first names, in order, of the dependencies of a package.json."""
    return F.slice(F.array_sort(F.json_object_keys(F.get_json_object(content, "$.dependencies"))), 1, most)


def knowledge(content: Column, schema: str) -> Column:
    """Fields of an entry of the knowledge folder; null for a text that doesn't parse."""
    return F.from_json(content, schema)


def block_keys(lines: DataFrame, block: str, indent: int) -> DataFrame:
    """(path, key): keys at that indentation under a top-level ``block:``."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    top = F.regexp_extract("line", r"^([^\s#:]+):", 1)
    scoped = lines.withColumn("top", F.last(F.when(top != "", top), True).over(w))
    key = F.regexp_extract("line", rf"^ {{{indent}}}([\w-]+):", 1)
    return scoped.where(F.col("top") == block).select("path", "line_no", key.alias("key")).where("key <> ''")


def references(content: Column, pattern: str) -> Column:
    """Sorted distinct first groups of a pattern."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), F.lit(1))))


#: Fixed values: (area, regular expression over lower-case workflow texts), in order.
COVERAGE = (
    ("lint", "lint|eslint|ruff|clippy|golint"), ("test", "test|pytest|jest|vitest|cargo.test|go.test"), ("build", "build|compile|cargo.build|go.build"),
    ("typecheck", "tsc|typecheck|type-check|mypy|pyright"), ("security", "audit|snyk|trivy|security|dependabot"),
)
#: Fixed values: (purpose, words in the names of jobs), in order; security is told by the text.
PURPOSES = (("lint", "lint|check"), ("test", "test|spec"), ("build", "build|compile"), ("deploy", "deploy|release|publish"))
WORKFLOW = r"^\.github/workflows/[^/]*\.ya?ml$"


def _block(content: Column, key: str) -> Column:
    """Lines below a top-level ``key:`` up to the next line that is neither indented nor empty."""
    found = F.regexp_extract(content, rf"(?dm)^{key}:[^\n]*\n((?:[ \t][^\n]*(?:\n|\z)|\n)*)", 1)
    return F.split(found, "\n")


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def triggers(content: Column) -> Column:
    """Events of a workflow: an inline list, else all keys below ``on:``, nested ones too."""
    inline = F.regexp_extract(content, r"(?dm)^on:[ \t]*(\[[^\n]*)", 1)
    listed = F.transform(F.split(F.translate(inline, "[]", ""), ","), lambda t: F.translate(_bare(t), "\"'", ""))
    rows = F.filter(F.transform(_block(content, "on"), _bare), lambda t: (t != "") & ~t.rlike("^[#-]"))
    return F.when(inline != "", F.filter(listed, lambda t: t != "")).otherwise(F.transform(rows, lambda t: F.when(t.endswith(":"), F.regexp_replace(t, ":$", "")).otherwise(_bare(F.substring_index(t, ":", 1)))))


def jobs(content: Column) -> Column:
    """Names at an indentation of two or three blanks below ``jobs:``."""
    rows = F.filter(_block(content, "jobs"), lambda x: x.rlike(r"^  (?!  ).*:\s*$"))
    return F.transform(rows, lambda x: F.regexp_replace(_bare(x), ":$", ""))


def purpose(names: Column, content: Column) -> Column:
    text = F.lower(F.array_join(names, " "))
    parts = F.array_compact(F.array(*(F.when(text.rlike(words), name) for name, words in PURPOSES), F.when(F.lower(content).rlike("security|codeql|snyk"), "security")))
    return F.when(F.size(parts) == 0, "general").otherwise(F.array_join(parts, " + "))


def workflows(files: DataFrame) -> DataFrame:
    """(repo, file, name, triggers, jobs, secrets, purpose) of every workflow of ``files`` (repo, path, content)."""
    found = files.where(F.col("path").rlike(WORKFLOW)).select("repo", F.substring_index("path", "/", -1).alias("file"), F.coalesce("content", F.lit("")).alias("content"))
    name = F.regexp_extract("content", r"""(?dm)^\s*name:[ \t]*["']*([^\n]*?)["']*\s*$""", 1)
    named = found.select("repo", "file", F.when(F.col("content").rlike(r"(?m)^\s*name:"), name).otherwise(F.col("file")).alias("name"), triggers(F.col("content")).alias("triggers"), jobs(F.col("content")).alias("jobs"), references(F.col("content"), r"secrets\.([A-Z_][A-Z0-9_]*)").alias("secrets"), "content")
    return named.select("repo", "file", "name", "triggers", "jobs", "secrets", purpose(F.col("jobs"), F.col("content")).alias("purpose"))


def ci_coverage(files: DataFrame) -> DataFrame:
    """(repo, coverage, gaps): areas that some workflow's text names, and the others, in fixed order."""
    low = F.lower(F.coalesce("content", F.lit("")))
    flow = F.col("path").rlike(WORKFLOW)
    flags = files.groupBy("repo").agg(*(F.coalesce(F.bool_or(flow & low.rlike(p)), F.lit(False)).alias(a) for a, p in COVERAGE))
    has = lambda wanted: F.array_compact(F.array(*(F.when(F.col(a) == wanted, a) for a, _ in COVERAGE)))
    return flags.select("repo", has(True).alias("coverage"), has(False).alias("gaps"))


#: Files that define variables, in order of priority.
ENV_FILES = (".env.example", ".env.template", ".env.sample")


def env_variables(files: DataFrame) -> DataFrame:
    """(repo, name, source, is_sensitive, default): variables of the first example file, then of the Dockerfile, then of the compose file; an earlier source wins."""
    text = F.coalesce("content", F.lit(""))
    rank = F.when(F.col("path") == ENV_FILES[0], 0).when(F.col("path") == ENV_FILES[1], 1).when(F.col("path") == ENV_FILES[2], 2).when(F.col("path") == "Dockerfile", 3)
    rank = rank.when(F.col("path").isin("docker-compose.yml", "docker-compose.yaml"), 4)
    ranked = files.select("repo", "path", rank.alias("rank"), text.alias("content")).where("rank is not null")
    # Only the first example file counts.
    first = Window.partitionBy("repo")
    ranked = ranked.withColumn("example", F.min(F.when(F.col("rank") < 3, F.col("rank"))).over(first)).where("rank >= 3 or rank = example")
    lines = ranked.select("repo", "path", "rank", "content", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"))
    t = F.trim("line")
    pair = F.when((F.col("rank") < 3) & ~t.startswith("#") & t.contains("="), F.array(F.struct(F.trim(F.substring_index(t, "=", 1)).alias("name"), F.expr("substring(trim(line), instr(trim(line), '=') + 1)").alias("value"))))
    docker = F.when(F.col("rank") == 3, F.array(F.struct(F.regexp_extract("line", r"^\s*(?:ENV|ARG)\s+([^\s=]+)", 1).alias("name"), F.lit(None).cast("string").alias("value"))))
    compose = F.when(F.col("rank") == 4, F.transform(F.regexp_extract_all("line", F.lit(r"\$\{([A-Z_][A-Z0-9_]*)"), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("value"))))
    rows = lines.select("repo", "path", "rank", "line_no", F.explode(F.coalesce(pair, docker, compose)).alias("v")).select("repo", "path", "rank", "line_no", "v.*").where(F.col("name").rlike("^[A-Z_][A-Z0-9_]*$"))
    order = Window.partitionBy("repo", "name").orderBy("rank", "path", "line_no")
    kept = rows.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return kept.select("repo", "name", F.col("path").alias("source"), sensitive_name(F.col("name")).alias("is_sensitive"), F.nullif(F.trim("value"), F.lit("")).alias("default"))


def own_sections(lines: DataFrame, standard: tuple[str, ...]) -> DataFrame:
    """(path, sections): the text of second-level sections whose header is no standard one."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("line").startswith("## "), F.col("line")), True).over(w)
    own = ~F.exists(F.array(*map(F.lit, standard)), lambda s: F.col("header").startswith(s))
    kept = lines.withColumn("header", header).where(F.col("header").isNotNull() & own)
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return kept.groupBy("path").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("sections"))
