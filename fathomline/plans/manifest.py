"""The manifest: one row a collection with a struct per section, from (repo, path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import archetype as A
from ..operators import domains as D
from ..operators import profile as P
from ..operators import structure as S
from ..operators import tools as T
from ..operators.classify import LANGUAGES
from ..sources import readers


def languages(files: DataFrame) -> DataFrame:
    """(repo, language, languages): the one with the highest score, ties by name, and all by extension."""
    points = F.array_compact(F.array(*(F.when(P.path().isin(*marks) if marks else F.lit(False), F.struct(F.lit(lang).alias("language"), P.path().alias("by"))) for lang, marks, _ in LANGUAGES), *(F.when(P.path().endswith(e), F.struct(F.lit(lang).alias("language"), F.lit(e).alias("by"))) for lang, _, exts in LANGUAGES for e in exts)))
    hits = files.select("repo", F.explode(points).alias("p")).groupBy("repo", "p.language", "p.by").agg(F.count("*").alias("n"))
    scores = hits.groupBy("repo", "language").agg(F.sum(F.least("n", F.lit(10))).alias("score"))
    main = scores.groupBy("repo").agg(F.min_by("language", F.struct(-F.col("score"), "language")).alias("language"))
    named = files.select("repo", paths.language(paths.extension(P.path())).alias("name")).groupBy("repo").agg(F.array_sort(F.collect_set("name")).alias("languages"))
    return named.join(main, "repo", "left").select("repo", F.coalesce("language", F.lit("unknown")).alias("language"), "languages")


def make_targets(files: DataFrame) -> DataFrame:
    """(repo, makefile_targets) in the order of the Makefile."""
    text = files.where(P.path() == "Makefile").select(F.col("repo").alias("path"), F.posexplode(F.split(P.content(), "\n")).alias("line_no", "line"))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "target")))
    return readers.make_targets(text).groupBy(F.col("path").alias("repo")).agg(F.transform(rows, lambda r: r["target"]).alias("makefile_targets"))


def _per_kind(rows: DataFrame, kinds: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """(repo, <kind><name> ...): a sorted list of values for each kind."""
    return rows.groupBy("repo").agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == k, value))).alias(k + name) for k in kinds))


def manifest(files: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """(repo, identity, stack, commands, structure, archetype, ci, domain, env, quality): a struct per section.

    Each section is an aggregation by repo; what is listed is bounded by the rules' names, but for
    entry points, key and configuration files and variables, which are as many as the collection has.
    """
    repos = files.select("repo").distinct()
    spoken = languages(files)
    manager = A.package_manager(files)
    stack = spoken.join(P.monorepo(files), "repo").join(T.framework(files, spoken), "repo").join(manager, "repo").join(A.python_version(files), "repo").join(P.node_facts(files).select("repo", "node_version"), "repo")
    by_language = P.first_rule(tuple((m, lang) for lang, marks, _ in LANGUAGES for m in marks), P.marked, "other")
    by_lock = P.first_rule(A.PACKAGE_MANAGERS, lambda x: F.substring_index("path", "/", -1) == x, "NOT_CONFIGURED")
    commands = P.commands(files, by_language, by_lock).join(make_targets(files), "repo", "left").join(P.ports(files), "repo").join(A.production_url(files), "repo")
    folders = S.known_dirs(files)
    ordered = folders.groupBy("repo").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("idx", "dir")))), lambda x: x["dir"]).alias(f"{k}_dirs") for k in S.DIRECTORIES))
    named = _per_kind(S.named_files(files), ("entry", "key", "config"), F.col("path"), "_files")
    layout = S.structure(files).join(ordered, "repo", "left").join(named, "repo", "left")
    history = A.maturity(files, commits if commits is not None else repos.select("repo", F.lit(0).cast("long").alias("n_commits")))
    kind = A.archetype(files).join(history, "repo").join(A.complexity(files), "repo")
    flows = readers.workflows(files).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("file", "name", "triggers", "jobs", "secrets", "purpose"))).alias("workflows"))
    checks = P.ci_facts(files).join(readers.ci_coverage(files), "repo").join(flows, "repo", "left")
    areas = D.detected(files)
    listed = areas.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("idx", "domain", "paths"))).alias("detected_domains"))
    domain = repos.join(listed, "repo", "left").join(D.invariants(areas), "repo", "left").join(D.security_concerns(areas), "repo", "left").join(P.principles(files), "repo", "left")
    variables = readers.env_variables(files).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("name", "source", "is_sensitive", "default"))).alias("variables"))
    tools = T.quality_tools(files)
    each = tools.groupBy("repo").agg(*(F.first(F.when(F.col("category") == c, F.struct("tool", "config_file", "configured")), True).alias(c) for c in T.RULES))
    quality = each.join(T.missing_tools(tools), "repo").join(T.hook_system(files).select("repo", F.struct("system", "directory", "pre_commit", "pre_push", "commit_msg").alias("hooks")), "repo")
    sections = {"identity": A.identity(files), "stack": stack, "commands": commands, "structure": layout, "archetype": kind, "ci": checks, "domain": domain, "env": variables, "quality": quality}
    out = repos
    for name, section in sections.items():
        out = out.join(section.select("repo", F.struct(*(c for c in section.columns if c != "repo")).alias(name)), "repo", "left")
    return out


def documents(rows: DataFrame) -> DataFrame:
    """(repo, document): the manifest as JSON, nulls kept out."""
    return rows.select("repo", F.to_json(F.struct(*(c for c in rows.columns if c != "repo"))).alias("document"))
