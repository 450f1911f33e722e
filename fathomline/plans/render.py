"""Documents rendered from manifests and indexes as column expressions: (repo, path, content) rows.

A document is a list of parts; a part that is null goes, and the rest is joined by line ends. Which
documents a collection gets depends on its tier. The prose is our own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import graph
from ..operators.checks import AGENTS, GUIDE, INDEX, MANIFEST
from ..operators.domains import DOMAIN_RULES, RULES
from ..operators.profile import UNSET
from .index import Index

#: Tiers from the smallest set of documents to the largest.
TIERS = ("lean", "standard", "full", "enterprise")
#: Our own prose: language -> (conventions, style, tests).
PROSE = {
    "python": ("Virtual environment first; type hints on public functions", "snake_case names, one import a line", "Tests in tests/, named test_*.py"),
    "typescript": ("Strict types; see tsconfig.json", "camelCase names, no default exports of many things", "Tests beside the code, named *.test.ts"),
    "javascript": ("Modules over scripts", "camelCase names", "Tests beside the code, named *.test.js"),
    "rust": ("cargo clippy without warnings", "cargo fmt", "Unit tests in the module, others in tests/"),
    "go": ("Errors are returned, not thrown", "gofmt", "Tests beside the code, named *_test.go"),
    "ruby": ("Small objects", "rubocop", "Tests in spec/"),
    "java": ("Interfaces at borders", "One class a file", "Tests in src/test"),
    "bash": ("set -euo pipefail; shellcheck clean", "Quote every expansion", "Tests run the scripts"),
}
#: Our own prose for other languages.
PLAIN = ("Follow the code around", "Follow the code around", "Keep tests beside what they test")
#: Commands that documents show, in order.
SHOWN = ("install", "dev", "build", "lint", "typecheck", "test", "format")
#: Formatter -> command for one file.
FORMATTERS = {"prettier": "npx prettier --write", "ruff-format": "ruff format", "black": "black", "rustfmt": "rustfmt", "gofmt": "gofmt -w"}
#: Language -> set-up steps of a workflow.
SETUP = {"python": "actions/setup-python@v5", "javascript": "actions/setup-node@v4", "typescript": "actions/setup-node@v4", "go": "actions/setup-go@v5", "ruby": "ruby/setup-ruby@v1", "java": "actions/setup-java@v4"}

Part = Column | str | None


def c(name: str) -> Column:
    return F.col(name)


def text(*parts: Part) -> Column:
    """Parts that are not null, each on its own lines."""
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts if p is not None))


def line(*pieces: Column | str) -> Column:
    """Pieces in a row; null if one of them is."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces))


def listed(values: Column, show: Callable[[Column], Column], most: int | None = None) -> Column:
    """A line for every value; null without any."""
    values = F.slice(values, 1, most) if most else values
    return F.when(F.size(values) > 0, F.array_join(F.transform(values, show), "\n"))


def section(title: str, body: Column) -> Column:
    """A headed section; null without a body."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"\n## {title}\n\n"), body))


def set_(name: str) -> Column:
    """A command, null where it is not set."""
    return F.nullif(c(f"commands.{name}"), F.lit(UNSET))


def fenced(body: Column, kind: str = "bash") -> Column:
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"```{kind}\n"), body, F.lit("\n```")))


def stack_label() -> Column:
    return F.concat_ws("/", c("stack.language"), F.nullif(c("stack.framework"), F.lit("none")))


def prose(at: int) -> Column:
    return paths.lookup({k: v[at] for k, v in PROSE.items()}, c("stack.language"), PLAIN[at])


def rules() -> Column:
    """Invariants of the guide: the first general one, then those of the domains that were found."""
    found = F.transform(F.coalesce("domain.detected_domains", F.array()), lambda d: d["domain"])
    own = [F.when(F.array_contains(found, d), f"- **{label}**: {rule}") for d, label, rule in DOMAIN_RULES]
    return F.concat_ws("\n", F.lit(f"- **{RULES[0][1]}**: {RULES[0][2]}"), *own)


def guide() -> Column:
    """The main guide."""
    commands = fenced(F.concat_ws("\n", *(F.when(set_(x).isNotNull(), F.concat(set_(x), F.lit(f"  # {x}"))) for x in SHOWN)))
    folders = F.concat_ws("\n", listed(c("structure.source_dirs"), lambda d: line("- **Source**: `", d, "/`")), listed(c("structure.test_dirs"), lambda d: line("- **Tests**: `", d, "/`")))
    tool = lambda t, k: F.when(c(f"quality.{k}.tool").isNotNull(), line(f"- **{t}**: ", c(f"quality.{k}.tool"), F.coalesce(line(" (`", c(f"quality.{k}.config_file"), "`)"), F.lit(""))))
    gotchas = F.concat_ws("\n", line("- ", prose(0)), F.when(c("stack.language").isin("typescript"), "- Compiler options live in tsconfig.json"), F.when(c("stack.language") == "bash", "- Run shellcheck before committing"))
    return text(
        line("# ", F.lit(GUIDE), " — ", c("identity.name")), F.when(c("identity.description") != "", line("\n> ", c("identity.description"))),
        "\n## Commands\n", F.coalesce(commands, F.lit("No commands were found.")),
        section("Architecture", F.concat_ws("\n", line("- **Stack**: ", stack_label()), line("- **Archetype**: ", c("archetype.archetype")), F.when(c("stack.is_monorepo"), line("- **Monorepo**: yes (", c("stack.monorepo_tool"), ")")))),
        section("Key Files", listed(c("top_files"), lambda f: line("- `", f, "`"), 15)), F.when(F.size("stack.languages") > 1, line("\n**Languages**: ", F.array_join("stack.languages", ", "))),
        section("Key Locations", folders), F.when(F.size("structure.entry_files") > 0, line("\n**Entry points**: `", F.array_join(F.slice("structure.entry_files", 1, 5), "`, `"), "`")),
        section("Environment Variables", listed(c("env.variables"), lambda v: line("| ", v["name"], " | ", F.when(v["is_sensitive"], "Yes").otherwise("No"), " |"), 20)),
        section("Invariants", rules()), section("Makefile", fenced(listed(c("commands.makefile_targets"), lambda t: line("make ", t)))),
        section("Quality Tools", F.concat_ws("\n", tool("Linter", "linter"), tool("Formatter", "formatter"), tool("Type checker", "type_checker"), tool("Test framework", "test_framework"))),
        section("CI", F.when(c("ci.ci_provider") != "none", F.concat_ws("\n", line("- **Provider**: ", c("ci.ci_provider")), F.when(F.size("ci.coverage") > 0, line("- **Covered**: ", F.array_join("ci.coverage", ", "))), F.when(F.size("ci.gaps") > 0, line("- **Gaps**: ", F.array_join("ci.gaps", ", ")))))),
        section("Gotchas", gotchas),
    )


def agents() -> Column:
    """The guide for several agents."""
    return text(
        line("# ", F.lit(AGENTS), " — ", c("identity.name")), F.when(c("identity.description") != "", line("\n", c("identity.description"))),
        section("Stack", F.concat_ws("\n", line("- **Language**: ", c("stack.language")), line("- **Framework**: ", F.nullif(c("stack.framework"), F.lit("none"))), line("- **Archetype**: ", c("archetype.archetype")))),
        section("Commands", F.concat_ws("\n", *(line(f"- **{x}**: `", set_(x), "`") for x in ("install", "build", "lint", "test")))),
        section("Structure", F.concat_ws("\n", line("- Source: ", F.array_join("structure.source_dirs", ", ")), line("- Tests: ", F.array_join("structure.test_dirs", ", ")), line("- Entry points: ", F.array_join(F.slice("structure.entry_files", 1, 5), ", ")))),
        section("Conventions", F.concat_ws("\n", *(line("- ", prose(i)) for i in range(3)))),
    )


def editor_rules() -> Column:
    return text(
        line("# Rules for ", c("identity.name")), line("\nStack: ", stack_label()), line("Style: ", prose(1)), line("Tests: ", prose(2)),
        line("Folders: ", F.array_join(F.concat(F.coalesce("structure.source_dirs", F.array()), F.coalesce("structure.test_dirs", F.array())), ", ")),
        line("Configuration: ", F.array_join(F.slice("structure.config_files", 1, 8), ", ")),
    )


def hook(name: str, commands: tuple[str, ...]) -> Column:
    """A hook that runs commands; null if none of them is set."""
    steps = F.concat_ws("\n", *(line(f'echo "{name}: {x}"\n', set_(x)) for x in commands))
    return F.when(steps != "", line("#!/usr/bin/env bash\nset -euo pipefail\n", steps, "\n"))


def settings() -> Column:
    """Editor settings as JSON: the formatter runs after a file is written, destructive commands are denied."""
    formatter = paths.lookup(FORMATTERS, c("quality.formatter.tool"))
    run = F.to_json(F.struct(F.lit("write").alias("after"), formatter.alias("run")))
    return line('{"deny": ["rm -rf /", "git push --force"], "format": ', F.when(formatter.isNotNull(), run).otherwise("null"), "}")


def workflow() -> Column:
    """A workflow; null where the collection has one."""
    steps = [F.when(paths.lookup(SETUP, c("stack.language")).isNotNull(), line("      - uses: ", paths.lookup(SETUP, c("stack.language"))))]
    steps += [line(f"      - name: {x}\n        run: ", set_(x)) for x in ("install", "lint", "test", "build")]
    whole = text("name: CI", "on:\n  push:\n    branches: [main]\n  pull_request:", "jobs:\n  ci:\n    runs-on: ubuntu-latest\n    steps:\n      - uses: actions/checkout@v4", *steps)
    return F.when(~c("ci.ci_provider").eqNullSafe("github-actions"), whole)


def skill(kind: str, commands: tuple[str, ...], steps: tuple[str, ...]) -> Column:
    head = line(f"---\nname: ", c("identity.short_name"), f"-{kind}\ndescription: {kind.capitalize()} for ", c("identity.name"), "\n---")
    return text(head, *(f"\n## Step {i}\n\n{s}" for i, s in enumerate(steps, 1)), F.concat(F.lit("\n"), fenced(F.concat_ws("\n", *(set_(x) for x in commands)))))


def workflow_rules() -> Column:
    return text("# Workflow", line("\n1. Read ", F.lit(GUIDE)), line("2. Before a commit: `", set_("lint"), "`"), line("3. Before a push: `", set_("test"), "`"), "4. Leave no placeholder behind")


def vault() -> Column:
    """Start page of the knowledge folder."""
    return text(line("# ", c("identity.name")), "\n- [Architecture](wiki/concepts/architecture.md)", section("Files", listed(c("top_files"), lambda f: line("- [[", F.translate(f, "/.", "--"), "]]"), 30)))


def companion() -> Column:
    return F.to_json(F.struct(c("identity.short_name").alias("name"), *(set_(x).alias(x) for x in ("lint", "test", "build"))))


def boxed(rows: Column, width: int = 60) -> Column:
    """Rows padded to one width between bars; longer ones keep their length."""
    bar = "+" + "-" * (width + 2) + "+"
    pad = lambda x: F.concat(F.lit("| "), x, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(x))), F.lit(" |"))
    return F.concat(F.lit(bar + "\n"), F.array_join(F.transform(rows, pad), "\n"), F.lit("\n" + bar))


def report() -> Column:
    """The summary that a terminal shows."""
    tools = F.concat_ws(", ", *(c(f"quality.{k}.tool") for k in ("linter", "formatter", "type_checker", "test_framework")))
    rows = F.array_compact(F.array(
        line(c("identity.name"), " ", c("identity.version")), line("Stack: ", stack_label()), line("Archetype: ", c("archetype.archetype"), ", ", c("archetype.maturity"), ", ", c("archetype.complexity")),
        line("Files: ", F.format_number("structure.total_files", 0)), line("Tests: ", c("structure.test_file_count").cast("string")), F.when(tools != "", line("Tools: ", tools)),
        line("CI: ", c("ci.ci_provider"), F.coalesce(line(", gaps: ", F.nullif(F.array_join("ci.gaps", ", "), F.lit(""))), F.lit(""))), F.when(F.size("domain.detected_domains") > 0, line("Domains: ", F.array_join(F.transform("domain.detected_domains", lambda d: d["domain"]), ", "))),
    ))
    return boxed(rows)


def session_health(files: DataFrame, now: Column | None = None, days: int = 14) -> DataFrame:
    """(repo, messages): what a session should be told: no guide, an old one, no index. ``files`` has mtime."""
    now = now if now is not None else F.current_timestamp()
    f = files.groupBy("repo").agg(F.max(F.when(F.col("path") == GUIDE, F.col("mtime"))).alias("guide"), F.max(F.when(F.col("path") == MANIFEST, 1)).alias("manifest"), F.max(F.when(F.col("path") == INDEX, 1)).alias("index"))
    age = F.datediff(now, F.col("guide"))
    rows = F.array_compact(F.array(
        F.when(F.col("guide").isNull(), "no guide: run the pipeline"), F.when(F.col("manifest").isNotNull() & (age > days), F.format_string("guide is %d days old: refresh", age)), F.when(F.col("manifest").isNotNull() & F.col("index").isNull(), "no index: run the index"),
    ))
    return f.select("repo", rows.alias("messages"))


def documents(manifests: DataFrame, tier: Column | str = "full") -> DataFrame:
    """(repo, path, content): all documents of each collection's tier. ``manifests`` may have ``top_files`` (array of paths)."""
    rows = manifests if "top_files" in manifests.columns else manifests.withColumn("top_files", F.array().cast("array<string>"))
    rows = rows.withColumn("_tier", F.array_position(F.array(*map(F.lit, TIERS)), F.lit(tier) if isinstance(tier, str) else tier))
    short = c("identity.short_name")
    plan: list[tuple[int, Column | str, Column]] = [
        (1, GUIDE, guide()), (1, AGENTS, agents()), (1, ".githooks/pre-commit", hook("pre-commit", ("lint",))), (1, ".githooks/pre-push", hook("pre-push", ("lint", "test"))),
        (1, ".claude/settings.json", settings()), (1, ".claude/rules/workflow.md", workflow_rules()),
        (2, ".cursorrules", editor_rules()), (2, ".github/workflows/ci.yml", workflow()),
        (2, line(".claude/skills/", short, "-review/SKILL.md"), skill("review", ("lint", "typecheck"), ("Check the invariants of every changed file.", "Run the checks below."))),
        (2, line(".claude/skills/", short, "-ship/SKILL.md"), skill("ship", ("lint", "typecheck", "test"), ("Run the checks below.", "Write the change log."))),
        (2, line("tools/learnings/", short, "-learnings.jsonl"), F.to_json(F.struct(F.lit("init").alias("type"), short.alias("project")))),
        (3, "vault/index.md", vault()), (3, ".companion/config.json", companion()),
    ]
    made = F.array(*(F.struct(F.lit(at).alias("tier"), (F.lit(p) if isinstance(p, str) else p).alias("path"), body.alias("content")) for at, p, body in plan))
    return rows.select("repo", "_tier", F.explode(made).alias("d")).where("d.tier <= _tier and d.content is not null").select("repo", "d.path", "d.content")


# ---- documents of an index ------------------------------------------------------------------


def entity_pages(index: Index, most: int = 50) -> DataFrame:
    """(path, page): a page for each of the most important files, with its symbols, imports and importers."""
    top = index.files.orderBy(F.desc("importance"), "path").limit(most)
    names = top.select("path").join(index.symbols, F.col("path") == F.col("file")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "kind", "name"))).alias("symbols"))
    ends = lambda key, value, name: index.edges.join(F.broadcast(top.select(F.col("path").alias(key))), key).groupBy(F.col(key).alias("path")).agg(F.array_sort(F.collect_set(value)).alias(name))
    rows = top.select("path", "language", "lines", "importance").join(names, "path", "left").join(ends("source", "target", "out"), "path", "left").join(ends("target", "source", "into"), "path", "left")
    page = text(
        line("# ", c("path")), F.format_string("\n%s, %d lines, importance %d", "language", "lines", "importance"), section("Symbols", listed(c("symbols"), lambda s: line("- ", s["kind"], " `", s["name"], "`"))),
        section("Imports", listed(c("out"), lambda p: line("- [[", paths.slug(p), "]]"))), section("Imported by", listed(c("into"), lambda p: line("- [[", paths.slug(p), "]]"))),
    )
    return rows.select("path", F.concat(F.lit("vault/wiki/entities/"), paths.slug(c("path")), F.lit(".md")).alias("page_path"), page.alias("page"))


def overview(index: Index) -> DataFrame:
    """(section, line_no, line): languages, top files, module dependencies and cycles."""
    langs = index.files.groupBy("language").agg(F.count("*").alias("n")).select(F.lit("Languages").alias("section"), F.struct(-F.col("n"), F.col("language")).alias("at"), F.format_string("%s: %d", "language", "n").alias("line"))
    top = index.files.orderBy(F.desc("importance"), "path").limit(10).select(F.lit("Top files").alias("section"), F.struct(-F.col("importance"), F.col("path")).alias("at"), F.format_string("%s (%d)", "path", "importance").alias("line"))
    pairs = graph.module_edges(index.edges)
    deps = pairs.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("target")), ", ").alias("to")).select(F.lit("Dependencies").alias("section"), F.struct(F.lit(0).cast("long"), F.col("source")).alias("at"), F.concat_ws(" -> ", "source", "to").alias("line"))
    cycles = graph.circular(pairs).select(F.lit("Cycles").alias("section"), F.struct(F.lit(0).cast("long"), F.col("module")).alias("at"), F.concat_ws(" <-> ", "module", F.array_join("circular_deps", ", ")).alias("line"))
    named = lambda d: d.select("section", F.col("at").cast("struct<n:bigint,name:string>").alias("at"), "line")
    rows = named(langs).unionByName(named(top)).unionByName(named(deps)).unionByName(named(cycles))
    return rows.select("section", F.row_number().over(Window.partitionBy("section").orderBy("at")).alias("line_no"), "line")


def top_for_docs(index: Index) -> DataFrame:
    """(document, path): prefixes of the top files that documents show; the first two keep only files of some importance, after the limit."""
    top = index.top_files(20).withColumn("n", F.row_number().over(Window.orderBy(F.desc("importance"), "path")))  # twenty rows
    shown = F.array_compact(F.array(F.when((F.col("n") <= 15) & (F.col("importance") > 0), "guide"), F.when(F.col("importance") > 0, "architecture"), F.when(F.col("n") <= 10, "overview")))
    return top.select(F.explode(shown).alias("document"), "path", "importance")
