"""Quality tools, hooks and frameworks of many collections, by ordered rules over their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import any_of, content, path, text_of

#: Fixed values: (tool, kind of test, its argument, configuration that is reported) of each category, in order of
#: priority. Kinds: ``file`` in the root, ``toml`` text of pyproject.toml, ``dep`` and ``script`` of package.json.
RULES: dict[str, tuple[tuple[str, str, str, str], ...]] = {
    "linter": (
        *(("eslint", "file", c, c) for c in (".eslintrc.js", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml", ".eslintrc", "eslint.config.js", "eslint.config.mjs", "eslint.config.cjs", "eslint.config.ts")),
        ("ruff", "file", ".ruff.toml", ".ruff.toml"), ("ruff", "file", "ruff.toml", "ruff.toml"), ("ruff", "toml", "[tool.ruff]", "pyproject.toml"),
        ("clippy", "file", "Cargo.toml", "Cargo.toml"), ("pylint", "file", ".pylintrc", ".pylintrc"),
        *(("golangci-lint", "file", c, c) for c in (".golangci.yml", ".golangci.yaml", ".golangci.json", ".golangci.toml")),
        ("rubocop", "file", ".rubocop.yml", ".rubocop.yml"), ("shellcheck", "file", ".shellcheckrc", ".shellcheckrc"),
        ("eslint", "dep", "eslint", "package.json"), ("eslint", "script", "lint", "package.json"),
    ),
    "formatter": (
        *(("prettier", "file", c, c) for c in (".prettierrc", ".prettierrc.json", ".prettierrc.js", ".prettierrc.yaml", ".prettierrc.yml", ".prettierrc.toml", "prettier.config.js", "prettier.config.mjs", "prettier.config.cjs")),
        ("prettier", "dep", "prettier", "package.json"), ("black", "toml", "[tool.black]", "pyproject.toml"), ("ruff-format", "toml", "[tool.ruff]", "pyproject.toml"),
        ("rustfmt", "file", "Cargo.toml", "built-in"), ("gofmt", "file", "go.mod", "built-in"),
    ),
    "type_checker": (
        ("tsc", "file", "tsconfig.json", "tsconfig.json"), ("mypy", "file", "mypy.ini", "mypy.ini"), ("mypy", "file", ".mypy.ini", "mypy.ini"), ("mypy", "toml", "[tool.mypy]", "pyproject.toml"),
        ("pyright", "file", "pyrightconfig.json", "pyrightconfig.json"), ("pyright", "toml", "[tool.pyright]", "pyproject.toml"),
        ("cargo-check", "file", "Cargo.toml", "built-in"), ("go-vet", "file", "go.mod", "built-in"),
    ),
    "test_framework": (
        *(("jest", "file", c, c) for c in ("jest.config.ts", "jest.config.js", "jest.config.json", "jest.config.mjs", "jest.config.cjs")),
        *(("vitest", "file", c, c) for c in ("vitest.config.ts", "vitest.config.js", "vitest.config.mts", "vitest.config.mjs")),
        ("pytest", "file", "pytest.ini", "pytest.ini"), ("pytest", "file", "conftest.py", "conftest.py"), ("pytest", "toml", "[tool.pytest", "pyproject.toml"),
        ("rspec", "file", ".rspec", ".rspec"), ("cargo-test", "file", "Cargo.toml", "built-in"), ("go-test", "file", "go.mod", "built-in"),
        ("jest", "dep", "jest", "package.json"), ("jest", "script", "test", "package.json"), ("vitest", "dep", "vitest", "package.json"), ("mocha", "dep", "mocha", "package.json"),
    ),
}
#: Name under which a category is missed, in order.
MISSING = {"linter": "linter", "formatter": "formatter", "type_checker": "type-checker", "test_framework": "test-framework"}
#: Fixed values: (marker, hook system, directory), in order.
HOOKS = ((".husky/", "husky", ".husky"), (".githooks/", "githooks", ".githooks"), (".pre-commit-config.yaml", "pre-commit", ".pre-commit-config.yaml"))
#: Our own registry: language -> (framework, words in manifests, parts of paths), in order of the names.
FRAMEWORKS = {
    "python": (("django", ("django",), ("manage.py",)), ("fastapi", ("fastapi",), ()), ("flask", ("flask",), ())),
    "typescript": (("angular", ("@angular/core",), ("angular.json",)), ("nestjs", ("@nestjs/core",), ()), ("nextjs", ('"next"',), ("next.config.",)), ("react", ('"react"',), ()), ("svelte", ('"svelte"',), ()), ("vue", ('"vue"',), ())),
    "javascript": (("express", ('"express"',), ()), ("nextjs", ('"next"',), ("next.config.",)), ("react", ('"react"',), ()), ("vue", ('"vue"',), ())),
    "rust": (("actix", ("actix-web",), ()), ("axum", ("axum",), ()), ("rocket", ("rocket",), ())),
    "go": (("echo", ("labstack/echo",), ()), ("fiber", ("gofiber/fiber",), ()), ("gin", ("gin-gonic/gin",), ())),
    "ruby": (("rails", ("rails",), ("config/routes.rb",)), ("sinatra", ("sinatra",), ())),
    "php": (("laravel", ("laravel/framework",), ("artisan",)), ("symfony", ("symfony/",), ())),
    "elixir": (("phoenix", (":phoenix",), ()),),
}
#: Manifests that name a framework's dependencies.
FRAMEWORK_MANIFESTS = ("package.json", "Cargo.toml", "requirements.txt", "go.mod", "Gemfile", "composer.json")


def package_has(section: str, key: str) -> Column:
    """Whether a file is the root's package.json and its section has the key, whatever the value."""
    return (path() == "package.json") & F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object(content(), f"$.{section}")), key), F.lit(False))


def _test(kind: str, argument: str) -> Column:
    if kind == "file":
        return path() == argument
    if kind == "toml":
        return (path() == "pyproject.toml") & content().contains(argument)
    if kind == "dep":
        return package_has("dependencies", argument) | package_has("devDependencies", argument)
    return package_has("scripts", argument)


def _first(rules: tuple[tuple[str, str, str, str], ...]) -> Column:
    """Aggregate: (tool, config) of the first rule that a file meets."""
    rank = F.lit(None).cast("int")
    for i in range(len(rules) - 1, -1, -1):
        rank = F.when(_test(rules[i][1], rules[i][2]), i).otherwise(rank)
    table = F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(c).alias("config_file")) for t, _, _, c in rules))
    return F.get(table, F.min(rank))


def quality_tools(files: DataFrame) -> DataFrame:
    """(repo, category, tool, config_file, configured): one row a category and collection, nulls without a tool."""
    strict = F.get_json_object(text_of("tsconfig.json"), "$.compilerOptions.strict") == "true"
    has = lambda name: any_of(path() == name)
    found = files.groupBy("repo").agg(*(_first(r).alias(c) for c, r in RULES.items()), F.coalesce(strict, F.lit(False)).alias("strict"), has("rustfmt.toml").alias("fmt"), has(".rustfmt.toml").alias("dot_fmt"))
    config = lambda c: F.when(F.col(f"{c}.tool") == "tsc", F.when(F.col("strict"), "tsconfig.json (strict)").otherwise("tsconfig.json")).when(F.col(f"{c}.tool") == "rustfmt", F.when(F.col("fmt"), "rustfmt.toml").when(F.col("dot_fmt"), ".rustfmt.toml").otherwise("built-in")).otherwise(F.col(f"{c}.config_file"))
    rows = F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"{c}.tool").alias("tool"), config(c).alias("config_file"), F.col(f"{c}.tool").isNotNull().alias("configured")) for c in RULES))
    return found.select("repo", F.explode(rows).alias("r")).select("repo", "r.*")


def missing_tools(tools: DataFrame) -> DataFrame:
    """(repo, missing): categories without a tool, in fixed order, of ``tools`` (repo, category, configured)."""
    have = tools.groupBy("repo").agg(F.collect_set(F.when(F.col("configured"), F.col("category"))).alias("have"))
    return have.select("repo", F.array_compact(F.array(*(F.when(~F.array_contains("have", c), name) for c, name in MISSING.items()))).alias("missing"))


def hook_system(files: DataFrame) -> DataFrame:
    """(repo, system, directory, pre_commit, pre_push, commit_msg) of the first hook system that is there."""
    flags = files.groupBy("repo").agg(
        *(any_of(path().startswith(m) if m.endswith("/") else path() == m).alias(s) for m, s, _ in HOOKS),
        *(any_of(path() == f"{d}/{h}").alias(f"{s} {h}") for _, s, d in HOOKS for h in ("pre-commit", "pre-push", "commit-msg")),
    )
    system = F.coalesce(*(F.when(F.col(f"`{s}`"), s) for _, s, _ in HOOKS))
    out = flags.withColumn("system", system)
    folder = F.coalesce(*(F.when(F.col("system") == s, d) for _, s, d in HOOKS))
    hook = lambda h: F.coalesce(*(F.when(F.col("system") == s, F.col(f"`{s} {h}`")) for _, s, _ in HOOKS), F.lit(False))
    return out.select("repo", "system", folder.alias("directory"), hook("pre-commit").alias("pre_commit"), hook("pre-push").alias("pre_push"), hook("commit-msg").alias("commit_msg"))


def framework(files: DataFrame, languages: DataFrame, registry: dict = FRAMEWORKS) -> DataFrame:
    """(repo, framework): the first framework of the collection's main language that a manifest or a path names, else ``none``."""
    nested = path().endswith("package.json") & path().contains("/") & ~path().contains("node_modules")
    manifest, low = path().isin(*FRAMEWORK_MANIFESTS) | nested, F.lower(content())
    rules = [(lang, name, words, parts) for lang, fs in registry.items() for name, words, parts in sorted(fs)]
    hit = lambda words, parts: F.lit(False) if not (words or parts) else _or([manifest & low.contains(w.lower()) for w in words] + [path().contains(p.replace("**/", "")) for p in parts])
    flags = files.groupBy("repo").agg(*(any_of(hit(ws, ps)).alias(f"f{i}") for i, (_, _, ws, ps) in enumerate(rules)))
    chosen = F.coalesce(*(F.when((F.col("language") == lang) & F.col(f"f{i}"), name) for i, (lang, name, _, _) in enumerate(rules)), F.lit("none"))
    return flags.join(languages.select("repo", "language"), "repo", "left").select("repo", chosen.alias("framework"))


def _or(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
