"""Rule tables on file listings."""

import pytest

from fathomline.operators import archetype, classify, domains, structure, tools
from fathomline.sources import readers


def listing(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


@pytest.mark.parametrize(
    "paths,language",
    [
        (("requirements.txt", "app.py", "lib/utils.py"), "python"),
        (("package.json", "tsconfig.json", "src/index.ts", "src/app.tsx"), "typescript"),
        (("Cargo.toml", "src/main.rs", "src/lib.rs"), "rust"),
        (("go.mod", "go.sum", "main.go", "handlers/api.go"), "go"),
    ],
)
def test_main_language(spark, paths, language):
    assert classify.main_language(listing(spark, *paths)).first().language == language


def test_scores_are_capped(spark):
    files = listing(spark, *(f"a{i}.py" for i in range(30)))
    assert classify.language_scores(files).collect() == [("python", 10)]


def files(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None) for r in rows], "repo string, path string, content string")


def by_repo(df):
    return {r["repo"]: tuple(r)[1:] for r in df.collect()}


def test_package_managers_in_the_documented_order(spark):
    f = files(spark, ("a", "package.json"), ("a", "x/yarn.lock"), ("b", "go.mod"), ("b", "package.json"), ("c", "x"), ("d", "uv.lock"), ("d", "pnpm-lock.yaml"), ("e", "bun.lock"))
    assert by_repo(archetype.package_manager(f)) == {"a": ("yarn",), "b": ("go",), "c": ("NOT_CONFIGURED",), "d": ("pnpm",), "e": ("bun",)}


def test_tools(spark):
    f = files(
        spark, ("js", "package.json", '{"devDependencies": {"eslint": null, "mocha": "1"}, "scripts": {"test": "x"}}'), ("js", "tsconfig.json", '{"compilerOptions": {"strict": true}}'), ("py", "pyproject.toml", "[tool.ruff]\n[tool.pytest.ini_options]"),
        ("rs", "Cargo.toml", ""), ("rs", ".rustfmt.toml", ""), ("go", "go.mod", ""), ("sub", "x/.eslintrc", ""), ("rs", ".husky/pre-commit", ""), ("go", ".pre-commit-config.yaml", ""),
    )
    got = {(r.repo, r.category): (r.tool, r.config_file) for r in tools.quality_tools(f).collect()}
    assert got["js", "linter"] == ("eslint", "package.json") and got["js", "type_checker"] == ("tsc", "tsconfig.json (strict)") and got["js", "test_framework"] == ("jest", "package.json")
    assert got["py", "linter"] == ("ruff", "pyproject.toml") and got["py", "formatter"] == ("ruff-format", "pyproject.toml") and got["py", "test_framework"] == ("pytest", "pyproject.toml")
    assert got["rs", "formatter"] == ("rustfmt", ".rustfmt.toml") and got["go", "formatter"] == ("gofmt", "built-in") and got["go", "type_checker"] == ("go-vet", "built-in")
    assert {c for (r, c), t in got.items() if r == "sub" and t[0] is None} == set(tools.RULES)
    assert by_repo(tools.missing_tools(tools.quality_tools(f))) == {"js": (["formatter"],), "py": (["type-checker"],), "rs": ([],), "go": (["linter"],), "sub": (["linter", "formatter", "type-checker", "test-framework"],)}
    hooks = by_repo(tools.hook_system(f))
    assert hooks["rs"] == ("husky", ".husky", True, False, False) and hooks["go"] == ("pre-commit", ".pre-commit-config.yaml", False, False, False) and hooks["js"][:2] == (None, None)


def test_archetypes(spark):
    dep = lambda *names: '{"dependencies": {%s}}' % ", ".join(f'"{n}": 1' for n in names)
    many = [f"src/f{i}.c" for i in range(6)]
    rows = [("mono", "turbo.json"), ("space", "package.json", '{"workspaces": null}'), ("data", "requirements.txt", "DBT-core\n"), ("ml", "Cargo.toml", 'torch = "1"'), ("mobile", "package.json", dep("react-native-x")), ("full", "pages/a.js"), ("full", "package.json", dep("express")),
            ("api", "requirements.txt", "flask"), ("web", "package.json", dep("nuxt")), ("front", "a.vue"), ("cli", "bin/x"), *(("lib", p) for p in many), ("docs", "package.json", dep("vitepress")), *(("md", f"{i}.md") for i in range(4)), ("tf", "main.tf"), ("tiny", "x")]
    rows += [("app", p) for p in (*many, "index.ts", "main.py")]
    got = {r.repo: r.archetype for r in archetype.archetype(files(spark, *rows)).collect()}
    assert got == {"mono": "monorepo", "space": "monorepo", "data": "data-pipeline", "ml": "ml-project", "mobile": "mobile-app", "full": "full-stack", "api": "api-service", "web": "web-app", "front": "web-app", "cli": "cli-tool", "lib": "library", "docs": "documentation-site", "md": "documentation-site", "tf": "infrastructure", "tiny": "minimal", "app": "application"}


def test_identity(spark):
    f = files(
        spark, ("a", "package.json", '{"name": "My App", "version": "2.1.0", "description": "x"}'), ("a", "VERSION", " 3.0 \n"), ("b", "Cargo.toml", '[package]\nname = "my-cli"\nversion = "3.0.0"\n'),
        ("c", "pyproject.toml", "[project]\n namespace = ''\nname = 'api'\n"), ("c", "README.md", "# Title\n\n![i](x)\n<b>\n[l](m)\n---\n  Does things. \nmore"), ("d", "x"), ("e", "README.md", "Only a title"),
    )
    assert by_repo(archetype.identity(f)) == {"a": ("My App", "my-app", "3.0", "x"), "b": ("my-cli", "my-cli", "3.0.0", ""), "c": ("api", "api", "0.0.0", "Does things."), "d": ("d", "d", "0.0.0", ""), "e": ("e", "e", "0.0.0", "")}


def test_domains(spark):
    f = files(spark, ("a", "src/auth/login.py"), ("a", "docs/auth/x.md"), ("a", "x.test.jwt.py"), ("a", "requirements.txt", "Stripe\nOpenAI"), *(("b", f"routes/r{i:02}.ts") for i in range(12)), ("c", "x.c"))
    found = domains.detected(f)
    assert {(r.repo, r.domain): r.paths for r in found.collect()} == {("a", "auth"): ["src/auth/login.py"], ("a", "ai"): [], ("a", "financial"): [], ("b", "api"): [f"routes/r{i:02}.ts" for i in range(10)]}
    assert by_repo(domains.invariants(found))["a"][0] == ["audit-logging-required", "decimal-precision-required", "llm-trust-boundary", "no-credentials-in-code", "output-sanitization-required", "session-validation-required"]
    rules = [(r.repo, r.id, r.domain) for r in domains.invariant_rules(f.select("repo").distinct(), found).orderBy("repo", "id").collect()]
    assert rules == [("a", "INV-1", "general"), ("a", "INV-2", "general"), ("a", "INV-3", "auth"), ("a", "INV-4", "ai"), ("b", "INV-1", "general"), ("b", "INV-2", "general"), ("b", "INV-3", "api"), ("c", "INV-1", "general"), ("c", "INV-2", "general")]


def test_workflows_and_variables(spark):
    flow = "name: 'CI'\non:\n  push:\n    branches: [main]\n\n  pull_request:\njobs:\n  lint-all:\n    steps: []\n  test:\n    x: y\nenv:\n  A: ${{ secrets.B }} secrets.A_1 secrets.B\n"
    f = files(spark, ("a", ".github/workflows/ci.yml", flow), ("a", ".github/workflows/d.yaml", "on: [push, 'x']\njobs:\n  release:\n    run: snyk"), ("a", ".github/workflows/sub/no.yml", flow), ("b", ".env.template", "A=1"), ("b", ".env.example", "# c\nDB_URL = x=y\nbad-name=1\nPORT=\n"), ("b", "Dockerfile", "ARG PORT\nENV MODE=x"))
    got = {r.file: tuple(r)[2:] for r in readers.workflows(f).collect()}
    assert got == {"ci.yml": ("CI", ["push", "branches", "pull_request"], ["lint-all", "test"], ["A_1", "B"], "lint + test"), "d.yaml": ("d.yaml", ["push", "x"], ["release"], [], "deploy + security")}
    assert by_repo(readers.ci_coverage(f))["a"] == (["lint", "test", "security"], ["build", "typecheck"])
    assert [tuple(r)[1:] for r in readers.env_variables(f).orderBy("name").collect()] == [("DB_URL", ".env.example", True, "x=y"), ("MODE", "Dockerfile", False, None), ("PORT", ".env.example", False, None)]


def test_structure(spark):
    f = files(spark, ("a", "src/index.ts"), ("a", "src/a.test.ts"), ("a", "lib/x/tests/y.rs"), ("a", ".gitignore"), ("a", "tests/test_b.py"), ("a", "api/user.controller.ts"), ("a", "node_modules/x.controller.ts"))
    row = structure.structure(f).first()
    assert (row.total_files, row.test_file_count, row.test_pattern, row.controllers, row.tests) == (7, 2, "*.test.ts / test_*.py / tests/*.rs", 1, 2)
    assert [(r.kind, r.dir) for r in structure.known_dirs(f).orderBy("kind", "idx").collect()] == [("source", "src"), ("source", "lib"), ("source", "api"), ("test", "tests")]
    assert {(r.kind, r.path) for r in structure.named_files(f).collect()} == {("entry", "src/index.ts"), ("config", ".gitignore")}
    assert {r.dir for r in structure.directories(f).collect()} == {"src", "lib/x/tests", "tests", "api", "node_modules"}


def test_companions(spark):
    f = files(spark, ("a", ".comp/config.json"), ("a", "tools/learnings/x.jsonl", "{}\n\n{}\n"), ("a", ".claude/skills/my-Retro/SKILL.md"), ("b", "x"))
    home = spark.createDataFrame([("learnings/g.jsonl", "{}"), ("skills/s1/x", ""), ("skills/s2/y", "")], "path string, content string")
    got = by_repo(archetype.companion_state(f, ".comp/", home))
    assert got["a"] == (False, True, True, True, 2, False, True, 1, 2) and got["b"] == (False, False, False, False, 0, False, False, 1, 2)


def test_git_and_urls(spark):
    f = files(spark, ("a", ".git/config", "[user]\n\temail = a@b.c\n[remote]\n\turl = https://x.y/z\n\turl = git@github.com:o/r.git\n"), ("a", ".env", "PRODUCTION_URL='https://p'\n"), ("b", "package.json", '{"homepage": "https://h"}'), ("b", ".python-version", "3.12\n"), ("c", "pyproject.toml", 'requires-python = ">=3.10"'))
    assert by_repo(archetype.git_facts(f))["a"] == ("a@b.c", "https://github.com/o/r")
    assert by_repo(archetype.production_url(f)) == {"a": ("https://p",), "b": ("https://h",), "c": ("",)}
    assert by_repo(archetype.python_version(f)) == {"a": ("",), "b": ("3.12",), "c": (">=3.10",)}
