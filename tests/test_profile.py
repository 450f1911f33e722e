"""Profile operators on collections worked out by hand."""

from pyspark.sql import functions as F

from fathomline.operators import profile as C
from fathomline.sources.readers import own_sections


def files(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None) for r in rows], "repo string, path string, content string")


def by_repo(df):
    return {r["repo"]: tuple(r)[1:] for r in df.collect()}


def test_ci_facts(spark):
    f = files(spark, ("a", ".github/workflows/x.yml", "on: push\nmain\nrelease GHCR.io"), ("a", "helm/x"), ("a", "fly.toml"), ("b", "x.tf"), ("b", "sub/Dockerfile"), ("c", "compose.yml"), ("c", "docker-compose.yaml"), ("d", None))
    assert by_repo(C.ci_facts(f)) == {
        "a": ("github-actions", "fly.io", None, "ghcr.io", "push-to-main"), "b": ("none", "terraform", None, None, None),
        "c": ("none", "none", "docker-compose.yaml", None, None), "d": ("none", "none", None, None, None),
    }


def test_monorepo_and_node(spark):
    f = files(spark, *(("a", f"p{i}/package.json") for i in range(3)), ("b", "x/nx.json"), ("c", "lerna.json"), ("c", "turbo.json"), ("d", "node_modules/x/package.json"), ("d", ".nvmrc", " \n"), ("d", ".node-version", "20\n"), ("d", "x/go.sum"))
    assert by_repo(C.monorepo(f)) == {"a": ("unknown", True), "b": ("unknown", True), "c": ("turborepo", True), "d": ("unknown", False)}
    assert by_repo(C.node_facts(f))["d"] == ("20", "go.sum", None)


def test_commands(spark):
    f = files(
        spark, ("make", "Makefile", "test:\n\tx\ncheck: y"), ("make", "package.json", '{"scripts": {"lint": "z"}}'), ("node", "package.json", '{"scripts": {"dev": "x", "type-check": "y"}}'),
        ("py", "pyproject.toml", "[tool.mypy]"), ("py", "Makefile", "build:\n"), ("bad", "package.json", "{"), ("none", "a"),
    )
    language = F.first(F.when(F.col("repo") == "py", "python").otherwise("other"))
    got = by_repo(C.commands(f, language, F.lit("pnpm")))
    no = C.UNSET
    assert got["make"] == (no, no, no, no, "make test", no, "make check")
    assert got["node"] == ("pnpm install", "pnpm dev", no, no, no, no, "pnpm typecheck")
    assert got["py"] == ("pip install -r requirements.txt", no, no, no, "pytest", no, "mypy .")
    assert got["bad"] == got["none"] == (no,) * 7
    gate = {(r.repo, r.name, r.status) for r in C.quality_gate(C.commands(f, language, F.lit("pnpm")).where("repo in ('make', 'none')")).collect()}
    assert gate == {("make", "quality-gate-lint", "WARN"), ("none", "quality-gate-lint", "WARN"), ("none", "quality-gate-test", "WARN")}


def test_flags(spark):
    f = files(spark, ("a", "Dockerfile", "EXPOSE 9000\nexpose 80 443"), ("a", ".env", "PORT='7'"), ("a", ".githooks/pre-push"), ("b", ".git/HEAD"), ("b", "go.mod"), ("b", "index.json", "{"), ("c", "index.json", '{"_meta": {"total_files": 7}}'))
    assert by_repo(C.ports(f)) == {"a": ("9000", "80"), "b": ("", ""), "c": ("", "")}
    assert by_repo(C.hooks(f))["a"] == ("WARN", "pre-commit missing") and by_repo(C.hooks(f))["b"] == ("WARN", "directory missing")
    assert by_repo(C.start_hint(f, ("index.json",))) == {"a": ("none", None), "b": ("bootstrapped", None), "c": ("bootstrapped", None)}
    assert by_repo(C.start_hint(f, ("GUIDE.md",)))["b"] == ("repository", "go")
    assert by_repo(C.index_state(f, "index.json")) == {"a": (0, "pending"), "b": (0, "pending"), "c": (7, "indexed")}
    assert {tuple(r) for r in C.skills(f).collect()} == {("a", "deploy")}
    assert by_repo(C.principles(files(spark, ("a", "tsconfig.json", '"strict":true'), ("a", "package.json", "TypeORM prisma"), ("b", "x"))) ) == {"a": (["strict-typescript", "prisma-orm"],), "b": ([],)}
    assert C.ci_facts(f.limit(0)).count() == 0


def test_stale(spark):
    f = spark.createDataFrame([("a", "m", 5), ("a", "src/x", 6), ("b", "m", 5), ("b", "src/deep/x", 6), ("c", "src/x", 1)], "repo string, path string, mtime int")
    assert by_repo(C.stale(f, "m", ("Makefile",))) == {"a": ("WARN",), "b": ("PASS",), "c": ("WARN",)}


def test_user_sections(spark):
    text = ["# T", "## Vault", "x", "## Mine", "y"]
    f = spark.createDataFrame([("p", i, t) for i, t in enumerate(text)] + [("q", 0, "none")], "path string, line_no int, line string")
    assert [tuple(r) for r in own_sections(f, ("## Vault",)).collect()] == [("p", "## Mine\ny")]
