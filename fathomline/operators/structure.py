"""Layout of many collections at once: directories, files of note, tests, components.

All operators take ``files`` (repo, path, ...) and group by ``repo`` only; rules are fixed lists that
become conditional aggregates, so one pass answers all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .profile import any_of, path

#: Candidate directories of each kind, in order.
DIRECTORIES = {
    "source": ("src", "lib", "app", "pkg", "internal", "cmd", "api"),
    "test": ("tests", "test", "__tests__", "spec", "specs", "test_data"),
    "ci": (".github", ".circleci", ".gitlab"),
    "doc": ("docs", "doc", "documentation"),
    "script": ("scripts", "bin", "tools"),
}
#: Names of entry points.
ENTRY_POINTS = (
    "main.py", "app.py", "manage.py", "main.ts", "index.ts", "app.ts", "main.js", "index.js", "app.js",
    "main.go", "main.rs", "main.java", "App.java", "Program.cs",
)
#: Paths of key files.
KEY_FILES = ("README.md", "CLAUDE.md", "AGENTS.md", "package.json", "Cargo.toml", "go.mod", "pyproject.toml", "requirements.txt", "Makefile", "Dockerfile", ".github/workflows/ci.yml")
#: Names or paths of configuration files.
CONFIG_FILES = (
    ".eslintrc", ".eslintrc.js", ".eslintrc.json", ".eslintrc.yml", ".prettierrc", ".prettierrc.js", ".prettierrc.json",
    "tsconfig.json", "jsconfig.json", ".env", ".env.example", ".env.local", "Dockerfile", "docker-compose.yml", "docker-compose.yaml",
    "Makefile", ".editorconfig", ".gitignore", "jest.config.js", "jest.config.ts", "vitest.config.ts",
    "webpack.config.js", "vite.config.ts", "next.config.js", "pyproject.toml", "setup.py", "setup.cfg", "tox.ini",
    "ruff.toml", ".ruff.toml", "mypy.ini", ".rubocop.yml", "Rakefile", ".github/workflows/ci.yml", ".gitlab-ci.yml",
    "fly.toml", "vercel.json", "netlify.toml", "terraform.tf", "pulumi.yaml",
)
#: Fixed values: (pattern that is reported, regular expression over a path), in order.
TEST_PATTERNS = (
    ("*.test.ts", r"\.test\.(ts|tsx|js)"), ("*.spec.ts", r"\.spec\.(ts|tsx|js)"), ("test_*.py", r"(^|/)test_[^/]*\.py$"),
    ("*_test.py", r"_test\.py$"), ("*_test.go", r"_test\.go$"), ("tests/*.rs", r"/tests/.*\.rs$"),
)
#: Folders whose files are no components, besides the folder that the engine writes to.
NO_COMPONENTS = ("node_modules/", ".git/", ".venv/", "target/", "vault/", ".claude/", "docs/", "tools/")
#: Folder of the engine's own documents.
OWN = ".fathomline/"


def outside(prefixes: tuple[str, ...]) -> Column:
    keep = ~path().startswith(OWN)
    for prefix in prefixes:
        keep = keep & ~path().startswith(prefix)
    return keep


def known_dirs(files: DataFrame) -> DataFrame:
    """(repo, kind, dir, idx): candidate directories that hold a file, idx in the order of the candidates."""
    flags = files.groupBy("repo").agg(*(any_of(path().startswith(c + "/")).alias(c) for cs in DIRECTORIES.values() for c in cs))
    rows = [F.when(F.col(f"`{c}`"), F.struct(F.lit(k).alias("kind"), F.lit(c).alias("dir"), F.lit(i).alias("idx"))) for k, cs in DIRECTORIES.items() for i, c in enumerate(cs)]
    return flags.select("repo", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("repo", "r.*")


def named_files(files: DataFrame) -> DataFrame:
    """(repo, kind, path): entry points (by name), key files (by path) and configuration files (by either)."""
    name = paths.basename(path())
    kinds = F.array_compact(F.array(F.when(name.isin(*ENTRY_POINTS), "entry"), F.when(path().isin(*KEY_FILES), "key"), F.when(name.isin(*CONFIG_FILES) | path().isin(*CONFIG_FILES), "config")))
    return files.select("repo", F.explode(kinds).alias("kind"), "path").distinct()


def directories(files: DataFrame) -> DataFrame:
    """(repo, dir): distinct directories of files, without those that begin with .git."""
    return files.select("repo", paths.dirname(path()).alias("dir")).where("dir <> '' and not startswith(dir, '.git')").distinct()


def test_pattern() -> Column:
    """Aggregate: the reported patterns that some path meets, joined; null if none."""
    return F.nullif(F.concat_ws(" / ", *(F.when(any_of(path().rlike(p)), name) for name, p in TEST_PATTERNS)), F.lit(""))


def is_test_file() -> Column:
    """Whether a path counts as a test."""
    low = F.lower("path")
    return low.rlike(r"\.test\.|\.spec\.|test_|_test\.|^tests/|^test/|^__tests__/")


def component_counts() -> dict[str, Column]:
    """Aggregates: numbers of files of each component kind; a file may count for several."""
    low, own = F.lower("path"), outside(NO_COMPONENTS)
    has = lambda *words: low.rlike("|".join(words))
    tests = {
        "controllers": has("controller"),
        "services": has("service") & ~has(r"\.test\.", r"\.spec\."),
        "models": has("model", "entity", r"schema\."),
        "dtos": has("dto", r"types\."),
        "routes": has("route", "router"),
        "middlewares": has("middleware"),
        "tests": has(r"\.test\.", r"\.spec\.", "test_", r"_test\."),
    }
    return {k: F.count_if(own & t) for k, t in tests.items()}


def structure(files: DataFrame) -> DataFrame:
    """(repo, total_files, test_file_count, test_pattern, and the component counts)."""
    counts = component_counts()
    return files.groupBy("repo").agg(F.count("*").alias("total_files"), F.count_if(is_test_file()).alias("test_file_count"), test_pattern().alias("test_pattern"), *(c.alias(k) for k, c in counts.items()))
