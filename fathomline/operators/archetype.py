"""Kind, maturity, complexity and identity of many collections, one aggregation each over (repo, path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .profile import any_of, content, first_rule, path, text_of
from .tables import complexity as complexity_score
from .tables import complexity_class

#: Parts of dependency names that stand for a kind.
DATA = ("airflow", "dagster", "dbt", "prefect", "luigi")
MACHINE_LEARNING = ("torch", "tensorflow", "scikit", "transformers", "keras")
MOBILE = ("react-native", "flutter", "expo")
API = ("fastapi", "flask", "django", "express", "gin", "echo", "chi", "fiber", "actix", "axum", "rocket", "sinatra", "rails", "spring", "quarkus", "nestjs", "hono", "starlette", "laravel", "symfony")
WEB = ("next", "nuxt", "svelte", "remix", "gatsby", "angular", "vue")
DOCUMENTATION = ("docusaurus", "vitepress", "mkdocs", "hugo", "eleventy", "astro")
#: Marker files of monorepos, entry points of libraries, markers of infrastructure.
MONOREPO = ("turbo.json", "lerna.json", "nx.json", "pnpm-workspace.yaml")
LIBRARY_ENTRIES = ("index.ts", "index.js", "main.rs", "lib.rs", "__init__.py", "main.py", "main.go")
INFRASTRUCTURE = ("terraform", "pulumi", "cdk.json", "ansible.cfg")
#: Texts that name dependencies, besides package.json.
DEPENDENCY_TEXTS = ("requirements.txt", "requirements-dev.txt", "Pipfile", "Cargo.toml")
#: Extensions that count as languages of a collection.
CODE = ("ts", "js", "py", "rs", "go", "rb", "java", "cs", "php")
#: Fixed values: (lock file or manifest, package manager): lock files first, in the documented order.
PACKAGE_MANAGERS = (
    ("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"), ("bun.lockb", "bun"), ("bun.lock", "bun"), ("Cargo.lock", "cargo"), ("poetry.lock", "poetry"), ("Pipfile.lock", "pipenv"), ("uv.lock", "uv"),
    ("go.sum", "go"), ("mix.lock", "mix"), ("Gemfile.lock", "bundler"), ("composer.lock", "composer"),
    ("go.mod", "go"), ("Cargo.toml", "cargo"), ("requirements.txt", "pip"), ("setup.py", "pip"), ("pyproject.toml", "pip"), ("package.json", "npm"), ("Gemfile", "bundler"), ("composer.json", "composer"), ("mix.exs", "mix"),
)


def _escaped(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def depends_on(words: tuple[str, ...]) -> Column:
    """Aggregate: whether a dependency of the root's manifests has one of the words in its name."""
    named = F.lit(False)
    for section in ("dependencies", "devDependencies"):
        keys = F.json_object_keys(F.get_json_object(content(), f"$.{section}"))
        named = named | F.coalesce(F.exists(keys, lambda k: k.rlike(_escaped(words))), F.lit(False))
    return any_of((path() == "package.json") & named | path().isin(*DEPENDENCY_TEXTS) & F.lower(content()).rlike(_escaped(words)))


def archetype(files: DataFrame) -> DataFrame:
    """(repo, archetype): the first kind, in fixed order, whose rule the collection meets."""
    has = lambda *words: path().rlike("|".join(words))
    flags = files.groupBy("repo").agg(
        F.count("*").alias("n"),
        any_of(path().isin(*MONOREPO) | (path() == "package.json") & F.coalesce(F.array_contains(F.json_object_keys(content()), "workspaces"), F.lit(False))).alias("mono"),
        depends_on(DATA).alias("data"), depends_on(MACHINE_LEARNING).alias("ml"), depends_on(MOBILE).alias("mobile"),
        any_of(has("components/", "pages/", "views/", "layouts/", r"\.tsx$", r"\.vue$", r"\.svelte$")).alias("front"),
        (any_of(has("routes/", "controllers/", "handlers/", "endpoints/")) | depends_on(API)).alias("api"),
        depends_on(WEB).alias("web"), any_of(path().startswith("bin/")).alias("bin"),
        F.count_if(path().isin(*LIBRARY_ENTRIES)).alias("entries"), depends_on(DOCUMENTATION).alias("doc"), F.count_if(has(r"\.md$", r"\.mdx$")).alias("md"),
        any_of(path().rlike(_escaped(INFRASTRUCTURE) + r"|\.tf$")).alias("infra"),
    )
    f = F.col
    kind = (
        F.when(f("mono"), "monorepo").when(f("data"), "data-pipeline").when(f("ml"), "ml-project").when(f("mobile"), "mobile-app")
        .when(f("front") & f("api"), "full-stack").when(f("api"), "api-service").when(f("web") | f("front"), "web-app").when(f("bin"), "cli-tool")
        .when((f("entries") <= 1) & (f("n") > 5), "library").when(f("doc") | (f("n") > 3) & (2 * f("md") > f("n")), "documentation-site")
        .when(f("infra"), "infrastructure").when(f("n") < 5, "minimal").otherwise("application")
    )
    return flags.select("repo", kind.alias("archetype"))


def maturity(files: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, maturity) from the files and ``commits`` (repo, n_commits); a collection without a count has none."""
    ci = files.groupBy("repo").agg(any_of(path().startswith(".github/workflows/") | path().startswith(".circleci/") | path().isin(".gitlab-ci.yml", "Jenkinsfile")).alias("ci"))
    n = F.coalesce("n_commits", F.lit(0))
    kind = F.when(n < 20, "greenfield").when(F.col("ci") & (n > 200), "mature").when(F.col("ci"), "active").when(n > 100, "legacy").otherwise("established")
    return ci.join(commits, "repo", "left").select("repo", kind.alias("maturity"))


def complexity(files: DataFrame) -> DataFrame:
    """(repo, score, complexity) from the number of files, containers, checks, languages and packages."""
    ext = paths.extension(path())
    flags = files.groupBy("repo").agg(
        F.count("*").alias("n"), any_of(path().isin("Dockerfile", "docker-compose.yml")).alias("docker"), any_of(path().contains(".github/workflows/") | path().contains(".gitlab-ci")).alias("ci"),
        (F.count_distinct(F.when(ext.isin(*CODE), ext)) >= 2).alias("multi"), any_of(path().isin("turbo.json", "lerna.json", "nx.json")).alias("mono"), F.count_if(path().endswith("package.json")).alias("packages"),
    )
    score = complexity_score(F.col("n"), F.col("docker"), F.col("ci"), F.col("multi"), F.col("mono"), F.col("packages")).cast("long")
    return flags.select("repo", score.alias("score"), complexity_class(score).alias("complexity"))


def package_manager(files: DataFrame) -> DataFrame:
    """(repo, package_manager): by the first lock file or manifest, in fixed order, that any folder holds."""
    name = F.substring_index("path", "/", -1)
    return files.groupBy("repo").agg(first_rule(PACKAGE_MANAGERS, lambda x: name == x, "NOT_CONFIGURED").alias("package_manager"))


def toml_value(text: Column, key: str) -> Column:
    """Text between the first = and the next of the first line that begins with the key and has some, without quotes; whatever its section."""
    return F.nullif(F.regexp_extract(text, rf"""(?dm)^[ \t]*{key}[^=\n]*=[ \t]*["']*([^\s="'][^=\n]*?)["']*[ \t\r]*(?:=.*)?$""", 1), F.lit(""))


def identity(files: DataFrame) -> DataFrame:
    """(repo, name, short_name, version, description); without a name in a manifest the collection's own name counts."""
    f = files.groupBy("repo").agg(*(text_of(p).alias(a) for a, p in (("package", "package.json"), ("cargo", "Cargo.toml"), ("project", "pyproject.toml"), ("version", "VERSION"), ("readme", "README.md"))))
    json = lambda k: F.get_json_object("package", f"$.{k}")
    name = F.coalesce(json("name"), toml_value(F.col("cargo"), "name"), toml_value(F.col("project"), "name"), F.col("repo").cast("string"))
    given = F.nullif(F.regexp_replace("version", r"^\s+|\s+$", ""), F.lit(""))
    version = F.coalesce(given, json("version"), toml_value(F.col("cargo"), "version"), toml_value(F.col("project"), "version"), F.lit("0.0.0"))
    # The first line after the title that is no heading, image, link, markup or rule.
    line = F.regexp_extract("readme", r"(?d)\A[^\n]*\n(?:[ \t\r]*(?:#|!\[|<|\[|---)[^\n]*\n|[ \t\r]*\n)*[ \t]*([^\s#<\[!-][^\n]*|!(?!\[)[^\n]*|-(?!--)[^\n]*)", 1)
    described = F.coalesce(json("description"), F.left(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+$", ""), F.lit(200)))
    return f.select("repo", name.alias("name"), paths.short_name(name).alias("short_name"), version.alias("version"), described.alias("description"))


def python_version(files: DataFrame) -> DataFrame:
    """(repo, python_version): of .python-version, else the whole specifier that the project asks for, else empty."""
    f = files.groupBy("repo").agg(text_of(".python-version").alias("pinned"), text_of("pyproject.toml").alias("project"))
    pinned = F.nullif(F.regexp_replace("pinned", r"^\s+|\s+$", ""), F.lit(""))
    asked = F.nullif(F.regexp_extract("project", r"""(?m)^\s*requires-python\s*=\s*["']?([^"'\n]*)""", 1), F.lit(""))
    return f.select("repo", F.coalesce(pinned, asked, F.lit("")).alias("python_version"))


def git_facts(files: DataFrame) -> DataFrame:
    """(repo, owner_email, github_url) from .git/config: the last address, the first url of that host as https."""
    f = files.groupBy("repo").agg(F.coalesce(text_of(".git/config"), F.lit("")).alias("config"))
    mails = F.regexp_extract_all("config", F.lit(r"(?m)^\s*email = ([^\n]*?)\s*$"), F.lit(1))
    urls = F.filter(F.regexp_extract_all("config", F.lit(r"(?m)^\s*url = ([^\n]*?)\s*$"), F.lit(1)), lambda u: u.contains("github.com"))
    url = F.replace(F.replace(F.get(urls, 0), F.lit("git@github.com:"), F.lit("https://github.com/")), F.lit(".git"), F.lit(""))
    return f.select("repo", F.coalesce(F.try_element_at(mails, F.lit(-1)), F.lit("")).alias("owner_email"), F.coalesce(url, F.lit("")).alias("github_url"))


def production_url(files: DataFrame) -> DataFrame:
    """(repo, production_url): of .env, else the homepage of package.json, else empty."""
    f = files.groupBy("repo").agg(text_of(".env").alias("env"), text_of("package.json").alias("package"))
    given = F.nullif(F.regexp_extract("env", r"""(?m)^\s*PRODUCTION_URL=\s*["']*([^"'\s]+)""", 1), F.lit(""))
    return f.select("repo", F.coalesce(given, F.get_json_object("package", "$.homepage"), F.lit("")).alias("production_url"))


def companion_state(files: DataFrame, folder: str, home: DataFrame | None = None) -> DataFrame:
    """(repo, vault_exists, config_exists, initialized, has_learnings, project_learnings, has_rules, has_retro_skill, and the home's counts).

    ``folder`` is the companion's, with a final slash; ``home`` (path, content) holds the user's own
    files below it, whose learnings and skills count for every collection.
    """
    blank = F.size(F.filter(F.split(content(), "\n"), lambda x: x.rlike(r"\S")))
    own = path().rlike(r"^tools/learnings/[^/]+\.jsonl$")
    out = files.groupBy("repo").agg(
        any_of(path().startswith("vault/")).alias("vault_exists"), any_of(path().startswith(folder) | (path() == folder.rstrip("/") + ".json")).alias("config_exists"),
        any_of(path() == folder + "config.json").alias("initialized"), any_of(path().contains("learnings") & path().endswith(".jsonl")).alias("has_learnings"),
        F.coalesce(F.sum(F.when(own, blank)), F.lit(0)).cast("long").alias("project_learnings"), any_of(path().startswith(".claude/rules/")).alias("has_rules"),
        any_of(F.lower(F.regexp_extract("path", r"^\.claude/skills/([^/]+)", 1)).contains("retro")).alias("has_retro_skill"),
    )
    if home is None:
        return out.withColumn("global_learnings", F.lit(0).cast("long")).withColumn("skill_count", F.lit(0).cast("long"))
    whole = home.agg(
        F.coalesce(F.sum(F.when(path().rlike(r"^learnings/[^/]+\.jsonl$"), blank)), F.lit(0)).cast("long").alias("global_learnings"),
        F.count_distinct(F.nullif(F.regexp_extract("path", r"^skills/([^/]+)/", 1), F.lit(""))).alias("skill_count"),
    )
    return out.crossJoin(F.broadcast(whole))  # one row
