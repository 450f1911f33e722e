"""Facts about many collections at once: rules over ``files`` (repo, path, content).

Every operator is one aggregation by ``repo``: a file's rank is the first rule that it meets, the
smallest rank of a collection names its value. Ranks combine before the shuffle, so a collection
may hold any number of files, and nothing is joined. Missing texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]

#: Fixed values: (file or directory, CI provider), in order of priority; a final slash marks a directory.
PROVIDERS = ((".github/workflows/", "github-actions"), (".gitlab-ci.yml", "gitlab-ci"), (".circleci/config.yml", "circleci"), ("Jenkinsfile", "jenkins"), (".travis.yml", "travis"))
#: Fixed values: (file or directory, deployment target), in order of priority.
DEPLOY_TARGETS = (("fly.toml", "fly.io"), ("vercel.json", "vercel"), ("netlify.toml", "netlify"), ("render.yaml", "render"), ("appspec.yml", "aws-codedeploy"), ("serverless.yml", "serverless"), ("serverless.yaml", "serverless"), ("wrangler.toml", "cloudflare-workers"), ("Dockerfile", "docker"), ("firebase.json", "firebase"), ("terraform/", "terraform"), ("k8s/", "kubernetes"), ("kubernetes/", "kubernetes"), ("helm/", "kubernetes"), ("supabase/", "supabase"))
#: Fixed values: (text in a workflow, registry), in order of priority.
REGISTRIES = (("ghcr.io", "ghcr.io"), ("ecr.", "ecr"), ("gcr.io", "gcr.io"), ("docker.io", "docker.io"), ("dockerhub", "docker.io"), ("registry.gitlab.com", "gitlab-registry"), ("azurecr.io", "acr"), ("quay.io", "quay.io"))
#: Names of compose files, in order of priority.
COMPOSE_FILES = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
#: Fixed values: (marker, monorepo tool), in order of priority.
MONOREPO_TOOLS = (("turbo.json", "turborepo"), ("lerna.json", "lerna"), ("nx.json", "nx"), ("pnpm-workspace.yaml", "pnpm-workspaces"))
#: Lock files.
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock", "Cargo.lock", "poetry.lock", "Pipfile.lock", "uv.lock", "go.sum", "mix.lock", "Gemfile.lock", "composer.lock")
#: Fixed values: (text in a manifest, principle), in order of priority.
ORMS = (("prisma", "prisma-orm"), ("drizzle", "drizzle-orm"), ("sequelize", "sequelize-orm"), ("sqlalchemy", "sqlalchemy-orm"), ("typeorm", "typeorm"), ("django.db", "django-orm"))
#: Fixed values: (skill, pattern over a file's path).
SKILLS = (("deploy", r"^(docker-compose\.ya?ml|Dockerfile)$"), ("migrate", r"migration|migrate"), ("seed", r"seed|fixtures"), ("api-docs", r"openapi|swagger|api\.(yaml|json)$"), ("storybook", r"\.storybook|\.stories\."), ("plan-infra", r"\.tf$|Pulumi"), ("e2e", r"e2e|playwright|cypress|selenium"), ("benchmark", r"bench|perf"))
#: Fixed values: (marker, language) for the hint at a bare start, in order of priority.
START_MARKERS = (("package.json", "node"), ("Cargo.toml", "rust"), ("go.mod", "go"), ("requirements.txt", "python"), ("pyproject.toml", "python"), ("Gemfile", "ruby"))
#: Names of tiers, and the tier of each complexity.
TIERS = {"lean": "lean", "lite": "lean", "standard": "standard", "full": "full", "enterprise": "enterprise"}
COMPLEXITY_TIERS = {"simple": "lean", "moderate": "standard", "complex": "full", "enterprise": "enterprise"}
#: Fixed value: what stands for an unset command.
UNSET = "NOT_CONFIGURED"
COMMANDS = ("install", "dev", "build", "lint", "test", "format", "typecheck")


def path() -> Column:
    return F.col("path")


def content() -> Column:
    return F.coalesce(F.col("content"), F.lit(""))


def any_of(test: Column) -> Column:
    """Aggregate: whether the test holds for a file; unknown counts as no."""
    return F.coalesce(F.bool_or(test), F.lit(False))


def marked(marker: str) -> Column:
    """Whether a file is the marker, or lies in it where it ends with a slash."""
    return path().startswith(marker) if marker.endswith("/") else path() == marker


def first_rule(rules: Rules, test: Callable[[str], Column], default: str | None) -> Column:
    """Aggregate: the value of the first rule that any file of the collection meets."""
    rank = F.when(test(rules[0][0]), 0)
    for i, (marker, _) in enumerate(rules[1:], 1):
        rank = rank.when(test(marker), i)
    return F.coalesce(F.get(F.array(*(F.lit(v) for _, v in rules)), F.min(rank)), F.lit(default))


def text_of(name: str) -> Column:
    """Aggregate: the content of the file of that path, null where there is none."""
    return F.min(F.when(path() == name, content()))


def ci_facts(files: DataFrame) -> DataFrame:
    """(repo, ci_provider, deploy_target, compose_file, registry, deploy_trigger)."""
    flow = path().rlike(r"^\.github/workflows/[^/]*\.ya?ml$")
    low = F.lower(content())
    said = lambda *words: any_of(flow & low.rlike("|".join(words)))
    target = first_rule(DEPLOY_TARGETS, marked, None)
    onto_main = said("push:", "on: push") & said("main", "master") & said("deploy", "release")
    return files.groupBy("repo").agg(
        first_rule(PROVIDERS, marked, "none").alias("ci_provider"),
        F.coalesce(target, F.when(any_of(path().rlike(r"^[^/]+\.tf$")), "terraform"), F.lit("none")).alias("deploy_target"),
        first_rule([(x, x) for x in COMPOSE_FILES], marked, None).alias("compose_file"),
        first_rule(REGISTRIES, lambda x: flow & low.contains(x), None).alias("registry"),
        F.when(said("tags:", "tag:"), "tag").when(said("workflow_dispatch"), "manual").when(onto_main, "push-to-main").alias("deploy_trigger"),
    )


def monorepo(files: DataFrame) -> DataFrame:
    """(repo, monorepo_tool, is_monorepo): a marker in the root; a marker anywhere or three nested manifests."""
    base = F.substring_index("path", "/", -1)
    nested = path().endswith("package.json") & path().contains("/") & ~path().startswith("node_modules/")
    return files.groupBy("repo").agg(
        first_rule(MONOREPO_TOOLS, marked, "unknown").alias("monorepo_tool"),
        (any_of(base.isin(*(m for m, _ in MONOREPO_TOOLS))) | (F.count_if(nested) >= 3)).alias("is_monorepo"),
    )


def node_facts(files: DataFrame) -> DataFrame:
    """(repo, node_version, lock_file, scripts): the lock file that comes first in path order."""
    base = F.substring_index("path", "/", -1)
    version = lambda name: F.nullif(F.regexp_replace(text_of(name), r"^\s+|\s+$", ""), F.lit(""))
    first = F.min(F.when(base.isin(*LOCK_FILES), path()))
    return files.groupBy("repo").agg(
        F.coalesce(version(".nvmrc"), version(".node-version"), F.lit("")).alias("node_version"),
        F.coalesce(F.substring_index(first, "/", -1), F.lit("")).alias("lock_file"),
        F.get_json_object(text_of("package.json"), "$.scripts").alias("scripts"),
    )


def skills(files: DataFrame) -> DataFrame:
    """(repo, skill): rules whose pattern a path of the collection meets."""
    flags = files.groupBy("repo").agg(*(any_of(path().rlike(p)).alias(s) for s, p in SKILLS))
    return flags.select("repo", F.explode(F.array_compact(F.array(*(F.when(F.col(s), s) for s, _ in SKILLS)))).alias("skill"))


def principles(files: DataFrame) -> DataFrame:
    """(repo, principles): strict typing, the first mapper named in a manifest, settings from the environment."""
    manifest = path().isin("package.json", "pyproject.toml")
    facts = files.groupBy("repo").agg(
        any_of((path() == "tsconfig.json") & content().rlike('"strict": ?true')).alias("strict"),
        first_rule(ORMS, lambda x: manifest & F.lower(content()).contains(x), None).alias("orm"),
        any_of(path().isin(".env.example", ".env.template", ".env.sample")).alias("env"),
    )
    return facts.select("repo", F.array_compact(F.array(F.when(F.col("strict"), "strict-typescript"), F.col("orm"), F.when(F.col("env"), "env-based-config"))).alias("principles"))


def _defaults(language: Column, manager: Column, has: Callable[[str], Column], mypy: Column) -> dict[str, Column]:
    """Commands of languages that neither make nor scripts set."""
    # Language -> command in the order of COMMANDS; None stands for unset.
    table = {
        "rust": ("cargo build", "cargo run", "cargo build --release", "cargo clippy", "cargo test", "cargo fmt", None),
        "go": ("go mod download", "go run .", "go build .", "golangci-lint run", "go test ./...", "gofmt -w .", None),
        "ruby": ("bundle install", None, None, "rubocop", F.when(has("Rakefile"), "rake test"), None, None),
        "bash": (None, None, None, "find . -name '*.sh' -not -path '*/.git/*' | xargs shellcheck", F.when(has("Makefile"), "make test"), None, "find . -name '*.sh' -not -path '*/.git/*' | xargs bash -n"),
        "python": (
            F.when(manager == "poetry", "poetry install").when(manager == "uv", "uv sync").when(manager == "pipenv", "pipenv install").otherwise("pip install -r requirements.txt"),
            None, None, F.when(has("ruff.toml") | has(".ruff.toml"), "ruff check ."),
            F.when(has("pytest.ini") | has("pyproject.toml"), "pytest").otherwise("python -m unittest discover"), None, F.when(mypy, "mypy ."),
        ),
    }
    out = {}
    for i, command in enumerate(COMMANDS):
        chosen = F.lit(None).cast("string")
        for name, row in table.items():
            value = row[i] if isinstance(row[i], Column) else F.lit(row[i])
            chosen = F.when(language == name, value).otherwise(chosen)
        out[command] = chosen
    return out


def commands(files: DataFrame, language: Column, manager: Column) -> DataFrame:
    """(repo, install, dev, build, lint, test, format, typecheck).

    A Makefile with a lint or test target sets all of them (``check`` is its type check), else the
    scripts of package.json do, else the language. ``language`` and ``manager`` are aggregates.
    """
    facts = files.groupBy("repo").agg(
        text_of("Makefile").alias("mk"), F.get_json_object(text_of("package.json"), "$.scripts").alias("scripts"), language.alias("language"), manager.alias("manager"),
        F.collect_set(F.when(path().isin("ruff.toml", ".ruff.toml", "pytest.ini", "pyproject.toml", "Rakefile", "Makefile"), path())).alias("present"),
        (any_of(path().isin("mypy.ini", ".mypy.ini")) | any_of((path() == "pyproject.toml") & content().contains("[tool.mypy]"))).alias("mypy"),
    )
    target = lambda name: F.col("mk").rlike(rf"(?m)^{name}:")
    by_make = F.coalesce(target("lint") | target("test"), F.lit(False))
    run = F.when(F.col("manager").isin("pnpm", "yarn", "bun"), F.col("manager")).otherwise("npm run")
    script = lambda name: F.get_json_object("scripts", f"$['{name}']").isNotNull()
    made = {"dev": None, "format": None, "typecheck": "check"}
    usual = _defaults(F.col("language"), F.col("manager"), lambda x: F.array_contains("present", x), F.col("mypy"))
    out = []
    for c in COMMANDS:
        goal = made.get(c, c)
        from_make = F.when(target(goal), f"make {goal}") if goal else F.lit(None).cast("string")
        if c == "install":
            from_scripts = F.concat("manager", F.lit(" install"))
        else:
            from_scripts = F.when(script(c) | script("type-check") if c == "typecheck" else script(c), F.concat(run, F.lit(f" {c}")))
        chosen = F.when(by_make, from_make).when(F.col("scripts").isNotNull(), from_scripts).otherwise(usual[c])
        out.append(F.coalesce(chosen, F.lit(UNSET)).alias(c))
    return facts.select("repo", *out)


def hooks(files: DataFrame, folder: str = ".githooks/") -> DataFrame:
    """(repo, status, detail) of the two hook files."""
    commit, push = any_of(path() == folder + "pre-commit"), any_of(path() == folder + "pre-push")
    f = files.groupBy("repo").agg(any_of(path().startswith(folder)).alias("folder"), commit.alias("c"), push.alias("p"))
    both = F.col("c") & F.col("p")
    detail = F.when(~F.col("folder"), "directory missing").when(both, "pre-commit + pre-push present").when(F.col("c"), "pre-push missing").when(F.col("p"), "pre-commit missing").otherwise("both hooks missing")
    return f.select("repo", F.when(both, "PASS").otherwise("WARN").alias("status"), detail.alias("detail"))


def quality_gate(commands: DataFrame) -> DataFrame:
    """(repo, name, status): one PASS where lint and test are set, else a WARN for each that is not."""
    lint, test = F.col("lint") != UNSET, F.col("test") != UNSET
    row = lambda when, name, status: F.when(when, F.struct(F.lit(name).alias("name"), F.lit(status).alias("status")))
    rows = F.array_compact(F.array(row(~lint, "quality-gate-lint", "WARN"), row(~test, "quality-gate-test", "WARN"), row(lint & test, "quality-gate", "PASS")))
    return commands.select("repo", F.explode(rows).alias("r")).select("repo", "r.*")


def stale(files: DataFrame, manifest: str, named: Sequence[str], folders: Sequence[str] = ("bin", "lib", "src", "tools")) -> DataFrame:
    """(repo, status): whether a named file or a direct child of a folder is newer than the manifest.

    ``files`` has ``mtime``. Without the manifest the status is WARN.
    """
    made = F.max(F.when(path() == manifest, F.col("mtime")))
    watched = path().isin(*named) | path().rlike(f"^({'|'.join(folders)})/[^/]+$")
    last = F.max(F.when(watched, F.col("mtime")))
    return files.groupBy("repo").agg(F.when(made.isNull() | F.coalesce(last > made, F.lit(False)), "WARN").otherwise("PASS").alias("status"))


def source_newer(files: DataFrame, manifest: str, own: str) -> DataFrame:
    """(repo, newer): whether a file outside version control, dependencies, build output and the engine's own folder is newer than the manifest.

    ``files`` has ``mtime``; without the manifest any file is.
    """
    made = F.max(F.when(path() == manifest, F.col("mtime")))
    watched = path() != manifest
    for part in (".git/", own, "node_modules/", "target/"):
        watched = watched & ~path().contains(part)
    last = F.max(F.when(watched, F.col("mtime")))
    return files.groupBy("repo").agg(F.coalesce(last > made, last.isNotNull()).alias("newer"))


def maintained(last_commit: Column, now: Column | None = None, days: int = 90) -> Column:
    """Whether the last commit is under 90 days old; an unknown one counts as such."""
    now = now if now is not None else F.current_timestamp()
    return F.coalesce(last_commit > now - F.expr(f"INTERVAL {days} DAYS"), F.lit(True))


def start_hint(files: DataFrame, ready: Sequence[str]) -> DataFrame:
    """(repo, state, language): ready where all of those files are there, else by the version-control folder."""
    done = any_of(path() == ready[0])
    for name in ready[1:]:
        done = done & any_of(path() == name)
    git = any_of(path().startswith(".git/"))
    f = files.groupBy("repo").agg(done.alias("done"), git.alias("git"), first_rule(START_MARKERS, marked, None).alias("language"))
    state = F.when(F.col("done"), "bootstrapped").when(F.col("git"), "repository").otherwise("none")
    return f.select("repo", state.alias("state"), F.when(state == "repository", F.col("language")).alias("language"))


def parse_tier(name: Column) -> Column:
    """The tier of a name in any case; null for unknown names."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), F.lower(name))


def tier_of_complexity(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in COMPLEXITY_TIERS.items() for x in kv)), name), F.lit("full"))


def ports(files: DataFrame) -> DataFrame:
    """(repo, dev_port, prod_port) from package.json, the Dockerfile and .env, in this order or the reverse."""
    pick = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    f = files.groupBy("repo").agg(F.get_json_object(text_of("package.json"), "$.scripts.dev").alias("dev"), text_of("Dockerfile").alias("docker"), text_of(".env").alias("env"))
    unquoted = r"""\s*["']*([^"'\s]+)"""
    dev = F.coalesce(pick(F.col("dev"), r"--port=?\s*(\d+)"), pick(F.col("dev"), r"PORT=(\d+)"), pick(F.col("docker"), r"(?im)^[ \t]*EXPOSE\s+(\S+)"), pick(F.col("env"), r"(?m)^[ \t]*PORT=" + unquoted), F.lit(""))
    prod = F.coalesce(pick(F.col("env"), r"(?m)^[ \t]*PROD(?:UCTION)?_PORT=" + unquoted), pick(F.col("docker"), r"(?im)^[ \t]*EXPOSE\s+(80|443|3000|8080)(?!\S)"), F.lit(""))
    return f.select("repo", dev.alias("dev_port"), prod.alias("prod_port"))


def index_state(files: DataFrame, index: str) -> DataFrame:
    """(repo, file_count, method): the count that a stored index names, or pending without one that parses."""
    f = files.groupBy("repo").agg(text_of(index).alias("doc"))
    valid = F.expr("try_parse_json(doc) is not null")
    count = F.coalesce(F.get_json_object("doc", "$._meta.total_files").try_cast("long"), F.lit(0))
    return f.select("repo", F.when(valid, count).otherwise(F.lit(0)).cast("long").alias("file_count"), F.when(valid, "indexed").otherwise("pending").alias("method"))
