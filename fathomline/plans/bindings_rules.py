"""Rule operators bound to small collections; the SQL lists or derives what their fixed rules must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import paths as P
from ..operators import archetype as A
from ..operators import checks as V
from ..operators import domains as D
from ..operators import profile as C
from ..operators import structure as S
from ..operators import tools as T
from ..sources import readers as L
from ..sources import repo as R
from ..sources import sinks
from . import manifest as M
from . import render
from . import server
from .bindings import FILES, files, read
from .bindings_profile import VIEW
from .bindings_profile import collections as profiles
from .fixtures import collections, expected, quoted

# ---- layout: a customer's orders are files ----------------------------------------------------

PATHS = (
    "src/main.py", "lib/index.ts", "app/routes/users.py", "pkg/x.go", "internal/y.go", "cmd/main.go", "api/handlers/z.rs", "tests/test_a.py", "__tests__/b.test.ts", "spec/c.spec.js", "docs/readme.md", "scripts/run.sh", "bin/tool",
    "tools/x_controller.js", "components/Button.tsx", "models/user.py", "db/schema.sql", "services/auth.ts", "workers/job.py", "package.json", "web/package.json", "requirements.txt", "Cargo.toml", "pyproject.toml", "go.mod", "turbo.json",
    "Makefile", "Dockerfile", "README.md", ".github/workflows/ci.yml", ".circleci/config.yml", "main.tf", "x_test.go", "y_test.py", "a/tests/t.rs", "src/payment_dto.ts", "middleware/guard.js", "mid/router.ts", ".gitlab-ci.yml", "yarn.lock",
    "node_modules/m/service.js", "src/prompt.md",
)
TEXTS = (
    "", '{"dependencies": {"express": "1", "next": "2"}, "devDependencies": {"eslint": "8"}}', '{"workspaces": ["a"], "dependencies": {"react-native": "1"}}', "Torch==2\n", "dbt", "stripe openai\n", '{"dependencies": {"gatsby": null}}', "axum",
)
_LIST = lambda values: "[" + ", ".join(map(quoted, values)) + "]"
LAYOUT = f"f AS (SELECT DISTINCT o_custkey AS repo, {_LIST(PATHS)}[o_orderkey % {len(PATHS)} + 1] AS path, {_LIST(TEXTS)}[(o_custkey + o_orderkey % {len(PATHS)}) % {len(TEXTS)} + 1] AS content FROM orders)"


def layout(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda values, index: F.get(F.array(*map(F.lit, values)), F.expr(index).cast("int"))
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), at(PATHS, f"o_orderkey % {len(PATHS)}").alias("path"), at(TEXTS, f"(o_custkey + o_orderkey % {len(PATHS)}) % {len(TEXTS)}").alias("content")).distinct()


_DIRS = [(k, d, i) for k, ds in (("source", "src lib app pkg internal cmd api"), ("test", "tests test __tests__ spec specs test_data"), ("ci", ".github .circleci .gitlab"), ("doc", "docs doc documentation"), ("script", "scripts bin tools")) for i, d in enumerate(ds.split())]


@query("p7_source_dirs", f"WITH {LAYOUT}, c(kind, dir, idx) AS (VALUES {', '.join(map(str, _DIRS))}) SELECT DISTINCT repo, kind, dir, idx FROM f JOIN c ON starts_with(path, dir || '/')")
def p7(spark, sf):
    return S.known_dirs(layout(spark, sf))


def _named(kind: str):
    return lambda spark, sf: S.named_files(layout(spark, sf)).where(F.col("kind") == kind).select("repo", "path")


_BASE = "regexp_extract(path, '[^/]*$')"
query("p8_entry_points", f"WITH {LAYOUT} SELECT repo, path FROM f WHERE {_BASE} IN ('main.py', 'app.py', 'manage.py', 'main.ts', 'index.ts', 'app.ts', 'main.js', 'index.js', 'app.js', 'main.go', 'main.rs', 'main.java', 'App.java', 'Program.cs')")(_named("entry"))
query("p9_key_files", f"WITH {LAYOUT} SELECT repo, path FROM f WHERE path IN ('README.md', 'package.json', 'Cargo.toml', 'go.mod', 'pyproject.toml', 'requirements.txt', 'Makefile', 'Dockerfile', '.github/workflows/ci.yml')")(_named("key"))
query("p10_config_files", f"WITH {LAYOUT} SELECT repo, path FROM f WHERE {_BASE} IN ('Dockerfile', 'Makefile', 'pyproject.toml', '.gitlab-ci.yml') OR path = '.github/workflows/ci.yml'")(_named("config"))


@query("a5_layout_directories", f"WITH {LAYOUT} SELECT DISTINCT repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f WHERE contains(path, '/') AND NOT starts_with(path, '.git')")
def a5_layout(spark, sf):
    return S.directories(layout(spark, sf))


_LOW = "lower(path)"
_TESTS = f"(contains({_LOW}, '.test.') OR contains({_LOW}, '.spec.') OR contains({_LOW}, 'test_') OR contains({_LOW}, '_test.') OR starts_with({_LOW}, 'tests/') OR starts_with({_LOW}, 'test/') OR starts_with({_LOW}, '__tests__/'))"
_OWN = "NOT regexp_matches(path, '^(node_modules|\\.git|\\.venv|target|vault|\\.claude|docs|tools)/')"


@query("p11_test_pattern", f"""WITH {LAYOUT} SELECT repo, nullif(concat_ws(' / ', CASE WHEN bool_or(contains(path, '.test.ts') OR contains(path, '.test.js')) THEN '*.test.ts' END, CASE WHEN bool_or(contains(path, '.spec.ts') OR contains(path, '.spec.js')) THEN '*.spec.ts' END,
    CASE WHEN bool_or(starts_with({_BASE}, 'test_') AND ends_with(path, '.py')) THEN 'test_*.py' END, CASE WHEN bool_or(ends_with(path, '_test.py')) THEN '*_test.py' END, CASE WHEN bool_or(ends_with(path, '_test.go')) THEN '*_test.go' END, CASE WHEN bool_or(contains(path, '/tests/') AND ends_with(path, '.rs')) THEN 'tests/*.rs' END), '') AS test_pattern FROM f GROUP BY repo""")
def p11(spark, sf):
    return S.structure(layout(spark, sf)).select("repo", "test_pattern")


@query("a8_test_file_count", f"WITH {LAYOUT} SELECT repo, count(*) AS total_files, count(*) FILTER (WHERE {_TESTS}) AS test_file_count FROM f GROUP BY repo")
def a8(spark, sf):
    return S.structure(layout(spark, sf)).select("repo", "total_files", "test_file_count")


@query("a7_component_counts", f"""WITH {LAYOUT} SELECT repo, {', '.join(f"count(*) FILTER (WHERE {_OWN} AND ({t})) AS {k}" for k, t in {
    'controllers': f"contains({_LOW}, 'controller')", 'services': f"contains({_LOW}, 'service') AND NOT contains({_LOW}, '.test.') AND NOT contains({_LOW}, '.spec.')", 'models': f"contains({_LOW}, 'model') OR contains({_LOW}, 'entity') OR contains({_LOW}, 'schema.')",
    'dtos': f"contains({_LOW}, 'dto') OR contains({_LOW}, 'types.')", 'routes': f"contains({_LOW}, 'route')", 'middlewares': f"contains({_LOW}, 'middleware')", 'tests': f"contains({_LOW}, '.test.') OR contains({_LOW}, '.spec.') OR contains({_LOW}, 'test_') OR contains({_LOW}, '_test.')"}.items())} FROM f GROUP BY repo""")
def a7(spark, sf):
    return S.structure(layout(spark, sf)).drop("total_files", "test_file_count", "test_pattern")


@query("p17_path_class", f"WITH {LAYOUT} SELECT repo, path FROM f WHERE NOT regexp_matches(path, '^(node_modules|\\.git|\\.venv|target|vault|review-specialists|templates|\\.claude|docs|tools)/') AND NOT contains(path, '.test.') AND NOT contains(path, '.spec.')")
def p17(spark, sf):
    return layout(spark, sf).where(S.outside(D.NO_SOURCES) & ~F.col("path").contains(".test.") & ~F.col("path").contains(".spec.")).select("repo", "path")


# ---- domains ----------------------------------------------------------------------------------

_DOMAINS = (
    ("auth", "auth/ auth. login session jwt oauth guard permission"), ("database", "migration schema. models/ model. entity prisma sequelize sqlalchemy drizzle .sql"), ("api", "routes/ controllers/ handlers/ endpoints/ controller. route. handler."),
    ("ai", "openai anthropic langchain llm prompt embedding agent rag"), ("frontend", "components/ pages/ views/ layouts/ .tsx .vue .svelte"), ("workers", "workers/ jobs/ queues/ worker. job. queue. consumer. cron"), ("file-upload", "upload storage s3 multer busboy gcs"), ("financial", "payment billing stripe invoice transaction payroll"),
)
_RULES = f"d(idx, domain, pattern) AS (VALUES {', '.join(f'({i}, {quoted(n)}, {quoted(p)})' for i, (n, ps) in enumerate(_DOMAINS) for p in ps.split())})"
_SOURCES = "s AS (SELECT * FROM f WHERE NOT regexp_matches(path, '^(node_modules|\\.git|\\.venv|target|vault|review-specialists|templates|\\.claude|docs|tools)/') AND NOT contains(path, '.test.') AND NOT contains(path, '.spec.'))"
_BY_PATH = "bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, domain ORDER BY path) AS rn FROM (SELECT DISTINCT repo, idx, domain, path FROM s JOIN d ON contains(lower(path), pattern))) WHERE rn <= 10)"
_BY_DEP = "bd AS (SELECT DISTINCT repo, idx, domain FROM f JOIN d ON contains(lower(content), rtrim(rtrim(pattern, '/'), '.')) WHERE path IN ('package.json', 'Cargo.toml', 'requirements.txt', 'go.mod', 'pyproject.toml', 'web/package.json'))"
_DETECTED = f"{LAYOUT}, {_RULES}, {_SOURCES}, {_BY_PATH}, {_BY_DEP}, found AS (SELECT repo, idx, domain FROM bp UNION SELECT repo, idx, domain FROM bd)"


@query("j6_domain_paths", f"WITH {LAYOUT}, {_RULES}, {_SOURCES}, {_BY_PATH} SELECT repo, domain, path FROM bp")
def j6(spark, sf):
    return D.domain_paths(layout(spark, sf)).select("repo", "domain", "path")


@query("j7_domain_deps", f"WITH {LAYOUT}, {_RULES}, {_BY_DEP} SELECT repo, domain FROM bd")
def j7(spark, sf):
    return D.domain_dependencies(layout(spark, sf)).select("repo", "domain")


_AFTER = {
    "invariants": {"auth": "no-credentials-in-code session-validation-required", "database": "migrations-required no-raw-sql-without-parameterization", "api": "input-validation-required rate-limiting-recommended", "ai": "llm-trust-boundary output-sanitization-required", "financial": "decimal-precision-required audit-logging-required", "file-upload": "file-size-limits-required file-type-validation-required"},
    "concerns": {"auth": "credential-exposure session-hijacking", "api": "injection-attacks broken-access-control", "ai": "llm-trust-boundary prompt-injection", "database": "sql-injection data-leakage", "financial": "payment-data-exposure transaction-integrity", "file-upload": "path-traversal malicious-file-upload"},
}


def _after(kind: str) -> str:
    rows = ", ".join(f"({quoted(d)}, {quoted(v)})" for d, vs in _AFTER[kind].items() for v in vs.split())
    return f"WITH {_DETECTED}, a(domain, value) AS (VALUES {rows}) SELECT repo, string_agg(DISTINCT value, ',' ORDER BY value) AS {kind} FROM found JOIN a USING (domain) GROUP BY repo"


@query("a15_domain_invariants", _after("invariants"))
def a15(spark, sf):
    return D.invariants(D.detected(layout(spark, sf))).select("repo", F.array_join("invariants", ",").alias("invariants"))


@query("a15_security_concerns", _after("concerns"))
def a15_concerns(spark, sf):
    return D.security_concerns(D.detected(layout(spark, sf))).select("repo", F.array_join("concerns", ",").alias("concerns"))


_INVARIANTS = f"""WITH {_DETECTED}, r(domain, place, rule) AS (VALUES ('auth', 0, 'Auth guards on all protected endpoints'), ('database', 1, 'Database access through ORM only'), ('api', 2, 'Input validation on all API endpoints'), ('ai', 3, 'LLM outputs sanitized before use')),
 x AS (SELECT DISTINCT repo, 'general' AS domain, -2 AS place, 'LLM trust boundary — validate all AI output' AS rule FROM f UNION ALL SELECT DISTINCT repo, 'general', -1, 'No secrets in source code' FROM f UNION ALL SELECT repo, domain, place, rule FROM found JOIN r USING (domain))
 SELECT repo, 'INV-' || row_number() OVER (PARTITION BY repo ORDER BY place) AS id, rule, domain, true AS enforced FROM x"""


@query("q6_check_invariants", _INVARIANTS)
def q6(spark, sf):
    rows = layout(spark, sf)
    return D.invariant_rules(rows.select("repo").distinct(), D.detected(rows))


@query("w8_dense_id", f"WITH q AS ({_INVARIANTS}) SELECT repo, count(*) AS n, max(substr(id, 5)::INT) AS last FROM q GROUP BY repo")
def w8(spark, sf):
    return q6(spark, sf).groupBy("repo").agg(F.count("*").alias("n"), F.max(F.expr("CAST(substr(id, 5) AS INT)")).alias("last"))


# ---- kinds ------------------------------------------------------------------------------------

_KEYS = "CASE WHEN path = 'package.json' AND json_valid(content) THEN list_concat(coalesce(json_keys(content, '$.dependencies'), []), coalesce(json_keys(content, '$.devDependencies'), [])) ELSE [] END"
_DEPENDS = lambda words: f"bool_or(len(list_filter({_KEYS}, lambda k: regexp_matches(k, '{words}'))) > 0 OR path IN ('requirements.txt', 'Cargo.toml') AND regexp_matches(lower(content), '{words}'))"
_API = "fastapi|flask|django|express|gin|echo|chi|fiber|actix|axum|rocket|sinatra|rails|spring|quarkus|nestjs|hono|starlette|laravel|symfony"


@query("j8_dependency_match", f"WITH {LAYOUT} SELECT repo, {_DEPENDS('torch|tensorflow|scikit|transformers|keras')} AS ml, {_DEPENDS(_API)} AS api FROM f GROUP BY repo")
def j8(spark, sf):
    return layout(spark, sf).groupBy("repo").agg(A.depends_on(A.MACHINE_LEARNING).alias("ml"), A.depends_on(A.API).alias("api"))


@query("c1_archetype", f"""WITH {LAYOUT}, g AS (SELECT repo, count(*) AS n, bool_or(path = 'turbo.json' OR path = 'package.json' AND contains(content, 'workspaces')) AS mono, {_DEPENDS('airflow|dagster|dbt|prefect|luigi')} AS data, {_DEPENDS('torch|tensorflow|scikit|transformers|keras')} AS ml, {_DEPENDS('react-native|flutter|expo')} AS mobile,
    bool_or(contains(path, 'components/') OR ends_with(path, '.tsx')) AS front, bool_or(contains(path, 'routes/') OR contains(path, 'handlers/')) OR {_DEPENDS(_API)} AS api, {_DEPENDS('next|nuxt|svelte|remix|gatsby|angular|vue')} AS web, bool_or(starts_with(path, 'bin/')) AS bin, {_DEPENDS('docusaurus|vitepress|mkdocs|hugo|eleventy|astro')} AS doc,
    count(*) FILTER (WHERE ends_with(path, '.md')) AS md, bool_or(ends_with(path, '.tf')) AS infra FROM f GROUP BY repo)
    SELECT repo, CASE WHEN mono THEN 'monorepo' WHEN data THEN 'data-pipeline' WHEN ml THEN 'ml-project' WHEN mobile THEN 'mobile-app' WHEN front AND api THEN 'full-stack' WHEN api THEN 'api-service' WHEN web OR front THEN 'web-app' WHEN bin THEN 'cli-tool' WHEN n > 5 THEN 'library'
    WHEN doc OR n > 3 AND 2 * md > n THEN 'documentation-site' WHEN infra THEN 'infrastructure' WHEN n < 5 THEN 'minimal' ELSE 'application' END AS archetype FROM g""")
def c1(spark, sf):
    return A.archetype(layout(spark, sf))


@query("a16_md_ratio", f"WITH {LAYOUT} SELECT repo, count(*) > 3 AND 2 * count(*) FILTER (WHERE regexp_matches(path, '\\.mdx?$')) > count(*) AS mostly_documents FROM f GROUP BY repo")
def a16(spark, sf):
    md = F.count_if(F.col("path").rlike(r"\.mdx?$"))
    return layout(spark, sf).groupBy("repo").agg(((F.count("*") > 3) & (2 * md > F.count("*"))).alias("mostly_documents"))


@query("c2_maturity", f"WITH {LAYOUT}, g AS (SELECT repo, bool_or(starts_with(path, '.github/workflows/') OR starts_with(path, '.circleci/') OR path = '.gitlab-ci.yml') AS ci FROM f GROUP BY repo) SELECT repo, CASE WHEN repo * 7 % 300 < 20 THEN 'greenfield' WHEN ci AND repo * 7 % 300 > 200 THEN 'mature' WHEN ci THEN 'active' WHEN repo * 7 % 300 > 100 THEN 'legacy' ELSE 'established' END AS maturity FROM g")
def c2(spark, sf):
    rows = layout(spark, sf)
    return A.maturity(rows, rows.select("repo").distinct().withColumn("n_commits", F.col("repo") * 7 % 300))


@query("c3_complexity", f"""WITH {LAYOUT}, g AS (SELECT repo, least(count(*), 500) // 10 + CASE WHEN bool_or(path = 'Dockerfile') THEN 10 ELSE 0 END + CASE WHEN bool_or(contains(path, '.github/workflows/') OR contains(path, '.gitlab-ci')) THEN 10 ELSE 0 END
    + CASE WHEN count(DISTINCT CASE WHEN regexp_matches(path, '\\.(ts|js|py|rs|go)$') THEN regexp_extract(path, '[^.]*$') END) >= 2 THEN 15 ELSE 0 END + CASE WHEN bool_or(path = 'turbo.json') THEN 20 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE ends_with(path, 'package.json')) >= 3 THEN 15 ELSE 0 END AS score FROM f GROUP BY repo)
    SELECT repo, score::BIGINT AS score, CASE WHEN score < 10 THEN 'simple' WHEN score < 30 THEN 'moderate' WHEN score < 60 THEN 'complex' ELSE 'enterprise' END AS complexity FROM g""")
def c3(spark, sf):
    return A.complexity(layout(spark, sf))


query("a13_complexity_score", f"WITH {LAYOUT} SELECT repo, count(*) FILTER (WHERE ends_with(path, 'package.json')) AS packages, count(DISTINCT CASE WHEN regexp_matches(path, '\\.(ts|js|py|rs|go)$') THEN regexp_extract(path, '[^.]*$') END) AS languages FROM f GROUP BY repo")(
    lambda spark, sf: layout(spark, sf).groupBy("repo").agg(F.count_if(F.col("path").endswith("package.json")).alias("packages"), F.count_distinct(F.when(P.extension(F.col("path")).isin(*A.CODE), P.extension(F.col("path")))).alias("languages"))
)


@query("a14_package_count", f"WITH {LAYOUT} SELECT repo, bool_or({_BASE} = 'turbo.json') OR count(*) FILTER (WHERE ends_with(path, 'package.json') AND contains(path, '/') AND NOT starts_with(path, 'node_modules/')) >= 3 AS is_monorepo FROM f GROUP BY repo")
def a14(spark, sf):
    return C.monorepo(layout(spark, sf)).select("repo", "is_monorepo")


@query("c5_package_manager", f"WITH {LAYOUT}, p(name, pm, rank) AS (VALUES ('yarn.lock', 'yarn', 1), ('go.mod', 'go', 2), ('Cargo.toml', 'cargo', 3), ('requirements.txt', 'pip', 4), ('pyproject.toml', 'pip', 5), ('package.json', 'npm', 6)) SELECT repo, coalesce(arg_min(pm, rank), 'NOT_CONFIGURED') AS package_manager FROM f LEFT JOIN p ON {_BASE} = name GROUP BY repo")
def c5(spark, sf):
    return A.package_manager(layout(spark, sf))


@query("c15_package_dirs", f"WITH {LAYOUT} SELECT DISTINCT repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f WHERE {_BASE} IN ('package.json', 'Cargo.toml') AND contains(path, '/')")
def c15(spark, sf):
    return layout(spark, sf).where(P.basename(F.col("path")).isin("package.json", "Cargo.toml")).select("repo", P.dirname(F.col("path")).alias("dir")).where("dir <> '' and not startswith(dir, 'node_modules')").distinct()


_EXT = f"regexp_extract({_BASE}, '^.+\\.([^.]*)$', 1)"
_LANGUAGE = f"CASE {_EXT} WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'sh' THEN 'bash' END"


@query("a6_all_languages", f"WITH {LAYOUT} SELECT repo, coalesce(string_agg(DISTINCT {_LANGUAGE}, ',' ORDER BY {_LANGUAGE}), '') AS languages FROM f GROUP BY repo")
def a6(spark, sf):
    return M.languages(layout(spark, sf)).select("repo", F.array_join("languages", ",").alias("languages"))


@query("j9_framework_detect", f"""WITH {LAYOUT}, g AS (SELECT repo, bool_or(path IN ('package.json', 'Cargo.toml', 'requirements.txt', 'go.mod', 'web/package.json') AND contains(content, '"next"')) AS nextjs, bool_or(path IN ('package.json', 'Cargo.toml', 'requirements.txt', 'go.mod', 'web/package.json') AND contains(content, '"express"')) AS express,
    bool_or(path IN ('package.json', 'Cargo.toml', 'requirements.txt', 'go.mod', 'web/package.json') AND contains(content, 'axum')) AS axum FROM f GROUP BY repo), m(language, k) AS (VALUES ('typescript', 0), ('javascript', 1), ('rust', 2), ('python', 3), ('unknown', 4))
    SELECT repo, CASE WHEN language = 'typescript' AND nextjs THEN 'nextjs' WHEN language = 'javascript' AND express THEN 'express' WHEN language = 'javascript' AND nextjs THEN 'nextjs' WHEN language = 'rust' AND axum THEN 'axum' ELSE 'none' END AS framework FROM g JOIN m ON repo % 5 = k""")
def j9(spark, sf):
    rows = layout(spark, sf)
    language = F.get(F.array(*map(F.lit, ("typescript", "javascript", "rust", "python", "unknown"))), (F.col("repo") % 5).cast("int"))
    return T.framework(rows, rows.select("repo").distinct().withColumn("language", language))


# ---- tools, identity and others: variants with listed rows --------------------------------------

_TOOLS = (
    (("package.json", '{"devDependencies": {"eslint": null, "prettier": "1"}, "scripts": {"test": "x"}}'), ("tsconfig.json", '{"compilerOptions": {"strict": true}}'), (".husky/pre-commit", "x")),
    (("pyproject.toml", "[tool.ruff]\n[tool.mypy]\n[tool.pytest.ini_options]"), ("Cargo.toml", ""), (".githooks/pre-push", "x"), (".githooks/commit-msg", "x")),
    (("Cargo.toml", ""), ("rustfmt.toml", ""), ("x/.eslintrc", "")),
    (("go.mod", ""), (".golangci.yaml", ""), ("vitest.config.mts", ""), (".pre-commit-config.yaml", "")),
    (("a.txt", ""),),
)
_FOUND = (
    (("linter", "eslint", "package.json", True), ("formatter", "prettier", "package.json", True), ("type_checker", "tsc", "tsconfig.json (strict)", True), ("test_framework", "jest", "package.json", True)),
    (("linter", "ruff", "pyproject.toml", True), ("formatter", "ruff-format", "pyproject.toml", True), ("type_checker", "mypy", "pyproject.toml", True), ("test_framework", "pytest", "pyproject.toml", True)),
    (("linter", "clippy", "Cargo.toml", True), ("formatter", "rustfmt", "rustfmt.toml", True), ("type_checker", "cargo-check", "built-in", True), ("test_framework", "cargo-test", "built-in", True)),
    (("linter", "golangci-lint", ".golangci.yaml", True), ("formatter", "gofmt", "built-in", True), ("type_checker", "go-vet", "built-in", True), ("test_framework", "vitest", "vitest.config.mts", True)),
    (("linter", None, None, False), ("formatter", None, None, False), ("type_checker", None, None, False), ("test_framework", None, None, False)),
)


@query("c9_quality_tools", expected(_FOUND, "category, tool, config_file, configured"))
def c9(spark, sf):
    return T.quality_tools(collections(spark, sf, _TOOLS))


@query("c9_hooks", expected(((("husky", ".husky", True, False, False),), (("githooks", ".githooks", False, True, True),), ((None, None, False, False, False),), (("pre-commit", ".pre-commit-config.yaml", False, False, False),), ((None, None, False, False, False),)), "system, directory, pre_commit, pre_push, commit_msg"))
def c9_hooks(spark, sf):
    return T.hook_system(collections(spark, sf, _TOOLS))


@query("a17_missing_tools", expected(((("",),), (("",),), (("",),), (("",),), (("linter,formatter,type-checker,test-framework",),)), "missing"))
def a17(spark, sf):
    return T.missing_tools(T.quality_tools(collections(spark, sf, _TOOLS))).select("repo", F.array_join("missing", ",").alias("missing"))


_IDENTITIES = (
    (("package.json", '{"name": "My App_{i}", "version": "2.1.{i}", "description": "It does {i}", "homepage": "https://h/{i}"}'), ("VERSION", "  \n"), ("Cargo.toml", 'name = "no"')),
    (("Cargo.toml", '[package]\nname = "cli-{i}"\nversion = "3.0.0"\n'), ("VERSION", " 9.{i} \n"), (".env", 'A=1\nPRODUCTION_URL="https://p/{i}"\n'), (".python-version", "3.12\n")),
    (("pyproject.toml", "[project]\nnamespace = ''\nname = 'api'\nrequires-python = \">=3.{i}\"\n"), ("README.md", "# T\n\n![x](y)\n[l](m)\n---\nServes {i} things.  \nmore"), (".git/config", "[user]\n\temail = a{i}@b.c\n[remote]\n\turl = https://x/y\n\turl = git@github.com:o/r{i}.git\n")),
    (("README.md", "# Only"),),
)


@query("c12_identity", expected(((("My App_{i}", "my-app-{i}", "2.1.{i}"),), (("cli-{i}", "cli-{i}", "9.{i}"),), (("api", "api", "0.0.0"),), (("{i}", "{i}", "0.0.0"),)), "name, short_name, version"))
def c12(spark, sf):
    return A.identity(collections(spark, sf, _IDENTITIES)).select("repo", "name", "short_name", "version")


@query("x11_readme_description", expected(((("It does {i}",),), (("",),), (("Serves {i} things.",),), (("",),)), "description"))
def x11(spark, sf):
    return A.identity(collections(spark, sf, _IDENTITIES)).select("repo", "description")


@query("x10_python_version", expected(((("",),), (("3.12",),), ((">=3.{i}",),), (("",),)), "python_version"))
def x10(spark, sf):
    return A.python_version(collections(spark, sf, _IDENTITIES))


@query("s15_git_config", expected(((("", ""),), (("", ""),), (("a{i}@b.c", "https://github.com/o/r{i}"),), (("", ""),)), "owner_email, github_url"))
def s15(spark, sf):
    return A.git_facts(collections(spark, sf, _IDENTITIES))


@query("x14_production_url", expected(((("https://h/{i}",),), (("https://p/{i}",),), (("",),), (("",),)), "production_url"))
def x14_url(spark, sf):
    return A.production_url(collections(spark, sf, _IDENTITIES))


_COMPANIONS = (
    ((".comp/config.json", "{}"), ("tools/learnings/a.jsonl", "{}\n\n{}\n{}"), ("tools/learnings/sub/b.jsonl", "{}")),
    ((".comp.json", "{}"), (".claude/skills/Retro-{i}/SKILL.md", ""), (".claude/rules/x.md", ""), ("vault/x", "")),
    (("x", ""),),
)


@query("c13_companion_state", expected((((False, True, True, True, 3, False, False),), ((True, True, False, False, 0, True, True),), ((False, False, False, False, 0, False, False),)), "vault_exists, config_exists, initialized, has_learnings, project_learnings, has_rules, has_retro_skill").replace("e.project_learnings", "e.project_learnings::BIGINT AS project_learnings"))
def c13(spark, sf):
    return A.companion_state(collections(spark, sf, _COMPANIONS), ".comp/").drop("global_learnings", "skill_count")


# ---- workflows and variables --------------------------------------------------------------------

_FLOWS = (
    ((".github/workflows/ci.yml", "name: CI {i}\non:\n  push:\n    branches: [main]\n\n  pull_request:\njobs:\n  lint:\n    runs-on: x\n  test-{i}:\n    steps: []\nenv:\n  A: ${{ secrets.TOKEN_B }} ${{ secrets.AKEY }} ${{ secrets.AKEY }}\n"), (".github/workflows/sub/no.yml", "name: no")),
    ((".github/workflows/cd.yaml", "on: [push, 'workflow_dispatch']\njobs:\n  deploy:\n    uses: x\n# codeql\n"),),
    ((".github/workflows/n.yml", 'name: "Nightly"\non:\n  schedule:\n    - cron: x\njobs:\n  build:\n    a: b\n    c:\n      d: e\n'), ("x.yml", "test")),
)
_FLOW_ROWS = ((("ci.yml", "CI {i}", "push,branches,pull_request", "lint,test-{i}", "AKEY,TOKEN_B", "lint + test"),), (("cd.yaml", "cd.yaml", "push,workflow_dispatch", "deploy", "", "deploy + security"),), (("n.yml", "Nightly", "schedule", "build", "", "build"),))


def flows(spark, sf) -> DataFrame:
    rows = L.workflows(collections(spark, sf, _FLOWS))
    return rows.select("repo", "file", "name", *(F.array_join(c, ",").alias(c) for c in ("triggers", "jobs", "secrets")), "purpose")


_FLOW_SQL = expected(_FLOW_ROWS, "file, name, triggers, jobs, secrets, purpose")


@query("s13_read_workflows", _FLOW_SQL)
def s13(spark, sf):
    return flows(spark, sf)


for _id, _column in (("x1_yaml_name", "name"), ("x2_yaml_triggers", "triggers"), ("x3_yaml_jobs", "jobs"), ("x4_secret_refs", "secrets"), ("x5_workflow_purpose", "purpose")):
    query(_id, f"SELECT repo, {_column} FROM ({_FLOW_SQL})")(lambda spark, sf, c=_column: flows(spark, sf).select("repo", c))

_COVERED = ((("lint,test", "build,typecheck,security"),), (("", "lint,test,build,typecheck,security"),), (("build", "lint,test,typecheck,security"),))


@query("x6_ci_coverage", f"SELECT repo, coverage FROM ({expected(_COVERED, 'coverage, gaps')})")
def x6(spark, sf):
    return L.ci_coverage(collections(spark, sf, _FLOWS)).select("repo", F.array_join("coverage", ",").alias("coverage"))


@query("u1_ci_gaps", f"SELECT repo, gaps FROM ({expected(_COVERED, 'coverage, gaps')})")
def u1_gaps(spark, sf):
    return L.ci_coverage(collections(spark, sf, _FLOWS)).select("repo", F.array_join("gaps", ",").alias("gaps"))


_ENVS = (
    ((".env.example", "# c\nAPI_KEY=abc{i}\nPORT={i}\nNEXT_PUBLIC_X=1\nlower=1\n"), (".env.sample", "OTHER=1"), ("Dockerfile", "FROM x\nENV PORT=1\nARG AWS_REGION\n"), ("docker-compose.yml", "services:\n  a:\n    image: ${DB_URL}\n    x: ${PORT}\n")),
    ((".env.template", "HOST=h\nHOST=again\n"), ("Dockerfile", "ENV SALT x\n")),
)
_VARIABLES = (
    (("API_KEY", ".env.example", True, "abc{i}"), ("PORT", ".env.example", False, "{i}"), ("NEXT_PUBLIC_X", ".env.example", False, "1"), ("AWS_REGION", "Dockerfile", True, None), ("DB_URL", "docker-compose.yml", True, None)),
    (("HOST", ".env.template", False, "h"), ("SALT", "Dockerfile", False, None)),
)


@query("w1_env_variables", expected(_VARIABLES, 'name, source, is_sensitive, "default"'))
def w1_env(spark, sf):
    return L.env_variables(collections(spark, sf, _ENVS))


@query("p14_public_env", "SELECT p_partkey AS repo, p_partkey % 2 = 0 AS has_public_env FROM part")
def p14(spark, sf):
    return L.env_variables(collections(spark, sf, _ENVS)).groupBy("repo").agg(F.bool_or(P.public_name(F.col("name"))).alias("has_public_env"))


_SENSITIVE = (("AWS_REGION", True), ("db_url", True), ("Passphrase", False), ("SALT", False), ("MY_TOKEN", True), ("CERT", False), ("GCP_X", True), ("REDIS_URL", True), ("AUTHOR", True), ("HOST", False), ("DSN", False), ("Mongo_Url_2", True), ("CONNECTION_STRING", True), ("AZURE_ID", True), ("webhook", False))


@query("p13_sensitive_names", f"SELECT p_partkey, {_LIST([n for n, _ in _SENSITIVE])}[p_partkey % {len(_SENSITIVE)} + 1] AS name, {_LIST([x for _, x in _SENSITIVE])}[p_partkey % {len(_SENSITIVE)} + 1] AS is_sensitive FROM part")
def p13(spark, sf):
    name = F.get(F.array(*(F.lit(n) for n, _ in _SENSITIVE)), (F.col("p_partkey") % len(_SENSITIVE)).cast("int"))
    return read(spark, sf, "part").select("p_partkey", name.alias("name"), P.sensitive_name(name).alias("is_sensitive"))


# ---- checks -------------------------------------------------------------------------------------

_OWN_DIR = S.OWN
_CHECKED = (
    (("GUIDE.md", "## Commands\n```\nmake lint\nmake test\n```\n"), ("AGENTS.md", "a\nb"), (_OWN_DIR + "manifest.json", '{"commands": {"lint": "make lint", "test": "make test"}}'), (".githooks/pre-commit", "make lint"), (".githooks/pre-push", "make test"), (".gitignore", "x\n .env \n"), (_OWN_DIR + "index.json", "{}")),
    (("GUIDE.md", "# T\nTOKEN = abcdefgh{i}\n"), (_OWN_DIR + "manifest.json", "{bad"), (".githooks/pre-push", "x"), (".gitignore", "x\n"), (".env", "A=1")),
    (("README.md", "x"),),
    (("GUIDE.md", "lint outside\n## Commands\n```\nnpm run Lint {i}\nnpm test\n```\nlint"), (_OWN_DIR + "manifest.json", '{"commands": {"lint": "ruff", "test": "NOT_CONFIGURED"}}'), (".githooks/pre-commit", "other"), ("AGENTS.md", "")),
)
_CHECKS = (
    (("GUIDE.md", "PASS", "exists, 5 lines"), ("AGENTS.md", "PASS", "exists, 2 lines"), ("guide structure", "PASS", "has ## Commands section"), ("manifest.json", "PASS", "valid JSON"), (".githooks/", "PASS", "pre-commit + pre-push present"), ("commands", "PASS", "lint + test configured"), ("consistency", "PASS", "commands agree"),
     ("security-gitignore", "PASS", ".gitignore includes .env"), ("security-secrets", "PASS", "no secret patterns in generated files"), ("security-env-tracked", "PASS", ".env not tracked"), ("freshness-index", "PASS", "index present"), ("quality-gate", "PASS", "lint: make lint, test: make test")),
    (("GUIDE.md", "PASS", "exists, 2 lines"), ("AGENTS.md", "FAIL", "missing"), ("guide structure", "WARN", "missing ## Commands section"), ("manifest.json", "FAIL", "invalid JSON"), (".githooks/", "WARN", "pre-commit missing"), ("commands", "WARN", "manifest not found or invalid"), ("consistency", "PASS", "commands agree"),
     ("security-gitignore", "WARN", ".gitignore has no .env entry"), ("security-secrets", "FAIL", "potential secrets in: GUIDE.md"), ("security-env-tracked", "FAIL", ".env is tracked"), ("freshness-index", "WARN", "no index"), ("quality-gate", "WARN", "manifest not available")),
    (("GUIDE.md", "FAIL", "missing"), ("AGENTS.md", "FAIL", "missing"), ("guide structure", "FAIL", "file not found"), ("manifest.json", "WARN", "not found"), (".githooks/", "WARN", "directory missing"), ("commands", "WARN", "manifest not found or invalid"), ("consistency", "PASS", "commands agree"),
     ("security-gitignore", "WARN", ".gitignore missing"), ("security-secrets", "PASS", "no secret patterns in generated files"), ("security-env-tracked", "PASS", ".env not tracked"), ("freshness-index", "WARN", "no index"), ("quality-gate", "WARN", "manifest not available")),
    (("GUIDE.md", "PASS", "exists, 7 lines"), ("AGENTS.md", "PASS", "exists, 0 lines"), ("guide structure", "PASS", "has ## Commands section"), ("manifest.json", "PASS", "valid JSON"), (".githooks/", "WARN", "pre-push missing"), ("commands", "WARN", "test not configured"), ("consistency-lint", "WARN", "not in the hook: npm run Lint {i}"), ("consistency-manifest-lint", "WARN", "not in the guide: ruff"),
     ("security-gitignore", "WARN", ".gitignore missing"), ("security-secrets", "PASS", "no secret patterns in generated files"), ("security-env-tracked", "PASS", ".env not tracked"), ("freshness-index", "WARN", "no index"), ("quality-gate-test", "WARN", "test command not configured")),
)
_CHECK_SQL = expected(_CHECKS, "name, status, detail")


def checked(spark, sf) -> DataFrame:
    return V.checks(collections(spark, sf, _CHECKED))


query("u3_union_checks", _CHECK_SQL)(checked)
query("a10_check_summary_rows", f"SELECT status, count(*) AS n, max(length(name))::BIGINT AS width FROM ({_CHECK_SQL}) GROUP BY 1")(lambda spark, sf: V.summary(checked(spark, sf)))
query("m5_verify_status", f"SELECT repo, bool_or(status = 'FAIL')::INT AS status FROM ({_CHECK_SQL}) GROUP BY repo")(lambda spark, sf: checked(spark, sf).groupBy("repo").agg(F.bool_or(F.col("status") == "FAIL").cast("int").alias("status")))
for _id, _names in (("v1_expected_files", ("GUIDE.md", "AGENTS.md")), ("v2_guide_structure", ("guide structure",)), ("v3_json_valid", ("manifest.json",)), ("v5_configured", ("commands",)), ("v6_consistency", ("consistency", "consistency-lint", "consistency-test", "consistency-manifest-lint", "consistency-manifest-test")), ("v7_security", ("security-gitignore", "security-secrets", "security-env-tracked")), ("v8_index_present", ("freshness-index",))):
    query(_id, f"SELECT * FROM ({_CHECK_SQL}) WHERE name IN ({', '.join(map(quoted, _names))})")(lambda spark, sf, ns=_names: checked(spark, sf).where(F.col("name").isin(*ns)))


query("j11_doc_consistency", f"SELECT repo, name, detail FROM ({_CHECK_SQL}) WHERE starts_with(name, 'consistency-')")(lambda spark, sf: checked(spark, sf).where("startswith(name, 'consistency-')").select("repo", "name", "detail"))


@query("v8_freshness", f"WITH {VIEW.replace('f AS', 'g AS')}, f AS (SELECT repo, CASE path WHEN 'index.json' THEN '{_OWN_DIR}manifest.json' ELSE path END AS path, mtime FROM g), t AS (SELECT repo, max(mtime) FILTER (WHERE path = '{_OWN_DIR}manifest.json') AS made, max(mtime) FILTER (WHERE path IN ('GUIDE.md', 'Makefile', 'src/a.py', 'lib/package.json')) AS latest FROM f GROUP BY repo) SELECT repo, CASE WHEN made IS NULL OR coalesce(latest > made, false) THEN 'WARN' ELSE 'PASS' END AS status FROM t")
def v8(spark, sf):
    rows = profiles(spark, sf).withColumn("path", F.when(F.col("path") == "index.json", V.MANIFEST).otherwise(F.col("path")))
    return V.checks(rows).where("name = 'freshness-manifest'").select("repo", "status")


@query("p18_newer_than", f"WITH {VIEW}, t AS (SELECT repo, max(mtime) FILTER (WHERE path = 'index.json') AS made, max(mtime) FILTER (WHERE path <> 'index.json' AND NOT contains(path, '.git/')) AS latest FROM f GROUP BY repo) SELECT repo, coalesce(latest > made, latest IS NOT NULL) AS newer FROM t")
def p18(spark, sf):
    return C.source_newer(profiles(spark, sf), "index.json", S.OWN)


@query("p20_maintained", "SELECT c_custkey, coalesce(max(o_orderdate) > TIMESTAMP '1998-06-01' - INTERVAL 90 DAYS, true) AS maintained FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def p20(spark, sf):
    last = read(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return read(spark, sf, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", C.maintained(F.col("last"), F.lit("1998-06-01").cast("timestamp_ntz")).alias("maintained"))


@query("x8_md_command", expected(((("make lint",),), ((None,),), ((None,),), (("npm run Lint {i}",),)), "command"))
def x8(spark, sf):
    from ..functions.text import fenced_command

    guides = collections(spark, sf, _CHECKED).groupBy("repo").agg(C.text_of("GUIDE.md").alias("guide"))
    return guides.select("repo", fenced_command(F.col("guide"), "lint").alias("command"))


_GUIDES = (
    (("GUIDE.md", "# T\n## Commands\nmake\n## Notes {i}\nkeep\n## Vault\nx\n## Other\ny"),),
    (("GUIDE.md", "## Gotchas\nz"),),
)


@query("x12_user_sections", "SELECT p_partkey::VARCHAR AS path, '## Notes ' || p_partkey || chr(10) || 'keep' || chr(10) || '## Other' || chr(10) || 'y' AS sections FROM part WHERE p_partkey % 2 = 0")
def x12(spark, sf):
    guides = collections(spark, sf, _GUIDES).select(F.col("repo").cast("string").alias("path"), F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return L.own_sections(guides, sinks.STANDARD)


query("f29_standard_sections", "SELECT p_partkey::VARCHAR AS path, 2 AS n FROM part WHERE p_partkey % 2 = 0")(lambda spark, sf: x12(spark, sf).select("path", F.regexp_count("sections", F.lit("(?m)^## ")).alias("n")))

# ---- scans --------------------------------------------------------------------------------------

_PREFIXES = ("", ".git/", "node_modules/", "vendor/", "__pycache__/", "target/", "dist/", "a/target/", "a/dist/")
_SCANNED = f"{FILES}, scanned AS (SELECT {_LIST(_PREFIXES)}[doc_id % 9 + 1] || path AS path, CASE WHEN doc_id % 10 = 0 THEN repeat(content, 300) WHEN doc_id % 10 = 1 THEN content || chr(0) ELSE content END AS content FROM files)"


def scanned(spark, sf) -> DataFrame:
    prefix = F.get(F.array(*map(F.lit, _PREFIXES)), (F.col("doc_id") % 9).cast("int"))
    content = F.when(F.col("doc_id") % 10 == 0, F.repeat("content", F.lit(300))).when(F.col("doc_id") % 10 == 1, F.concat("content", F.lit("\0"))).otherwise(F.col("content"))
    return files(spark, sf).select(F.concat(prefix, "path").alias("path"), content.alias("content")).withColumn("size_bytes", F.octet_length("content").cast("long"))


@query("s1_scan_repo", f"WITH {_SCANNED} SELECT path, octet_length(encode(content))::BIGINT AS size_bytes FROM scanned WHERE octet_length(encode(content)) <= 524288 AND NOT contains(content, chr(0)) AND NOT contains(path, '/target/') AND NOT regexp_matches(path, '^(\\.git|node_modules|vendor|__pycache__|target|dist)/')")
def s1(spark, sf):
    rows = R.selected(scanned(spark, sf).withColumn("content", F.encode("content", "UTF-8")))
    return rows.where(R.readable(F.col("content"))).select("path", "size_bytes")


@query("s3_collect_files", f"WITH {_SCANNED} SELECT path FROM scanned WHERE NOT starts_with(path, '.git/')")
def s3(spark, sf):
    return R.listed(scanned(spark, sf)).select("path")


# ---- documents ----------------------------------------------------------------------------------

_RENDERED = (
    (("README.md", "# T\nDoes {i}.\n"), ("Cargo.toml", '[package]\nname = "app-{i}"\nversion = "1.0.{i}"\n'), ("src/main.rs", "fn main() {}"), ("tests/a.rs", "")),
    (("package.json", '{"name": "web-{i}", "scripts": {"lint": "x", "test": "y"}, "dependencies": {"express": "1"}}'), ("yarn.lock", ""), ("index.js", ""), (".github/workflows/ci.yml", "on: push\njobs:\n  test:\n    a: b\n")),
)


def manifest(spark, sf) -> DataFrame:
    """Manifests of the collections, made when they are read."""
    return M.manifest(collections(spark, sf, _RENDERED))


def manifests(spark, sf) -> DataFrame:
    """Manifests of the collections: built once a session, as a table."""
    from ..sources.shared import written

    key = (spark.sparkContext.applicationId, sf)
    if key not in _MADE:
        _MADE[key] = written(manifest(spark, sf))
    return _MADE[key]


_MADE: dict[tuple[str, str], DataFrame] = {}


@query("m12_manifest", expected(((("app-{i}", "rust", "none", "cargo", "cargo clippy", "minimal", "src"),), (("web-{i}", "javascript", "express", "yarn", "yarn lint", "api-service", ""),)), "name, language, framework, manager, lint, archetype, sources"))
def m12_manifest(spark, sf):
    return manifests(spark, sf).select("repo", F.col("identity.name").alias("name"), F.col("stack.language").alias("language"), F.col("stack.framework").alias("framework"), F.col("stack.package_manager").alias("manager"), F.col("commands.lint").alias("lint"), F.col("archetype.archetype").alias("archetype"), F.coalesce(F.array_join("structure.source_dirs", ","), F.lit("")).alias("sources"))


def _document(path: str):
    return lambda spark, sf: render.documents(manifests(spark, sf), "enterprise").where(F.col("path").rlike(path)).select("repo", "path", "content")


_GUIDE_RUST = "# GUIDE.md — app-{i}\n\n> Does {i}.\n\n## Commands\n\n```bash\ncargo build  # install\ncargo run  # dev\ncargo build --release  # build\ncargo clippy  # lint\ncargo test  # test\ncargo fmt  # format\n```\n\n## Architecture\n\n- **Stack**: rust\n- **Archetype**: minimal\n\n## Key Locations\n\n- **Source**: `src/`\n- **Tests**: `tests/`\n\n**Entry points**: `src/main.rs`\n\n## Invariants\n\n- **INV-1**: LLM trust boundary — validate all AI output\n\n## Quality Tools\n\n- **Linter**: clippy (`Cargo.toml`)\n- **Formatter**: rustfmt (`built-in`)\n- **Type checker**: cargo-check (`built-in`)\n- **Test framework**: cargo-test (`built-in`)\n\n## Gotchas\n\n- cargo clippy without warnings"
_GUIDE_WEB = "# GUIDE.md — web-{i}\n\n## Commands\n\n```bash\nyarn install  # install\nyarn lint  # lint\nyarn test  # test\n```\n\n## Architecture\n\n- **Stack**: javascript/express\n- **Archetype**: api-service\n\n**Entry points**: `index.js`\n\n## Invariants\n\n- **INV-1**: LLM trust boundary — validate all AI output\n\n## Quality Tools\n\n- **Linter**: eslint (`package.json`)\n- **Test framework**: jest (`package.json`)\n\n## CI\n\n- **Provider**: github-actions\n- **Covered**: test\n- **Gaps**: lint, build, typecheck, security\n\n## Gotchas\n\n- Modules over scripts"
_HOOK = "#!/usr/bin/env bash\nset -euo pipefail\n"
_DOCUMENTS = {
    "r1_main_guide": ("^GUIDE.md$", ((("GUIDE.md", _GUIDE_RUST),), (("GUIDE.md", _GUIDE_WEB),))),
    "r2_agents_guide": ("^AGENTS.md$", ((("AGENTS.md", "# AGENTS.md — app-{i}\n\nDoes {i}.\n\n## Stack\n\n- **Language**: rust\n- **Archetype**: minimal\n\n## Commands\n\n- **install**: `cargo build`\n- **build**: `cargo build --release`\n- **lint**: `cargo clippy`\n- **test**: `cargo test`\n\n## Structure\n\n- Source: src\n- Tests: tests\n- Entry points: src/main.rs\n\n## Conventions\n\n- cargo clippy without warnings\n- cargo fmt\n- Unit tests in the module, others in tests/"),),
                                           (("AGENTS.md", "# AGENTS.md — web-{i}\n\n## Stack\n\n- **Language**: javascript\n- **Framework**: express\n- **Archetype**: api-service\n\n## Commands\n\n- **install**: `yarn install`\n- **lint**: `yarn lint`\n- **test**: `yarn test`\n\n## Structure\n\n- Source: \n- Tests: \n- Entry points: index.js\n\n## Conventions\n\n- Modules over scripts\n- camelCase names\n- Tests beside the code, named *.test.js"),))),
    "r3_editor_rules": ("^.cursorrules$", (((".cursorrules", "# Rules for app-{i}\n\nStack: rust\nStyle: cargo fmt\nTests: Unit tests in the module, others in tests/\nFolders: src, tests\nConfiguration: "),), ((".cursorrules", "# Rules for web-{i}\n\nStack: javascript/express\nStyle: camelCase names\nTests: Tests beside the code, named *.test.js\nFolders: \nConfiguration: .github/workflows/ci.yml"),))),
    "r4_git_hooks": ("^.githooks/", (((".githooks/pre-commit", _HOOK + 'echo "pre-commit: lint"\ncargo clippy\n'), (".githooks/pre-push", _HOOK + 'echo "pre-push: lint"\ncargo clippy\necho "pre-push: test"\ncargo test\n')), ((".githooks/pre-commit", _HOOK + 'echo "pre-commit: lint"\nyarn lint\n'), (".githooks/pre-push", _HOOK + 'echo "pre-push: lint"\nyarn lint\necho "pre-push: test"\nyarn test\n')))),
    "r5_settings": ("^.claude/settings", (((".claude/settings.json", '{"deny": ["rm -rf /", "git push --force"], "format": {"after":"write","run":"rustfmt"}}'),), ((".claude/settings.json", '{"deny": ["rm -rf /", "git push --force"], "format": null}'),))),
    "r6_ci_workflow": ("^.github/", (((".github/workflows/ci.yml", "name: CI\non:\n  push:\n    branches: [main]\n  pull_request:\njobs:\n  ci:\n    runs-on: ubuntu-latest\n    steps:\n      - uses: actions/checkout@v4\n      - name: install\n        run: cargo build\n      - name: lint\n        run: cargo clippy\n      - name: test\n        run: cargo test\n      - name: build\n        run: cargo build --release"),), ())),
    "r7_skills": ("skills/.*-ship", (((".claude/skills/app-{i}-ship/SKILL.md", "---\nname: app-{i}-ship\ndescription: Ship for app-{i}\n---\n\n## Step 1\n\nRun the checks below.\n\n## Step 2\n\nWrite the change log.\n\n```bash\ncargo clippy\ncargo test\n```"),), ((".claude/skills/web-{i}-ship/SKILL.md", "---\nname: web-{i}-ship\ndescription: Ship for web-{i}\n---\n\n## Step 1\n\nRun the checks below.\n\n## Step 2\n\nWrite the change log.\n\n```bash\nyarn lint\nyarn test\n```"),))),
    "r8_workflow_rules": ("rules/workflow", (((".claude/rules/workflow.md", "# Workflow\n\n1. Read GUIDE.md\n2. Before a commit: `cargo clippy`\n3. Before a push: `cargo test`\n4. Leave no placeholder behind"),), ((".claude/rules/workflow.md", "# Workflow\n\n1. Read GUIDE.md\n2. Before a commit: `yarn lint`\n3. Before a push: `yarn test`\n4. Leave no placeholder behind"),))),
    "r10_vault": ("^vault/", ((("vault/index.md", "# app-{i}\n\n- [Architecture](wiki/concepts/architecture.md)"),), (("vault/index.md", "# web-{i}\n\n- [Architecture](wiki/concepts/architecture.md)"),))),
    "r13_tracking": ("learnings|companion", ((("tools/learnings/app-{i}-learnings.jsonl", '{"type":"init","project":"app-{i}"}'), (".companion/config.json", '{"name":"app-{i}","lint":"cargo clippy","test":"cargo test","build":"cargo build --release"}')), (("tools/learnings/web-{i}-learnings.jsonl", '{"type":"init","project":"web-{i}"}'), (".companion/config.json", '{"name":"web-{i}","lint":"yarn lint","test":"yarn test"}')))),
}
for _id, (_pattern, _rows) in _DOCUMENTS.items():
    query(_id, expected(_rows, "path, content"))(_document(_pattern))


_REPORTS = (
    ("app-{i} 1.0.{i}", "Stack: rust", "Archetype: minimal, greenfield, simple", "Files: 4", "Tests: 1", "Tools: clippy, rustfmt, cargo-check, cargo-test", "CI: none, gaps: lint, test, build, typecheck, security"),
    ("web-{i} 0.0.0", "Stack: javascript/express", "Archetype: api-service, greenfield, moderate", "Files: 4", "Tests: 0", "Tools: eslint, jest", "CI: github-actions, gaps: lint, build, typecheck, security"),
)


@query("r14_report", "SELECT repo, '+' || repeat('-', 62) || '+' || chr(10) || string_agg('| ' || rpad(line, greatest(60, length(line))::INT, ' ') || ' |', chr(10) ORDER BY place) || chr(10) || '+' || repeat('-', 62) || '+' AS report FROM (" + expected([[(n, r) for n, r in enumerate(rows)] for rows in _REPORTS], "place, line") + ") GROUP BY repo")
def r14(spark, sf):
    return manifests(spark, sf).select("repo", render.report().alias("report"))


@query("m19_boxes", "SELECT p_partkey, '+--------+' || chr(10) || '| ' || rpad(p_brand, greatest(6, length(p_brand))::INT, ' ') || ' |' || chr(10) || '| x      |' || chr(10) || '+--------+' AS box FROM part")
def m19(spark, sf):
    return read(spark, sf, "part").select("p_partkey", render.boxed(F.array("p_brand", F.lit("x")), 6).alias("box"))


@query("m18_prose", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'gofmt' WHEN 1 THEN 'rubocop' ELSE 'Follow the code around' END AS style FROM part")
def m18(spark, sf):
    language = F.get(F.array(F.lit("go"), F.lit("ruby"), F.lit("cobol")), (F.col("p_partkey") % 3).cast("int"))
    rows = read(spark, sf, "part").select("p_partkey", F.struct(language.alias("language")).alias("stack"))
    return rows.select("p_partkey", render.prose(1).alias("style"))


@query("r15_session_health", f"WITH {VIEW}, g AS (SELECT repo, max(mtime) FILTER (WHERE path = 'GUIDE.md') AS guide, bool_or(path = 'index.json') AS m FROM f GROUP BY repo) SELECT repo, concat_ws('; ', CASE WHEN guide IS NULL THEN 'no guide: run the pipeline' END, CASE WHEN m AND DATE '1998-09-01' - guide::DATE > 14 THEN 'guide is ' || (DATE '1998-09-01' - guide::DATE) || ' days old: refresh' END, CASE WHEN m THEN 'no index: run the index' END) AS messages FROM g")
def r15(spark, sf):
    rows = profiles(spark, sf).withColumn("path", F.when(F.col("path") == "index.json", V.MANIFEST).otherwise(F.col("path")))
    return render.session_health(rows, F.lit("1998-09-01").cast("timestamp_ntz")).select("repo", F.array_join("messages", "; ").alias("messages"))


_GATED = {"lean": 6, "standard": 11, "full": 13, "enterprise": 13}


@query("r0_tier_gate", " UNION ALL ".join(f"SELECT p_partkey AS repo, '{t}' AS tier, {n} - CASE WHEN p_partkey % 2 = 1 AND {n} > 6 THEN 1 ELSE 0 END AS n FROM part" for t, n in _GATED.items()))
def r0(spark, sf):
    tiers = manifests(spark, sf).withColumn("tier", F.explode(F.array(*map(F.lit, _GATED))))
    keyed = tiers.withColumn("repo", F.struct("repo", "tier"))
    return render.documents(keyed, F.col("tier")).groupBy("repo").agg(F.count("*").cast("int").alias("n")).select("repo.repo", "repo.tier", "n")


@query("q9_resource_commands", expected(((("build: cargo build --release\ndev: cargo run\nformat: cargo fmt\ninstall: cargo build\nlint: cargo clippy\ntest: cargo test",),), (("install: yarn install\nlint: yarn lint\ntest: yarn test",),)), "text"))
def q9(spark, sf):
    return server.commands_text(manifests(spark, sf))


@query("q9_resource_architecture", expected(((("Stack: rust/none\nArchetype: minimal",),), (("Stack: javascript/express\nArchetype: api-service",),)), "text"))
def q9_architecture(spark, sf):
    return server.architecture_text(manifests(spark, sf))
