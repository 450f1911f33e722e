"""Profile operators bound to ``orders``: a customer's orders stand for the files of a collection.

Path and text of a file cycle over the fixtures below by the order's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import profile as C
from ..sources import readers as L
from .bindings import FILES, files, lines, read
from .bindings_config import made, split

PATHS = (
    ".github/workflows/ci.yml", "Jenkinsfile", ".gitlab-ci.yml", "fly.toml", "Dockerfile", "k8s/app.yaml", "main.tf", "compose.yaml", "turbo.json", "nx.json", "package.json", "web/package.json",
    "api/package.json", "lib/package.json", ".nvmrc", ".node-version", "go.sum", "yarn.lock", "db/migrations/1.sql", "openapi.json", "e2e/a.ts", "perf/b.rs", "tsconfig.json", "pyproject.toml",
    ".env.sample", ".env", "Makefile", "ruff.toml", ".githooks/pre-commit", ".githooks/pre-push", "GUIDE.md", "index.json", ".git/config", "Cargo.toml", "src/a.py", "docs/b.md", "requirements.txt",
)
TEXTS = (
    "", "on: push\nbranches: main\ndeploy to ghcr.io", "tags: v1 quay.io", "workflow_dispatch", '{"strict": true, "scripts": {"dev": "x --port 4000", "lint": "y"}, "drizzle": 1}', "18.2\n", "lint:\n\tx\ncheck:\n\ty\n",
    '{"_meta": {"total_files": 12}, "scripts": {"test": "t", "type-check": "u"}}', "EXPOSE 8080\nPROD_PORT=443\nPORT=81", "[tool.mypy]\nsqlalchemy", "build:\n\tx\n",
)
_LIST = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
#: The same view for DuckDB. Of files with one path, as no real collection has them, the smallest text counts.
VIEW = f"f AS (SELECT o_custkey AS repo, {_LIST(PATHS)}[o_orderkey % {len(PATHS)} + 1] AS path, {_LIST(TEXTS)}[o_orderkey // 3 % {len(TEXTS)} + 1] AS content, o_orderdate AS mtime FROM orders)"


def collections(spark, sf) -> DataFrame:
    at = lambda values, index: F.get(F.array(*map(F.lit, values)), F.expr(index).cast("int"))
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), at(PATHS, f"o_orderkey % {len(PATHS)}").alias("path"), at(TEXTS, f"o_orderkey div 3 % {len(TEXTS)}").alias("content"), F.col("o_orderdate").alias("mtime"))


def _has(*names: str) -> str:
    return "bool_or(path IN (" + ", ".join(f"'{n}'" for n in names) + "))"


def _text(name: str) -> str:
    return f"min(content) FILTER (path = '{name}')"


def _flow(*words: str) -> str:
    return "bool_or(path = '.github/workflows/ci.yml' AND (" + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + "))"


@query("c8_ci_facts", f"""WITH {VIEW} SELECT repo,
    CASE WHEN {_has('.github/workflows/ci.yml')} THEN 'github-actions' WHEN {_has('.gitlab-ci.yml')} THEN 'gitlab-ci' WHEN {_has('Jenkinsfile')} THEN 'jenkins' ELSE 'none' END AS ci_provider,
    CASE WHEN {_has('fly.toml')} THEN 'fly.io' WHEN {_has('Dockerfile')} THEN 'docker' WHEN {_has('k8s/app.yaml')} THEN 'kubernetes' WHEN {_has('main.tf')} THEN 'terraform' ELSE 'none' END AS deploy_target,
    CASE WHEN {_has('compose.yaml')} THEN 'compose.yaml' END AS compose_file,
    CASE WHEN {_flow('ghcr.io')} THEN 'ghcr.io' WHEN {_flow('quay.io')} THEN 'quay.io' END AS registry,
    CASE WHEN {_flow('tags:')} THEN 'tag' WHEN {_flow('workflow_dispatch')} THEN 'manual' WHEN {_flow('on: push')} AND {_flow('main')} AND {_flow('deploy')} THEN 'push-to-main' END AS deploy_trigger
    FROM f GROUP BY repo""")
def c8(spark, sf):
    return C.ci_facts(collections(spark, sf))


@query("c7_monorepo", f"WITH {VIEW} SELECT repo, CASE WHEN {_has('turbo.json')} THEN 'turborepo' WHEN {_has('nx.json')} THEN 'nx' ELSE 'unknown' END AS monorepo_tool, {_has('turbo.json', 'nx.json')} OR count(*) FILTER (path LIKE '%/package.json') >= 3 AS is_monorepo FROM f GROUP BY repo")
def c7(spark, sf):
    return C.monorepo(collections(spark, sf))


_VERSION = lambda name: f"nullif(trim({_text(name)}, chr(10) || ' '), '')"


@query("c16_node_facts", f"WITH {VIEW} SELECT repo, coalesce({_VERSION('.nvmrc')}, {_VERSION('.node-version')}, '') AS node_version, coalesce(min(path) FILTER (path IN ('go.sum', 'yarn.lock')), '') AS lock_file FROM f GROUP BY repo")
def c16(spark, sf):
    return C.node_facts(collections(spark, sf)).drop("scripts")


_SKILLS = {"deploy": "path = 'Dockerfile'", "migrate": "contains(path, 'migration')", "api-docs": "contains(path, 'openapi')", "plan-infra": "ends_with(path, '.tf')", "e2e": "contains(path, 'e2e')", "benchmark": "contains(path, 'perf')"}


@query("c10_skill_suggestions", f"WITH {VIEW} " + " UNION ALL ".join(f"SELECT DISTINCT repo, '{name}' AS skill FROM f WHERE {test}" for name, test in _SKILLS.items()))
def c10(spark, sf):
    return C.skills(collections(spark, sf))


_MANIFEST = "path IN ('package.json', 'pyproject.toml')"


@query("c11_core_principles", f"""WITH {VIEW} SELECT repo, concat_ws(',', CASE WHEN bool_or(path = 'tsconfig.json' AND contains(content, '"strict": true')) THEN 'strict-typescript' END,
    CASE WHEN bool_or({_MANIFEST} AND contains(content, 'drizzle')) THEN 'drizzle-orm' WHEN bool_or({_MANIFEST} AND contains(content, 'sqlalchemy')) THEN 'sqlalchemy-orm' END,
    CASE WHEN {_has('.env.sample')} THEN 'env-based-config' END) AS principles FROM f GROUP BY repo""")
def c11(spark, sf):
    return C.principles(collections(spark, sf)).withColumn("principles", F.array_join("principles", ","))


def command_table(spark, sf) -> DataFrame:
    manager = F.when(C.any_of(C.path() == "yarn.lock"), "yarn").otherwise("npm")
    language = C.first_rule((("Cargo.toml", "rust"), ("src/a.py", "python")), C.marked, "other")
    return C.commands(collections(spark, sf), language, manager)


_COMMANDS = f"""{VIEW}, g AS (SELECT repo, {_text('Makefile')} AS mk, CASE WHEN json_valid({_text('package.json')}) THEN json_extract({_text('package.json')}, '$.scripts') END AS s, {_has('yarn.lock')} AS yarn,
    CASE WHEN {_has('Cargo.toml')} THEN 'rust' WHEN {_has('src/a.py')} THEN 'python' END AS lang, {_has('ruff.toml')} AS ruff, {_has('pyproject.toml')} AS pyp, bool_or(path = 'pyproject.toml' AND contains(content, 'mypy')) AS mypy FROM f GROUP BY repo),
    h AS (SELECT *, coalesce(contains(mk, 'lint:'), false) AS m, s IS NOT NULL AS j, CASE WHEN yarn THEN 'yarn' ELSE 'npm run' END AS run, coalesce(lang, '') AS l FROM g),
    c AS (SELECT repo,
    CASE WHEN m THEN NULL WHEN j THEN CASE WHEN yarn THEN 'yarn' ELSE 'npm' END || ' install' WHEN l = 'rust' THEN 'cargo build' WHEN l = 'python' THEN 'pip install -r requirements.txt' END AS install,
    CASE WHEN m THEN NULL WHEN j THEN CASE WHEN json_exists(s, '$.dev') THEN run || ' dev' END WHEN l = 'rust' THEN 'cargo run' END AS dev,
    CASE WHEN m OR j THEN NULL WHEN l = 'rust' THEN 'cargo build --release' END AS build,
    CASE WHEN m THEN 'make lint' WHEN j THEN CASE WHEN json_exists(s, '$.lint') THEN run || ' lint' END WHEN l = 'rust' THEN 'cargo clippy' WHEN l = 'python' AND ruff THEN 'ruff check .' END AS lint,
    CASE WHEN m THEN NULL WHEN j THEN CASE WHEN json_exists(s, '$.test') THEN run || ' test' END WHEN l = 'rust' THEN 'cargo test' WHEN l = 'python' THEN CASE WHEN pyp THEN 'pytest' ELSE 'python -m unittest discover' END END AS test,
    CASE WHEN m OR j THEN NULL WHEN l = 'rust' THEN 'cargo fmt' END AS format,
    CASE WHEN m THEN 'make check' WHEN j THEN CASE WHEN json_exists(s, '$."type-check"') THEN run || ' typecheck' END WHEN l = 'python' AND mypy THEN 'mypy .' END AS typecheck FROM h),
    k AS (SELECT repo, {', '.join(f"coalesce({x}, 'NOT_CONFIGURED') AS {x}" for x in C.COMMANDS)} FROM c)"""


@query("c6_commands", f"WITH {_COMMANDS} SELECT * FROM k")
def c6(spark, sf):
    return command_table(spark, sf)


@query("v9_quality_gate", f"WITH {_COMMANDS}, t AS (SELECT repo, lint <> 'NOT_CONFIGURED' AS a, test <> 'NOT_CONFIGURED' AS b FROM k) SELECT repo, 'quality-gate' AS name, 'PASS' AS status FROM t WHERE a AND b UNION ALL SELECT repo, 'quality-gate-lint', 'WARN' FROM t WHERE NOT a UNION ALL SELECT repo, 'quality-gate-test', 'WARN' FROM t WHERE NOT b")
def v9(spark, sf):
    return C.quality_gate(command_table(spark, sf))


@query("v4_hooks", f"""WITH {VIEW}, g AS (SELECT repo, {_has('.githooks/pre-commit')} AS c, {_has('.githooks/pre-push')} AS p FROM f GROUP BY repo)
    SELECT repo, CASE WHEN c AND p THEN 'PASS' ELSE 'WARN' END AS status, CASE WHEN c AND p THEN 'pre-commit + pre-push present' WHEN c THEN 'pre-push missing' WHEN p THEN 'pre-commit missing' ELSE 'directory missing' END AS detail FROM g""")
def v4(spark, sf):
    return C.hooks(collections(spark, sf))


@query("p19_freshness_shallow", f"WITH {VIEW}, g AS (SELECT repo, max(mtime) FILTER (path = 'index.json') AS m, max(mtime) FILTER (path IN ('GUIDE.md', 'Makefile', 'src/a.py')) AS x FROM f GROUP BY repo) SELECT repo, CASE WHEN m IS NULL OR coalesce(x > m, false) THEN 'WARN' ELSE 'PASS' END AS status FROM g")
def p19(spark, sf):
    return C.stale(collections(spark, sf), "index.json", ("GUIDE.md", "Makefile"), ("src",))


@query("m11_start_hint", f"""WITH {VIEW}, g AS (SELECT repo, {_has('GUIDE.md')} AND {_has('index.json')} AS d, {_has('.git/config')} AS v, CASE WHEN {_has('package.json')} THEN 'node' WHEN {_has('Cargo.toml')} THEN 'rust' WHEN {_has('requirements.txt', 'pyproject.toml')} THEN 'python' END AS l FROM f GROUP BY repo)
    SELECT repo, CASE WHEN d THEN 'bootstrapped' WHEN v THEN 'repository' ELSE 'none' END AS state, CASE WHEN v AND NOT d THEN l END AS language FROM g""")
def m11(spark, sf):
    return C.start_hint(collections(spark, sf), ("GUIDE.md", "index.json"))


_LEAD = lambda name, pattern: f"nullif(regexp_extract({_text(name)}, '{pattern}', 1), '')"


@query("x14_ports", f"""WITH {VIEW} SELECT repo, coalesce(nullif(regexp_extract({_text('package.json')}, '--port (\\d+)', 1), ''), {_LEAD('Dockerfile', 'EXPOSE (\\d+)')}, {_LEAD('.env', '(?m)^PORT=(\\d+)')}, '') AS dev_port,
    coalesce({_LEAD('.env', 'PROD_PORT=(\\d+)')}, {_LEAD('Dockerfile', 'EXPOSE (8080)')}, '') AS prod_port FROM f GROUP BY repo""")
def x14(spark, sf):
    return C.ports(collections(spark, sf))


@query("m13_index_state", f"""WITH {VIEW}, g AS (SELECT repo, {_text('index.json')} AS doc FROM f GROUP BY repo), v AS (SELECT repo, coalesce(json_valid(doc), false) AS ok, doc FROM g)
    SELECT repo, CASE WHEN ok THEN coalesce(json_extract_string(CASE WHEN ok THEN doc END, '$._meta.total_files')::BIGINT, 0) ELSE 0 END AS file_count, CASE WHEN ok THEN 'indexed' ELSE 'pending' END AS method FROM v""")
def m13(spark, sf):
    return C.index_state(collections(spark, sf), "index.json")


@query("m12_section_assembly", f"WITH {VIEW} SELECT repo, count(*) AS n_files, count(DISTINCT path) AS n_paths, {_has('Dockerfile')} AS docker, {_has('.github/workflows/ci.yml')} AS ci FROM f GROUP BY repo")
def m12(spark, sf):
    section = F.struct(F.count("*").alias("n_files"), F.count_distinct("path").alias("n_paths"), C.any_of(C.path() == "Dockerfile").alias("docker"), C.any_of(C.marked(".github/workflows/")).alias("ci"))
    return collections(spark, sf).groupBy("repo").agg(section.alias("section")).select("repo", "section.*")


@query("m14_workflow_text", f"WITH {VIEW} SELECT repo, string_agg(content, chr(10) ORDER BY path, content) AS content FROM f WHERE path = '.github/workflows/ci.yml' GROUP BY repo")
def m14(spark, sf):
    flows = collections(spark, sf).where(C.marked(".github/workflows/"))
    texts = F.array_sort(F.collect_list(F.struct("path", "content")))
    return flows.groupBy("repo").agg(F.array_join(F.transform(texts, lambda x: x["content"]), "\n").alias("content"))


@query("m15_existence_tests", f"WITH {VIEW} SELECT repo, bool_or(path = 'pyproject.toml' AND contains(content, '[tool.mypy]')) AS toml_section, coalesce(json_exists(CASE WHEN json_valid({_text('package.json')}) THEN {_text('package.json')} END, '$.scripts.lint'), false) AS lint_script FROM f GROUP BY repo")
def m15(spark, sf):
    script = F.get_json_object(C.text_of("package.json"), "$.scripts.lint").isNotNull()
    return collections(spark, sf).groupBy("repo").agg(C.any_of((C.path() == "pyproject.toml") & F.col("content").contains("[tool.mypy]")).alias("toml_section"), script.alias("lint_script"))


@query("m16_tier_parsing", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'lean' WHEN 1 THEN 'full' WHEN 2 THEN 'enterprise' END AS tier, CASE c_custkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'lean' WHEN 2 THEN 'standard' ELSE 'enterprise' END AS by_complexity FROM customer")
def m16(spark, sf):
    at = lambda *values: F.get(F.array(*map(F.lit, values)), (F.col("c_custkey") % 4).cast("int"))
    return read(spark, sf, "customer").select("c_custkey", C.parse_tier(at("Lite", "FULL", "Enterprise", "bogus")).alias("tier"), C.tier_of_complexity(at("other", "simple", "moderate", "enterprise")).alias("by_complexity"))


# ---- functions of texts ---------------------------------------------------------------------


@query("f1_trim", f"WITH {FILES} SELECT path, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content FROM files")
def f1(spark, sf):
    return files(spark, sf).select("path", T.trim(F.col("content")).alias("content"))


@query("f2_lines", f"WITH {FILES} SELECT path, CASE WHEN content = '' THEN 0 ELSE len(string_split(regexp_replace(content, '\\n$', ''), chr(10))) END AS n FROM files")
def f2(spark, sf):
    return lines(spark, sf).groupBy("path").agg(F.count("*").alias("n")).unionByName(files(spark, sf).where("content = ''").select("path", F.lit(0).cast("long").alias("n")))


@query("f5_split_words", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[^\\pL\\pN_]'), lambda w: w <> ''))::BIGINT AS n FROM documents")
def f5(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split("text", r"[^\p{L}\p{N}_]"), lambda w: w != "")).cast("long").alias("n"))


@query("f6_ends", "SELECT doc_id, left(text, 80) AS head, right(text, 500) AS tail FROM documents")
def f6(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.left("text", F.lit(80)).alias("head"), F.right("text", F.lit(500)).alias("tail"))


@query("f7_byte_length", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents")
def f7(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))


@query("f20_json_keys", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def f20(spark, sf):
    return read(spark, sf, "events").select("event_id", F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("keys"))


@query("f30_parse_number", "SELECT p_partkey, try_cast(regexp_extract(p_brand, '[^#]*$') AS BIGINT) AS n FROM part")
def f30(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.regexp_extract("p_brand", "[^#]*$", 0).try_cast("long").alias("n"))


@query("f31_any_all", "SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS any_the, len(list_filter(string_split(text, ' '), lambda w: length(w) >= 40)) = 0 AS all_short FROM documents")
def f31(spark, sf):
    words = F.split("text", " ")
    return read(spark, sf, "documents").select("doc_id", F.array_contains(words, "the").alias("any_the"), F.forall(words, lambda w: F.length(w) < 40).alias("all_short"))


# ---- readers, sections, ranks ---------------------------------------------------------------


@query("s12_compose_services", "SELECT p_partkey::VARCHAR AS path, unnest(['db', 'web' || p_size]) AS service FROM part")
def s12(spark, sf):
    doc = split(made(spark, sf, "version: 3\nservices:\n  db:\n    image: x\n  web", F.col("p_size"), ":\n    build: .\nvolumes:\n  data:\n"))
    return L.block_keys(doc, "services", 2).select("path", F.col("key").alias("service"))


@query("x13_key_deps", "SELECT p_partkey::VARCHAR AS path, unnest(['flask', 'lib' || p_size, 'a', 'b']) AS name FROM part")
def x13(spark, sf):
    python = L.requirements(split(made(spark, sf, "flask==1\nlib", F.col("p_size"), "[x]>2\n")))
    node = made(spark, sf, '{"dependencies": {"b": 1, "a": 2}}').select("path", F.explode(L.package_dependencies(F.col("content"))).alias("name"))
    return node.unionByName(python)


@query("t6_lang_breakdown", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def t6(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


