"""Domains of collections by paths and dependencies, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import content, path
from .structure import outside

#: Fixed values: (domain, its title, parts of lower-case paths or dependency texts), in order.
DOMAINS = (
    ("auth", "Authentication & Authorization", ("auth/", "auth.", "login", "session", "jwt", "oauth", "guard", "permission")),
    ("database", "Database & Data Layer", ("migration", "schema.", "models/", "model.", "entity", "prisma", "sequelize", "sqlalchemy", "drizzle", ".sql")),
    ("api", "API Endpoints", ("routes/", "controllers/", "handlers/", "endpoints/", "controller.", "route.", "handler.")),
    ("ai", "AI/LLM Integration", ("openai", "anthropic", "langchain", "llm", "prompt", "embedding", "agent", "rag")),
    ("frontend", "Frontend UI", ("components/", "pages/", "views/", "layouts/", ".tsx", ".vue", ".svelte")),
    ("workers", "Background Workers / Jobs", ("workers/", "jobs/", "queues/", "worker.", "job.", "queue.", "consumer.", "cron")),
    ("file-upload", "File Upload / Storage", ("upload", "storage", "s3", "multer", "busboy", "gcs")),
    ("financial", "Financial Calculations", ("payment", "billing", "stripe", "invoice", "transaction", "payroll")),
)
#: Folders whose files name no domain, besides the engine's own.
NO_SOURCES = ("node_modules/", ".git/", ".venv/", "target/", "vault/", "review-specialists/", "templates/", ".claude/", "docs/", "tools/")
#: Manifests whose text names dependencies.
MANIFESTS = ("package.json", "Cargo.toml", "requirements.txt", "go.mod", "Gemfile", "composer.json", "pyproject.toml")
#: Domain -> invariants, and domain -> security concerns.
INVARIANTS = {
    "auth": ("no-credentials-in-code", "session-validation-required"),
    "database": ("migrations-required", "no-raw-sql-without-parameterization"),
    "api": ("input-validation-required", "rate-limiting-recommended"),
    "ai": ("llm-trust-boundary", "output-sanitization-required"),
    "financial": ("decimal-precision-required", "audit-logging-required"),
    "file-upload": ("file-size-limits-required", "file-type-validation-required"),
}
CONCERNS = {
    "auth": ("credential-exposure", "session-hijacking"),
    "api": ("injection-attacks", "broken-access-control"),
    "ai": ("llm-trust-boundary", "prompt-injection"),
    "database": ("sql-injection", "data-leakage"),
    "financial": ("payment-data-exposure", "transaction-integrity"),
    "file-upload": ("path-traversal", "malicious-file-upload"),
}
#: Fixed values: (domain, short label, rule); the general ones come first.
RULES = (("general", "INV-1", "LLM trust boundary — validate all AI output"), ("general", "INV-2", "No secrets in source code"))
DOMAIN_RULES = (
    ("auth", "INV-AUTH", "Auth guards on all protected endpoints"),
    ("database", "INV-DB", "Database access through ORM only"),
    ("api", "INV-API", "Input validation on all API endpoints"),
    ("ai", "INV-AI", "LLM outputs sanitized before use"),
)


def _domains(test) -> Column:
    """Array of (idx, domain) of the domains for whose patterns ``test`` holds."""
    return F.array_compact(F.array(*(F.when(test(ps), F.struct(F.lit(i).alias("idx"), F.lit(d).alias("domain"))) for i, (d, _, ps) in enumerate(DOMAINS))))


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    found = text.contains(patterns[0])
    for p in patterns[1:]:
        found = found | text.contains(p)
    return found


def domain_paths(files: DataFrame, most: int = 10) -> DataFrame:
    """(repo, idx, domain, path): the first paths of each domain; tests and other folders go."""
    sources = files.where(outside(NO_SOURCES) & ~path().contains(".test.") & ~path().contains(".spec."))
    low = F.lower("path")
    hits = sources.select("repo", "path", F.explode(_domains(lambda ps: _any(low, ps))).alias("d")).select("repo", "d.*", "path")
    rank = F.row_number().over(Window.partitionBy("repo", "domain").orderBy("path"))
    return hits.withColumn("rn", rank).where(F.col("rn") <= most).drop("rn")


def domain_dependencies(files: DataFrame) -> DataFrame:
    """(repo, idx, domain) of the domains that a manifest of the collection names; final / and . of a pattern don't count."""
    nested = path().endswith("package.json") & path().contains("/") & ~path().contains("node_modules")
    low = F.lower(content())
    hits = _domains(lambda ps: _any(low, tuple(p.rstrip("/").rstrip(".") for p in ps)))
    return files.where(path().isin(*MANIFESTS) | nested).select("repo", F.explode(hits).alias("d")).select("repo", "d.*").distinct()


def detected(files: DataFrame) -> DataFrame:
    """(repo, idx, domain, paths): every domain that a path or a manifest names, with its first paths."""
    both = domain_paths(files).unionByName(domain_dependencies(files).withColumn("path", F.lit(None).cast("string")))
    return both.groupBy("repo", "idx", "domain").agg(F.array_sort(F.collect_set("path")).alias("paths"))  # ten paths at most


def _per_domain(domains: DataFrame, table: dict[str, tuple[str, ...]], name: str) -> DataFrame:
    values = F.create_map(*(x for k, vs in table.items() for x in (F.lit(k), F.array(*map(F.lit, vs)))))
    return domains.select("repo", F.explode(F.try_element_at(values, F.col("domain"))).alias("value")).groupBy("repo").agg(F.array_sort(F.collect_set("value")).alias(name))


def invariants(domains: DataFrame) -> DataFrame:
    """(repo, invariants), sorted, of ``domains`` (repo, domain)."""
    return _per_domain(domains, INVARIANTS, "invariants")


def security_concerns(domains: DataFrame) -> DataFrame:
    return _per_domain(domains, CONCERNS, "concerns")


def invariant_rules(repos: DataFrame, domains: DataFrame) -> DataFrame:
    """(repo, id, rule, domain, enforced): two general rules for every collection, then one for each domain that has one, numbered on."""
    position = {d: i for i, (d, *_) in enumerate(DOMAINS)}
    general = F.array(*(F.struct(F.lit(i - 10).alias("at"), F.lit(d).alias("domain"), F.lit(r).alias("rule")) for i, (d, _, r) in enumerate(RULES)))
    own = F.create_map(*(x for d, _, r in DOMAIN_RULES for x in (F.lit(d), F.struct(F.lit(position[d]).alias("at"), F.lit(d).alias("domain"), F.lit(r).alias("rule")))))
    rows = repos.select("repo", F.explode(general).alias("r")).unionByName(domains.select("repo", F.try_element_at(own, F.col("domain")).alias("r")).where("r is not null"))
    number = F.row_number().over(Window.partitionBy("repo").orderBy("r.at"))  # six rows a collection
    return rows.distinct().select("repo", F.concat(F.lit("INV-"), number.cast("string")).alias("id"), "r.rule", "r.domain", F.lit(True).alias("enforced"))
