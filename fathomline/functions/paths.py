"""Path, name and import-string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> language.
EXT_LANGUAGE = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "rs": "rust", "rb": "ruby", "sh": "bash", "bash": "bash", "zsh": "bash", "java": "java", "cs": "csharp", "php": "php",
    "kt": "kotlin", "kts": "kotlin", "swift": "swift", "ex": "elixir", "exs": "elixir",
}


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """After the last dot of the name; names with a leading dot only have none."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def strip_extension(path: Column) -> Column:
    """Without what follows the last dot of the whole path."""
    return F.regexp_replace(path, r"\.[^.]*$", "")


def language(ext: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in EXT_LANGUAGE.items() for x in pair))[ext]


def slug(path: Column) -> Column:
    return F.translate(path, "/.", "--")


def short_name(name: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(name), " _", "--"), r"[^\p{L}\p{N}-]", "")


def python_import(x: Column) -> Column:
    return F.replace(F.regexp_replace(x, r"^\.+", ""), F.lit("."), F.lit("/"))


def relative_import(x: Column) -> Column:
    """Null for a bare package; leading ./ and then ../ removed."""
    return F.when(x.startswith(".") | x.contains("/"), F.regexp_replace(F.regexp_replace(x, r"^(\./)+", ""), r"^(\.\./)+", ""))


def tildify(path: Column, home: str) -> Column:
    """The path with the home directory as ~."""
    return F.when((path == home) | path.startswith(home.rstrip("/") + "/"), F.concat(F.lit("~"), F.substring(path, len(home.rstrip("/")) + 1, 1 << 20))).otherwise(path)


def suffixes(path: Column) -> Column:
    """The path's endings at component borders, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def env_name(x: Column) -> Column:
    return x.rlike("^[A-Z_][A-Z0-9_]*$")


#: Parts of names of sensitive variables.
SENSITIVE = (
    "SECRET", "KEY", "TOKEN", "PASSWORD", "PRIVATE", "CREDENTIAL", "DATABASE_URL", "DB_URL",
    "REDIS_URL", "MONGO_URL", "CONNECTION_STRING", "AUTH", "API_KEY", "AWS_", "GCP_", "AZURE_",
)
#: Beginnings of names of variables that reach browsers.
PUBLIC = ("NEXT_PUBLIC_", "VITE_")
#: Last directory name -> role of a module.
ROLES = {
    "scanners": "discovery", "scan": "discovery", "scanner": "discovery",
    "generators": "generation", "gen": "generation", "generator": "generation",
    "validators": "validation", "validator": "validation", "validation": "validation",
    "indexers": "indexing", "indexer": "indexing", "index": "indexing",
    "parsers": "parsing", "parser": "parsing",
    "mcp": "mcp",
    "tests": "testing", "test": "testing", "__tests__": "testing", "spec": "testing",
    "utils": "utility", "util": "utility", "helpers": "utility", "helper": "utility", "lib": "utility", "common": "utility",
    "api": "api", "routes": "api", "controllers": "api", "handlers": "api",
    "models": "data", "entities": "data", "schemas": "data",
    "services": "service", "service": "service",
    "middleware": "middleware", "middlewares": "middleware",
    "config": "config", "configs": "config", "settings": "config",
    "migrations": "migration", "migrate": "migration",
    "bin": "cli", "cmd": "cli", "cli": "cli",
    "data": "data",
    "bridge": "bridge",
    "freshness": "tracking",
}


def lookup(table: dict[str, str], name: Column, default: str | None = None) -> Column:
    """The name's value in a small fixed table."""
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), name)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def module_role(module: Column) -> Column:
    """Role of a directory by its last name."""
    return lookup(ROLES, F.substring_index(module, "/", -1), "module")


def sensitive_name(x: Column) -> Column:
    return F.upper(x).rlike("|".join(SENSITIVE))


def public_name(x: Column) -> Column:
    return x.startswith(PUBLIC[0]) | x.startswith(PUBLIC[1])


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that two strings share, in one pass over both."""
    differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs == 0, F.length(a)).otherwise(differs - 1).cast("int")
