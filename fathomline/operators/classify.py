"""Languages of one collection by marker files and extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Our own registry: (language, marker files, extensions).
LANGUAGES = (
    ("python", ("pyproject.toml", "setup.py", "requirements.txt", "Pipfile"), (".py",)),
    ("typescript", ("tsconfig.json",), (".ts", ".tsx")),
    ("javascript", ("package.json",), (".js", ".jsx", ".mjs", ".cjs")),
    ("rust", ("Cargo.toml",), (".rs",)),
    ("go", ("go.mod",), (".go",)),
    ("ruby", ("Gemfile",), (".rb",)),
    ("java", ("pom.xml", "build.gradle"), (".java",)),
    ("kotlin", ("build.gradle.kts",), (".kt", ".kts")),
    ("csharp", ("global.json",), (".cs",)),
    ("php", ("composer.json",), (".php",)),
    ("swift", ("Package.swift",), (".swift",)),
    ("elixir", ("mix.exs",), (".ex", ".exs")),
    ("bash", (), (".sh", ".bash")),
)


def language_scores(files: DataFrame, languages=LANGUAGES, cap: int = 10) -> DataFrame:
    """(language, score): marker files in the root, and per extension its files, counted up to ``cap``."""
    points = [F.struct(F.lit(lang).alias("language"), F.lit(m).alias("by"), F.lit(True).alias("exact")) for lang, marks, _ in languages for m in marks]
    points += [F.struct(F.lit(lang).alias("language"), F.lit(e).alias("by"), F.lit(False).alias("exact")) for lang, _, exts in languages for e in exts]
    hits = files.select(F.explode(F.filter(F.array(*points), lambda r: F.when(r["exact"], F.col("path") == r["by"]).otherwise(F.col("path").endswith(r["by"])))).alias("r"))
    return hits.groupBy("r.language", "r.by").agg(F.count("*").alias("n")).groupBy("language").agg(F.sum(F.least("n", F.lit(cap))).alias("score"))


def main_language(files: DataFrame) -> DataFrame:
    """(language): the highest score, ties by name."""
    return language_scores(files).orderBy(F.desc("score"), "language").limit(1).select("language")
