"""Rollups, windows, top-k, set and rule operators over plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, key: Column | str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def top(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """Top-k with an explicit tie-breaker: TakeOrderedAndProject, no full sort."""
    return df.orderBy(*order).limit(n)


def sections(df: DataFrame, doc: str, line: str, header: Column) -> DataFrame:
    """Adds ``section``: the last header at or before each line of its document."""
    w = Window.partitionBy(doc).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("section", F.last(header, True).over(w))


def fenced(df: DataFrame, doc: str, line: str, fence: Column) -> DataFrame:
    """Adds ``inside``: whether an odd number of fences came up to and with each line."""
    w = Window.partitionBy(doc).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("inside", F.sum(fence.cast("int")).over(w) % 2 == 1)


def first_match(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The value of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for test, value in rules[1:]:
        out = out.when(test, value)
    return out.otherwise(default)


def capped_scores(counts: DataFrame, key: str, n: str, cap: int) -> DataFrame:
    return counts.groupBy(key).agg(F.sum(F.least(F.col(n), F.lit(cap))).alias("score"))


def complexity(n: Column, docker: Column, ci: Column, multi: Column, mono: Column, packages: Column) -> Column:
    """Score and class of a collection's complexity."""
    b = lambda c, v: F.when(c, v).otherwise(0)
    return F.floor(F.least(n, F.lit(500)) / 10) + b(docker, 10) + b(ci, 10) + b(multi, 15) + b(mono, 20) + b(packages >= 3, 15)


def complexity_class(score: Column) -> Column:
    return first_match([(score < 10, "simple"), (score < 30, "moderate"), (score < 60, "complex")], "enterprise")


def tier(configured: Column, complexity: Column) -> Column:
    return F.coalesce(configured, first_match([(complexity == "simple", "lean"), (complexity == "moderate", "standard"), (complexity == "complex", "full"), (complexity == "enterprise", "enterprise")], "full"))
