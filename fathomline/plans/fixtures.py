"""Small collections made of rows of ``part``, for queries whose SQL lists the rows that they must give.

Row ``i`` of ``part`` becomes collection ``i``; its files are those of variant ``i mod n``, with {i}
in their paths and texts replaced. The SQL side knows nothing of files: it lists expected rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import read

Variant = Sequence[tuple[str, str]]


def collections(spark: SparkSession, sf: str, variants: Sequence[Variant]) -> DataFrame:
    """(repo, path, content)."""
    i = F.col("p_partkey").cast("string")
    file = lambda p, c: F.struct(F.lit(p).alias("path"), F.lit(c).alias("content"))
    chosen = F.get(F.array(*(F.array(*(file(p, c) for p, c in v)) for v in variants)), (F.col("p_partkey") % len(variants)).cast("int"))
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("repo"), i.alias("i"), F.explode(chosen).alias("f"))
    named = lambda c: F.replace(F.col(c), F.lit("{i}"), F.col("i"))
    return rows.select("repo", named("f.path").alias("path"), named("f.content").alias("content"))


def quoted(value: object) -> str:
    """A value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def expected(variants: Sequence[Sequence[tuple]], columns: str, key: str = "repo") -> str:
    """SQL for the rows of every collection's variant, with {i} replaced in text columns."""
    names = [c.strip() for c in columns.split(",")]
    rows = ", ".join(f"({v}, {', '.join(map(quoted, r))})" for v, rows in enumerate(variants) for r in rows)
    text = {n for at, n in enumerate(names) for rows in variants for r in rows if isinstance(r[at], str)}
    shown = ", ".join(f"replace(e.{n}, '{{i}}', p_partkey::VARCHAR) AS {n}" if n in text else f"e.{n}" for n in names)
    return f"SELECT p_partkey AS {key}, {shown} FROM part JOIN (VALUES {rows}) AS e(v, {', '.join(names)}) ON p_partkey % {len(variants)} = e.v"
