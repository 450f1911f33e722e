"""Sinks: documents, upserts by key, and files that are only written where absent or owned."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ends every file that we write and may therefore overwrite.
FOOTER = "<!-- generated -->"
#: What follows this line in a file belongs to its reader.
USER = "<!-- USER SECTIONS -->"
#: Headers of the sections that the guide has itself.
STANDARD = (
    "## Commands", "## Invariants", "## Architecture", "## Key Locations", "## Environment Variables", "## Gotchas", "## Common Mistakes", "## Key State", "## Makefile",
    "## Automated Enforcement", "## Skills", "## Self-Healing Workflow", "## Vault", "## Doc Sync", "## Getting Started", "## Self-Evolution", "## Session Learnings",
)
#: Headers that our own guide adds to them.
OWN_HEADERS = ("## Key Files", "## Quality Tools", "## CI")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_if_missing(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a table in any of Spark's formats unless something is there."""
    df.write.mode("ignore").format(kind).save(path)


def write_text_if_missing(path: str, text: str) -> bool:
    """Writes a file on the driver unless it is there."""
    target = Path(path)
    if target.exists():
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
    return True


# ---- tables of the newest row of every key ----------------------------------------------------
#
# A table is a folder of segments and a pointer, a small file that lists those that count and their rows. An upsert
# writes its rows as a segment of their own, then replaces the pointer in one step, so whoever reads
# finds the table before or after it, never half of it, and what a broken run has left behind doesn't count.
# Segments are merged when one is no longer than twice what follows it, so a stream of small batches rewrites
# a row only as often as the table doubles. One writer at a time.

POINTER = "_current.json"


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder.getFileSystem(conf), folder


def _pointer(spark: SparkSession, path: str) -> dict | None:
    """What the pointer of a table says; None without a table."""
    jvm, system, folder = _files(spark, path)
    at = jvm.org.apache.hadoop.fs.Path(folder, POINTER)
    if not system.exists(at):
        if system.exists(folder) and any(f.getPath().getName().endswith(".parquet") for f in system.listStatus(folder)):
            return {"segments": [{"name": "", "rows": -1}], "before": []}  # plain Parquet, as others write it
        return None
    stream = system.open(at)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _replace_pointer(spark: SparkSession, path: str, told: dict) -> None:
    """Puts a new pointer in the place of the old one in one step."""
    jvm, system, folder = _files(spark, path)
    to, new = jvm.org.apache.hadoop.fs.Path(folder, POINTER), jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}.json")
    stream = system.create(new)
    stream.write(bytearray(json.dumps(told).encode()))
    stream.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(kind, 1)
    overwrite[0] = kind.valueOf("OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), system.getConf()).rename(system.makeQualified(new), system.makeQualified(to), overwrite)


def _newest(rows: DataFrame, key: str, order: str, fill: Sequence[str], later: bool = False) -> DataFrame:
    """One row a key: the last by ``order``; a column in ``fill`` has its last value that isn't null.

    With ``later`` the rows come after others of a table, and ``_filled`` tells what they do to its values (see ``_folded``).
    """
    own = {c: F.when(F.col(c).isNotNull(), F.col(order)) for c in fill}
    picked = [F.max_by(c, own.get(c, F.col(order))).alias(c) for c in rows.columns if c != key]
    if later and fill:
        picked.append(F.struct(*(F.struct(F.max_by(c, own[c]).alias("first"), F.max_by(c, own[c]).alias("last"), F.max(own[c]).alias("at")).alias(c) for c in fill)).alias("_filled"))
    return rows.groupBy(key).agg(*picked)


def _folded(spark: SparkSession, path: str, segments: list[dict], key: str, order: str, fill: Sequence[str], later: bool = False) -> DataFrame:
    """The rows that segments make one after the other, as if each were upserted into what those before it left.

    A table's value in a ``fill`` column counts as of its row's order, whenever it came in, so it stands against a
    later segment's value that is older than that row. What a segment does to any table before it is three values a
    column: one that goes in where its order ``at`` is above the row's, and one where there is none yet; ``later`` keeps these.
    """
    parts = [spark.read.parquet(f"{path}/{x['name'] or '*.parquet'}").withColumn("_n", F.lit(n)) for n, x in enumerate(segments)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    has = rows.schema["_filled"].dataType.names if "_filled" in rows.columns else ()
    fill = [c for c in fill if c in rows.columns]
    kept = [c for c in rows.columns if c not in (key, "_n", "_filled", *fill)]
    by = F.when(F.col(order).isNotNull(), F.struct(order, -F.col("_n")))  # of rows with one order the earliest stays
    newest = [F.max_by(c, by).alias(c) for c in kept]
    if not fill:
        return rows.groupBy(key).agg(*newest)

    def does(c: str):
        whole = F.struct(F.col(c).alias("first"), F.col(c).alias("last"), F.when(F.col(c).isNotNull(), F.col(order)).alias("at"))
        return (F.coalesce(F.col(f"_filled.{c}"), whole) if c in has else whole).alias(c)

    steps = F.collect_list(F.struct("_n", F.col(order).alias("top"), *map(does, fill)))  # as many as there are segments
    grouped = rows.groupBy(key).agg(*newest, F.array_sort(steps, lambda x, y: x["_n"] - y["_n"]).alias("_steps"))
    kind = grouped.schema["_steps"].dataType.elementType

    def fold(c: str):
        def step(a, x):
            newer = F.coalesce(x[c]["at"] > a["top"], a["top"].isNull() & x[c]["at"].isNotNull())
            pick = lambda f: F.when(newer, x[c][f]).otherwise(a[f]).alias(f)
            return F.struct(F.greatest(a["top"], x["top"]).alias("top"), F.coalesce(a["first"], x[c]["first"]).alias("first"), pick("last"), pick("at"))

        none = [F.lit(None).cast(kind["top"].dataType).alias("top"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in kind[c].dataType)]
        return F.aggregate("_steps", F.struct(*none), step).dropFields("top").alias(c)

    out = grouped.select(key, *kept, F.struct(*map(fold, fill)).alias("_filled"))
    values = {c: F.when(F.col(f"_filled.{c}.at").isNotNull(), F.col(f"_filled.{c}.last")).otherwise(F.col(f"_filled.{c}.first")).alias(c) for c in fill}
    return out.select(*(values.get(c, c) for c in rows.columns if c not in ("_n", "_filled")), *(["_filled"] if later else []))


def read_newest(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that upserts have made under ``path``, one row a key; None if there is none."""
    told = _pointer(spark, path)
    if told is None:
        return None
    if len(told["segments"]) == 1:
        return spark.read.parquet(f"{path}/{told['segments'][0]['name'] or '*.parquet'}")
    return _folded(spark, path, told["segments"], told["key"], told["order"], told["fill"])


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str = "repo_name", order: str = "timestamp", fill: Sequence[str] = ()) -> DataFrame:
    """Keeps the newest row of every key; columns in ``fill`` keep an older value where the new one is null. Returns the table.

    Rows that are upserted again change nothing.
    """
    told = _pointer(spark, path) or {"segments": [], "before": []}
    own = {"name": f"segment-{uuid.uuid4().hex}"}
    _newest(rows, key, order, fill, bool(told["segments"])).write.parquet(f"{path}/{own['name']}")
    own["rows"] = spark.read.parquet(f"{path}/{own['name']}").count()
    segments, merged = [*told["segments"], own], 0
    following = 0
    for back in reversed(range(len(segments))):  # from the last one on: how many are to be one
        if merged and segments[back]["rows"] > 2 * following:
            break
        merged, following = merged + 1, following + max(0, segments[back]["rows"])
    if merged > 1:
        one = {"name": f"segment-{uuid.uuid4().hex}"}
        _folded(spark, path, segments[-merged:], key, order, fill, merged < len(segments)).write.parquet(f"{path}/{one['name']}")
        one["rows"] = spark.read.parquet(f"{path}/{one['name']}").count()
        segments = [*segments[:-merged], one]
    _replace_pointer(spark, path, {"segments": segments, "before": [x["name"] for x in told["segments"]], "key": key, "order": order, "fill": list(fill)})
    _, system, _ = _files(spark, path)
    for name in set(told["before"]) - {x["name"] for x in [*told["segments"], *segments]} - {""}:  # readers of the table before this one may still need its segments
        system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return read_newest(spark, path)


def stats(knowledge: DataFrame) -> DataFrame:
    """One row over all collections: counts and the distinct languages."""
    totals = knowledge.agg(F.count("*").alias("repos"), F.sum("total_files").alias("files"), F.sum("total_symbols").alias("symbols"))
    names = knowledge.select(F.explode_outer(F.map_keys("languages")).alias("language")).agg(F.sort_array(F.collect_set("language")).alias("languages"))
    return totals.crossJoin(names)  # one row each


def user_sections(text: str, standard: Iterable[str] = (*STANDARD, *OWN_HEADERS)) -> str:
    """What a reader has added to a document: all behind the mark, else the sections whose header is none of ours."""
    _, mark, rest = text.partition(USER)
    if mark and (own := rest.replace(FOOTER, "").strip()):
        return own
    kept: list[str] = []
    own_section = False
    for line in text.replace(FOOTER, "").splitlines():
        if line.startswith("## "):
            own_section = not line.startswith(tuple(standard))
            if own_section and kept:
                kept.append("")
        if own_section:
            kept.append(line)
    return "\n".join(kept).strip()


def write_owned(path: str, text: str) -> bool:
    """Writes a report on the driver; a file that isn't ours stays. Ours is backed up first, and its reader's sections come along."""
    target = Path(path)
    added = ""
    if target.exists():
        current = target.read_text()
        if FOOTER not in current:
            return False
        target.with_suffix(target.suffix + ".bak").write_text(current)
        added = user_sections(current)
    target.parent.mkdir(parents=True, exist_ok=True)
    base = text.partition(USER)[0].rstrip()
    target.write_text(f"{base}\n\n{USER}\n{added}\n\n{FOOTER}\n" if added else f"{base}\n\n{FOOTER}\n")
    return True
