"""The import graph of a tree kept up to date by differences.

A change of files touches few imports: those of the files themselves, and those that one of the paths that
came or went could answer. The second kind is found by a reverse key. Every way in which an import
finds a path (the path itself, without its extension, beside the source, as a path's end, by the
stem, or with dots for slashes) makes the import's last component equal the path's name, its stem, or the last
component of the path without extension; so one equi-join of these keys finds all imports that need another
look, and the same keys say which paths can answer them. All other resolved imports stay as they are, and
counts of modules and pairs of modules are sums to which differences are added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.shared import written
from . import graph


@dataclass
class ImportGraph:
    """``parsed`` (path, hash, symbols, imports, ...), ``resolved`` (source, import, target, tier), ``pairs`` (source, target, n) of modules, and their ``modules``."""

    parsed: DataFrame
    resolved: DataFrame
    pairs: DataFrame
    modules: DataFrame

    def edges(self) -> DataFrame:
        return graph.edges(self.resolved)


def _asked(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("source"), F.explode("imports").alias("import"))


def import_keys(x: Column) -> Column:
    """The last components that a path must have to answer an import."""
    return F.array_distinct(F.array(paths.basename(x), paths.basename(F.replace(x, F.lit("."), F.lit("/")))))


def path_keys(path: Column) -> Column:
    """The last components by which imports may mean a path."""
    return F.array_distinct(F.array(paths.basename(path), paths.stem(path), paths.basename(paths.strip_extension(path))))


def affected(asked: DataFrame, changed: DataFrame) -> DataFrame:
    """Of the imports ``asked`` (source, import, ...) those that one of the paths ``changed`` could answer."""
    keys = changed.select(F.explode(path_keys(F.col("path"))).alias("key")).distinct()
    wanted = asked.select("*", F.explode(import_keys(F.col("import"))).alias("key"))
    return wanted.join(keys, "key", "left_semi").drop("key").distinct()


def candidates(known: DataFrame, asked: DataFrame) -> DataFrame:
    """Of the paths ``known`` those that could answer one of the imports ``asked``."""
    keys = asked.select(F.explode(import_keys(F.col("import"))).alias("key")).distinct()
    return known.select("path", F.explode(path_keys(F.col("path"))).alias("key")).join(keys, "key", "left_semi").select("path").distinct()


def _counted(links: DataFrame, sign: int) -> DataFrame:
    """(source, target, n) of the modules that links lead between, those inside one too."""
    return links.select(paths.dirname(F.col("source")).alias("source"), paths.dirname(F.col("target")).alias("target")).groupBy("source", "target").agg((sign * F.count("*")).alias("n"))


def _own(parsed: DataFrame, sign: int) -> DataFrame:
    """(module, n_files, total_symbols, fan_in, fan_out) by the modules' own files."""
    zero = F.lit(0).cast("long")
    return parsed.groupBy(paths.dirname(F.col("path")).alias("module")).agg((sign * F.count("*")).alias("n_files"), (sign * F.sum(F.size("symbols"))).cast("long").alias("total_symbols")).select("*", zero.alias("fan_in"), zero.alias("fan_out"))


def _fans(pairs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    out = pairs.select(F.col("source").alias("module"), zero.alias("n_files"), zero.alias("total_symbols"), zero.alias("fan_in"), F.col("n").alias("fan_out"))
    return out.unionByName(pairs.select(F.col("target").alias("module"), zero.alias("n_files"), zero.alias("total_symbols"), F.col("n").alias("fan_in"), zero.alias("fan_out")))


def _summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("module").agg(*(F.sum(c).alias(c) for c in ("n_files", "total_symbols", "fan_in", "fan_out")))
    return sums.where("n_files > 0")


def build(parsed: DataFrame) -> ImportGraph:
    """The graph of all files."""
    resolved = written(graph.resolve_imports(parsed.select("path"), _asked(parsed)))
    pairs = written(_counted(graph.edges(resolved), 1))
    counts = _summed(_own(parsed, 1).unionByName(_fans(pairs)))
    return ImportGraph(parsed, resolved, pairs, written(counts.join(graph.circular(pairs), "module", "left")))


def refresh(old: ImportGraph, parsed: DataFrame) -> ImportGraph:
    """``build(parsed)``, from an earlier graph: only what the changed files touch is resolved and counted."""
    was, now = old.parsed.select("path", F.col("hash").alias("was")), parsed.select("path", F.col("hash").alias("now"))
    changes = written(was.join(now, "path", "full").where("was is null or now is null or was <> now"))
    if changes.isEmpty():
        return ImportGraph(parsed, old.resolved, old.pairs, old.modules)
    sources, moved = changes.select(F.col("path").alias("source")), changes.where("was is null or now is null").select("path")
    again = affected(_asked(parsed).join(sources, "source", "left_anti"), moved)
    asked = written(again.unionByName(_asked(parsed.join(changes.select("path"), "path", "left_semi"))).distinct())
    fresh = written(graph.resolve_imports(candidates(parsed.select("path"), asked), asked))
    gone = old.resolved.join(sources, "source", "left_semi").unionByName(old.resolved.join(sources, "source", "left_anti").join(asked, ["source", "import"], "left_semi"))
    stay = old.resolved.join(sources, "source", "left_anti").join(asked, ["source", "import"], "left_anti")
    resolved = written(stay.unionByName(fresh.select(*stay.columns)))

    gone = written(gone)
    shift = written(_counted(graph.edges(gone), -1).unionByName(_counted(graph.edges(fresh), 1)).groupBy("source", "target").agg(F.sum("n").alias("n")).where("n <> 0"))
    pairs = written(old.pairs.unionByName(shift).groupBy("source", "target").agg(F.sum("n").alias("n")).where("n <> 0"))
    own = _own(old.parsed.join(changes.select("path"), "path", "left_semi"), -1).unionByName(_own(parsed.join(changes.select("path"), "path", "left_semi"), 1))
    counts = _summed(old.modules.select("module", "n_files", "total_symbols", "fan_in", "fan_out").unionByName(own).unionByName(_fans(shift)))
    # Only pairs that came or went can open or close a cycle.
    keys = ["source", "target"]
    flipped = shift.join(old.pairs.select(*keys), keys, "left_anti").select(*keys).unionByName(shift.join(pairs.select(*keys), keys, "left_anti").select(*keys))
    touched = written(flipped.select(F.explode(F.array("source", "target")).alias("module")).distinct())
    near = pairs.join(touched.withColumnRenamed("module", "source"), "source", "left_semi").unionByName(pairs.join(touched.withColumnRenamed("module", "target"), "target", "left_semi")).distinct()
    cycles = graph.circular(near).join(touched, "module", "left_semi").unionByName(old.modules.where("circular_deps is not null").select("module", "circular_deps").join(touched, "module", "left_anti"))
    return ImportGraph(parsed, resolved, pairs, written(counts.join(cycles, "module", "left")))
