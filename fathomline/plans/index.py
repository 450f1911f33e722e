"""The code index: files with measures, symbols, edges, modules, importance and totals."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import delta, graph, search, tables
from ..operators.structure import OWN
from ..sources import parsers, repo
from ..sources.shared import written

#: Times of documents: seconds, UTC (the session's zone).
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


@dataclass
class Index:
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    modules: DataFrame
    parsed: DataFrame | None = None
    graph: delta.ImportGraph | None = None
    postings: DataFrame | None = None

    def with_search(self) -> Index:
        """The same with posting lists of the symbols' names, which searches then read instead of all symbols."""
        return replace(self, postings=search.postings(self.symbols.select("file", "line", "name", "kind"), "name"))

    def meta(self) -> DataFrame:
        """One row: totals and the languages' counts."""
        counts = self.files.groupBy("language").agg(F.count("*").alias("n"))
        languages = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages"), F.sum("n").alias("total_files"))
        return languages.crossJoin(self.symbols.agg(F.count("*").alias("total_symbols"))).crossJoin(self.edges.agg(F.count("*").alias("total_edges"))).withColumn("generated_at", F.date_format(F.current_timestamp(), ISO))  # one-row tables

    def top_files(self, n: int = 10) -> DataFrame:
        """Most important files, 20 at most; ties by path."""
        return tables.top(self.files.select("path", "importance"), [F.desc("importance"), "path"], min(n, 20))

    def file_symbols(self, path: str) -> DataFrame:
        return self.symbols.where(F.col("file") == path)

    def search_symbols(self, query: str) -> DataFrame:
        found = self.symbols.where(F.lower("name").contains(query.lower())) if self.postings is None or not query else search.find(self.postings, "name", query)
        return tables.top(found, ["file", "line"], 20)

    def analyze_file(self, path: str) -> DataFrame:
        """One row per fact: symbol, imports_from or imported_by."""
        near = graph.neighbours(self.edges, path).select(F.when(F.col("direction") == "out", "imports_from").otherwise("imported_by").alias("fact"), F.col("node").alias("name"))
        return self.file_symbols(path).select(F.lit("symbol").alias("fact"), "name").unionByName(near)

    def find_tests(self, path: str = "") -> DataFrame:
        """Files whose path says test and, with a path given, names its stem; with their test functions."""
        wanted = self.files.where(F.col("path").contains("test") | F.col("path").contains("spec"))
        if path:
            name = path.rpartition("/")[2]
            stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
            wanted = wanted.where(F.col("path").contains(stem)) if stem else wanted.limit(0)
        tests = self.symbols.where(F.col("name").contains("test") | F.col("name").startswith("Test"))
        named = tests.groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_set("name")).alias("tests"))
        return wanted.select("path").join(named, "path", "left")


def file_metrics(content: Column) -> list[Column]:
    """Lines, complexity, logical lines and patterns of a file's text."""
    return [text.count_lines(content).alias("lines"), text.cyclomatic(content).alias("complexity"), text.logical_loc(content).alias("logical_loc"), text.code_patterns(content).alias("patterns")]


def parsed_files(files: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(path, hash, language, symbols, imports, exports); a file whose path and hash are in ``previous`` is taken from there."""
    hashed = files.withColumn("hash", F.sha2("content", 256))
    if previous is None:
        return written(parsers.parse_files(hashed))
    same = previous.join(hashed.select("path", "hash"), ["path", "hash"], "left_semi")
    changed = hashed.join(previous.select("path", "hash"), ["path", "hash"], "left_anti")
    fresh = parsers.parse_files(changed)
    return written(same.unionByName(fresh.select(*same.columns)))


def linked(files: DataFrame, previous: DataFrame | None = None) -> Index:
    """The index before its files are measured and ranked: enough for totals, symbols, edges and modules."""
    return _linked(parsed_files(files, previous))


def _linked(parsed: DataFrame, links: delta.ImportGraph | None = None) -> Index:
    links = links or delta.build(parsed)
    symbols = parsed.select(F.explode("symbols").alias("s")).select("s.*")
    return Index(parsed, symbols, links.edges(), links.modules.withColumn("role", paths.module_role(F.col("module"))), parsed, links)


def build(files: DataFrame, previous: DataFrame | None = None) -> Index:
    """From (path, content, size_bytes, language); ``previous`` is an earlier index's ``parsed``, whose unchanged files aren't parsed again."""
    return ranked(linked(files, previous), files)


def placed(own: Index) -> Index:
    """An index of ``linked`` with its files' ranks but not their measures: enough for requests."""
    ranks = graph.importance(graph.pagerank(own.edges)).select(F.col("id").alias("path"), "importance")
    return replace(own, files=written(own.files.select("path", "language").join(ranks, "path", "left").fillna(0, ["importance"])))


def ranked(own: Index, files: DataFrame, ranks: DataFrame | None = None) -> Index:
    """An index of ``linked`` with its files' measures and ranks, or ``ranks`` (id, importance) that are known."""
    ranks = graph.importance(graph.pagerank(own.edges)) if ranks is None else ranks
    return _assembled(own, files.select("path", "size_bytes", *file_metrics(F.col("content"))), ranks)


def refresh(old: Index, files: DataFrame) -> Index:
    """``build(files)`` from an earlier index: changed files are parsed and measured, imports that the change touches are resolved, counts are shifted.

    Ranks belong to the whole graph; they are computed again if any edge changed.
    """
    parsed = parsed_files(files, old.parsed)
    links = delta.refresh(old.graph, parsed)
    same = old.parsed.select("path", "hash").join(parsed.select("path", "hash"), ["path", "hash"], "left_semi").select("path")
    columns = ["path", "size_bytes", "lines", "complexity", "logical_loc", "patterns"]
    fresh = files.join(same, "path", "left_anti").select("path", "size_bytes", *file_metrics(F.col("content")))
    measured = old.files.join(same, "path", "left_semi").select(*columns).unionByName(fresh.select(*columns))
    before, after = (x.edges().groupBy("source", "target").agg(F.count("*").alias("n")) for x in (old.graph, links))
    unchanged = links.resolved is old.graph.resolved or before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()
    ranks = old.files.select(F.col("path").alias("id"), "importance") if unchanged else graph.importance(graph.pagerank(links.edges()))
    return _assembled(_linked(parsed, links), measured, ranks)


def _assembled(own: Index, measured: DataFrame, ranks: DataFrame) -> Index:
    whole = own.parsed.drop("hash").join(measured, "path").join(ranks.select(F.col("id").alias("path"), "importance"), "path", "left").fillna(0, ["importance"])
    return replace(own, files=written(whole))


def build_from(spark: SparkSession, root: str, previous: DataFrame | None = None) -> Index:
    return build(repo.with_language(repo.scan(spark, root)), previous)


def source_newer(files: DataFrame, made) -> bool:
    """Whether a file of the listing (path, modified), but for generated and vendored ones, is newer than a time."""
    watched = files
    for part in (".git/", OWN, "node_modules/", "target/"):
        watched = watched.where(~F.col("path").contains(part))
    return not watched.where(F.col("modified") > F.lit(made)).isEmpty()


def architecture(index: Index) -> DataFrame:
    """(section, line_no, line): the architecture report's rows."""
    top = index.top_files(20).select(F.lit("Key files").alias("section"), F.concat_ws(" - ", "path", F.col("importance").cast("string")).alias("line"))
    mods = index.modules.select(F.lit("Modules").alias("section"), F.format_string("%s (%s): in %d, out %d", F.when(F.col("module") == "", "(root)").otherwise(F.col("module")), "role", "fan_in", "fan_out").alias("line"))
    langs = index.files.groupBy("language").agg(F.count("*").alias("n")).select(F.lit("Languages").alias("section"), F.format_string("%s: %d", "language", "n").alias("line"))
    rows = top.unionByName(mods).unionByName(langs)
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("section").orderBy("line")))
