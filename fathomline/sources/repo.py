"""Scanning a directory of source files into (path, size_bytes, modified, content).

Directories are a table, the frontier: each task lists the ones it got, goes down from there, and hands
back what it had no share left for as the next round's frontier, dealt to all tasks anew. The ignore rules on
the way to a directory go along in a column, so any task can enter it. The driver sees neither directories nor
files. Spark's file sources can't be used, as they pass over names that begin with a dot or an underscore
(.github, __init__.py); any file system that Arrow knows will do. Contents are read after sizes and
paths are tested.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from . import ignore
from .shared import written

#: Excluded directories and the largest file in bytes.
EXCLUDED = (".git/", "node_modules/", "vendor/", "__pycache__/", "target/", "dist/")
MAX_BYTES = 512 * 1024
#: Entries that a task lists below one directory of the frontier before it hands on what is left.
SHARE = 5_000


def included(path: Column, excluded: Iterable[str] = EXCLUDED) -> Column:
    keep = ~path.contains("/target/")
    for prefix in excluded:
        keep = keep & ~path.startswith(prefix)
    return keep


def listed(files: DataFrame) -> DataFrame:
    """A listing without version control: what the rules look at, whatever its size."""
    return files.where(~F.col("path").startswith(".git/"))


def selected(files: DataFrame, excluded: Iterable[str] = EXCLUDED) -> DataFrame:
    """Files (path, size_bytes, ...) of bounded size outside the excluded directories: what is read and parsed."""
    return files.where((F.col("size_bytes") <= MAX_BYTES) & included(F.col("path"), excluded))


def shebang_language(content: Column) -> Column:
    """Extension by the first line of a file without one; null if it names no interpreter."""
    first = F.split(content, "\n")[0]
    has = lambda *xs: F.lit(False) if not xs else first.contains(xs[0]) | has(*xs[1:])
    return F.when(has("/bash", "/sh", "env bash", "env sh"), "sh").when(has("python"), "py").when(has("ruby"), "rb").when(has("node"), "js")


def readable(content: Column) -> Column:
    """Binary content that is valid UTF-8 without NUL."""
    return F.is_valid_utf8(content.cast("string")) & (F.locate("\0", content.cast("string")) == 0)


def _opened(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a directory given as a path or a URI."""
    if "://" in root or root.startswith("file:"):
        system, base = arrow_fs.FileSystem.from_uri(root)
    else:
        system, base = arrow_fs.LocalFileSystem(), root
    return system, base.rstrip("/")


def _text(system: arrow_fs.FileSystem, path: str) -> str:
    with system.open_input_stream(path) as stream:
        return stream.read().decode("utf-8", "replace")


_RULES = lru_cache(4096)(ignore.parse)
_ENTRY = pa.schema([("is_folder", pa.bool_()), ("path", pa.string()), ("size_bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("levels", pa.list_(pa.struct([("folder", pa.string()), ("rules", pa.string())])))])
_ENTRY_DDL = "is_folder boolean, path string, size_bytes long, modified timestamp, levels array<struct<folder:string,rules:string>>"


def _below(system: arrow_fs.FileSystem, base: str, folder: str, levels: list[dict], honour_ignores: bool, share: int) -> Iterator[dict]:
    """Files below a directory (empty, or with a final slash), and the directories that weren't entered once ``share`` entries were listed."""
    if not folder and honour_ignores and system.get_file_info(f"{base}/.git/info/exclude").type == arrow_fs.FileType.File:
        levels = [{"folder": "", "rules": _text(system, f"{base}/.git/info/exclude")}]
    todo, listed = [(folder, levels)], 0
    while todo:
        folder, levels = todo.pop()
        if listed >= share:
            yield {"is_folder": True, "path": folder, "size_bytes": None, "modified": None, "levels": levels}
            continue
        entries = system.get_file_info(arrow_fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
        listed += len(entries) + 1
        if honour_ignores and any(e.base_name == ".gitignore" and e.type == arrow_fs.FileType.File for e in entries):
            levels = [*levels, {"folder": folder, "rules": _text(system, f"{base}/{folder}.gitignore")}]
        parsed = [(x["folder"], _RULES(x["rules"])) for x in levels]
        for entry in entries:
            path, is_folder = folder + entry.base_name, entry.type == arrow_fs.FileType.Directory
            if is_folder and entry.base_name == ".git" or ignore.ignored(path, is_folder, parsed):
                continue
            if is_folder:
                todo.append((path + "/", levels))
            elif entry.type == arrow_fs.FileType.File:
                yield {"is_folder": False, "path": path, "size_bytes": entry.size, "modified": entry.mtime, "levels": None}


def listing(spark: SparkSession, root: str, honour_ignores: bool = True, share: int = SHARE) -> DataFrame:
    """(path, size_bytes, modified) of all files below ``root``; ``.git`` is never entered.

    Rules come from .git/info/exclude and the .gitignore files on the way. A directory that has gone meanwhile has
    no files. Each round is written, so a lost executor costs no more than its own directories.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            for at in batch.select(["path", "levels"]).to_pylist():
                held = []
                for entry in _below(system, base, at["path"], at["levels"], honour_ignores, share):
                    held.append(entry)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, _ENTRY)
                        held = []
                yield pa.RecordBatch.from_pylist(held, _ENTRY)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frontier = spark.range(1).select(F.lit("").alias("path"), F.array().cast("array<struct<folder:string,rules:string>>").alias("levels"))
    found = None
    while True:
        entries = written(frontier.mapInArrow(run, _ENTRY_DDL))
        files = entries.where("not is_folder").select("path", "size_bytes", "modified")
        found = files if found is None else found.unionByName(files)
        frontier = entries.where("is_folder").select("path", "levels")
        if frontier.isEmpty():
            return found
        frontier = frontier.repartition(tasks, "path")


def deposit(files: DataFrame, root: str) -> DataFrame:
    """Write (path, content) rows as files below ``root``, by the executors; a row (path, size_bytes) for each.

    A file is written under another name and then moved, so a task that is run again leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                raw, to = (content or "").encode("utf-8", "surrogatepass"), f"{base}/{path}"
                system.create_dir(to.rpartition("/")[0], recursive=True)
                name = f"{to}.{uuid.uuid4().hex}"
                with system.open_output_stream(name, compression=None) as stream:
                    stream.write(raw)
                system.move(name, to)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "size_bytes": pa.array(sizes, pa.int64())})

    return written(files.select("path", "content").mapInArrow(run, "path string, size_bytes long"))


def contents(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, ...) with their bytes as ``content``; a file that has gone meanwhile has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _opened(root)
        for frame in frames:
            for at in range(0, len(frame), 100):
                part = frame.iloc[at : at + 100].copy()
                raw = []
                for path in part["path"]:
                    try:
                        with system.open_input_stream(f"{base}/{path}") as stream:
                            raw.append(stream.read())
                    except FileNotFoundError:
                        raw.append(None)
                part["content"] = raw
                yield part

    return files.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in files.dtypes) + ", content binary")


def scan(spark: SparkSession, root: str, excluded: Iterable[str] = EXCLUDED, honour_ignores: bool = True) -> DataFrame:
    """(path, size_bytes, modified, content) of all text files under ``root``: sizes and paths are tested before any content is read."""
    found = selected(listing(spark, root, honour_ignores), excluded)
    spread = found.repartition(spark.sparkContext.defaultParallelism)
    text = contents(spread, root).where(F.col("content").isNotNull()).where(readable(F.col("content")))
    return text.withColumn("content", F.col("content").cast("string"))


def with_language(files: DataFrame) -> DataFrame:
    """Adds ext and language; files of unknown kind go."""
    ext = F.when(paths.extension(F.col("path")) != "", paths.extension(F.col("path"))).otherwise(shebang_language(F.col("content")))
    return files.withColumn("ext", ext).withColumn("language", paths.language(F.col("ext"))).where("language is not null")


def key_values(lines: DataFrame, key: str) -> DataFrame:
    """(path, value): the text after the first = of a file's first line that starts with ``key``, without quotes."""
    hits = lines.where(F.col("line").startswith(key) & F.col("line").contains("="))
    value = F.trim(F.translate(F.regexp_extract("line", "^[^=]*=(.*)$", 1), "\"'", ""))
    return hits.groupBy("path").agg(F.min_by(value, "line_no").alias("value"))
