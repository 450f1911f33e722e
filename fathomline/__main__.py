"""Commands over one source tree: index, run, discover, generate, verify, refresh, report, serve, stats.

Documents of one collection are small and written by the driver; tables are written by Spark.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks as V
from .operators.profile import COMPLEXITY_TIERS, TIERS, start_hint
from .operators.structure import OWN
from .plans import index as I
from .plans import manifest as M
from .plans import render, server
from .sources import git, repo, sinks

#: Where the knowledge of all collections is kept unless told.
KNOWLEDGE = Path.home() / OWN / "knowledge"


def collection(spark: SparkSession, root: str) -> DataFrame:
    """(repo, path, content, mtime) of a tree: all listed files, with content where it is readable text of bounded size."""
    listed = repo.listing(spark, root)
    texts = repo.scan(spark, root, excluded=()).select("path", "content")
    # What the engine has written is left out of version control, but its checks read it.
    own = Path(root) / OWN
    extra = [(f"{OWN}{p.name}", datetime.fromtimestamp(p.stat().st_mtime), p.read_text()) for p in sorted(own.glob("*.json"))] if own.is_dir() else []
    documents = spark.createDataFrame(extra, "path string, mtime timestamp, content string")
    rows = listed.where(~F.col("path").startswith(OWN)).join(texts, "path", "left").select("path", F.col("modified").alias("mtime"), "content").unionByName(documents)
    return rows.select(F.lit(Path(root).resolve().name).alias("repo"), "path", "content", "mtime")


def write_document(root: str, name: str, text: str) -> None:
    target = Path(root) / OWN / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)


def discover(spark: SparkSession, root: str, commits: int | None = None, output: str | None = None) -> DataFrame:
    """Builds the manifest, writes it as JSON and returns its row; the number of commits is asked from version control unless given."""
    commits = git.log(spark, root).first()["n_commits"] if commits is None else commits
    files = collection(spark, root).where(~F.col("path").startswith(OWN)).persist()
    history = files.select("repo").distinct().withColumn("n_commits", F.lit(commits).cast("long"))
    rows = M.manifest(files.select("repo", "path", "content"), history).persist()
    text = json.dumps(json.loads(M.documents(rows).first()["document"]), indent=2)
    if output:
        Path(output).write_text(text)
    else:
        write_document(root, "manifest.json", text)
    files.unpersist()
    return rows


def make_index(spark: SparkSession, root: str, output: str | None = None) -> I.Index:
    """Builds the index, from an earlier one's tables by difference, and writes its tables and its totals."""
    folder = output or str(Path(root) / OWN / "index")
    names = ("files", "symbols", "edges", "modules", "parsed", "resolved", "pairs")
    if all(Path(f"{folder}/{n}/_SUCCESS").exists() for n in names):
        old = {n: spark.read.parquet(f"{folder}/{n}") for n in names}
        links = I.delta.ImportGraph(old["parsed"], old["resolved"], old["pairs"], old["modules"].drop("role"))
        made = I.refresh(I.Index(old["files"], old["symbols"], old["edges"], old["modules"], old["parsed"], links), repo.with_language(repo.scan(spark, root)))
    else:
        made = I.build_from(spark, root)
    tables = {"files": made.files, "symbols": made.symbols, "edges": made.edges, "modules": made.modules, "parsed": made.parsed, "resolved": made.graph.resolved, "pairs": made.graph.pairs}
    if made.graph.resolved.inputFiles()[:1] == [x for x in spark.read.parquet(f"{folder}/resolved").inputFiles()[:1]] if Path(f"{folder}/resolved").is_dir() else False:
        tables = {}  # nothing has changed
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    top = [r.asDict() for r in made.top_files(20).collect()]
    meta = made.meta().first().asDict(True) | {"top_files": top}
    write_document(root, "index.json", json.dumps({"_meta": meta}, indent=2, default=str))
    return made


def tier_of(given: str | None, manifest: DataFrame) -> str:
    """The given tier, else that of the collection's complexity."""
    if given:
        return TIERS[given.lower()]
    return COMPLEXITY_TIERS.get(manifest.first()["archetype"]["complexity"], "full")


def generate(root: str, manifest: DataFrame, made: I.Index | None, tier: str, dry_run: bool = False) -> list[str]:
    """Renders and writes the documents of a tier; returns the paths that were written."""
    rows = manifest
    if made is not None:
        top = [r.path for r in made.top_files(20).where("importance > 0").collect()]
        rows = rows.withColumn("top_files", F.array(*map(F.lit, top)) if top else F.array().cast("array<string>"))
    documents = [(r.path, r.content) for r in render.documents(rows, tier).orderBy("path").collect()]
    if made is not None and tier in ("full", "enterprise"):
        documents += [(r.page_path, r.page) for r in render.entity_pages(made).collect()]
        lines = render.overview(made).orderBy("section", "line_no").collect()
        documents.append(("vault/wiki/concepts/architecture.md", "\n".join(f"{'## ' + r.section + chr(10) if r.line_no == 1 else ''}- {r.line}" for r in lines)))
    done = []
    for path, text in documents:
        target = str(Path(root) / path)
        written = dry_run or (sinks.write_owned(target, text) if path == V.GUIDE else sinks.write_text_if_missing(target, text + "\n"))
        if written and not dry_run and path.startswith(".githooks/"):
            Path(target).chmod(0o755)
        if written:
            done.append(path)
    return done


def verify(spark: SparkSession, root: str) -> DataFrame:
    """The checks of a tree; without version control .env doesn't count as tracked."""
    tracked = bool(git.log(spark, root).first()["env_tracked"])
    return V.checks(collection(spark, root), tracked).drop("repo").orderBy("name")


def show_checks(rows: DataFrame) -> int:
    """Prints the checks and their counts; 1 if any failed."""
    found = rows.collect()
    width = max((len(r.name) for r in found), default=0)
    for r in found:
        print(f"{r.status:4}  {r.name:{width}}  {r.detail}")
    counts = {s: sum(r.status == s for r in found) for s in ("PASS", "WARN", "FAIL")}
    print(", ".join(f"{n} {s}" for s, n in counts.items()))
    return 1 if counts["FAIL"] else 0


def remember(spark: SparkSession, root: str, manifest: DataFrame, made: I.Index | None, knowledge: str) -> None:
    """Upserts the collection's entry; totals that this run doesn't know stay."""
    totals = made.meta() if made is not None else None
    entry = manifest.select(
        F.col("identity.short_name").alias("repo_name"), F.lit(str(Path(root).resolve())).alias("repo_path"), F.col("identity.version").alias("version"), F.lit(datetime.now(timezone.utc).isoformat()).alias("timestamp"),
        F.col("stack.language").alias("language"), F.col("stack.framework").alias("framework"), F.col("archetype.archetype").alias("archetype"),
    )
    if totals is not None:
        entry = entry.crossJoin(totals.select("total_files", "total_symbols", "total_edges", "languages"))  # one row each
    else:
        entry = entry.selectExpr("*", "CAST(NULL AS BIGINT) AS total_files", "CAST(NULL AS BIGINT) AS total_symbols", "CAST(NULL AS BIGINT) AS total_edges", "CAST(NULL AS MAP<STRING, BIGINT>) AS languages")
    sinks.upsert(spark, knowledge, entry, fill=("total_files", "total_symbols", "total_edges", "languages"))


def run(spark: SparkSession, root: str, with_index: bool = True, tier: str | None = None, dry_run: bool = False, knowledge: str = str(KNOWLEDGE), commits: int | None = None) -> int:
    """The whole pipeline; a dry run writes manifest and index only."""
    manifest = discover(spark, root, commits)
    made = make_index(spark, root) if with_index else None
    done = generate(root, manifest, made, tier_of(tier, manifest), dry_run)
    print(f"{'would write' if dry_run else 'wrote'} {len(done)} documents: {', '.join(done)}")
    if dry_run:
        return 0
    status = show_checks(verify(spark, root))
    remember(spark, root, manifest, made, knowledge)
    return status


def refresh(spark: SparkSession, root: str, tier: str | None = None) -> bool:
    """Builds all anew if a source is newer than the manifest; unchanged files aren't parsed again."""
    stored = Path(root) / OWN / "manifest.json"
    if stored.exists() and not I.source_newer(repo.listing(spark, root), datetime.fromtimestamp(stored.stat().st_mtime)):
        return False
    manifest = discover(spark, root)
    generate(root, manifest, make_index(spark, root), tier_of(tier, manifest))
    return True


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fathomline", description=__doc__)
    commands = parser.add_subparsers(dest="command")
    for name in ("index", "run", "discover", "generate", "verify", "refresh", "report", "serve", "stats"):
        sub = commands.add_parser(name)
        sub.add_argument("--target", default=".")
        sub.add_argument("--output")
        sub.add_argument("--tier", choices=sorted(TIERS), type=str.lower)
        sub.add_argument("--no-index", action="store_true")
        sub.add_argument("--dry-run", action="store_true")
        sub.add_argument("--summary", action="store_true")
        sub.add_argument("--commits", type=int)
        sub.add_argument("--knowledge", default=str(KNOWLEDGE))
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("fathomline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command is None:
        hint = start_hint(collection(spark, "."), (V.GUIDE, V.MANIFEST)).first()
        print(f"{hint.state}{': ' + hint.language if hint.language else ''}; see --help")
        return 0
    root = given.target
    if given.command == "index":
        meta = make_index(spark, root, given.output).meta().first()
        print(f"{meta.total_files} files, {meta.total_symbols} symbols, {meta.total_edges} edges" if given.summary else json.dumps(meta.asDict(True), default=str))
    elif given.command == "run":
        return run(spark, root, not given.no_index, given.tier, given.dry_run, given.knowledge, given.commits)
    elif given.command == "discover":
        manifest = discover(spark, root, given.commits, given.output)
        if not given.no_index:
            make_index(spark, root)
        remember(spark, root, manifest, None, given.knowledge)
    elif given.command == "generate":
        manifest = discover(spark, root, given.commits)
        print("\n".join(generate(root, manifest, None if given.no_index else make_index(spark, root), tier_of(given.tier, manifest), given.dry_run)))
    elif given.command == "verify":
        return show_checks(verify(spark, root))
    elif given.command == "refresh":
        print("refreshed" if refresh(spark, root, given.tier) else "up to date")
    elif given.command == "report":
        print(discover(spark, root, given.commits).select(render.report().alias("text")).first()["text"])
    elif given.command == "serve":
        load = lambda: server.Served(make_index(spark, root), discover(spark, root, given.commits))
        served = load()
        served.refresh = load
        for answer in server.serve(served, sys.stdin):
            print(answer, flush=True)
    else:
        row = sinks.stats(sinks.read_newest(spark, given.knowledge)).first()
        print(f"{row.repos} collections, {row.files} files, {row.symbols} symbols, {', '.join(row.languages)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
