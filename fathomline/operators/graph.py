"""Import resolution, dependency edges, module rollups and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.shared import written

#: Damping and number of iterations.
DAMPING, ITERATIONS = 0.85, 20
#: Rounds that one plan holds: longer plans take longer to plan than a table of ranks takes to write.
CUT = 5
#: Files and imports of one stem that are sorted together.
CROWD = 100_000
#: Edges of a partition of ranks: as few partitions as the first asks for, as many as the second does.
LEAST_PART, MOST_PART = 20_000, 2_000_000
#: Most sources whose edges are dealt by both ends, and the degree from which on a source may be one.
MOST_CUT, LEAST_CUT = 1_000, 100_000


def path_keys(files: DataFrame) -> DataFrame:
    """(key, target): every path and its extension-less form; the later path wins a clash."""
    both = files.select(F.col("path").alias("key"), "path").unionByName(files.where(F.col("path").contains(".")).select(paths.strip_extension(F.col("path")).alias("key"), "path"))
    return both.groupBy("key").agg(F.max("path").alias("target"))


def _around(stems: DataFrame, asks: DataFrame, crowd: int) -> DataFrame:
    """``asks`` (stem, at, source) with the stem's paths next to ``at`` in order: ``before``, at or before it, and ``after``, at or after it.

    Rows of a stem are sorted together. A stem with more than ``crowd`` rows is cut into ranges of its
    paths instead, each as large as any other's, and what the rows of a range miss at its ends is
    carried over from the nearest range that has it. A ``crowd`` of 0 says that there is no such stem.
    """
    rows = stems.select("stem", "at", F.lit(1).alias("file"), F.lit(None).cast("string").alias("source")).unionByName(asks.select("stem", "at", F.lit(0).alias("file"), "source"))
    path = F.when(F.col("file") == 1, F.col("at"))
    # Both ways a frame only grows, so each is one pass over sorted rows; a path at the place itself counts both ways.
    ahead = lambda *keys: Window.partitionBy(*keys).orderBy("at", F.desc("file")).rowsBetween(Window.unboundedPreceding, 0)
    back = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("file")).rowsBetween(Window.unboundedPreceding, 0)
    found = lambda t, *keys: t.select("*", F.last(path, True).over(ahead(*keys)).alias("before"), F.last(path, True).over(back(*keys)).alias("after")).where("file = 0")
    crowded = rows.groupBy("stem").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    total = crowded.agg(F.sum("n")).first()[0] if crowd else 0
    if not total:
        return found(rows, "stem").select("stem", "source", "before", "after")
    crowded = F.broadcast(written(crowded.select("stem")))  # each of them has more than ``crowd`` rows, so they are few
    ranges = max(2, -(-total // crowd))
    cut = written(rows.join(crowded, "stem", "left_semi").repartitionByRange(ranges, "stem", "at", "file", F.xxhash64("source")).withColumn("part", F.spark_partition_id()))
    ends = cut.where("file = 1").groupBy("stem", "part").agg(F.max("at").alias("last"), F.min("at").alias("first"))
    parts = cut.select("stem", "part").distinct().join(ends, ["stem", "part"], "left")
    others = Window.partitionBy("stem").orderBy("part")
    carried = parts.select("stem", "part", F.last("last", True).over(others.rowsBetween(Window.unboundedPreceding, -1)).alias("from_before"), F.first("first", True).over(others.rowsBetween(1, Window.unboundedFollowing)).alias("from_after"))
    near = found(cut, "part", "stem").join(F.broadcast(carried), ["stem", "part"])  # a range has its first stem and its last in common with others: two rows a range, and one for each stem
    wide = near.select("stem", "source", F.coalesce("before", "from_before").alias("before"), F.coalesce("after", "from_after").alias("after"))
    return found(rows.join(crowded, "stem", "left_anti"), "stem").select("stem", "source", "before", "after").unionByName(wide)


def _nearest_of_stem(files: DataFrame, wanted: DataFrame, crowd: int) -> DataFrame:
    """(source, import, target): of the files whose stem is the import, the one that shares the longest prefix with the source.

    In path order the longest prefix is shared by the source's neighbour before or after; the first
    path with that prefix then is the next one from the prefix on. Two searches, no pairs.
    """
    stems = files.select(paths.stem(F.col("path")).alias("stem"), F.col("path").alias("at"))
    near = _around(stems, wanted.select(F.col("import").alias("stem"), F.col("source").alias("at"), "source"), crowd).where("before is not null or after is not null")
    shared = lambda c: F.coalesce(paths.common_prefix(F.col("source"), F.col(c)), F.lit(0))
    starts = near.select("stem", F.left("source", F.greatest(shared("before"), shared("after"))).alias("at"), "source")
    return _around(stems, starts, crowd).select("source", F.col("stem").alias("import"), F.col("after").alias("target"))


def _unaligned(known: DataFrame, asked: DataFrame) -> DataFrame:
    """(k, target): the smallest path that ends with ``k``, which holds a slash, wherever in a name it begins.

    A path's endings at component borders are matched with what follows the first slash of ``k``;
    only those that are asked for are then extended letter by letter into the component before.
    """
    rest = F.expr("substring(k, instr(k, '/') + 1)")
    ends = asked.select(rest.alias("tail")).distinct()
    parts = F.split("path", "/")
    at = lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("tail"), F.get(parts, i - 2).alias("before"))
    cut = known.where(F.col("path").contains("/")).select("path", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), at)).alias("e")).select("path", "e.*")
    met = cut.join(ends, "tail", "left_semi")
    starts = F.explode(F.sequence(F.lit(0), F.length("before")))
    grown = met.select("path", "tail", "before", starts.alias("n")).select(F.concat(F.expr("right(before, n)"), F.lit("/"), "tail").alias("k"), "path")
    return grown.groupBy("k").agg(F.min("path").alias("target"))


def resolve_imports(files: DataFrame, imports: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(source, import, target, tier): the first of five ways that finds a file wins.

    1 exact path or stripped path; 2 the same beside the source; 3 a path that ends in the import
    (with a /), at a component's border or else anywhere; 4 the file stem, by the longest prefix
    shared with the source; 5 dots as slashes, exact or as a path's end. Where several paths end
    alike the smallest counts. All ways but the fourth are one equi-join: an import asks with a key a way.
    """
    keys = path_keys(files)
    known = keys.select(F.col("target").alias("path")).distinct()
    wanted = imports.select("source", "import").distinct()
    x, folder = F.col("import"), paths.dirname(F.col("source"))
    as_path = F.replace(x, F.lit("."), F.lit("/"))
    slashed, dotted = x.contains("/"), x.contains(".")
    # (kind of key, key, tier, rank); a way that doesn't apply has no key.
    ways = [("path", x, 1, 1), ("path", F.when(folder != "", F.concat_ws("/", folder, x)), 2, 2), ("tail", F.when(slashed, x), 3, 3), ("end", F.when(slashed, x), 3, 4), ("path", F.when(dotted, as_path), 5, 6), ("end", F.when(dotted, as_path), 5, 7)]
    made = F.array(*(F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.lit(tier).alias("tier"), F.lit(rank).alias("rank")) for kind, k, tier, rank in ways))
    asked = wanted.select("source", "import", F.explode(F.filter(made, lambda w: w["k"].isNotNull())).alias("w")).select("source", "import", "w.*")
    ends = _unaligned(known, asked.where("kind = 'end'").select("k"))
    tails = known.select(F.explode(paths.suffixes(F.col("path"))).alias("k"), "path").groupBy("k").agg(F.min("path").alias("target"))
    answers = keys.select(F.lit("path").alias("kind"), F.col("key").alias("k"), "target").unionByName(tails.withColumn("kind", F.lit("tail"))).unionByName(ends.withColumn("kind", F.lit("end")))
    found = asked.join(answers, ["kind", "k"]).select("source", "import", "target", "tier", "rank")
    crowd = crowd if files.count() + imports.count() > crowd else 0
    nearest = _nearest_of_stem(files, wanted.where(~slashed), crowd).select("source", "import", "target", F.lit(4).alias("tier"), F.lit(5).alias("rank"))
    return found.unionByName(nearest).groupBy("source", "import").agg(F.min_by(F.struct("target", "tier"), "rank").alias("best")).select("source", "import", "best.*")


def edges(resolved: DataFrame) -> DataFrame:
    """Resolved imports but those of a file itself; two imports of one file are two edges."""
    return resolved.where("target is not null and target <> source").select("source", "target", F.lit("import").alias("type"))


def module_rollup(files: DataFrame, links: DataFrame) -> DataFrame:
    """(module, n_files, total_symbols, fan_in, fan_out); links inside a module count on both sides."""
    own = files.groupBy(paths.dirname(F.col("path")).alias("module")).agg(F.count("*").alias("n_files"), F.sum("n_symbols").alias("total_symbols"))
    out = links.groupBy(paths.dirname(F.col("source")).alias("module")).agg(F.count("*").alias("fan_out"))
    into = links.groupBy(paths.dirname(F.col("target")).alias("module")).agg(F.count("*").alias("fan_in"))
    return own.join(out, "module", "left").join(into, "module", "left").fillna(0, ["fan_in", "fan_out"])


def module_edges(links: DataFrame) -> DataFrame:
    """(source, target): distinct pairs of directories that links lead between."""
    pairs = links.select(paths.dirname(F.col("source")).alias("source"), paths.dirname(F.col("target")).alias("target"))
    return pairs.where("source <> target").distinct()


def circular(pairs: DataFrame) -> DataFrame:
    """(module, circular_deps): modules that import each other; ``pairs`` (source, target) of modules."""
    one = pairs.where("source <> target").select("source", "target").distinct()
    back = one.select(F.col("target").alias("source"), F.col("source").alias("target"))
    both = one.join(back, ["source", "target"])
    return both.groupBy(F.col("source").alias("module")).agg(F.sort_array(F.collect_set("target")).alias("circular_deps"))


def pagerank(links: DataFrame, iterations: int = ITERATIONS, least_cut: int = LEAST_CUT) -> DataFrame:
    """(id, rank): fixed iterations, multiple edges count, mass of vertices without edges is lost.

    Vertices are numbered, so rounds move whole numbers. Weighted edges are dealt and sorted by source and
    vertices by number once and kept so; a round then shuffles only the sums that the edges send, as these arrive
    dealt by their target, which is the next round's source. Edges of a source with more than a
    ``MOST_CUT``-th of all (and than ``least_cut``) are dealt by both ends instead: its rank goes to all of them, and its edges'
    sums merge as all others do. There can be no more than ``MOST_CUT`` such sources, so their ranks
    are the only ones that are broadcast. Ranks are cut from their lineage every ``CUT`` rounds by a written
    table, small next to the edges.
    """
    spark = links.sparkSession
    counted = written(links.groupBy("source", "target").agg(F.count("*").alias("n")))
    numbered = written(counted.select(F.explode(F.array("source", "target")).alias("id")).distinct().select("id", F.monotonically_increasing_id().alias("v")))
    n, edges = numbered.count(), counted.count()
    if not n:
        return numbered.select("id", F.lit(0.0).alias("rank"))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(shuffled, -(-edges // LEAST_PART)), -(-edges // MOST_PART))
    most = max(least_cut, -(-edges // MOST_CUT))
    sources = counted.groupBy("source").agg(F.sum("n").alias("total"), F.count("*").alias("degree")).join(numbered.select(F.col("id").alias("source"), F.col("v").alias("s")), "source")
    targets = numbered.select(F.col("id").alias("target"), F.col("v").alias("t"))
    weighted = written(counted.join(sources, "source").join(targets, "target").select("s", "t", (F.col("n") / F.col("total")).alias("weight"), (F.col("degree") > most).alias("cut")))

    fixed = _fixed_plans(spark, parts)
    numbers, weighted = fixed.read.parquet(*numbered.inputFiles()).select("v"), fixed.read.parquet(*weighted.inputFiles())
    light = weighted.where("not cut").select("s", "t", "weight").repartition(parts, "s").sortWithinPartitions("s").persist()
    vertices = numbers.repartition(parts, "v").sortWithinPartitions("v").persist()
    cut = light.count() < edges  # once they are there, the planner knows their partitions and order
    vertices.count()
    spread = weighted.where("cut").select("s", "t", "weight").repartition(parts, "s", "t").persist() if cut else None
    hubs = F.broadcast(written(weighted.where("cut").select("s").distinct())) if cut else None
    ranks, step = vertices.withColumn("rank", F.lit(1.0 / n)), 1 if cut else CUT  # hubs read the ranks a second time
    for i in range(iterations):
        sums = light.join(ranks.hint("merge"), light.s == ranks.v).select("t", (F.col("rank") * F.col("weight")).alias("sent"))
        if cut:
            own = ranks.join(hubs, ranks.v == hubs.s, "left_semi")
            sums = sums.unionByName(spread.join(F.broadcast(own), spread.s == own.v).select("t", (F.col("rank") * F.col("weight")).alias("sent")))
        sums = sums.groupBy("t").agg(F.sum("sent").alias("sent"))
        ranks = vertices.join(sums.hint("merge"), vertices.v == sums.t, "left").select("v", (F.lit((1 - DAMPING) / n) + DAMPING * F.coalesce("sent", F.lit(0.0))).alias("rank"))
        if i % step == step - 1 or i == iterations - 1:
            ranks = written(ranks)
    for kept in (light, vertices, spread):
        if kept is not None:
            kept.unpersist()
    return numbered.join(spark.read.parquet(*ranks.inputFiles()), "v").select("id", "rank")


def _fixed_plans(spark: SparkSession, parts: int) -> SparkSession:
    """A session whose plans aren't changed while they run: rounds know their partitions, and planning them anew after each stage costs more than it gives."""
    fixed = spark.newSession()
    fixed.conf.set("spark.sql.shuffle.partitions", str(parts))
    fixed.conf.set("spark.sql.adaptive.enabled", "false")
    return fixed


def importance(ranks: DataFrame) -> DataFrame:
    """(id, importance): ranks scaled so that the largest is 1000, rounded."""
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.round(F.col("rank") / F.col("top") * 1000)).otherwise(0).cast("long").alias("importance"))  # one row


def neighbours(links: DataFrame, node: str) -> DataFrame:
    """(direction, node) one hop around a vertex."""
    return links.where(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("target").alias("node")).unionByName(links.where(F.col("target") == node).select(F.lit("in").alias("direction"), F.col("source").alias("node")))
