"""Approximate nearest neighbours by inner product: hierarchical k-means tree, best bin first.

Inner-product search becomes Euclidean by one more coordinate, ``sqrt(M^2 - |v|^2)`` with M the
largest norm (0 for queries). A k-means tree of that space is fitted on a bounded sample
(``SAMPLE`` vectors with the smallest hashes); every row of the table is then indexed in it. A
query walks the tree with a priority queue over unvisited nodes, nearest centre first, and visits
leaves until it has as many as the calibration asks for: the smallest number at which the true
neighbours of ``CALIBRATION`` queries, found by brute force over all rows, are met to the recall
wanted. Best bin first meets leaves in the order of the largest distance on their path, so the order
is found for many queries at once; leaves with the last distance that is visited are visited all.
Candidates meet queries block by block, a block being neighbouring leaves of about ``BLOCK_ROWS`` rows
or a part of a larger leaf, and ``ASKERS`` queries at a time: a task holds no more of either,
and ``PAIRS`` of their products at once, however large the table is.

Equal vectors are stored once with their k + 1 smallest ids, which is all that an answer of k can
hold, so a vector with a third of all rows costs no more than another. Scores are sums of double
products, row by row, so equal vectors score alike.

Edge cases: vectors that are null, empty, zero, hold null, NaN or infinite components, or differ
in length from the most frequent length (the smaller on a tie) take no part; fewer than k
candidates give fewer answers; ties go to the smaller id; repeated ids are separate rows that
exclude each other as their own; a row without an id takes no part; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SAMPLE, CALIBRATION, BRANCH, LEAF_ROWS, BLOCK_ROWS, LEAST_BLOCK = 40_000, 200, 8, 200, 32_768, 512
#: Queries of a slice, pairs of a query and a row that are scored at once, and columns of which only the best is looked at first.
ASKERS, PAIRS, STRIDE = 16_384, 1 << 20, 64


class Tree:
    """Centres of a hierarchical k-means tree; a leaf has no children."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int = 7):
        self.centres, self.children, parent = [sample.mean(0) if len(sample) else sample.sum(0)], [[]], [0]
        self.leaf_of: dict[int, int] = {}
        rng, todo = np.random.default_rng(seed), [(0, sample)]
        while todo:
            node, points = todo.pop()
            groups = self.split(points, rng) if len(points) > leaf else []
            if len(groups) < 2:
                self.leaf_of[node] = len(self.leaf_of)
                continue
            for group in groups:
                self.centres.append(group.mean(0))
                self.children.append([])
                parent.append(node)
                self.children[node].append(len(self.centres) - 1)
                todo.append((len(self.centres) - 1, group))
        self.points, self.parent = np.array(self.centres), np.array(parent)
        self.norm2, self.ends = (self.points**2).sum(1), np.array(sorted(self.leaf_of, key=self.leaf_of.get))
        self.levels, level = [], np.array(self.children[0], int)
        while len(level):
            self.levels.append(level)
            level = np.array([kid for node in level for kid in self.children[node]], int)

    @staticmethod
    def split(points: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        centres = points[rng.choice(len(points), min(BRANCH, len(points)), replace=False)]
        nearest = np.zeros(len(points), int)
        for _ in range(8):
            nearest = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
            centres = np.array([points[nearest == c].mean(0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        nearest = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        return [points[nearest == c] for c in range(len(centres)) if (nearest == c).any()]

    def place(self, points: np.ndarray) -> np.ndarray:
        """Leaf of every point, going to the nearest child at each node."""
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            kids = np.array(self.children[node])
            centres = self.points[kids]
            nearest = ((centres**2).sum(1) - 2 * points[rows] @ centres.T).argmin(1)
            todo += [(kid, rows[nearest == k]) for k, kid in enumerate(kids)]
        return out

    def order(self, queries: np.ndarray) -> np.ndarray:
        """(query, leaf) numbers by which best-bin-first traversal meets the leaves: the largest distance on the path, less the query's own part."""
        key = self.norm2[:, None] - 2 * self.points @ queries.T
        key[0] = -np.inf
        for level in self.levels:
            key[level] = np.maximum(key[level], key[self.parent[level]])
        return key[self.ends].T


def usable(vectors: Column) -> Column:
    x = vectors.cast("array<double>")
    return vectors.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return np.concatenate(flat).astype(np.float64).reshape(len(column), -1)


def _scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return (rows * query).sum(1)


def _top(query: np.ndarray, rows: np.ndarray, rough: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows by (score, id) among those near the top of the rough scores."""
    if len(rows) > 2 * k:
        bound = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= bound - 1e-9 * (1 + abs(bound)))
    else:
        near = np.arange(len(rows))
    score = _scores(query, rows[near])
    order = np.lexsort((first[near], -score))[:k]
    return near[order], score[order]


def _met(queries: np.ndarray, visited: np.ndarray, points: np.ndarray, sizes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows by (score, id) in the leaves that it visits; rows lie leaf by leaf, ``sizes`` of each."""
    wide, found = -(-len(points) // STRIDE) * STRIDE, []
    most = max(1, PAIRS // wide)
    for at in range(0, len(queries), most):
        own = queries[at : at + most]
        rough = np.full((len(own), wide), -np.inf)
        rough[:, : len(points)] = own @ points.T
        np.copyto(rough[:, : len(points)], -np.inf, where=np.repeat(~visited[at : at + most], sizes, axis=1))
        # At least 2 * k columns reach the 2 * k-th best of the strides' best ones; that leaves room for products that differ in the last place.
        best = rough.reshape(len(own), -1, STRIDE).max(2) if wide >= 2 * k * STRIDE else rough
        n = min(2 * k, best.shape[1])
        bound = np.partition(best, best.shape[1] - n, axis=1)[:, best.shape[1] - n]
        who, row = np.nonzero((rough >= (bound - 1e-9 * (1 + np.abs(bound)))[:, None]) & (rough > -np.inf))
        score = (own[who] * points[row]).sum(1)
        order = np.lexsort((first[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        near = np.arange(len(who)) - np.searchsorted(who, np.arange(len(own)))[who] < k
        found.append((who[near] + at, row[near], score[near]))
    return tuple(np.concatenate(x) for x in zip(*found))


def search(df: DataFrame, is_query: Column, k: int = 20, recall: float = 0.94, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for every row where ``is_query`` holds."""
    spark = df.sparkSession
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"  # floats are stored as they are, and scored as doubles
    rows = df.where(usable(df[vector_col]) & df[id_col].isNotNull()).select(df[id_col].cast("long").alias("id"), df[vector_col].cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double").withColumnRenamed("id", id_col)
    if not dims:
        return empty
    rows = rows.where(F.size("v") == dims[0].dim)
    by_vector = Window.partitionBy("v").orderBy("id")
    few = rows.select("v", "id").withColumn("rn", F.row_number().over(by_vector)).where(F.col("rn") <= k + 1)
    items = materialise(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    asked = materialise(rows.where("asks").select(F.col("id").alias("query_id"), "v"))
    questions = asked.groupBy("v").agg(F.min("query_id").alias("q"))
    count, top = items.agg(F.count("*"), F.max("norm2")).first()
    hashed = lambda d: d.orderBy(F.xxhash64("v"), "v")
    sample = _rows(hashed(items.select("v")).limit(SAMPLE).toArrow()["v"])
    lift = lambda x: np.column_stack([x, np.sqrt(np.maximum(top - (x**2).sum(1), 0))])
    tree = Tree(lift(sample), max(2, int(LEAF_ROWS * len(sample) / count)))
    shared = spark.sparkContext.broadcast(tree)

    trial = hashed(questions).limit(CALIBRATION).toPandas()
    if not len(trial):
        return empty
    probe = spark.sparkContext.broadcast(_matrix(trial["v"]))

    def brute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = _matrix(frame["v"])
            first, leaf, rough = frame["id"].to_numpy(), shared.value.place(lift(points)), points @ probe.value.T
            near = [_top(query, points, rough[:, i], first, k + 1) for i, query in enumerate(probe.value)]
            rows = np.concatenate([x for x, _ in near])
            yield pd.DataFrame({"i": np.repeat(np.arange(len(near)), [len(x) for x, _ in near]), "leaf": leaf[rows], "first": first[rows], "score": np.concatenate([x for _, x in near])})

    found = items.select("v", F.col("ids")[0].alias("id")).mapInPandas(brute, "i int, leaf long, first long, score double")
    best = Window.partitionBy("i").orderBy(F.desc("score"), "first")
    truth = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).select("i", "leaf").toPandas()
    total = len(tree.leaf_of)
    met = np.zeros(total)
    for i, leaves in truth.groupby("i")["leaf"]:
        key = tree.order(np.append(probe.value[i], 0.0)[None])[0]
        met += np.bincount(np.searchsorted(np.sort(key), key[leaves.to_numpy()]), minlength=total)
    # Widened by one step beyond the calibrated number, as other queries vary.
    visits = min(total, int(1.03 * (np.searchsorted(np.cumsum(met) / max(met.sum(), 1), recall) + 1)) + 1)

    placed_of = lambda frames: (pd.DataFrame({"leaf": shared.value.place(lift(_matrix(f["v"]))), "first": f["first"], "v": f["v"]}) for f in frames)
    placed = materialise(items.select(F.col("ids")[0].alias("first"), "v").mapInPandas(placed_of, f"leaf long, first long, v {kind}"))
    sizes = dict.fromkeys(range(total), 0) | {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # as many as the tree has leaves
    # Blocks of a small table are smaller, so that all cores have some.
    block_rows = max(LEAST_BLOCK, min(BLOCK_ROWS, count // (4 * spark.sparkContext.defaultParallelism)))
    group, parts, at, held = {}, {}, 0, 0
    for leaf in range(total):  # leaves are numbered along the tree
        if held and held + sizes[leaf] > block_rows:
            at, held = at + 1, 0
        group[leaf], parts[leaf], held = at, max(1, -(-sizes[leaf] // block_rows)), held + sizes[leaf]
    begin = np.searchsorted(np.array([group[leaf] for leaf in range(total)]), np.arange(at + 2))  # of each group's leaves
    layout = spark.sparkContext.broadcast((begin, [parts[leaf] for leaf in begin[:-1].tolist()]))  # a leaf of several parts is a group
    slices = max(1, -(-questions.count() // ASKERS))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, parts = layout.value
        for whole in batches:
            for batch in (whole.slice(n, 512) for n in range(0, len(whole), 512)):
                queries = _rows(batch["v"])
                order = shared.value.order(np.column_stack([queries, np.zeros(len(queries))]))
                visited = order <= np.partition(order, visits - 1, axis=1)[:, visits - 1 : visits]
                for g in range(len(parts)):
                    own = visited[:, begin[g] : begin[g + 1]]
                    who = np.flatnonzero(own.any(1))
                    leaves = pa.array([x.tobytes() for x in np.packbits(own[who], axis=1)], pa.binary())
                    for b in range(parts[g] if len(who) else 0):
                        same = lambda n: pa.array(np.full(len(who), n), pa.int32())
                        yield pa.RecordBatch.from_arrays([same(g), same(b), batch["slice"].take(who), batch["q"].take(who), leaves, batch["v"].take(who)], ["grp", "block", "slice", "q", "leaves", "v"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        begin, _ = layout.value
        g = left["grp"][0].as_py()
        leaf = right["leaf"].to_numpy() - begin[g]
        order = np.argsort(leaf, kind="stable")
        points, first = _rows(right["v"])[order], right["first"].to_numpy()[order]
        n = int(begin[g + 1] - begin[g])
        visited = np.unpackbits(np.frombuffer(b"".join(left["leaves"].to_pylist()), np.uint8).reshape(len(left), -1), axis=1, count=n).astype(bool)
        who, row, score = _met(_rows(left["v"]), visited, points, np.bincount(leaf, minlength=n), first, k + 1)
        return pa.table([left["q"].to_numpy()[who], first[row], score], schema=schema)

    numbers = spark.createDataFrame([(leaf, group[leaf], parts[leaf]) for leaf in range(total)], "leaf long, grp int, parts int")
    stored = placed.join(F.broadcast(numbers), "leaf").withColumn("block", F.pmod(F.xxhash64("first"), F.col("parts")).cast("int"))
    keys = ["grp", "block", "slice"]
    sliced = questions.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(slices)).cast("int").alias("slice"))
    walks = sliced.repartition(spark.sparkContext.defaultParallelism).mapInArrow(walk, f"grp int, block int, slice int, q long, leaves binary, v {kind}")
    stored = stored.select("grp", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "leaf", "first", "v")
    hits = walks.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(answer, "q long, first long, score double")
    kept = hits.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first"))).where(F.col("rn") <= k + 1)
    lists = items.select(F.col("ids")[0].alias("first"), "ids")
    # Every distinct question's neighbours in order, at most (k + 1)^2 ids; then each row's own id leaves.
    answers = kept.drop("rn").join(lists, "first").groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids"))).alias("near"))
    flat = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["s"].alias("s"), i.alias("id")))))
    answers = answers.select("q", F.slice(F.array_sort(flat), 1, k + 1).alias("near"))
    by_row = asked.join(questions, "v").select("query_id", "q").join(answers, "q")
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return by_row.select("query_id", F.posexplode(own).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.s")).alias("score"))
