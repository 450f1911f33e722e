"""Substring search over short texts by posting lists of their letter groups.

Every text is listed under each of its groups of one, two and three characters (lower case). A query
of three characters or more is looked up under its rarest group of three, a shorter one under itself; what the list
holds is then confirmed. Lists lie in folders by a hash of the group, so a single query
reads the folders of its groups only, and many queries are one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path, written

LONGEST, FOLDERS = 3, 64
#: As many queries are compared with every text, and as many groups are sent to all tasks.
FEW, SENT = 32, 100_000


def groups(text: Column, lengths: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The distinct groups of a text in lower case, of each length."""
    low = F.lower(text)
    at = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*map(at, lengths))))


def _folder(group: Column) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(FOLDERS)).cast("int")


def _asked(query: Column) -> Column:
    """The groups under which a query may be looked up."""
    return F.when(F.length(query) < LONGEST, F.array(F.lower(query))).otherwise(groups(query, (LONGEST,)))


def postings(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` under each group of the column ``text``, as a table in folders."""
    path = shared_path(rows.sparkSession, "postings")
    listed = rows.select("*", F.explode(groups(F.col(text))).alias("group")).withColumn("folder", _folder(F.col("group")))
    listed.repartition("folder", F.pmod(F.xxhash64("group", text), F.lit(8))).write.partitionBy("folder").parquet(path)  # a frequent group's list is several files
    return rows.sparkSession.read.schema(listed.schema).parquet(path)


def find(lists: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text contains ``query``, in whatever case; it isn't empty."""
    spark = lists.sparkSession
    own = spark.range(1).select(F.explode(_asked(F.lit(query))).alias("group")).withColumn("folder", _folder(F.col("group"))).collect()  # as many as the query has letters
    near = lists.where(F.col("folder").isin(*{r.folder for r in own}) & F.col("group").isin(*{r.group for r in own}))
    sizes = near.groupBy("group").agg(F.count("*").alias("n")).collect() if len(own) > 1 else []
    if len(own) > 1 and len(sizes) < len(own):
        return lists.limit(0).drop("group", "folder")  # a group that no text has
    rarest = min(sizes, key=lambda r: (r.n, r.group)).group if sizes else own[0].group
    folder = next(r.folder for r in own if r.group == rarest)
    return lists.where((F.col("folder") == folder) & (F.col("group") == rarest) & F.lower(text).contains(query.lower())).drop("group", "folder")


def find_many(lists: DataFrame, text: str, queries: DataFrame, exact: bool = False) -> DataFrame:
    """``queries`` (query) joined with the rows whose text contains them; ``exact`` minds the case."""
    asked = queries.where("query <> ''").distinct().select("query", F.explode(_asked(F.col("query"))).alias("group"))
    sizes = lists.join(F.broadcast(asked.select("group").distinct()) if queries.count() < 10_000 else asked.select("group").distinct(), "group", "left_semi").groupBy("group").agg(F.count("*").alias("n"))
    rarest = asked.join(sizes, "group", "left").groupBy("query").agg(F.min_by("group", F.struct(F.coalesce("n", F.lit(0)), "group")).alias("group"))
    met = rarest.join(lists, "group").drop("group", "folder")
    return met.where(F.col(text).contains(F.col("query")) if exact else F.lower(text).contains(F.lower("query")))


def find_among(rows: DataFrame, text: str, queries: DataFrame, exact: bool = False) -> DataFrame:
    """What ``find_many`` finds, of ``rows`` without posting lists: few queries are compared with every text, for more of them texts are listed, under the groups that are asked for only."""
    asked = written(queries.where("query <> ''").select("query").distinct())
    if asked.count() <= FEW:
        return rows.join(F.broadcast(asked), F.col(text).contains(F.col("query")) if exact else F.lower(text).contains(F.lower("query")))
    own = written(asked.select(F.explode(_asked(F.col("query"))).alias("group")).distinct())
    own = F.broadcast(own) if own.count() <= SENT else own
    return find_many(written(rows.select("*", F.explode(groups(F.col(text))).alias("group")).join(own, "group", "left_semi")), text, asked, exact)


def first_of_each(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1 as ``pos``."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("pos") <= n)
