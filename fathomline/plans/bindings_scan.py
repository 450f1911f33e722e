"""Scans bound to trees of real files: each row of ``part`` becomes a file, written by the executors and found again.

Folders ``d0`` to ``d49`` hold ``s0`` to ``s3``. Ignore files stand at the root, in every other folder and
among the excludes of the tree itself; the SQL says for each row whether they leave it out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sources import repo as R
from ..sources.shared import shared_path
from .bindings import read

FOLDERS, SUBFOLDERS = 50, 4
ENDINGS = ("py", "log", "tmp", "js", "dat")
#: Ignore files: of the tree, of its root, of each folder with an even number.
EXCLUDE, ROOT, EVEN = "# of this tree\nd7/s1/\n", "*.log\n/d1/\nnode_modules\n", "!f*0.log\n*.tmp\n/s3/\nd*/\n"
_PLACED: dict[tuple[str, str], str] = {}


def placed(spark: SparkSession, sf: str) -> str:
    """The root of the tree's files: written once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PLACED:
        i, at = F.col("p_partkey"), lambda n: (F.col("p_partkey") % n).cast("string")
        ending = F.get(F.array(*map(F.lit, ENDINGS)), (i % len(ENDINGS)).cast("int"))
        path = F.concat(F.lit("d"), at(FOLDERS), F.lit("/s"), F.floor(i / FOLDERS).cast("long") % SUBFOLDERS, F.lit("/f"), i, F.lit("."), ending)
        content = F.when(i % 5 == 4, F.concat(F.lit("a\0"), i)).otherwise(F.concat(F.lit("x = "), i, F.lit("\n")))
        rows = read(spark, sf, "part").select(path.alias("path"), content.alias("content"))
        even = rows.select(F.regexp_extract("path", r"^d(\d+)/", 1).cast("int").alias("d")).distinct().where("d % 2 = 0").select(F.concat(F.lit("d"), "d", F.lit("/.gitignore")).alias("path"), F.lit(EVEN).alias("content"))
        fixed = spark.range(2).select(F.when(F.col("id") == 0, ".gitignore").otherwise(".git/info/exclude").alias("path"), F.when(F.col("id") == 0, ROOT).otherwise(EXCLUDE).alias("content"))
        root = shared_path(spark, "tree")
        R.deposit(rows.unionByName(even).unionByName(fixed), root)
        _PLACED[key] = root
    return _PLACED[key]


_TEXT = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
_TREE = f"""t AS (SELECT p_partkey AS i, p_partkey % {FOLDERS} AS d, p_partkey // {FOLDERS} % {SUBFOLDERS} AS s, ['py', 'log', 'tmp', 'js', 'dat'][p_partkey % 5 + 1] AS ending FROM part),
 p AS (SELECT *, 'd' || d || '/s' || s || '/f' || i || '.' || ending AS path, CASE WHEN i % 5 = 4 THEN 2 + length(i::VARCHAR) ELSE 5 + length(i::VARCHAR) END AS size_bytes FROM t),
 kept AS (SELECT path, size_bytes, ending FROM p WHERE d <> 1 AND NOT (d = 7 AND s = 1) AND CASE WHEN d % 2 = 0 THEN s <> 3 AND ending <> 'tmp' AND (ending <> 'log' OR i % 10 = 0) ELSE ending <> 'log' END
  UNION ALL SELECT DISTINCT 'd' || d || '/.gitignore', {len(EVEN)}, '' FROM t WHERE d % 2 = 0 UNION ALL SELECT '.gitignore', {len(ROOT)}, '' FROM (SELECT count(*) FROM part))"""


@query("s3_tree_listing", f"WITH {_TREE} SELECT path, size_bytes::BIGINT AS size_bytes FROM kept")
def s3_tree(spark, sf) -> DataFrame:
    return R.listing(spark, placed(spark, sf), share=500).select("path", "size_bytes")


@query("s1_tree_scan", f"WITH {_TREE} SELECT path, size_bytes::BIGINT AS size_bytes, sha256(CASE WHEN ending IN ('py', 'js', 'log', 'tmp') THEN 'x = ' || regexp_extract(path, '/f([0-9]+)', 1) || chr(10) WHEN path = '.gitignore' THEN {_TEXT(ROOT)} ELSE {_TEXT(EVEN)} END) AS digest FROM kept WHERE ending <> 'dat'")
def s1_tree(spark, sf) -> DataFrame:
    return R.scan(spark, placed(spark, sf)).select("path", "size_bytes", F.sha2("content", 256).alias("digest"))
