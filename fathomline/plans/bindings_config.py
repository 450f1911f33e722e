"""Readers, rules and lookups bound to small configuration texts made of ``part`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import paths as P
from ..operators import classify as C
from ..operators import tables as O
from ..sources import readers as L
from ..sources import repo as R
from .bindings import EDGES, FILES, _PAGERANK, files, g1, links, read

_K = "p_partkey::VARCHAR"


def made(spark, sf, *parts: Column | str) -> DataFrame:
    """(path, content): one text per part; strings are literal, columns are cast."""
    columns = [F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]
    return read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(*columns).alias("content"))


def split(df: DataFrame) -> DataFrame:
    return df.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))


def key() -> Column:
    return F.col("p_partkey")


@query("s5_ext_dispatch", f"WITH {FILES} SELECT path FROM files WHERE regexp_extract(path, '\\.([^./]*)$', 1) IN ('py', 'go', 'rs')")
def s5(spark, sf):
    parsers = spark.createDataFrame([("py",), ("go",), ("rs",)], "ext string")
    return files(spark, sf).withColumn("ext", P.extension(F.col("path"))).join(F.broadcast(parsers), "ext").select("path")  # a fixed table


@query("s9_toml_kv", f"SELECT {_K} AS path, 'part-' || p_partkey AS value FROM part")
def s9(spark, sf):
    return R.key_values(split(made(spark, sf, "[package]\nname = \"part-", key(), "\"\nnamespace = \"x\"\n")), "name")


@query("s10_env_file", f"SELECT {_K} AS path, unnest(['A_KEY', 'PORT']) AS name, unnest(['v' || p_partkey, '80']) AS value FROM part")
def s10(spark, sf):
    return L.env_entries(split(made(spark, sf, "# c\nA_KEY=v", key(), "\nlower=1\n\nPORT=80"))).select("path", "name", "value")


@query("s11_dockerfile", f"SELECT {_K} AS path, unnest(['MODE', 'V' || p_size]) AS name FROM part")
def s11(spark, sf):
    return L.docker_env(split(made(spark, sf, "FROM base\nENV MODE=x\nRUN y\nARG V", F.col("p_size"), "\n")))


@query("s14_makefile", f"SELECT {_K} AS path, unnest(['lint', 't' || p_partkey]) AS target FROM part")
def s14(spark, sf):
    return L.make_targets(split(made(spark, sf, ".PHONY: all\nlint:\n\tx: y\nt", key(), ": lint\n%.o: %.c\nA := 1"))).select("path", "target")


@query("s18_read_knowledge", f"SELECT {_K} AS path, p_brand AS repo, p_size::BIGINT AS total FROM part")
def s18(spark, sf):
    doc = L.knowledge(F.col("content"), "repo string, total long")
    return made(spark, sf, '{"repo": "', F.col("p_brand"), '", "total": ', F.col("p_size"), "}").select("path", doc["repo"].alias("repo"), doc["total"].alias("total"))


@query("s19_requirements", f"SELECT {_K} AS path, unnest(['flask', 'lib' || p_partkey]) AS name FROM part")
def s19(spark, sf):
    return L.requirements(split(made(spark, sf, "flask==1\n# c\n-r x\nlib", key(), ">=2; y\n")))


@query("s20_pkg_json_deps", f"SELECT {_K} AS path, 'a,b' || p_size || ',c' AS deps FROM part")
def s20(spark, sf):
    return made(spark, sf, '{"dependencies": {"c": 1, "b', F.col("p_size"), '": 2, "a": 3}}').select("path", F.array_join(L.package_dependencies(F.col("content")), ",").alias("deps"))


@query("x7_compose_var_refs", f"SELECT {_K} AS path, 'DB,P' || p_size AS refs FROM part")
def x7(spark, sf):
    return made(spark, sf, "a: ${P", F.col("p_size"), ":-1}\nb: ${DB}\nc: ${DB}\n").select("path", F.array_join(L.references(F.col("content"), r"\$\{([A-Z_][A-Z0-9_]*)"), ",").alias("refs"))


_EXT = "regexp_extract(path, '\\.([^./]*)$', 1)"


@query("j13_name_in_language", f"WITH {FILES}, n AS (SELECT CASE {_EXT} WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'rb' THEN 'ruby' WHEN 'sh' THEN 'bash' WHEN 'java' THEN 'java' WHEN 'cs' THEN 'csharp' WHEN 'php' THEN 'php' WHEN 'kt' THEN 'kotlin' WHEN 'swift' THEN 'swift' ELSE 'elixir' END AS language, count(*) AS n FROM files GROUP BY 1) SELECT language, least(n, 10)::BIGINT AS score FROM n")
def j13(spark, sf):
    return C.language_scores(files(spark, sf))


@query("t2_get_top_files", f"{_PAGERANK} SELECT id, importance FROM imp ORDER BY importance DESC, id LIMIT 10")
def t2(spark, sf):
    return O.top(g1(spark, sf), [F.desc("importance"), "id"], 10)


@query("t8_sort_dedup", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) = 3))), ' ') AS words FROM documents")
def t8(spark, sf):
    words = F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) == 3)
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("words"))


@query("j4_pagerank_step", f"WITH {EDGES}, o AS (SELECT source, count(*) AS od FROM edges GROUP BY 1) SELECT target AS id, round(sum(1.0::DOUBLE / od), 9) AS received FROM edges JOIN o USING (source) GROUP BY 1")
def j4(spark, sf):
    e = links(spark, sf)
    degree = e.groupBy("source").agg(F.count("*").alias("od"))
    return e.join(degree, "source").groupBy(F.col("target").alias("id")).agg(F.round(F.sum(1 / F.col("od")), 9).alias("received"))


