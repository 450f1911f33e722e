"""The engine's operators bound to the shared tables, each with the SQL it must equal.

``documents`` stand for files: a path is made of source, language and id, with an extension that
cycles over thirteen. The supply graph of ``lineitem`` stands for imports between files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import paths as P
from ..functions import text as T
from ..operators import graph as G
from ..operators import tables as O
from ..sources import repo as R
from ..sources.shared import spread
from ..streaming import incremental as I

EXTS = (".py", ".ts", ".js", ".go", ".rs", ".rb", ".sh", ".java", ".cs", ".php", ".kt", ".swift", ".ex")
FILES = f"files AS (SELECT source || '/' || lang || '/doc_' || doc_id || ({list(EXTS)!r})[doc_id % 13 + 1] AS path, text AS content, doc_id, lang, source FROM documents)"
LINES = f"{FILES}, lines AS (SELECT path, doc_id, unnest(CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, '\\n$', ''), chr(10)) END) AS line FROM files)"
EDGES = "edges AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS source, CASE WHEN l_linenumber % 2 = 0 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS target FROM lineitem)"
_TRIM = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.get(F.array(*(F.lit(e) for e in EXTS)), (F.col("doc_id") % 13).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    return spread(read(spark, sf, "documents")).select(path.alias("path"), F.col("text").alias("content"), "doc_id", "lang", "source")


def links(spark: SparkSession, sf: str) -> DataFrame:
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    even = F.col("l_linenumber") % 2 == 0
    return read(spark, sf, "lineitem").select(F.when(even, s).otherwise(p).alias("source"), F.when(even, p).otherwise(s).alias("target")).distinct()


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("path", "doc_id", F.posexplode(T.lines(F.col("content"))).alias("line_no", "line"))


# ---- sources --------------------------------------------------------------------------------


@query("s2_exclude_dirs", f"WITH {FILES} SELECT path FROM files WHERE NOT starts_with(path, 'src1/') AND NOT starts_with(path, 'src7/') AND NOT contains(path, '/target/')")
def s2(spark, sf):
    return files(spark, sf).where(R.included(F.col("path"), ("src1/", "src7/"))).select("path")


@query("s4_sniff_shebang", "WITH d AS (SELECT doc_id, string_split((['#!/bin/bash', '#!/usr/bin/env python3', '#!/usr/bin/ruby', '#!/usr/bin/env node', 'plain'])[doc_id % 5 + 1] || chr(10) || text, chr(10))[1] AS first FROM documents) SELECT doc_id, CASE WHEN contains(first, '/bash') OR contains(first, '/sh') THEN 'sh' WHEN contains(first, 'python') THEN 'py' WHEN contains(first, 'ruby') THEN 'rb' WHEN contains(first, 'node') THEN 'js' END AS ext FROM d")
def s4(spark, sf):
    first = F.get(F.array(*(F.lit(x) for x in ("#!/bin/bash", "#!/usr/bin/env python3", "#!/usr/bin/ruby", "#!/usr/bin/env node", "plain"))), (F.col("doc_id") % 5).cast("int"))
    return read(spark, sf, "documents").select("doc_id", R.shebang_language(F.concat(first, F.lit("\n"), "text")).alias("ext"))


_LANG_SQL = "CASE regexp_extract(path, '\\.([^./]*)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'rb' THEN 'ruby' WHEN 'sh' THEN 'bash' WHEN 'java' THEN 'java' WHEN 'cs' THEN 'csharp' WHEN 'php' THEN 'php' WHEN 'kt' THEN 'kotlin' WHEN 'swift' THEN 'swift' WHEN 'ex' THEN 'elixir' END"


@query("s6_ext_to_language", f"WITH {FILES} SELECT path, regexp_extract(path, '\\.([^./]*)$', 1) AS ext, {_LANG_SQL} AS language FROM files")
def s6(spark, sf):
    return R.with_language(files(spark, sf)).select("path", "ext", "language")


@query("s7_text_guard", f"WITH {FILES} SELECT path FROM files WHERE NOT contains(content, chr(0))")
def s7(spark, sf):
    return files(spark, sf).where(R.readable(F.encode("content", "UTF-8"))).select("path")


@query("s8_read_json_doc", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s8(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("s17_jsonl_count", "SELECT event_type, count(*) AS n FROM events WHERE trim(props) <> '' GROUP BY 1")
def s17(spark, sf):
    return O.count_by(read(spark, sf, "events").where(T.trim(F.col("props")) != ""), "event_type")


# ---- text measures --------------------------------------------------------------------------


@query("p2_count_lines", f"WITH {FILES} SELECT path, (length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines FROM files")
def p2(spark, sf):
    return files(spark, sf).select("path", T.count_lines(F.col("content")).alias("lines"))


_WORDS_SQL = "len(list_filter(regexp_split_to_array(t, '[^\\p{L}\\p{N}_]'), lambda w: w IN ('if', 'elif', 'elsif', 'else', 'for', 'while', 'case', 'when', 'catch', 'except', 'rescue')))"


@query("p3_cyclomatic", f"WITH {LINES}, t AS (SELECT path, {_TRIM} AS t FROM lines) SELECT path, (1 + sum(CASE WHEN t = '' OR starts_with(t, '//') OR starts_with(t, '#') OR starts_with(t, '*') OR starts_with(t, '/*') THEN 0 ELSE {_WORDS_SQL} + (length(t) - length(replace(t, '&&', ''))) // 2 + (length(t) - length(replace(t, '||', ''))) // 2 + CASE WHEN contains(t, '?') AND contains(t, ':') THEN 1 ELSE 0 END END))::BIGINT AS complexity FROM t GROUP BY path")
def p3(spark, sf):
    return files(spark, sf).where("content <> ''").select("path", T.cyclomatic(F.col("content")).alias("complexity"))


@query("p5_code_patterns", f"WITH {LINES} SELECT path, concat_ws(',', CASE WHEN count(*) > 500 THEN 'large_file' END, CASE WHEN count(*) FILTER (WHERE contains(line, 'function ') OR starts_with({_TRIM}, 'def ') OR starts_with({_TRIM}, 'fn ') OR starts_with({_TRIM}, 'func ') OR contains(line, '=>') AND contains(line, 'const ')) > 20 THEN 'many_functions' END, CASE WHEN count(*) FILTER (WHERE regexp_matches(upper(line), 'TODO|FIXME|HACK')) > 5 THEN 'many_todos' END, CASE WHEN count(*) FILTER (WHERE length(regexp_extract(line, '^\\s*')) >= 20 OR starts_with(line, repeat(chr(9), 5))) > 10 THEN 'deep_nesting' END) AS patterns FROM lines GROUP BY path")
def p5(spark, sf):
    return files(spark, sf).where("content <> ''").select("path", F.concat_ws(",", T.code_patterns(F.col("content"))).alias("patterns"))


@query("p12_env_names", "SELECT p_partkey, regexp_matches(upper(replace(p_name, ' ', '_')), '^[A-Z_][A-Z0-9_]*$') AS is_name FROM part")
def p12(spark, sf):
    return read(spark, sf, "part").select("p_partkey", P.env_name(F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("is_name"))


@query("p15_secret_scan", f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(content, '(?i)(API_KEY|SECRET|PASSWORD|TOKEN)\\s*=\\s*[''\"]?[A-Za-z0-9/+=]{{8,}}')")
def p15(spark, sf):
    return files(spark, sf).where(T.secrets(F.col("content"))).select("path")


# ---- paths and strings ----------------------------------------------------------------------


@query("f8_path_parts", f"WITH {FILES} SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/]*$') AS base, regexp_extract(regexp_extract(path, '[^/]*$'), '^(.+)\\.[^.]*$', 1) AS stem, regexp_extract(path, '\\.([^./]*)$', 1) AS ext FROM files")
def f8(spark, sf):
    p = F.col("path")
    return files(spark, sf).select("path", P.dirname(p).alias("dir"), P.basename(p).alias("base"), P.stem(p).alias("stem"), P.extension(p).alias("ext"))


@query("f9_strip_extension", f"WITH {FILES} SELECT path, regexp_replace(path, '\\.[^.]*$', '') AS stripped FROM files")
def f9(spark, sf):
    return files(spark, sf).select("path", P.strip_extension(F.col("path")).alias("stripped"))


@query("f10_slug", f"WITH {FILES} SELECT path, translate(path, '/.', '--') AS slug FROM files")
def f10(spark, sf):
    return files(spark, sf).select("path", P.slug(F.col("path")).alias("slug"))


@query("f11_short_name", "SELECT p_partkey, regexp_replace(translate(lower(p_name), ' _', '--'), '[^\\p{L}\\p{N}-]', '', 'g') AS short FROM part")
def f11(spark, sf):
    return read(spark, sf, "part").select("p_partkey", P.short_name(F.col("p_name")).alias("short"))


@query("f12_python_import", f"WITH {FILES} SELECT path, replace(regexp_replace('..' || path, '^\\.+', ''), '.', '/') AS module FROM files")
def f12(spark, sf):
    return files(spark, sf).select("path", P.python_import(F.concat(F.lit(".."), "path")).alias("module"))


@query("f13_relative_import", f"WITH {FILES} SELECT path, regexp_replace(regexp_replace('./../' || path, '^(\\./)+', ''), '^(\\.\\./)+', '') AS target FROM files")
def f13(spark, sf):
    return files(spark, sf).select("path", P.relative_import(F.concat(F.lit("./../"), "path")).alias("target"))


@query("f15_last_segment", "SELECT page_id, regexp_extract(url, '[^/]*$') AS segment FROM pages")
def f15(spark, sf):
    return read(spark, sf, "pages").select("page_id", P.basename(F.col("url")).alias("segment"))


@query("f19_json_default", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), 'none') AS v FROM events")
def f19(spark, sf):
    return read(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k"), F.lit("none")).alias("v"))


@query("f24_thousands", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS price FROM orders")
def f24(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("price"))


@query("f28_marker_digits", "SELECT page_id, regexp_extract(url, 'page=([0-9]+)', 1) AS page FROM pages")
def f28(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"page=(\d+)", 1).alias("page"))


@query("x4_link_refs", "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))), '|') AS refs FROM pages")
def x4(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))), "|").alias("refs"))


# ---- joins ----------------------------------------------------------------------------------

_IMPORTS = """imports AS (SELECT path AS source, CASE doc_id % 4 WHEN 0 THEN source || '/' || lang || '/doc_' || (doc_id // 2) WHEN 1 THEN 'doc_' || (doc_id // 3) WHEN 2 THEN lang || '/doc_' || (doc_id // 2) || '.py' ELSE source || '.' || lang || '.doc_' || (doc_id // 5) END AS import FROM files)"""


def imports(spark: SparkSession, sf: str) -> DataFrame:
    half = lambda n: F.concat(F.lit("doc_"), F.floor(F.col("doc_id") / n).cast("string"))
    kind = F.col("doc_id") % 4
    made = (
        F.when(kind == 0, F.concat_ws("/", "source", "lang", half(2)))
        .when(kind == 1, half(3))
        .when(kind == 2, F.concat(F.col("lang"), F.lit("/"), half(2), F.lit(".py")))
        .otherwise(F.concat_ws(".", "source", "lang", half(5)))
    )
    return files(spark, sf).select(F.col("path").alias("source"), made.alias("import"))


def resolve_sql(files: str, imports: str) -> str:
    """Tables keys, known, found and resolved for DuckDB, from tables ``files`` (path) and ``imports`` (source, import)."""
    folder, dotted = "regexp_extract(source, '^(.*)/[^/]*$', 1)", "replace(import, '.', '/')"
    name = "regexp_extract(path, '[^/]*$')"
    stem = f"CASE WHEN regexp_matches({name}, '^.+\\.[^.]*$') THEN regexp_extract({name}, '^(.+)\\.[^.]*$', 1) ELSE {name} END"
    shared = "len(list_filter(generate_series(1, least(length(source), length(path))::BIGINT), lambda k: left(source, k) = left(path, k)))"
    return f"""keys AS (SELECT key, max(path) AS target FROM (SELECT path AS key, path FROM {files} UNION ALL SELECT regexp_replace(path, '\\.[^.]*$', ''), path FROM {files} WHERE contains(path, '.')) GROUP BY key),
known AS (SELECT DISTINCT target AS path FROM keys), stems AS (SELECT path, {stem} AS stem FROM {files}),
found AS (
 SELECT source, import, target, 1 AS rank, 1 AS tier, 0 AS shared FROM {imports} JOIN keys ON key = import
 UNION ALL SELECT source, import, target, 2, 2, 0 FROM {imports} JOIN keys ON key = {folder} || '/' || import WHERE {folder} <> ''
 UNION ALL SELECT source, import, min(path), 3, 3, 0 FROM {imports} JOIN known ON ends_with(path, '/' || import) WHERE contains(import, '/') GROUP BY ALL
 UNION ALL SELECT source, import, min(path), 4, 3, 0 FROM {imports} JOIN known ON ends_with(path, import) WHERE contains(import, '/') GROUP BY ALL
 UNION ALL SELECT source, import, path, 5, 4, {shared} FROM {imports} JOIN stems ON stem = import
 UNION ALL SELECT source, import, target, 6, 5, 0 FROM {imports} JOIN keys ON key = {dotted} WHERE contains(import, '.')
 UNION ALL SELECT source, import, min(path), 7, 5, 0 FROM {imports} JOIN known ON ends_with(path, {dotted}) WHERE contains(import, '.') GROUP BY ALL),
resolved AS (SELECT source, import, target, tier FROM (SELECT *, row_number() OVER (PARTITION BY source, import ORDER BY rank, shared DESC, target) AS rn FROM found) WHERE rn = 1)"""


_RESOLVE = f"{FILES}, {_IMPORTS}, {resolve_sql('files', 'imports')}"


@query("j1_resolve_imports", f"WITH {_RESOLVE} SELECT source, import, target, tier FROM resolved")
def j1(spark, sf):
    return G.resolve_imports(files(spark, sf), imports(spark, sf))


@query("j1a_path_lookup", f"WITH {FILES} SELECT key, max(path) AS target FROM (SELECT path AS key, path FROM files UNION ALL SELECT regexp_replace(path, '\\.[^.]*$', ''), path FROM files) GROUP BY key")
def j1a(spark, sf):
    return G.path_keys(files(spark, sf))


@query("j2_edges", f"WITH {_RESOLVE} SELECT source, target, 'import' AS type FROM resolved WHERE target <> source")
def j2(spark, sf):
    return G.edges(j1(spark, sf))


@query("j10_imported_by", f"WITH {EDGES} SELECT target, count(*) AS n, min(source) AS first, max(source) AS last FROM edges GROUP BY 1")
def j10(spark, sf):
    return links(spark, sf).groupBy("target").agg(F.count("*").alias("n"), F.min("source").alias("first"), F.max("source").alias("last"))


# ---- aggregations ---------------------------------------------------------------------------


@query("a1_language_counts", "SELECT lang AS language, count(*) AS n FROM documents GROUP BY 1")
def a1(spark, sf):
    return O.count_by(read(spark, sf, "documents"), F.col("lang").alias("language"))


@query("a3_module_rollup", f"WITH {_RESOLVE}, e AS (SELECT source, target FROM resolved WHERE target <> source), d AS (SELECT path, doc_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS module FROM files), o AS (SELECT regexp_extract(source, '^(.*)/[^/]*$', 1) AS module, count(*) AS n FROM e GROUP BY 1), i AS (SELECT regexp_extract(target, '^(.*)/[^/]*$', 1) AS module, count(*) AS n FROM e GROUP BY 1) SELECT d.module, count(*) AS n_files, sum(doc_id % 7)::BIGINT AS total_symbols, coalesce(any_value(i.n), 0) AS fan_in, coalesce(any_value(o.n), 0) AS fan_out FROM d LEFT JOIN o USING (module) LEFT JOIN i USING (module) GROUP BY 1")
def a3(spark, sf):
    return G.module_rollup(files(spark, sf).withColumn("n_symbols", F.col("doc_id") % 7), j2(spark, sf))


@query("a4_count_by_extension", f"WITH {FILES} SELECT regexp_extract(path, '\\.([^./]*)$', 1) AS ext, count(*) AS n FROM files GROUP BY 1")
def a4(spark, sf):
    return O.count_by(files(spark, sf), P.extension(F.col("path")).alias("ext"))


@query("a5_directories", f"WITH {FILES} SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files WHERE NOT starts_with(path, '.git')")
def a5(spark, sf):
    return files(spark, sf).where(~F.col("path").startswith(".git")).select(P.dirname(F.col("path")).alias("dir")).where("dir <> ''").distinct()


@query("a9_stats", "SELECT count(DISTINCT source) AS repos, count(*) AS files, sum(n_chars)::BIGINT AS symbols, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents")
def a9(spark, sf):
    return read(spark, sf, "documents").agg(F.countDistinct("source").alias("repos"), F.count("*").alias("files"), F.sum("n_chars").alias("symbols"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"))


def _status():
    return F.when(F.col("toxic") == 1, "FAIL").when(F.col("quality") == 0, "WARN").otherwise("PASS")


@query("a10_check_summary", "SELECT CASE WHEN toxic = 1 THEN 'FAIL' WHEN quality = 0 THEN 'WARN' ELSE 'PASS' END AS status, count(*) AS n, max(length(doc_id::VARCHAR)) AS width FROM labels GROUP BY 1")
def a10(spark, sf):
    return read(spark, sf, "labels").groupBy(_status().alias("status")).agg(F.count("*").alias("n"), F.max(F.length(F.col("doc_id").cast("string"))).cast("long").alias("width"))


@query("a11_max_normalise", "SELECT p_partkey, round(p_retailprice / max(p_retailprice) OVER () * 1000)::BIGINT AS importance FROM part")
def a11(spark, sf):
    return G.importance(read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("rank"))).select(F.col("id").alias("p_partkey"), "importance")


@query("a12_language_score", f"WITH {FILES} SELECT source, sum(least(n, 10))::BIGINT AS score FROM (SELECT source, regexp_extract(path, '\\.([^./]*)$', 1) AS ext, count(*) AS n FROM files GROUP BY ALL) GROUP BY 1")
def a12(spark, sf):
    return O.capped_scores(O.count_by(files(spark, sf).withColumn("ext", P.extension(F.col("path"))).select("source", "ext"), F.struct("source", "ext").alias("k")).select("k.source", "n"), "source", "n", 10)


# ---- windows, top-k, sets -------------------------------------------------------------------


@query("w1_first_per_key", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def w1(spark, sf):
    return O.first_per_key(read(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("w2_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def w2(spark, sf):
    latest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return read(spark, sf, "events").groupBy("user_id").agg(latest.alias("e")).select("user_id", "e.event_id", "e.event_type")


@query("w3_section_scope", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL)")
def w3(spark, sf):
    rows = read(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return O.sections(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn"))).select("conv_id", "turn", "section")


@query("w7_code_fence", "SELECT conv_id, turn, sum(CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) % 2 = 1 AS inside FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def w7(spark, sf):
    return O.fenced(read(spark, sf, "conversations").select("conv_id", "turn").distinct(), "conv_id", "turn", F.col("turn") % 3 == 1).select("conv_id", "turn", "inside")


@query("w9_per_group_limit", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10")
def w9(spark, sf):
    return O.first_n_per_key(read(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 10)


_PAGERANK = f"""WITH RECURSIVE {EDGES}, v AS MATERIALIZED (SELECT source AS id FROM edges UNION SELECT target FROM edges),
o AS MATERIALIZED (SELECT source, count(*) AS od FROM edges GROUP BY 1), n AS (SELECT count(*) AS n FROM v),
pr(it, id, r) AS (SELECT 0, id, 1.0::DOUBLE / (SELECT n FROM n) FROM v
 UNION ALL SELECT p.it + 1, p.id, 0.15::DOUBLE / (SELECT n FROM n) + 0.85 * coalesce(c.c, 0) FROM pr p
 LEFT JOIN (SELECT e.target, sum(q.r / o.od) AS c FROM pr q JOIN edges e ON e.source = q.id JOIN o ON o.source = e.source GROUP BY 1) c ON c.target = p.id WHERE p.it < 20),
imp AS (SELECT id, CAST(round(r / (SELECT max(r) FROM pr WHERE it = 20) * 1000) AS BIGINT) AS importance FROM pr WHERE it = 20)"""


@query("g1_pagerank", f"{_PAGERANK} SELECT id, importance FROM imp")
def g1(spark, sf):
    return G.importance(G.pagerank(links(spark, sf)))


@query("t1_top_files", f"{_PAGERANK} SELECT id, importance FROM imp ORDER BY importance DESC, id LIMIT 20")
def t1(spark, sf):
    return O.top(g1(spark, sf), [F.desc("importance"), "id"], 20)


@query("g3_neighbours", f"WITH {EDGES} SELECT 'out' AS direction, target AS node FROM edges WHERE source = 's1' UNION ALL SELECT 'in', source FROM edges WHERE target = 's1'")
def g3(spark, sf):
    return G.neighbours(links(spark, sf), "s1")


@query("g4_degree", f"WITH {EDGES} SELECT source AS id, count(*) AS degree FROM edges GROUP BY 1")
def g4(spark, sf):
    return O.count_by(links(spark, sf), F.col("source").alias("id"), "degree")


@query("t5_argmax_language", "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE rn = 1")
def t5(spark, sf):
    return O.first_per_key(read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")), ["source"], [F.desc("n"), "lang"]).select("source", "lang")


@query("t7_limit_matches", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'o') ORDER BY p_partkey LIMIT 20")
def t7(spark, sf):
    return O.top(read(spark, sf, "part").where(F.lower("p_name").contains("o")).select("p_partkey", "p_name"), ["p_partkey"], 20)


@query("u1_coverage_gaps", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u1(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").distinct()


@query("u2_union_all", "SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels")
def u2(spark, sf):
    return read(spark, sf, "documents").select("doc_id").unionByName(read(spark, sf, "labels").select("doc_id"))


@query("u4_union_distinct", "SELECT lang AS name FROM documents UNION SELECT source FROM documents")
def u4(spark, sf):
    return read(spark, sf, "documents").select(F.explode(F.array("lang", "source")).alias("name")).distinct()


# ---- rules, lookups, checks -----------------------------------------------------------------


@query("c4_tier", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'lean' WHEN c_acctbal < 0 THEN 'lean' WHEN c_acctbal < 3000 THEN 'standard' WHEN c_acctbal < 6000 THEN 'full' ELSE 'enterprise' END AS tier FROM customer")
def c4(spark, sf):
    a = F.col("c_acctbal")
    level = O.first_match([(a < 0, "simple"), (a < 3000, "moderate"), (a < 6000, "complex")], "enterprise")
    return read(spark, sf, "customer").select("c_custkey", O.tier(F.when(F.col("c_mktsegment") == "BUILDING", "lean"), level).alias("tier"))


@query("st1_windowed_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st1(spark, sf):
    return I.drain(spark, sf, "events", I.windowed_counts).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


@query("st2_upsert_latest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def st2(spark, sf):
    events = read(spark, sf, "events").select("user_id", "event_id", "ts")
    old, new = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")  # the table and the batch that meets it
    return I.upsert_latest(old, new, "user_id", ["ts", "event_id"]).select("user_id", "event_id")
