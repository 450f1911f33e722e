"""The code index bound to a generated source tree: a file a row of ``part``, in one of thirteen languages.

File ``i`` imports file ``i // 2 + 1``. The SQL lists each language's symbols and imports as they must
be found, and resolves, ranks and rolls up by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import paths as P
from ..functions import text as T
from ..operators import graph as G
from ..sources import parsers as S
from ..sources.shared import spread, written
from . import index as I
from . import render as R
from .bindings import FILES, files, read, resolve_sql
from .fixtures import quoted

FOLDERS = ("lib", "api", "models", "services", "tests", "cmd", "config", "web/handlers", "core")
#: (extension, language, text, symbols: (line, name, kind, visibility, parent, docstring), imports, exports).
LANGUAGES = (
    ("py", "python", 'import os\nfrom lib.m{j} import x\n\nclass C{i}:\n    """Holds things"""\n    def run(self):\n        return 1\n\ndef f_{i}():\n    pass\n\ndef _g{i}():\n    pass\n# def gone(): pass\nLIMIT_{i} = 1\nclass D{i}:\n    """Two\n    lines."""\n    TEXT = """\ndef not_real():\n    pass\n"""\n    def after(self):\n        """Own text\n        goes on."""\n',
     ((4, "C{i}", "class", "public", None, "Holds things"), (6, "run", "method", "public", "C{i}", None), (9, "f_{i}", "function", "public", None, None), (12, "_g{i}", "function", "private", None, None), (15, "LIMIT_{i}", "const", "public", None, None), (16, "D{i}", "class", "public", None, "Two"), (23, "after", "method", "public", "D{i}", "Own text")), ("lib/m{j}", "os"), ("C{i}", "f_{i}", "LIMIT_{i}", "D{i}")),
    ("ts", "typescript", "import {{ a }} from './m{j}';\nimport express from 'express';\nexport interface I{i} {{\n  a: string;\n}}\nexport class C{i} {{\n  async run(p: number): Promise<void> {{\n    if (p) {{\n    }}\n  }}\n}}\nexport function f_{i}(): void {{\n}}\nclass Hid{i} {{\n}}\nexport const V_{i} = '1';\nexport const text{i} = `\nclass No {{\n${{ \"}}\" }}`;\nnamespace N{i} {{\n  export function in_{i}(): void {{}}\n}}\n",
     ((3, "I{i}", "interface", "public", None, None), (6, "C{i}", "class", "public", None, None), (7, "run", "method", "public", "C{i}", None), (12, "f_{i}", "function", "public", None, None), (14, "Hid{i}", "class", "private", None, None), (16, "V_{i}", "const", "public", None, None), (17, "text{i}", "const", "public", None, None), (21, "in_{i}", "function", "public", None, None)), ("m{j}",), ("I{i}", "C{i}", "f_{i}", "V_{i}", "text{i}", "in_{i}")),
    ("js", "javascript", "const x = require('../lib/m{j}');\nclass C{i} {{\n  run(a) {{\n  }}\n}}\nfunction f_{i}(a) {{\n}}\nexport const g{i} = (a) => a;\nclass E{i} {{\n  text = \"{{\";\n  go(a) {{\n  }}\n}}\n/* function gone() {{}}\n   class Gone {{}} */\nfunction top{i}() {{}}\n",
     ((2, "C{i}", "class", "private", None, None), (3, "run", "method", "public", "C{i}", None), (6, "f_{i}", "function", "private", None, None), (8, "g{i}", "function", "public", None, None), (9, "E{i}", "class", "private", None, None), (11, "go", "method", "public", "E{i}", None), (16, "top{i}", "function", "private", None, None)), ("lib/m{j}",), ("g{i}",)),
    ("go", "go", 'package main\n\nimport (\n\t"fmt"\n\t"app/m{j}"\n)\n\ntype C{i} struct {{\n}}\n\n// Run does it\nfunc (s *C{i}) Run() {{\n}}\n\nfunc f_{i}() *C{i} {{\n\treturn nil\n}}\nvar raw{i} = `\nfunc fake() {{\n`\n\n// First of two.\n// Second.\nfunc Late{i}() string {{\n\treturn "}}"\n}}\n',
     ((8, "C{i}", "struct", "public", None, None), (12, "Run", "method", "public", "C{i}", "Run does it"), (15, "f_{i}", "function", "private", None, None), (18, "raw{i}", "const", "private", None, None), (24, "Late{i}", "function", "public", None, "First of two.")), ("fmt", "m{j}"), ("C{i}", "Late{i}")),
    ("rs", "rust", "use crate::m{j};\nmod m{j};\n\npub struct C{i} {{\n}}\n\nimpl C{i} {{\n    /// Makes one\n    pub fn new() -> Self {{\n        C{i} {{}}\n    }}\n    fn inner(&self) {{\n    }}\n}}\npub fn f_{i}() {{\n}}\nuse crate::{{a, b::c}};\n/* /* fn no() {{ */ fn gone() {{}} */\nimpl C{i} {{\n    fn odd(&self) -> char {{ '}}' }}\n}}\nfn tail{i}() -> &'static str {{ r#\"fn raw() {{ \" \"# }}\n",
     ((4, "C{i}", "struct", "public", None, None), (9, "new", "method", "public", "C{i}", "Makes one"), (12, "inner", "method", "private", "C{i}", None), (15, "f_{i}", "function", "public", None, None), (20, "odd", "method", "private", "C{i}", None), (22, "tail{i}", "function", "private", None, None)), ("crate/m{j}", "m{j}", "crate/a", "crate/b/c"), ("C{i}", "f_{i}")),
    ("rb", "ruby", "require_relative 'm{j}'\nclass C{i}\n  def run\n  end\n  private\n  def hid\n  end\nend\nclass D{i}\n  TEXT = <<~EOS\n    def fake\n    end\n  EOS\n  def late(a)\n    a.each do |x|\n      puts \"end\"\n    end\n  end\nend\ndef top{i}; end\n",
     ((2, "C{i}", "class", "public", None, None), (3, "run", "method", "public", "C{i}", None), (6, "hid", "method", "private", "C{i}", None), (9, "D{i}", "class", "public", None, None), (14, "late", "method", "public", "D{i}", None), (20, "top{i}", "function", "public", None, None)), ("m{j}",), ("C{i}", "run", "D{i}", "late", "top{i}")),
    ("sh", "bash", '#!/bin/bash\nsource "$ROOT/lib/m{j}.sh"\nf_{i}() {{\n  echo\n}}\nfunction g_{i} {{\n  echo\n}}\nh_{i}() {{\n  cat <<EOF\nfake() {{\n}}\nsource no.sh\nEOF\n  inner() {{ :; }}\n}}\n',
     ((3, "f_{i}", "function", "public", None, None), (6, "g_{i}", "function", "public", None, None), (9, "h_{i}", "function", "public", None, None)), ("lib/m{j}.sh",), ("f_{i}", "g_{i}", "h_{i}")),
    ("java", "java", "import lib.m{j};\npublic class C{i} {{\n    public C{i}(int a) {{\n    }}\n    private int run(int x) {{\n    }}\n}}\ninterface I{i} {{\n}}\nclass D{i} {{\n    String s = \"}}\"; char c = '{{';\n    /* void gone() {{ */\n    public <T> java.util.Map<String, T> get(T a) {{ return null; }}\n}}\n",
     ((2, "C{i}", "class", "public", None, None), (5, "run", "method", "private", "C{i}", None), (8, "I{i}", "interface", "public", None, None), (10, "D{i}", "class", "private", None, None), (13, "get", "method", "public", "D{i}", None)), ("lib.m{j}",), ("C{i}", "I{i}")),
    ("cs", "csharp", "using core.m{j};\npublic class C{i} {{\n    public void Run() {{\n    }}\n    internal int Hid() {{\n    }}\n}}\npublic interface IFace{i} {{\n}}\nclass D{i} {{\n    string s = @\"class \"\"Fake\"\" {{\";\n    public int Late() {{ return 1; }}\n}}\n",
     ((2, "C{i}", "class", "public", None, None), (3, "Run", "method", "public", "C{i}", None), (5, "Hid", "method", "private", "C{i}", None), (8, "IFace{i}", "interface", "public", None, None), (10, "D{i}", "class", "private", None, None), (12, "Late", "method", "public", "D{i}", None)), ("core.m{j}",), ("C{i}", "IFace{i}")),
    ("php", "php", "<?php\nuse api\\m{j};\nfunction f_{i}() {{\n}}\nclass C{i} {{\n    private function hid() {{\n    }}\n}}\n$t = '\nfunction fake() {{}}\n';\n",
     ((3, "f_{i}", "function", "public", None, None), (5, "C{i}", "class", "public", None, None), (6, "hid", "method", "private", "C{i}", None)), ("api/m{j}",), ("f_{i}", "C{i}")),
    ("kt", "kotlin", "import m{j}\nfun f_{i}() {{}}\nclass C{i} {{\n    internal fun hid() {{}}\n}}\nval t = \"\"\"\nfun fake() {{}}\n\"\"\"\n",
     ((2, "f_{i}", "function", "public", None, None), (3, "C{i}", "class", "public", None, None), (4, "hid", "method", "private", "C{i}", None)), ("m{j}",), ("f_{i}", "C{i}")),
    ("swift", "swift", "import m{j}\npublic struct C{i} {{\n    private func hid() {{}}\n    func run() {{}}\n}}\nprotocol Q{i} {{\n}}\nlet t = \"\"\"\nfunc fake() {{}}\n\"\"\"\n",
     ((2, "C{i}", "struct", "public", None, None), (3, "hid", "method", "private", "C{i}", None), (4, "run", "method", "public", "C{i}", None), (6, "Q{i}", "interface", "public", None, None)), ("m{j}",), ("C{i}", "Q{i}")),
    ("ex", "elixir", "defmodule C{i} do\n  alias m{j}\n  def run(x) do\n  end\n  defp hid(x) do\n  end\n  defmacro mac(x) do\n  end\nend\n@doc \"\"\"\ndef fake(x) do\n\"\"\"\n",
     ((1, "C{i}", "class", "public", None, None), (3, "run", "function", "public", "C{i}", None), (5, "hid", "function", "private", "C{i}", None), (7, "mac", "function", "public", "C{i}", None)), ("m{j}",), ("C{i}", "run")),
)
_LIST = lambda values: "[" + ", ".join(map(quoted, values)) + "]"
_FILLED = lambda c: f"replace(replace({c}, '{{i}}', p_partkey::VARCHAR), '{{j}}', (p_partkey // 2 + 1)::VARCHAR)"
_TEXTS = tuple(x[2].replace("{{", "{").replace("}}", "}") for x in LANGUAGES)
TREE = f"tree AS (SELECT p_partkey AS i, {_LIST(FOLDERS)}[p_partkey % {len(FOLDERS)} + 1] || '/m' || p_partkey || '.' || {_LIST([x[0] for x in LANGUAGES])}[p_partkey % 13 + 1] AS path, {_LIST([x[1] for x in LANGUAGES])}[p_partkey % 13 + 1] AS language, {_FILLED(_LIST(_TEXTS) + '[p_partkey % 13 + 1]')} AS content FROM part)"
_ROWS = ", ".join(f"({k}, {', '.join(map(quoted, s))})" for k, x in enumerate(LANGUAGES) for s in x[3])
SYMBOLS = f"symbols AS (SELECT path AS file, line::BIGINT AS line, replace(name, '{{i}}', i::VARCHAR) AS name, kind, visibility, replace(parent, '{{i}}', i::VARCHAR) AS parent, docstring FROM tree JOIN (VALUES {_ROWS}) AS s(k, line, name, kind, visibility, parent, docstring) ON i % 13 = k)"
_IMPORTED = ", ".join(f"({k}, {quoted(s)})" for k, x in enumerate(LANGUAGES) for s in x[4])
IMPORTS = f"imports AS (SELECT path AS source, replace(s.import, '{{j}}', (i // 2 + 1)::VARCHAR) AS import FROM tree JOIN (VALUES {_IMPORTED}) AS s(k, import) ON i % 13 = k)"
_RESOLVED = f"{TREE}, {SYMBOLS}, {IMPORTS}, files AS (SELECT path FROM tree), {resolve_sql('files', 'imports')}, edges AS (SELECT source, target FROM resolved WHERE target <> source)"
_DIR = "regexp_extract({}, '^(.*)/[^/]*$', 1)"
_PAIRS = f"pairs AS (SELECT DISTINCT {_DIR.format('source')} AS source, {_DIR.format('target')} AS target FROM edges WHERE {_DIR.format('source')} <> {_DIR.format('target')})"
#: Ranks for DuckDB: the same sums over edges with their multiplicity; files without an edge have none.
_RANKED = f"""{_RESOLVED}, {_PAIRS}, v AS MATERIALIZED (SELECT source AS id FROM edges UNION SELECT target FROM edges),
o AS MATERIALIZED (SELECT source, count(*) AS od FROM edges GROUP BY 1), n AS (SELECT count(*) AS n FROM v),
pr(it, id, r) AS (SELECT 0, id, 1.0::DOUBLE / (SELECT n FROM n) FROM v
 UNION ALL SELECT p.it + 1, p.id, 0.15::DOUBLE / (SELECT n FROM n) + 0.85 * coalesce(c.c, 0) FROM pr p
 LEFT JOIN (SELECT e.target, sum(q.r / o.od) AS c FROM pr q JOIN edges e ON e.source = q.id JOIN o ON o.source = e.source GROUP BY 1) c ON c.target = p.id WHERE p.it < 20),
ranked AS (SELECT path, language, octet_length(encode(content))::BIGINT AS size_bytes, (length(content) - length(replace(content, chr(10), '')))::BIGINT AS lines, coalesce(CAST(round(r / (SELECT max(r) FROM pr WHERE it = 20) * 1000) AS BIGINT), 0) AS importance FROM tree LEFT JOIN (SELECT * FROM pr WHERE it = 20) ON id = path)"""


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """(path, language, content, size_bytes) of the generated files."""
    i, at = F.col("p_partkey"), lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % n).cast("int"))
    filled = F.replace(F.replace(at(_TEXTS, 13), F.lit("{i}"), i.cast("string")), F.lit("{j}"), (F.floor(i / 2) + 1).cast("string"))
    path = F.concat(at(FOLDERS, len(FOLDERS)), F.lit("/m"), i.cast("string"), F.lit("."), at([x[0] for x in LANGUAGES], 13))
    return spread(read(spark, sf, "part")).select(path.alias("path"), at([x[1] for x in LANGUAGES], 13).alias("language"), filled.alias("content")).withColumn("size_bytes", F.octet_length("content").cast("long"))


_LINKED: dict[tuple[str, str], I.Index] = {}
_PLACED: dict[tuple[str, str], I.Index] = {}
_BUILT: dict[tuple[str, str], I.Index] = {}


def linked(spark: SparkSession, sf: str) -> I.Index:
    """The tree's index before ranks: built once a session, as its tables are written."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LINKED:
        _LINKED[key] = I.linked(tree(spark, sf))
    return _LINKED[key]


def placed(spark: SparkSession, sf: str) -> I.Index:
    """The tree's index with ranks, for what asks for no measures of files."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _BUILT:
        return _BUILT[key]
    if key not in _PLACED:
        _PLACED[key] = I.placed(linked(spark, sf))
    return _PLACED[key]


def built(spark: SparkSession, sf: str) -> I.Index:
    """The tree's index, with measures and ranks."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        known = _PLACED[key].files.select(F.col("path").alias("id"), "importance") if key in _PLACED else None
        _BUILT[key] = I.ranked(linked(spark, sf), tree(spark, sf), known)
    return _BUILT[key]


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return S.parse_files(tree(spark, sf))


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select(F.explode("symbols").alias("s")).select("s.*")


# ---- parsing --------------------------------------------------------------------------------


@query("x9_symbol_parser", f"WITH {TREE}, {SYMBOLS} SELECT file, line, name, kind, visibility, parent FROM symbols")
def x9(spark, sf):
    return symbols(spark, sf).select("file", "line", "name", "kind", "visibility", "parent")


@query("x9_parser_function", f"WITH {TREE}, {SYMBOLS} SELECT file, line, name, kind, visibility, parent, docstring FROM symbols")
def x9_function(spark, sf):
    tree(spark, sf).createOrReplaceTempView("parsed_tree")
    return spark.sql(f"SELECT s.file, s.line, s.name, s.kind, s.visibility, s.parent, s.docstring FROM parsed_tree, LATERAL {S.register(spark)}(path, content, language) s")


@query("x9_imports", f"WITH {TREE}, {IMPORTS} SELECT source, import FROM imports")
def x9_imports(spark, sf):
    return parsed(spark, sf).select(F.col("path").alias("source"), F.explode("imports").alias("import"))


@query("x9_exports", f"WITH {TREE} SELECT path, replace({_LIST([','.join(x[5]) for x in LANGUAGES])}[i % 13 + 1], '{{i}}', i::VARCHAR) AS exports FROM tree")
def x9_exports(spark, sf):
    return parsed(spark, sf).select("path", F.array_join("exports", ",").alias("exports"))


@query("w4_brace_depth", f"WITH {TREE}, {SYMBOLS} SELECT file, name, parent FROM symbols WHERE regexp_matches(file, '\\.(ts|js|rs)$')")
def w4(spark, sf):
    scoped = tree(spark, sf).where(F.col("language").isin("typescript", "javascript", "rust"))
    return S.parse_files(scoped).select(F.explode("symbols").alias("s")).select("s.file", "s.name", "s.parent")


@query("w5_current_class", f"WITH {TREE}, {SYMBOLS} SELECT file, name, parent FROM symbols WHERE parent IS NOT NULL")
def w5(spark, sf):
    return symbols(spark, sf).where("parent is not null").select("file", "name", "parent")


@query("w6_pending_doc", f"WITH {TREE}, {SYMBOLS} SELECT file, name, docstring FROM symbols WHERE docstring IS NOT NULL")
def w6(spark, sf):
    return symbols(spark, sf).where("docstring is not null").select("file", "name", "docstring")


def _imports_of(language: str):
    k = next(n for n, x in enumerate(LANGUAGES) if x[1] == language)
    sql = f"WITH {TREE}, {IMPORTS} SELECT source, import FROM imports WHERE ends_with(source, '.{LANGUAGES[k][0]}')"
    return sql, lambda spark, sf: S.parse_files(tree(spark, sf).where(F.col("language") == language)).select(F.col("path").alias("source"), F.explode("imports").alias("import"))


for _name, _language in (("f14_shell_path", "bash"), ("f16_rust_use", "rust"), ("f17_php_use", "php")):
    query(_name, _imports_of(_language)[0])(_imports_of(_language)[1])


@query("f33_first_line_of_docs", f"WITH {TREE}, {SYMBOLS} SELECT file, docstring FROM symbols WHERE docstring IS NOT NULL AND regexp_matches(file, '\\.(py|go|rs)$')")
def f33(spark, sf):
    return symbols(spark, sf).where("docstring is not null").select("file", "docstring")


@query("a18_file_symbol_count", f"WITH {TREE}, {SYMBOLS} SELECT file AS path, count(*) AS n FROM symbols GROUP BY 1")
def a18(spark, sf):
    return parsed(spark, sf).select("path", F.size("symbols").cast("long").alias("n"))


# ---- the index ------------------------------------------------------------------------------


@query("p1_file_projection", f"WITH {TREE} SELECT path, language, octet_length(encode(content))::BIGINT AS size_bytes, (length(content) - length(replace(content, chr(10), '')))::BIGINT AS lines, regexp_matches(content, 'if ')::INT + 1 AS complexity FROM tree")
def p1(spark, sf):
    return built(spark, sf).files.select("path", "language", "size_bytes", "lines", F.col("complexity").cast("int").alias("complexity"))


@query("j1_tree_imports", f"WITH {_RESOLVED} SELECT source, import, target, tier FROM resolved")
def j1_tree(spark, sf):
    found = written(parsed(spark, sf).select("path", "imports"))  # resolution reads them a dozen times
    return G.resolve_imports(found.select("path"), found.select(F.col("path").alias("source"), F.explode("imports").alias("import")))


@query("a2_index_totals", f"WITH {_RESOLVED} SELECT (SELECT count(*) FROM tree) AS total_files, (SELECT count(*) FROM symbols) AS total_symbols, (SELECT count(*) FROM edges) AS total_edges")
def a2(spark, sf):
    return linked(spark, sf).meta().select("total_files", "total_symbols", "total_edges")


@query("j5_attach_importance", f"WITH RECURSIVE {_RANKED} SELECT path, importance FROM ranked")
def j5(spark, sf):
    return built(spark, sf).files.select("path", "importance")


_ROLE = f"CASE regexp_extract(module, '[^/]*$') WHEN 'lib' THEN 'utility' WHEN 'api' THEN 'api' WHEN 'models' THEN 'data' WHEN 'services' THEN 'service' WHEN 'tests' THEN 'testing' WHEN 'cmd' THEN 'cli' WHEN 'config' THEN 'config' WHEN 'handlers' THEN 'api' ELSE 'module' END"
_CYCLES = "cycles AS (SELECT a.source AS module, array_to_string(list_sort(list(a.target)), ',') AS circular_deps FROM pairs a JOIN pairs b ON a.source = b.target AND a.target = b.source GROUP BY 1)"
_MODULES = f"""{_CYCLES}, own AS (SELECT {_DIR.format('path')} AS module, count(*) AS n_files FROM tree GROUP BY 1), s AS (SELECT {_DIR.format('file')} AS module, count(*) AS total_symbols FROM symbols GROUP BY 1),
 fi AS (SELECT {_DIR.format('target')} AS module, count(*) AS fan_in FROM edges GROUP BY 1), fo AS (SELECT {_DIR.format('source')} AS module, count(*) AS fan_out FROM edges GROUP BY 1),
 modules AS (SELECT module, n_files, total_symbols, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, {_ROLE} AS role, circular_deps FROM own JOIN s USING (module) LEFT JOIN fi USING (module) LEFT JOIN fo USING (module) LEFT JOIN cycles USING (module))"""


@query("g2_build_graph", f"WITH {_RESOLVED}, {_PAIRS}, {_MODULES} SELECT * FROM modules")
def g2(spark, sf):
    return built(spark, sf).modules.select("module", "n_files", "total_symbols", "fan_in", "fan_out", "role", F.array_join("circular_deps", ",").alias("circular_deps"))


@query("c14_module_role", f"WITH {TREE}, m AS (SELECT DISTINCT {_DIR.format('path')} AS module FROM tree) SELECT module, {_ROLE} AS role FROM m")
def c14(spark, sf):
    return tree(spark, sf).select(P.dirname(F.col("path")).alias("module")).distinct().select("module", P.module_role(F.col("module")).alias("role"))


_NAMES = ("x/scanner", "gen", "a/validation", "indexers", "parser", "mcp", "src", "docs", "__tests__", "helpers", "routes", "schemas", "service", "middlewares", "settings", "migrate", "cli", "data", "bridge", "freshness", "common", "spec", "")
_ROLES = ("discovery", "generation", "validation", "indexing", "parsing", "mcp", "module", "module", "testing", "utility", "api", "data", "service", "middleware", "config", "migration", "cli", "data", "bridge", "tracking", "utility", "testing", "module")


@query("f32_role_lookup", f"SELECT p_partkey, {_LIST(_ROLES)}[p_partkey % {len(_NAMES)} + 1] AS role FROM part")
def f32(spark, sf):
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int"))
    return read(spark, sf, "part").select("p_partkey", P.module_role(name).alias("role"))


@query("j3_circular_deps", f"WITH {_RESOLVED}, {_PAIRS}, {_CYCLES} SELECT * FROM cycles")
def j3(spark, sf):
    found = built(spark, sf)
    return G.circular(G.module_edges(found.edges)).select("module", F.array_join("circular_deps", ",").alias("circular_deps"))


@query("u5_distinct_module_edges", f"WITH {_RESOLVED}, {_PAIRS} SELECT * FROM pairs")
def u5(spark, sf):
    return G.module_edges(built(spark, sf).edges)


# ---- lookups --------------------------------------------------------------------------------


@query("q1_top_files", f"WITH RECURSIVE {_RANKED} SELECT path, importance FROM ranked ORDER BY importance DESC, path LIMIT 10")
def q1(spark, sf):
    return built(spark, sf).top_files()


@query("q2_file_symbols", f"WITH {TREE}, {SYMBOLS} SELECT name, kind, line FROM symbols WHERE file = 'api/m1.ts'")
def q2(spark, sf):
    return built(spark, sf).file_symbols("api/m1.ts").select("name", "kind", "line")


@query("q3_search_symbols", f"WITH {TREE}, {SYMBOLS} SELECT file, name, line FROM symbols WHERE contains(lower(name), 'f_1') ORDER BY file, line LIMIT 20")
def q3(spark, sf):
    return built(spark, sf).search_symbols("F_1").select("file", "name", "line")


@query("q4_analyze_file", f"WITH {_RESOLVED}, t AS (SELECT path FROM tree WHERE i = 3) SELECT 'symbol' AS fact, name FROM symbols JOIN t ON file = path UNION ALL SELECT 'imports_from', target FROM edges JOIN t ON source = path UNION ALL SELECT 'imported_by', source FROM edges JOIN t ON target = path")
def q4(spark, sf):
    return built(spark, sf).analyze_file("services/m3.go").select("fact", "name")


@query("q5_find_tests", f"WITH {TREE}, {SYMBOLS}, s AS (SELECT file, array_to_string(list_sort(list(DISTINCT name)), ',') AS tests FROM symbols WHERE contains(name, 'test') GROUP BY 1) SELECT path, tests FROM tree LEFT JOIN s ON file = path WHERE contains(path, 'test') OR contains(path, 'spec')")
def q5(spark, sf):
    return built(spark, sf).find_tests().select("path", F.array_join("tests", ",").alias("tests"))


@query("j12_find_tests_match", f"WITH {TREE} SELECT path FROM tree WHERE contains(path, 'test') AND contains(path, 'm4')")
def j12(spark, sf):
    return built(spark, sf).find_tests("services/m4.py").select("path")


@query("q3_indexed_search", f"WITH {TREE}, {SYMBOLS} SELECT file, name, line FROM symbols WHERE contains(lower(name), 'un') ORDER BY file, line LIMIT 20")
def q3_indexed(spark, sf):
    return built(spark, sf).with_search().search_symbols("Un").select("file", "name", "line")


# ---- documents ------------------------------------------------------------------------------


@query("t3_top_for_docs", f"WITH RECURSIVE {_RANKED}, t AS (SELECT *, row_number() OVER (ORDER BY importance DESC, path) AS n FROM ranked) SELECT 'guide' AS document, path, importance FROM t WHERE n <= 15 AND importance > 0 UNION ALL SELECT 'architecture', path, importance FROM t WHERE n <= 20 AND importance > 0 UNION ALL SELECT 'overview', path, importance FROM t WHERE n <= 10")
def t3(spark, sf):
    return R.top_for_docs(built(spark, sf))


@query("t4_top50_entities", f"WITH RECURSIVE {_RANKED} SELECT path, 'vault/wiki/entities/' || translate(path, '/.', '--') || '.md' AS page_path FROM ranked ORDER BY importance DESC, path LIMIT 50")
def t4(spark, sf):
    return R.entity_pages(built(spark, sf)).select("path", "page_path")


_LISTING = lambda values, title: f"coalesce(chr(10) || chr(10) || '## {title}' || chr(10) || chr(10) || {values}, '')"


@query("r11_entity_pages", f"""WITH RECURSIVE {_RANKED}, t AS (SELECT * FROM ranked ORDER BY importance DESC, path LIMIT 50),
 sy AS (SELECT file, string_agg('- ' || kind || ' `' || name || '`', chr(10) ORDER BY line, kind, name) AS rows FROM symbols GROUP BY 1),
 ou AS (SELECT source, string_agg('- [[' || translate(target, '/.', '--') || ']]', chr(10) ORDER BY target) AS rows FROM (SELECT DISTINCT source, target FROM edges) GROUP BY 1),
 inn AS (SELECT target, string_agg('- [[' || translate(source, '/.', '--') || ']]', chr(10) ORDER BY source) AS rows FROM (SELECT DISTINCT source, target FROM edges) GROUP BY 1)
 SELECT path, '# ' || path || chr(10) || chr(10) || language || ', ' || lines || ' lines, importance ' || importance || {_LISTING('sy.rows', 'Symbols')} || {_LISTING('ou.rows', 'Imports')} || {_LISTING('inn.rows', 'Imported by')} AS page
 FROM t LEFT JOIN sy ON sy.file = path LEFT JOIN ou ON ou.source = path LEFT JOIN inn ON inn.target = path""")
def r11(spark, sf):
    return R.entity_pages(built(spark, sf)).select("path", "page")


@query("r12_graph_overview", f"""WITH RECURSIVE {_RANKED}, {_CYCLES}, l AS (SELECT language, count(*) AS n FROM tree GROUP BY 1), d AS (SELECT source, string_agg(target, ', ' ORDER BY target) AS targets FROM pairs GROUP BY 1),
 r AS (SELECT 'Languages' AS section, -n AS a, language AS b, language || ': ' || n AS line FROM l UNION ALL SELECT 'Dependencies', 0, source, source || ' -> ' || targets FROM d UNION ALL SELECT 'Cycles', 0, module, module || ' <-> ' || replace(circular_deps, ',', ', ') FROM cycles
 UNION ALL SELECT * FROM (SELECT 'Top files', -importance, path, path || ' (' || importance || ')' FROM ranked ORDER BY importance DESC, path LIMIT 10))
 SELECT section, row_number() OVER (PARTITION BY section ORDER BY a, b)::INT AS line_no, line FROM r""")
def r12(spark, sf):
    return R.overview(built(spark, sf))


@query("r9_architecture_rows", f"""WITH RECURSIVE {_RANKED}, {_MODULES}, l AS (SELECT language, count(*) AS n FROM tree GROUP BY 1)
 SELECT 'Languages' AS section, language || ': ' || n AS line FROM l UNION ALL SELECT 'Modules', module || ' (' || role || '): in ' || fan_in || ', out ' || fan_out FROM modules
 UNION ALL SELECT * FROM (SELECT 'Key files', path || ' - ' || importance FROM ranked ORDER BY importance DESC, path LIMIT 20)""")
def r9(spark, sf):
    return I.architecture(built(spark, sf)).select("section", "line")


# ---- measures of texts ----------------------------------------------------------------------

_NUMBERED = "numbered AS (SELECT path, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT path, CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, '\\r?\\n$', ''), chr(10)) END AS ls FROM files)))"
#: A line lies in a block comment when, before it, the last line that opened one without closing it comes after the last that closed one.
_STATE = "state AS (SELECT path, t, coalesce(max(CASE WHEN starts_with(t, '/*') AND NOT contains(t, '*/') THEN i END) OVER w, 0) > coalesce(max(CASE WHEN contains(t, '*/') THEN i END) OVER w, 0) AS inside FROM numbered WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
_LOC = "count(*) FILTER (WHERE NOT inside AND t <> '' AND NOT starts_with(t, '/*') AND NOT starts_with(t, '//') AND NOT starts_with(t, '#'))::BIGINT"
#: A third of the texts get block comments around what the others have.
_COMMENTED = FILES.replace("text AS content", "CASE doc_id % 3 WHEN 0 THEN 'a' || chr(10) || '/* x' || chr(10) || text || chr(10) || 'y */' || chr(10) || '  b' || chr(10) || '/* c */' || chr(10) || '// d' WHEN 1 THEN replace(text, '. ', '.' || chr(10) || ' /* ') ELSE text END AS content")


def commented(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a\n/* x\n"), "content", F.lit("\ny */\n  b\n/* c */\n// d"))).when(F.col("doc_id") % 3 == 1, F.replace("content", F.lit(". "), F.lit(".\n /* "))).otherwise(F.col("content"))
    return files(spark, sf).withColumn("content", text)


@query("p4_logical_loc", f"WITH {_COMMENTED}, {_NUMBERED}, {_STATE} SELECT path, {_LOC} AS logical_loc FROM state GROUP BY path UNION ALL SELECT path, 0 FROM files WHERE content = ''")
def p4(spark, sf):
    return commented(spark, sf).select("path", T.logical_loc(F.col("content")).alias("logical_loc"))


@query("m17_file_metrics", f"WITH {FILES}, {_NUMBERED}, {_STATE}, loc AS (SELECT path, {_LOC} AS logical_loc FROM state GROUP BY path) SELECT path, (length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines, coalesce(logical_loc, 0) AS logical_loc FROM files LEFT JOIN loc USING (path)")
def m17(spark, sf):
    return files(spark, sf).select("path", *I.file_metrics(F.col("content"))).select("path", "lines", "logical_loc")




@query("p6_func_line", f"WITH {TREE}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS line FROM tree), t AS (SELECT path, line, trim(line, ' ' || chr(9)) AS t FROM l) SELECT path, count(*) AS n FROM t WHERE starts_with(t, 'def ') OR starts_with(t, 'fn ') OR starts_with(t, 'func ') OR contains(t, 'function ') OR contains(t, '=>') AND contains(t, 'const ') GROUP BY path")
def p6(spark, sf):
    rows = tree(spark, sf).select("path", F.explode(T.lines(F.col("content"))).alias("line"))
    return rows.where(T.func_line(F.col("line"))).groupBy("path").agg(F.count("*").alias("n"))
