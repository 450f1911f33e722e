"""Engine operators on miniature inputs with results worked out by hand, and the registered queries against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomline import catalog
from fathomline.functions import paths, text
from fathomline.operators import graph
from fathomline.sources import repo

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def value(spark, column, **inputs):
    frame = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs))
    return frame.select(column.alias("v")).first().v


@pytest.mark.parametrize("content,n", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2)])
def test_line_count(spark, content, n):
    assert value(spark, text.count_lines(F.col("c")), c=content) == n


def test_text_measures(spark):
    assert value(spark, text.logical_loc(F.col("c")), c="a\n/* x\ny */\nb\n// c\n\n# d\n  e") == 3
    assert value(spark, text.cyclomatic(F.col("c")), c="if a && b {\n} else if c {") == 5
    for n, want in ((500, []), (501, ["large_file"])):
        assert value(spark, text.code_patterns(F.col("c")), c="x\n" * n) == want
    for n, want in ((20, []), (21, ["many_functions"])):
        assert value(spark, text.code_patterns(F.col("c")), c="def f\n" * n) == want
    for n, want in ((5, []), (6, ["many_todos"])):
        assert value(spark, text.code_patterns(F.col("c")), c="todo\n" * n) == want
    for n, want in ((10, []), (11, ["deep_nesting"])):
        assert value(spark, text.code_patterns(F.col("c")), c=(" " * 20 + "x\n") * n) == want
    assert value(spark, text.secrets(F.col("c")), c="token = abcdefgh") and not value(spark, text.secrets(F.col("c")), c="token = abc")


def test_path_functions(spark):
    assert value(spark, paths.extension(F.col("p")), p="a/.gitignore") == ""
    assert value(spark, paths.stem(F.col("p")), p="a/b.test.js") == "b.test"
    assert value(spark, paths.relative_import(F.col("p")), p="./../lib/x") == "lib/x" and value(spark, paths.relative_import(F.col("p")), p="express") is None
    assert value(spark, paths.suffixes(F.col("p")), p="a/b/c") == ["a/b/c", "b/c", "c"]


def test_pagerank_pair(spark):
    links = spark.createDataFrame([("a", "b")], "source string, target string")
    assert {r.id: r.importance for r in graph.importance(graph.pagerank(links)).collect()} == {"a": 541, "b": 1000}


def test_resolve_tiers(spark):
    files = spark.createDataFrame([(p,) for p in ("foo", "foo.py", "x/a.py", "x/b.py", "lib/util/deep.py", "p/one/same.py", "p/two/same.py", "self.py")], "path string")
    imports = spark.createDataFrame([("x/a.py", "foo"), ("x/a.py", "b"), ("x/a.py", "util/deep"), ("x/a.py", "util/deep.py"), ("p/twofold/z.py", "same"), ("x/a.py", "lib.util.deep"), ("self.py", "self"), ("x/a.py", "absent")], "source string, import string")
    found = {(r["source"], r["import"]): (r["target"], r["tier"]) for r in graph.resolve_imports(files, imports).collect()}
    assert found == {
        ("x/a.py", "foo"): ("foo.py", 1), ("x/a.py", "b"): ("x/b.py", 2), ("x/a.py", "util/deep.py"): ("lib/util/deep.py", 3), ("p/twofold/z.py", "same"): ("p/two/same.py", 4),
        ("x/a.py", "lib.util.deep"): ("lib/util/deep.py", 5), ("self.py", "self"): ("self.py", 1),
    }
    assert ("self.py", "self.py") not in {(r.source, r.target) for r in graph.edges(graph.resolve_imports(files, imports)).collect()}


def test_module_graph(spark):
    files = spark.createDataFrame([("x/a", 2), ("y/b", 3)], "path string, n_symbols long")
    links = spark.createDataFrame([("x/a", "y/b"), ("y/b", "x/a"), ("x/a", "x/a2")], "source string, target string")
    rolled = {r.module: (r.fan_in, r.fan_out, r.total_symbols) for r in graph.module_rollup(files, links).collect()}
    assert rolled == {"x": (2, 2, 2), "y": (1, 1, 3)}
    pairs = links.select(paths.dirname(F.col("source")).alias("source"), paths.dirname(F.col("target")).alias("target"))
    assert {r.module: r.circular_deps for r in graph.circular(pairs).collect()} == {"x": ["y"], "y": ["x"]}


def test_scan(spark, tmp_path):
    for name, content in {"src/a.py": b"import os\n", "run": b"#!/bin/bash\necho", "node_modules/x.js": b"x", "big.py": b"x" * (512 * 1024 + 1), "edge.py": b"x" * (512 * 1024), "nul.py": b"a\0b", "bad.py": b"\xff\xfe", "note.txt": b"n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = {r.path: r.language for r in repo.with_language(repo.scan(spark, str(tmp_path))).collect()}
    assert found == {"src/a.py": "python", "run": "bash", "edge.py": "python"}


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, want.fetchall())
