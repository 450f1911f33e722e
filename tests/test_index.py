"""Symbol parsers, the index and the checks on small repositories."""

import pytest

from fathomline.operators.graph import resolve_imports
from fathomline.plans import index
from fathomline.sources.parsers import LANGUAGES, parse

CASES = {
    "python": ("import os\nfrom pathlib import Path\n\nclass Box:\n    def open(self):\n        pass\n\ndef pub():\n    pass\n\ndef _hid():\n    pass\n\nLIMIT = 10\n", {("Box", "class", "public", None), ("open", "method", "public", "Box"), ("pub", "function", "public", None), ("_hid", "function", "private", None), ("LIMIT", "const", "public", None)}, {"os", "pathlib"}),
    "typescript": ("import { a } from './foo';\nimport express from 'express';\nexport interface Conf {\n  a: string;\n}\nexport class Server {\n  async start(port: number): Promise<void> {\n  }\n}\nexport function make(): void {\n}\nexport const VERSION = '1';\n", {("Conf", "interface", "public", None), ("Server", "class", "public", None), ("start", "method", "public", "Server"), ("make", "function", "public", None), ("VERSION", "const", "public", None)}, {"foo"}),
    "rust": ("use crate::config;\n\npub struct App {\n}\n\nimpl App {\n    pub fn new() -> Self {\n        App {}\n    }\n    fn inner(&self) {\n    }\n}\npub trait Handler {\n}\npub enum State {\n    On,\n}\n", {("App", "struct", "public", None), ("new", "method", "public", "App"), ("inner", "method", "private", "App"), ("Handler", "trait", "public", None), ("State", "enum", "public", None)}, {"crate/config"}),
    "go": ('package main\n\nimport (\n\t"fmt"\n\t"net/http"\n)\n\ntype Server struct {\n}\n\nfunc (s *Server) Start() {\n}\n\nfunc NewServer() *Server {\n\treturn nil\n}\n', {("Server", "struct", "public", None), ("Start", "method", "public", "Server"), ("NewServer", "function", "public", None)}, {"fmt", "http"}),
    "bash": ('#!/bin/bash\nsource "$ROOT/lib/help.sh"\none() {\n  echo\n}\nfunction two {\n  echo\n}\n', {("one", "function", "public", None), ("two", "function", "public", None)}, {"lib/help.sh"}),
    "ruby": ("require 'json'\nclass A\n  def b\n  end\n  private\n  def c\n  end\nend\n", {("A", "class", "public", None), ("b", "method", "public", "A"), ("c", "method", "private", "A")}, {"json"}),
    "java": ("import java.util.List;\npublic class A {\n    private int b(int x) {\n    }\n}\n", {("A", "class", "public", None), ("b", "method", "private", "A")}, {"java.util.List"}),
    "csharp": ("using System.IO;\npublic class A {\n    public void B() {\n    }\n}\npublic interface IB {\n}\n", {("A", "class", "public", None), ("B", "method", "public", "A"), ("IB", "interface", "public", None)}, {"System.IO"}),
    "php": ("<?php\nuse App\\Model;\nclass A {\n    private function b() {\n    }\n}\n", {("A", "class", "public", None), ("b", "method", "private", "A")}, {"App/Model"}),
    "kotlin": ("import a.b.C\nclass A {\n    private fun b() {}\n}\n", {("A", "class", "public", None), ("b", "method", "private", "A")}, {"a.b.C"}),
    "swift": ("import UIKit\npublic struct A {\n    private func b() {}\n}\n", {("A", "struct", "public", None), ("b", "method", "private", "A")}, {"UIKit"}),
    "elixir": ("defmodule A.B do\n  alias C.D\n  def e(x) do\n  end\n  defp f(x) do\n  end\nend\n", {("A.B", "class", "public", None), ("e", "function", "public", "A.B"), ("f", "function", "private", "A.B")}, {"C.D"}),
}


@pytest.mark.parametrize("language", CASES)
def test_parser(language):
    content, symbols, imports = CASES[language]
    found, deps, _ = parse(content, "f", language)
    assert {(s["name"], s["kind"], s["visibility"], s["parent"]) for s in found} == symbols
    assert set(deps) == imports


def test_all_languages_have_parsers():
    assert len(LANGUAGES) == 13


def test_index_of_a_repository(spark, tmp_path):
    for name, content in {"src/a.py": "import b\n\ndef one():\n    pass\n", "src/b.py": "from lib.c import x\n", "lib/c.py": "import src.b\n\nclass C:\n    pass\n", "tests/test_a.py": "import a\n\ndef test_one():\n    pass\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    made = index.build_from(spark, str(tmp_path))
    assert {(r.source, r.target) for r in made.edges.collect()} == {("src/a.py", "src/b.py"), ("src/b.py", "lib/c.py"), ("lib/c.py", "src/b.py"), ("tests/test_a.py", "src/a.py")}
    meta = made.meta().first()
    assert (meta.total_files, meta.total_symbols, meta.total_edges, meta.languages) == (4, 3, 4, {"python": 4})
    assert made.top_files(1).first().importance == 1000
    modules = {r.module: r for r in made.modules.collect()}
    assert modules["src"].circular_deps == ["lib"] and modules["tests"].role == "testing" and modules["src"].fan_in == 3
    assert {r.fact for r in made.analyze_file("src/b.py").collect()} == {"imports_from", "imported_by"}
    assert [r.tests for r in made.find_tests("src/a.py").collect()] == [["test_one"]]
    assert [r.name for r in made.search_symbols("ON").collect()] == ["one", "test_one"]
    assert {r.section for r in index.architecture(made).collect()} == {"Key files", "Modules", "Languages"}


def test_index_takes_unchanged_files_from_the_one_before(spark, monkeypatch):
    rows = [(f"src/f{i}.py", f"import f{i + 1}\n\ndef g{i}():\n    pass\n", 30, "python") for i in range(6)]
    schema = "path string, content string, size_bytes long, language string"
    first = index.build(spark.createDataFrame(rows, schema))
    changed = [*rows[:5], ("src/f5.py", "def new():\n    pass\n", 20, "python"), ("src/f9.py", "X = 1\n", 6, "python")]
    asked = []
    inner = index.parsers.parse_files
    monkeypatch.setattr(index.parsers, "parse_files", lambda d: asked.append(sorted(r.path for r in d.select("path").collect())) or inner(d))
    second = index.build(spark.createDataFrame(changed, schema), first.parsed)
    assert asked == [["src/f5.py", "src/f9.py"]]
    whole = index.build(spark.createDataFrame(changed, schema))
    rows_of = lambda d: sorted(map(str, d.collect()))
    assert rows_of(second.symbols) == rows_of(whole.symbols) and rows_of(second.edges) == rows_of(whole.edges) and rows_of(second.files.select("path", "importance", "lines")) == rows_of(whole.files.select("path", "importance", "lines"))


def test_import_ways(spark):
    paths = ["lib/a/util.py", "web/util.py", "web/deep/util.ts", "x/b/foo.py", "y/xb/foo.py", "foo", "foo.py", "src/main.py", "web/deep/main.py"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    asked = [("src/main.py", i) for i in ("lib/a/util.py", "lib/a/util", "foo", "b/foo", "b/foo.py", "util", "a.util", "nothing", "no/thing", "xb.foo")]
    asked += [("web/deep/main.py", "util"), ("web/deep/main.py", "util.ts"), ("web/x.py", "util")]
    got = {(r.source, r["import"]): (r.target, r.tier) for r in resolve_imports(files, spark.createDataFrame(asked, "source string, import string")).collect()}
    s, w = "src/main.py", "web/deep/main.py"
    assert got == {
        (s, "lib/a/util.py"): ("lib/a/util.py", 1), (s, "lib/a/util"): ("lib/a/util.py", 1), (s, "foo"): ("foo.py", 1), (s, "b/foo.py"): ("x/b/foo.py", 3), (s, "util"): ("lib/a/util.py", 4),
        (w, "util"): ("web/deep/util.ts", 2), (w, "util.ts"): ("web/deep/util.ts", 2), ("web/x.py", "util"): ("web/util.py", 2),
    }


def test_imports_that_end_inside_a_name(spark):
    files = spark.createDataFrame([(p,) for p in ("lib/freshness/track.sh", "z/xfreshness/track.sh", "q/a/b/c.py")], "path string")
    asked = [("s", "ness/track.sh"), ("s", "freshness/track.sh"), ("s", "/b/c.py"), ("s", "a.b.c.py"), ("s", "ss.track.sh")]
    got = {r["import"]: (r.target, r.tier) for r in resolve_imports(files, spark.createDataFrame(asked, "source string, import string")).collect()}
    assert got == {"ness/track.sh": ("lib/freshness/track.sh", 3), "freshness/track.sh": ("lib/freshness/track.sh", 3), "/b/c.py": ("q/a/b/c.py", 3)}


def test_nearest_stem_by_shared_letters(spark):
    files = spark.createDataFrame([(p,) for p in ("a/m.py", "ab/m.py", "abc/x/m.py", "abc/y/m.py", "b/m.py", "é/ü/m.py", "é/z/m.py")], "path string")
    asked = [("abc/y/q.py", "m"), ("abc/z.py", "m"), ("ac/z.py", "m"), ("zz.py", "m"), ("é/ü/q.py", "m"), ("", "m")]
    got = {r.source: r.target for r in resolve_imports(files, spark.createDataFrame([(s + "", i) for s, i in asked if s], "source string, import string")).where("tier = 4").collect()}
    assert got == {"abc/z.py": "abc/x/m.py", "ac/z.py": "a/m.py", "zz.py": "a/m.py"}


def test_a_crowded_stem_is_cut_into_ranges(spark):
    """Equal to a search by hand, whatever the crowd: a stem of half of all files, sources between, before and after its paths."""
    import random

    rng = random.Random(4)
    folders = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 5))) for _ in range(60)]
    paths = sorted({f"{f}/{rng.choice(['m', 'm', 'n', 'z'])}.{rng.choice(['py', 'ts'])}" for f in folders})
    sources = sorted({f"{f}{rng.choice('ab')}/q.py" for f in folders} | {"0.py", "~.py"})
    asked = [(s, i) for s in sources for i in ("m", "n", "none")]

    def nearest(source, stem):
        share = lambda p: next((k for k, (a, b) in enumerate(zip(p, source)) if a != b), min(len(p), len(source)))
        own = [p for p in paths if p.rpartition("/")[2].rpartition(".")[0] == stem]
        return min(own, key=lambda p: (-share(p), p.encode())) if own else None

    files, imports = spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(asked, "source string, import string")
    for crowd in (1, 7, 1000):
        found = {(r.source, r["import"]): r.target for r in resolve_imports(files, imports, crowd).where("tier = 4").collect()}
        assert found and all(nearest(*k) == v for k, v in found.items())
        assert {k for k in asked if nearest(*k) and k not in found} <= {(s, i) for s, i in asked if any(p in (f"{s.rpartition('/')[0]}/{i}.py", f"{s.rpartition('/')[0]}/{i}.ts") for p in paths)}


def test_tree_imports_are_resolved_from_files_parsed_once(spark, tmp_path):
    """Resolution reads files and imports many times; it must not parse them each time, nor in one task."""
    from pyspark.sql import functions as F

    from fathomline.plans import bindings_tree as B

    spark.range(40).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    plan = B.j1_tree(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "mapinarrow" not in plan.lower()
    assert B.tree(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_the_index_resource_needs_no_ranks(spark, tmp_path, monkeypatch):
    from fathomline.plans import bindings_sinks as K

    spark.range(40).selectExpr("id AS p_partkey", "cast(id AS string) AS p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(index.graph, "pagerank", lambda *a: 1 / 0)
    row = K.q8(spark, str(tmp_path)).first()
    assert (row.resource, row.kind, row.total_files) == ("code-index", "application/json", 40) and row.total_symbols > 40 and row.total_edges > 0
