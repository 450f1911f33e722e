"""Parsers on ordinary code that line patterns can't read: strings, comments, templates, here-documents, nesting, groups."""

import time

import pytest
from pyspark.sql import functions as F

from fathomline.sources import parsers
from fathomline.sources.lexer import LEXICONS, Tree, lex

#: language: (text, (line, name, kind, visibility, parent, docstring) in order, imports)
HARD = {
    "python": ('"""Module text.\n\ndef not_real():\n    pass\n"""\nimport os, sys as system\nfrom ..pkg.mod import (\n    a,\n    b,\n)\n\n@decorated(\n    "class Fake:"\n)\nclass Box(Base,\n          metaclass=Meta):\n    """First line.\n\n    class Inner in text:\n    """\n    x = {"def": 1}\n    LIMIT = 3\n\n    async def open(self, a={"k": (1, 2)}) -> dict[str, int]:\n        \'\'\'Opens\n        it.\'\'\'\n        def hidden():\n            pass\n        return f"{a}: # no comment"\n\n    class Inner:\n        def deep(self): pass\n\ndef pub(a, b="):"):  # trailing: def x()\n    r"""Raw doc"""\n\nif True:\n    def cond(): ...\n    LEVEL: int = 1\ns = """\nimport fake\nX_Y = 2\n"""\n_HID = 1\nA = 2\n',
        [(15, "Box", "class", "public", None, "First line."), (24, "open", "method", "public", "Box", "Opens"), (31, "Inner", "class", "public", None, None), (32, "deep", "method", "public", "Inner", None), (34, "pub", "function", "public", None, "Raw doc"), (38, "cond", "function", "public", None, None), (39, "LEVEL", "const", "public", None, None), (44, "_HID", "const", "public", None, None)], {"os", "sys", "pkg/mod"}),
    "javascript": ('import def, { x } from "./a";\nimport "./side";\nexport { y } from \'../lib/y\';\n/* function gone() {}\n   class Gone {} */\n/**\n * @tag skipped\n * Runs things.\n */\nexport class Server extends Base {\n  text = "{";\n  re = /[{/]\\/}/g;\n  #hidden = `a ${ {b: "}"}.b } {`;\n  constructor(a) { super(a); }\n  async run(a, { b } = {}) {\n    if (a) { go(); }\n    function local() {}\n    const inner = () => 1;\n  }\n  static get size() { return 1 / 2; }\n  *gen() { yield "import z from \'./z\'"; }\n}\nfunction top() {}\nexport default async function main(\n  a,\n  b,\n) {\n}\nconst add = (a, b) => a + b, other = 1;\nconst plain = { run() {}, x: () => { function no() {} } };\nexport const make = async ({ a, b }) => {\n  const not = () => {};\n};\nexport const LIMIT = 10;\nlet one = x => x * 2;\nif (a) { function branch() {} }\nconst m = require(\'./req\');\nconst { q } = require("../up/q");\n// class Comment {}\nconst t = `\nclass InTemplate {}\nimport f from "./fake"\n`;\n',
        [(10, "Server", "class", "public", None, "Runs things."), (15, "run", "method", "public", "Server", None), (20, "size", "method", "public", "Server", None), (21, "gen", "method", "public", "Server", None), (23, "top", "function", "private", None, None), (24, "main", "function", "public", None, None), (29, "add", "function", "private", None, None), (31, "make", "function", "public", None, None), (34, "LIMIT", "const", "public", None, None), (35, "one", "function", "private", None, None), (36, "branch", "function", "private", None, None)], {"a", "side", "lib/y", "req", "up/q"}),
    "typescript": ('import type { T } from "../types";\nexport abstract class Repo<T extends { id: string }> implements X<T> {\n  private map: Map<string, { a: number }> = new Map();\n  abstract find(id: string): T;\n  public async get<K extends keyof T>(key: K, opts: { deep?: boolean } = {}): Promise<T[K]> {\n    return `${key}}`;\n  }\n}\nexport interface Shape {\n  area(): number;\n  inner: { f(): void };\n}\nexport type Pair<A> = { run(): A };\nexport const enum Color { Red = "}" }\nnamespace N {\n  export function inside(): void {}\n  class Hid { go() {} }\n}\nexport const typed: (a: number) => void = (a) => {};\nexport const gen = <T,>(x: T): T => x;\n',
        [(2, "Repo", "class", "public", None, None), (5, "get", "method", "public", "Repo", None), (9, "Shape", "interface", "public", None, None), (13, "Pair", "type", "public", None, None), (14, "Color", "enum", "public", None, None), (16, "inside", "function", "public", None, None), (17, "Hid", "class", "private", None, None), (17, "go", "method", "public", "Hid", None), (19, "typed", "function", "public", None, None), (20, "gen", "function", "public", None, None)], {"types"}),
    "go": ('package a\n\nimport "os"\nimport (\n\tf "fmt"\n\t_ "github.com/x/y"\n\t// "commented/out"\n)\n\nconst (\n\tOne = iota\n\ttwo\n)\n\nvar text = `\nfunc fake() {}\n"quoted/path"\n`\n\n// Shape is one.\n// More of it.\ntype Shape interface {\n\tArea() float64\n}\n\ntype (\n\tPoint struct{ X int }\n\tID    string\n)\n\nfunc (p *Point) Move(f func(int) interface{}) (err error) {\n\tvar local = "}"\n\ttype inner struct{}\n\treturn func() error { return nil }()\n}\n\nfunc New[T any](x T) struct{} {\n\treturn struct{}{}\n}\n',
        [(11, "One", "const", "public", None, None), (12, "two", "const", "private", None, None), (15, "text", "const", "private", None, None), (22, "Shape", "interface", "public", None, "Shape is one."), (27, "Point", "struct", "public", None, None), (28, "ID", "type", "public", None, None), (31, "Move", "method", "public", "Point", None), (37, "New", "function", "public", None, None)], {"os", "fmt", "y"}),
    "rust": ('use crate::{a, b::{self, c as d}, e::*};\nuse super::up;\nuse std::fmt;\nmod child;\npub mod open_ { pub fn in_mod() {} }\n/* outer /* fn nested() {} */ fn still() {} */\n/// Docs of App.\n#[derive(Debug, Clone)]\npub struct App<\'a> {\n    c: char,\n}\nimpl<\'a, T: Into<String>> From<T> for App<\'a> {\n    fn from(t: T) -> Self {\n        let c = \'{\';\n        let s = r#"fn raw() { " }"#;\n        fn local() {}\n        App { c }\n    }\n}\nimpl App<\'_> {\n    /// Runs.\n    pub async fn run(&self) -> [u8; 3] { [b\'}\', 0, 0] }\n}\npub trait Handler {\n    fn handle(&self) { }\n}\nmacro_rules! make { () => { fn made() {} } }\npub(crate) const LIMIT: &str = "const FAKE: u8 = 1;";\nstatic mut STATE: u8 = 0;\npub type Res<T> = Result<T, ()>;\nenum Kind { A { x: u8 }, B }\nunsafe fn raw() {}\n',
        [(5, "in_mod", "function", "public", None, None), (9, "App", "struct", "public", None, "Docs of App."), (13, "from", "method", "private", "App", None), (22, "run", "method", "public", "App", "Runs."), (24, "Handler", "trait", "public", None, None), (28, "LIMIT", "const", "public", None, None), (29, "STATE", "const", "private", None, None), (30, "Res", "type", "public", None, None), (31, "Kind", "enum", "private", None, None), (32, "raw", "function", "private", None, None)], {"crate/a", "crate/b", "crate/b/c", "crate/e/*", "super/up", "child"}),
    "ruby": ('require "json"\nrequire_relative \'lib/a\'\n=begin\nclass Gone\nend\n=end\nmodule Outer\n  class Inner < Base\n    TEXT = <<~EOS\n      def fake\n      end\n    EOS\n    def run(a = "end", b: %w[if end])\n      if a then b end\n      x = if a\n        1\n      end\n      return 1 unless b\n      while a do\n        a.each do |y|\n          puts "#{y.map { |z| "end" }}"\n        end\n      end\n      /end/ =~ a\n    end\n    def short = 1\n    def self.make; new; end\n    class << self\n      def meta; end\n    end\n    private\n    def hid?; end\n  end\n  def after; end # def comment\nend\ndef top; end\n',
        [(7, "Outer", "class", "public", None, None), (8, "Inner", "class", "public", None, None), (13, "run", "method", "public", "Inner", None), (26, "short", "method", "public", "Inner", None), (27, "make", "method", "public", "Inner", None), (29, "meta", "method", "public", "Inner", None), (32, "hid?", "method", "private", "Inner", None), (34, "after", "method", "public", "Outer", None), (36, "top", "function", "public", None, None)], {"json", "lib/a"}),
    "bash": ('#!/bin/bash\n. ./lib/a.sh\nsource "$(dirname "$0")/lib/b.sh"\n# source fake.sh\nrun() {\n  echo "}" \'{\' ${x#*/} $#\n  inner() { :; }\n  cat <<EOF\nfake() {\n}\nsource no.sh\nEOF\n}\nx=$((1<<n))\nfunction two {\n  [ -n "$1" ] && source lib/c.sh\n}\n',
        [(5, "run", "function", "public", None, None), (15, "two", "function", "public", None, None)], {"./lib/a.sh", "lib/b.sh", "lib/c.sh"}),
    "java": ('package p;\nimport static a.B.c;\nimport java.util.*;\n/* class Gone {} */\n@Service("class X {")\npublic final class A extends B<C> implements D {\n  private Map<String, List<Integer>> m = new HashMap<>();\n  char c = \'{\'; String s = "\\"}{"; String t = """\n    void fake() {}\n    """;\n  public A(int x) { super(x); }\n  @Override\n  public <T extends X> Map<String, T> run(final int x) throws E, F {\n    if (x > 1) { call(); }\n    Runnable r = () -> { go(); };\n    return new Object() { void anon() {} };\n  }\n  private static int[] hid(){ return null; }\n  enum Kind { A { }, B; void of() {} }\n  static class Nested { abstract int deep(); }\n  void last() {}\n}\ninterface I { int size(); default void go() {} }\n',
        [(6, "A", "class", "public", None, None), (13, "run", "method", "public", "A", None), (18, "hid", "method", "private", "A", None), (19, "Kind", "enum", "public", None, None), (19, "of", "method", "public", "Kind", None), (20, "Nested", "class", "private", None, None), (20, "deep", "method", "public", "Nested", None), (21, "last", "method", "public", "A", None), (23, "I", "interface", "public", None, None), (23, "size", "method", "public", "I", None), (23, "go", "method", "public", "I", None)], {"a.B.c", "java.util.*"}),
    "csharp": ('using System.IO;\n// class Gone {}\npublic class A {\n    string s = @"class ""Fake"" {";\n    string t = $"{(x ? "}" : "{")} class Fake2 {{";\n    public async Task<int> Run(int x) {\n    }\n    /* public void Gone() {\n    } */\n    private int hid() { return 1; }\n}\n',
        [(3, "A", "class", "public", None, None), (6, "Run", "method", "public", "A", None), (10, "hid", "method", "private", "A", None)], {"System.IO"}),
    "php": ("<?php\nuse App\\Model;\nrequire_once('lib/x.php');\n$t = <<<EOT\nclass Fake {}\nEOT;\nfunction top() { return 'function fake() {}'; }\nclass A {\n    # function gone() {}\n    private function hid() {}\n    public static function &pub() {}\n}\n",
        [(7, "top", "function", "public", None, None), (8, "A", "class", "public", None, None), (10, "hid", "method", "private", "A", None), (11, "pub", "method", "public", "A", None)], {"App/Model", "lib/x.php"}),
    "kotlin": ('import a.b.C\n/* /* class Gone */ fun gone() {} */\nval t = """\nfun fake() {}\n"""\ndata class A(val x: String = "}") {\n    private fun hid() = "${ listOf("fun x()").map { it } }"\n    suspend fun pub() {}\n}\n',
        [(6, "A", "class", "public", None, None), (7, "hid", "method", "private", "A", None), (8, "pub", "method", "public", "A", None)], {"a.b.C"}),
    "swift": ('import UIKit\nlet t = """\nfunc fake() {}\n"""\npublic struct A {\n    private func hid() { print("\\(x("}")) func no() {") }\n    // func gone() {}\n    func pub() {}\n}\n',
        [(5, "A", "struct", "public", None, None), (6, "hid", "method", "private", "A", None), (8, "pub", "method", "public", "A", None)], {"UIKit"}),
    "elixir": ('defmodule A.B do\n  @doc """\n  def fake(x) do\n  """\n  alias C.D\n  def run(x), do: "defp no #{x}"\n  # def gone(x)\n  defp hid(x), do: ~s(def no)\nend\n',
        [(1, "A.B", "class", "public", None, None), (6, "run", "function", "public", "A.B", None), (8, "hid", "function", "private", "A.B", None)], {"C.D"}),
}


@pytest.mark.parametrize("language", HARD)
def test_hard_code(language):
    text, symbols, imports = HARD[language]
    found, deps, _ = parsers.parse(text, "f", language)
    assert [(s["line"], s["name"], s["kind"], s["visibility"], s["parent"], s["docstring"]) for s in found] == symbols
    assert set(deps) == imports
    crlf, *_ = parsers.parse(text.replace("\n", "\r\n"), "f", language)
    assert [(s["line"], s["name"]) for s in crlf] == [(s[0], s[1]) for s in symbols] or language in ("php",)


def test_brackets_and_strings():
    code = lex("a('(', /* ) */ [b{c}]) `${ `x ${ {d: 1}.d }` } ) {`;\ne({", LEXICONS["javascript"]).code
    tree = Tree(code)
    assert [code[k] for k in tree.opens] == ["(", "[", "{", "(", "{"] and tree.closes[-2:] == [len(code)] * 2
    assert tree.inner(code.index("c")) == 2 and tree.inner(code.index("e")) == -1 and code.count("\n") == 1
    assert Tree(")]}a{").inner(3) == -1 and Tree("{(}a").inner(3) == -1


def test_unfinished_code_is_read_to_its_end():
    for language in LEXICONS:
        for text in ("", "\n", '"', "'", "`${", "/*", "{", "}", "<<EOF\n", "class", "def ", "r#\"", "$(", '"""', "(" * 5000, "}" * 5000, '"#{' * 3000, "`${" * 3000, "\\"):
            assert parsers.parse(text, "f", language)[0] == []


def test_time_grows_with_the_text():
    for language, (text, symbols, _) in HARD.items():
        many = -(-200_000 // len(text))
        began = time.time()
        parsers.parse(text * many, "f", language)
        parsers.parse((text[: len(text) // 2] + "\n") * many, "f", language)
        for odd in ("let x: a < (", "'\"/* `", "a(b[c{", "@x public \n", "import (\n", "<<A\n", "impl<a ", "# \"\"\"\n"):
            parsers.parse(odd * (60_000 // len(odd)), "f", language)
        assert time.time() - began < 15, language


def test_table_function_and_batches_agree(spark):
    rows = [(f"{language}.x", text, language) for language, (text, _, _) in HARD.items()] + [("n", None, "go"), ("u", "text", "unknown"), ("e", "", "rust")]
    files = spark.createDataFrame(rows, "path string, content string, language string").repartition(3)
    listed = parsers.parse_files(files)
    assert {r.path: len(r.symbols) for r in listed.collect()} == {f"{k}.x": len(v[1]) for k, v in HARD.items()} | {"n": 0, "e": 0}
    flat = sorted(map(str, listed.select(F.explode("symbols").alias("s")).select("s.*").collect()))
    files.createOrReplaceTempView("hard_files")
    name = parsers.register(spark)
    assert sorted(map(str, spark.sql(f"SELECT s.* FROM hard_files, LATERAL {name}(path, content, language) s").collect())) == flat
