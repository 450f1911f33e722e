"""Requests as tables and streams against the request loop, and substring search against every row."""

import json
import random

import pytest

from fathomline.operators import search
from fathomline.plans import index, requests, server


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in {"src/a.py": "import b\n\nclass One:\n    def two(self):\n        pass\n", "src/b.py": "X_Y = 1\n", "tests/test_a.py": "import a\n\ndef test_one():\n    pass\n", "spec/A.py": ""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    return index.build_from(spark, str(root))


def call(name, **arguments):
    return json.dumps({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})


LINES = [
    "", "   ", "{bad", "text", "[]", json.dumps({"id": 2, "method": "nope"}), json.dumps({"id": 3}), json.dumps({"method": "tools/list", "id": 4}), call("nope"), call("get_file_symbols"), call("search_symbols"),
    call("get_file_symbols", path="src/a.py"), call("get_file_symbols", path="src/a.py", offset=1), call("get_file_symbols", path="src/a.py", offset=-5), call("get_file_symbols", path="none"), call("analyze_file", path="src/a.py"), call("analyze_file", path="src/b.py"),
    call("search_symbols", query="O"), call("search_symbols", query="ON"), call("search_symbols", query="one"), call("search_symbols", query="test_on"), call("search_symbols", query="_"), call("search_symbols", query="zzzz"),
    call("find_tests"), call("find_tests", path="x/a.py"), call("find_tests", path="src/A.py"), call("find_tests", path="q/zz.py"), call("get_top_files", limit=2), call("get_top_files"), call("get_top_files", limit=0), call("get_top_files", limit=99),
]


def one_by_one(made, line):
    """The same answer from the request loop: (code, facts)."""
    (answer,) = [json.loads(x) for x in server.serve(made, [line])]
    if "error" in answer:
        return answer["error"]["code"], None
    result = answer["result"]
    if "tools" in result:
        return 0, [t["name"] for t in result["tools"]]
    body = json.loads(result["content"][0]["text"])
    rows = [] if isinstance(body, str) else body["rows"] if isinstance(body, dict) else body
    shown = {"kind": lambda r: f"{r['name']} {r['kind']} {r['line']}", "fact": lambda r: f"{r['fact']} {r['name']}", "importance": lambda r: f"{r['path']} {r['importance']}", "tests": lambda r: r["path"]}
    tool = json.loads(line)["params"]["name"]
    how = {"get_file_symbols": "kind", "analyze_file": "fact", "find_tests": "tests", "get_top_files": "importance"}.get(tool)
    return 0, [f"{r['file']} {r['name']} {r['line']}" if tool == "search_symbols" else shown[how](r) for r in rows]


def test_as_the_request_loop_answers(spark, made):
    asked = [(f"r{n}", line) for n, line in enumerate(LINES)] + [("again", LINES[11])]
    rows = {}
    for r in requests.answers(spark.createDataFrame(asked, "request string, line string").repartition(3), made).collect():
        rows.setdefault(r.request, []).append((r.pos, r.code, r.fact))
    assert "r0" not in rows and "r1" not in rows and len(rows) == len(asked) - 2
    for request, line in asked[2:]:
        got = sorted(rows[request])
        code, facts = one_by_one(made, line) if line not in ("[]", json.dumps({"id": 3})) else (got[0][1], None)
        assert got[0][1] == code, line
        if code == 0:
            assert [f for p, _, f in got if p] == facts, line
        else:
            assert [p for p, _, _ in got] == [0] and got[0][2]


def test_a_stream_of_requests(spark, made, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = lambda name, rows: (folder / name).write_text("\n".join(json.dumps({"request": r, "line": x}) for r, x in rows))
    stream = lambda: spark.readStream.schema("request string, line string").json(str(folder))
    lines("1.json", [("a", LINES[11]), ("b", "{bad")])
    serve = lambda: {r.request: json.loads(r.response) for r in requests.serve_stream(stream(), made, str(tmp_path / "out"), str(tmp_path / "progress")).collect()}
    first = serve()
    assert first["a"] == {"jsonrpc": "2.0", "id": "1", "result": {"rows": ["One class 3", "two method 4"]}} and first["b"]["error"]["code"] == -32700
    lines("2.json", [("c", call("search_symbols", query="TWO"))])
    assert serve().keys() == {"a", "b", "c"} and serve()["c"]["result"]["rows"] == ["src/a.py two 4"]


def test_search_by_posting_lists(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("abÄä_1") for _ in range(rng.randint(0, 7))) for _ in range(120)] + ["a", "", "aaaa", "Übermaß"]
    rows = spark.createDataFrame(list(enumerate(names)), "n long, name string").repartition(3)
    lists = search.postings(rows, "name")
    asked = ["a", "AB", "aba", "_1_", "ä", "Ä1", "baab", "zzz", "übermaß", "aaaa", "b_", "x"]
    for query in asked[::3]:
        assert sorted(r.n for r in search.find(lists, "name", query).collect()) == [n for n, x in enumerate(names) if query.lower() in x.lower()]
    many = spark.createDataFrame([(q,) for q in [*asked, "a", ""]], "query string")
    for exact in (False, True):
        got = sorted((r.query, r.n) for r in search.find_many(lists, "name", many, exact).collect())
        assert got == sorted((q, n) for q in asked for n, x in enumerate(names) if (q in x if exact else q.lower() in x.lower()))
    plan = search.find(lists, "name", "aba")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan


def test_search_without_posting_lists(spark, monkeypatch):
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(("One", "two", "", "Übermaß", "t", "onetwo"))], "n long, name string")
    asked = ["one", "T", "wo", "übermaß", "zzz", "etw"]
    many = spark.createDataFrame([(q,) for q in [*asked, "T", "", None]], "query string")
    names = [r.name for r in rows.orderBy("n").collect()]
    for few, sent in ((32, 9), (2, 9), (2, 1)):
        monkeypatch.setattr(search, "FEW", few)
        monkeypatch.setattr(search, "SENT", sent)
        for exact in (False, True):
            got = sorted((r.query, r.n) for r in search.find_among(rows, "name", many, exact).collect())
            assert got == sorted((q, n) for q in asked for n, x in enumerate(names) if (q in x if exact else q.lower() in x.lower()))


def test_requests_ask_for_no_measures_and_no_posting_lists(spark, monkeypatch):
    from fathomline.plans import bindings_sinks, bindings_tree

    for kept in ("_LINKED", "_PLACED", "_BUILT"):
        monkeypatch.setattr(bindings_tree, kept, {})
    made = lambda *_: pytest.fail("made for nothing")
    with monkeypatch.context() as m:
        m.setattr(index, "file_metrics", made)
        m.setattr(search, "postings", made)
        assert bindings_sinks.q10(spark, "/root/testdata/sf0.001").where("code = 0").count() > 0
    ranks = {(r.path, r.importance) for r in bindings_tree.placed(spark, "/root/testdata/sf0.001").files.collect()}
    whole = bindings_tree.built(spark, "/root/testdata/sf0.001")
    assert {(r.path, r.importance) for r in whole.files.collect()} == ranks and "complexity" in whole.files.columns
    assert bindings_tree.placed(spark, "/root/testdata/sf0.001") is whole
