"""The index kept by differences equals one built anew."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import delta, graph
from fathomline.plans import index

SCHEMA = "path string, content string, size_bytes long, language string"


def made(spark, tree):
    return spark.createDataFrame([(p, c, len(c), "python") for p, c in sorted(tree.items())], SCHEMA)


def seen(table, *columns):
    return sorted(map(str, table.select(*columns).collect()))


def same(left, right):
    for name, columns in {"files": ["path", "size_bytes", "lines", "complexity", "importance", "imports", "exports"], "symbols": ["file", "line", "name"], "edges": ["source", "target", "type"], "modules": ["module", "n_files", "total_symbols", "fan_in", "fan_out", "role", F.array_join("circular_deps", ",").alias("c")]}.items():
        assert seen(getattr(left, name), *columns) == seen(getattr(right, name), *columns), name
    for name, columns in {"resolved": ["source", "import", "target", "tier"], "pairs": ["source", "target", "n"]}.items():
        assert seen(getattr(left.graph, name), *columns) == seen(getattr(right.graph, name), *columns), name


def module(rng, names):
    imports = rng.sample(["util", "a.util", "b.core", "lib.c.deep", "core", "deep", "x.y", "os", "b", "c.odd", "a.b.util", "lib.a"], rng.randint(0, 4))
    return "".join(f"import {i}\n" for i in imports) + "".join(f"def f{k}():\n    pass\n" for k in range(rng.randint(0, 2)))


def test_reverse_keys_cover_every_way(spark):
    known = ["lib/a/util.py", "web/util.py", "web/deep/util.ts", "x/b/foo.py", "y/xb/foo.py", "foo", "foo.py", "src/main.py", "a.b/c", ".env", "d/.env", "d/e.f.g"]
    asked = ["lib/a/util.py", "lib/a/util", "foo", "b/foo", "b/foo.py", "util", "a.util", "nothing", "xb.foo", "a", "d/e.f", "e.f", "ness/x", "b/c", "c", "d/", "oo.py", "e", "/foo.py", "a.b.c", "b.c"]
    pairs = spark.createDataFrame([(s, i) for s in ("src/main.py", "web/deep/q.py", "d/x") for i in asked], "source string, import string")
    for n in (0, 3, 7, 8, 10, 11):
        files = spark.createDataFrame([(p,) for p in known[: n + 1]], "path string")
        one = spark.createDataFrame([(known[n],)], "path string")
        near = {tuple(r) for r in delta.affected(pairs, one).collect()}
        found = {(r.source, r["import"]) for r in graph.resolve_imports(one, pairs).collect()}
        assert found <= near
        if n == 11:
            narrow = graph.resolve_imports(delta.candidates(files, pairs), pairs)
            assert seen(narrow, "source", "import", "target", "tier") == seen(graph.resolve_imports(files, pairs), "source", "import", "target", "tier")


@pytest.fixture
def by_degree(monkeypatch):
    """Ranks by incoming edges in place of PageRank, which has tests of its own."""
    monkeypatch.setattr(graph, "pagerank", lambda links: links.groupBy(F.col("target").alias("id")).agg(F.count("*").cast("double").alias("rank")))


def test_changes_by_difference(spark, by_degree):
    rng = random.Random(1)
    names = [f"{d}{n}.py" for d in ("a/", "b/", "lib/c/", "lib/a/", "", "a/b/") for n in ("util", "core", "deep", "odd", "b", "c")]
    tree = {p: module(rng, names) for p in rng.sample(names, 14)}
    kept = index.build(made(spark, tree))
    for step in range(2):
        for p in rng.sample(sorted(tree), 2):
            del tree[p]
        for p in rng.sample(sorted(tree), 2):
            tree[p] = module(rng, names)
        for p in rng.sample([n for n in names if n not in tree], 3):
            tree[p] = module(rng, names)
        kept = index.refresh(kept, made(spark, tree))
    same(kept, index.build(made(spark, tree)))


def test_only_touched_imports_are_resolved(spark, monkeypatch):
    tree = {f"m{k}/f{i}.py": f"import f{i + 1}\nimport g{k}\n\ndef h():\n    pass\n" for k in range(3) for i in range(5)}
    asked, ranked = [], []
    resolve = graph.resolve_imports
    monkeypatch.setattr(graph, "resolve_imports", lambda files, imports: asked.append((sorted(r.path for r in files.collect()), sorted(map(tuple, imports.collect())))) or resolve(files, imports))
    cheap = lambda links: links.groupBy(F.col("target").alias("id")).agg(F.count("*").cast("double").alias("rank"))
    monkeypatch.setattr(graph, "pagerank", lambda links: ranked.append(1) or cheap(links))
    before = index.build(made(spark, tree))
    asked.clear(), ranked.clear()
    again = index.refresh(before, made(spark, tree))
    assert not asked and not ranked
    same(again, before)
    tree["m0/f0.py"] += "X = 1\n"  # no import and no path changes
    again = index.refresh(again, made(spark, tree))
    assert not ranked and asked.pop() == (["m0/f1.py", "m1/f1.py", "m2/f1.py"], [("m0/f0.py", "f1"), ("m0/f0.py", "g0")])
    tree["lib/g1.py"] = ""
    del tree["m2/f4.py"]
    again = index.refresh(again, made(spark, tree))
    known, pairs = asked.pop()
    assert known == ["lib/g1.py", "m0/f4.py", "m1/f4.py"]
    assert set(pairs) == {(f"m1/f{i}.py", "g1") for i in range(5)} | {(f"m{k}/f3.py", "f4") for k in range(3)} - {("m2/f4.py", "g1")}
    assert ranked
    same(again, index.build(made(spark, tree)))


def test_from_and_to_nothing(spark, by_degree):
    tree = {"a/x.py": "import y\n", "b/y.py": "import x\n"}
    empty = index.build(made(spark, tree).limit(0))
    full = index.refresh(empty, made(spark, tree))
    same(full, index.build(made(spark, tree)))
    assert {r.module: r.circular_deps for r in full.modules.collect()} == {"a": ["b"], "b": ["a"]}
    assert index.refresh(full, made(spark, tree).limit(0)).modules.count() == 0


def test_hubs_are_cut_with_the_same_ranks(spark):
    rng = random.Random(2)
    links = [("hub", f"v{i}") for i in range(120)] + [(f"v{rng.randint(0, 119)}", rng.choice(["hub", "hub2", f"v{rng.randint(0, 119)}"])) for _ in range(200)] + [("hub2", f"v{i % 7}") for i in range(60)]
    df = spark.createDataFrame(links, "source string, target string")
    ranks = {r.id: r["rank"] for r in graph.pagerank(df, 5).collect()}
    cut = {r.id: r["rank"] for r in graph.pagerank(df, 5, least_cut=6).collect()}
    out, ids = {}, sorted({x for e in links for x in e})
    for s, t in links:
        out.setdefault(s, []).append(t)
    want = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(5):
        sent = dict.fromkeys(ids, 0.0)
        for s, ts in out.items():
            for t in ts:
                sent[t] += want[s] / len(ts)
        want = {i: 0.15 / len(ids) + 0.85 * sent[i] for i in ids}
    assert ranks.keys() == cut.keys() == want.keys()
    assert all(abs(ranks[i] - want[i]) < 1e-12 and abs(cut[i] - want[i]) < 1e-12 for i in ids)
    assert graph.pagerank(df.limit(0)).count() == 0
