"""Sinks and the request loop."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fathomline.plans import index, server
from fathomline.sources import sinks


def test_upsert_and_stats(spark, tmp_path):
    schema = "repo_name string, timestamp string, total_files long, total_symbols long, languages map<string,long>"
    path = str(tmp_path / "knowledge")
    sinks.upsert(spark, path, spark.createDataFrame([("a", "1", 5, 9, {"go": 1}), ("b", "1", 2, 3, {"go": 2, "rust": 1})], schema))
    out = sinks.upsert(spark, path, spark.createDataFrame([("a", "2", None, 10, {"python": 1})], schema), fill=("total_files",))
    assert {r.repo_name: (r.timestamp, r.total_files, r.total_symbols) for r in out.collect()} == {"a": ("2", 5, 10), "b": ("1", 2, 3)}
    assert tuple(sinks.stats(out).first()) == (2, 7, 13, ["go", "python", "rust"])


ENTRY = "repo_name string, timestamp string, total_files long"


@pytest.mark.parametrize("breaks", ["write", "replace"])
def test_a_broken_upsert_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch, breaks):
    path = str(tmp_path / "t")
    sinks.upsert(spark, path, spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], ENTRY))
    with monkeypatch.context() as patch:
        if breaks == "replace":
            patch.setattr(sinks, "_replace_pointer", lambda *a: 1 / 0)
            new = spark.createDataFrame([("a", "2", 9)], ENTRY)
        else:  # a row fails while the segment is written
            new = spark.createDataFrame([("a", "2", 9)], ENTRY).withColumn("total_files", F.expr("total_files + cast(raise_error('lost') as long)"))
        with pytest.raises(Exception, match="division|lost"):
            sinks.upsert(spark, path, new)
    rows = lambda t: {r.repo_name: (r.timestamp, r.total_files) for r in t.collect()}
    assert rows(sinks.read_newest(spark, path)) == {"a": ("1", 1), "b": ("1", 2)}
    assert rows(sinks.upsert(spark, path, spark.createDataFrame([("a", "3", 3)], ENTRY))) == {"a": ("3", 3), "b": ("1", 2)}


def test_many_small_upserts_rewrite_little(spark, tmp_path):
    """Equal to one that sees all rows, with a reader that holds an older table, and with few segments."""
    path, seen = str(tmp_path / "t"), {}
    (tmp_path / "t").mkdir()
    spark.createDataFrame([(f"k{i}", "00", i) for i in range(40)], ENTRY).write.mode("overwrite").parquet(path)  # as others write it
    seen.update({f"k{i}": ("00", i) for i in range(40)})
    held = None
    for n in range(1, 6):
        batch = [(f"k{(n * 7 + j) % 50}", f"{n:02}", None if j == 1 else 100 * n + j) for j in range(3)]
        for k, t, v in batch:
            seen[k] = (t, seen.get(k, (None, None))[1] if v is None else v)
        out = sinks.upsert(spark, path, spark.createDataFrame(batch, ENTRY), fill=("total_files",))
        if held is not None:
            assert held.count() >= 40  # its segments are still there
        held = out
        assert len(sinks._pointer(spark, path)["segments"]) <= 4
    rows = {r.repo_name: (r.timestamp, r.total_files) for r in held.collect()}
    assert rows == seen
    again = sinks.upsert(spark, path, spark.createDataFrame(batch, ENTRY), fill=("total_files",))
    assert {r.repo_name: (r.timestamp, r.total_files) for r in again.collect()} == seen
    assert sinks.read_newest(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("seed", range(3))
def test_a_filled_value_counts_as_of_its_row(spark, tmp_path, seed):
    """Late rows and nulls over many upserts: the table is what upserting row by row into it leaves, however segments merged."""
    draw, path, table = random.Random(seed), str(tmp_path / "t"), {}
    for n, most in enumerate((12, 1, 2, 1, 4, 1)):
        times = draw.sample(range(n, 300, 6), 3 * most)  # no time twice
        batch = [(f"k{draw.randrange(most)}", f"{t:03}", draw.choice((None, t))) for t in times]
        for k in {k for k, _, _ in batch}:
            held = [table[k]] if k in table else []
            both = held + [(t, v) for x, t, v in batch if x == k]
            table[k] = (max(t for t, _ in both), max(((t, v) for t, v in both if v is not None), default=(None, None))[1])
        out = sinks.upsert(spark, path, spark.createDataFrame(batch, ENTRY), fill=("total_files",))
        assert out.columns == ["repo_name", "timestamp", "total_files"]
        assert {r.repo_name: (r.timestamp, r.total_files) for r in out.collect()} == table


def test_owned_files(tmp_path):
    own, foreign = tmp_path / "g.md", tmp_path / "f.md"
    foreign.write_text("mine")
    assert sinks.write_owned(str(own), "one") and sinks.write_owned(str(own), "two") and not sinks.write_owned(str(foreign), "x")
    assert "two" in own.read_text() and "one" in (tmp_path / "g.md.bak").read_text() and foreign.read_text() == "mine"


def test_sections_of_readers_stay(tmp_path):
    own = tmp_path / "g.md"
    sinks.write_owned(str(own), "# T\n## Commands\nmake")
    own.write_text(own.read_text().replace("make\n", "make\n\n## Notes\nkeep me\n"))
    sinks.write_owned(str(own), "# T\n## Commands\nmake all")
    sinks.write_owned(str(own), "# T\n## Commands\nmake more")
    text = own.read_text()
    assert "make more" in text and text.count("## Notes\nkeep me") == 1 and "make all" not in text
    assert sinks.user_sections("a\n## Gotchas\nx\n## Mine\ny\n## CI\nz\n## Other\nw") == "## Mine\ny\n\n## Other\nw"


def test_request_loop(spark, tmp_path):
    (tmp_path / "a.py").write_text("import b\n\ndef one():\n    pass\n")
    (tmp_path / "b.py").write_text("X = 1\n")
    made = index.build_from(spark, str(tmp_path))
    calls = [("initialize", {}), ("tools/list", {}), ("tools/call", {"name": "get_top_files", "arguments": {"limit": 1}}), ("tools/call", {"name": "get_file_symbols", "arguments": {"path": "a.py"}}), ("tools/call", {"name": "get_file_symbols", "arguments": {"path": "none"}}), ("nope", {}), ("resources/list", {}), ("resources/read", {"uri": "repo://code-index"}), ("resources/read", {"uri": "repo://manifest"})]
    asked = ["", "{bad", *(json.dumps({"id": n, "method": m, "params": p}) for n, (m, p) in enumerate(calls))]
    bad, *out = [json.loads(x) for x in server.serve(made, asked)]
    assert bad["error"]["code"] == -32700 and len(out[1]["result"]["tools"]) == 7 and all(t["inputSchema"]["type"] == "object" for t in out[1]["result"]["tools"])
    body = lambda n: json.loads(out[n]["result"]["content"][0]["text"])
    assert body(2) == [{"path": "b.py", "importance": 1000}] and body(3)["rows"][0]["name"] == "one" and not body(3)["more"] and "none" in body(4)
    assert out[5]["error"]["code"] == -32603 and [r["uri"] for r in out[6]["result"]["resources"]] == ["repo://code-index"]
    assert json.loads(out[7]["result"]["contents"][0]["text"])["total_files"] == 2 and "no manifest" in out[8]["error"]["message"]


def test_streams(spark, tmp_path):
    from fathomline.streaming import incremental

    folder, table, progress = tmp_path / "in", str(tmp_path / "latest"), str(tmp_path / "progress")
    folder.mkdir()
    schema = "repo_name string, timestamp string, total long"
    stream = lambda: spark.readStream.schema(schema).json(str(folder))
    (folder / "1.json").write_text('{"repo_name": "a", "timestamp": "1", "total": 1}\n{"repo_name": "b", "timestamp": "1", "total": 2}\n')
    incremental.upsert_stream(stream(), table, "repo_name", "timestamp", progress)
    (folder / "2.json").write_text('{"repo_name": "a", "timestamp": "2", "total": 5}\n')
    out = incremental.upsert_stream(stream(), table, "repo_name", "timestamp", progress)
    assert {r.repo_name: (r.timestamp, r.total) for r in out.collect()} == {"a": ("2", 5), "b": ("1", 2)}
    log = lambda: incremental.append_learnings(spark, str(folder), str(tmp_path / "log"), schema, str(tmp_path / "seen"))
    assert log().count() == 3
    (folder / "3.json").write_text('{bad\n{"repo_name": "c", "timestamp": "3", "total": 1}\n')
    assert log().count() == 4 and log().count() == 4
