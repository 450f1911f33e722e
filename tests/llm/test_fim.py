"""Fill-in-the-middle against a per-row version with the standard library."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import fim, queries

PATTERNS = {"lines": r"[^\n]*\n|[^\n]+", "chars": r"(?s:.)", "words": r"(?s:^[ \t-\r]*[^ \t-\r]*|[ \t-\r]+[^ \t-\r]*)"}
TEXTS = [None, "", "a", "\n", "a\nb", "a\n\nb\n", "é\n🙂🙂\nü", "x<P>y\n", "<", "<P", "P>", "<S", "ends with <", "line one\nline two\nline three", "\x00\r\n\x00"]


def by_row(text, numbers, unit, rate, spm):
    text = text or ""
    units = [x for x in re.findall(PATTERNS[unit], text) if x]
    n = len(units)
    a, b = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.SENTINELS) or numbers[2] % 100 >= rate:
        return n, "plain", None, None, text
    if numbers[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", PATTERNS)
def test_kernel(unit):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["a", "é", "🙂", "\n", " ", "<", "P", ">", "<M>" if rng.random() < 0.1 else "q"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    seeds = [np.random.default_rng(k).integers(0, 1 << 32, len(texts)) for k in range(4)]
    for rate, spm in ((100, 50), (60, 0), (60, 100), (0, 50)):
        for rows in (slice(None), slice(0, 0), slice(0, 2), slice(2, 3), slice(5, 90)):
            made = fim.transform(pa.array(texts, pa.string())[rows], [s[rows] for s in seeds], unit, rate, spm, fim.SENTINELS)
            got = list(zip(*(made[c].to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars", "output"))))
            assert got == [by_row(t, [int(s) for s in h], unit, rate, spm) for t, *h in zip(texts[rows], *(s[rows] for s in seeds))]
            assert fim.rebuilt(made["output"], made["form"], fim.SENTINELS).to_pylist() == [t or "" for t in texts[rows]]


def test_operator_over_rows(spark):
    texts = [*TEXTS, "long line\n" * 700_000, "one " * 3, "one " * 3]
    rows = [(i, t, "k", 1, "f", "o") for i, t in enumerate(texts)] + [(None, "a\nb\nc", "k", 1, "f", "o"), (16, "one " * 3, "k", 1, "f", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n int, form string, output string").repartition(3)
    out = fim.fill_in_middle(df, carry=["text", "n"])
    for r in out.collect():
        digest = hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        want = by_row(r.carried.text, [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], "lines", 100, 50)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
    assert out.count() == len(rows)
    back = fim.restore(out, carry=["carried"])
    assert back.where(~F.col("text").eqNullSafe(F.coalesce("carried.carried.text", F.lit("")))).count() == 0
    assert fim.restore(fim.fill_in_middle(df.limit(0)), carry=["doc_id"]).count() == 0
    assert fim.fill_in_middle(df, rate=0).where("form <> 'plain'").count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, sentinels=("<P>", "<P>", "<M>"))


def test_wrong_output_is_told():
    with pytest.raises(ValueError):
        fim.rebuilt(pa.array(["<P>a<S>b"]), pa.array(["psm"]), fim.SENTINELS)


def test_registered_query(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op12_fim"]).fetchall()
    got = queries.op12_fim(spark, "/root/testdata/sf0.001").select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
