"""The divergence audit against sums over every term, with whole numbers of any size."""

import collections
import random
import re

import duckdb

from fathomline.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, item string"


def brute(rows, min_docs, top):
    groups, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source, *_ in rows:
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p = shares(own)
        f = lambda a, b: (a - b) ** 2 // b
        pairs = []
        for (other, name), theirs in groups.items():
            if other == lang and name != source:
                q = shares(theirs)
                pairs.append((name, sum(f(p[t], q[t]) for t in kept)))
        whole = shares(sum((c for (x, _), c in groups.items() if x == lang), collections.Counter()))
        terms = [(t, f(p[t], whole[t])) for t in kept if own[t] > 0 and p[t] > whole[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked[:most], 1)]
    return sorted(out)


def rows():
    rng = random.Random(1)
    words = ["Alpha", "beta", "γάμμα", "Über", "über", "a", "日本", "ÉTÉ", "x_y", "don't", "🙂"]
    made = []
    for i in range(90):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + " rare" + "abcdefgh"[i % 8] * (i % 40)
        made.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "S2", "ß", None])))
    made += [(200, None, "en", "empty"), (201, "", "de", "only"), (202, "123 ... \n", "de", "digits"), (203, "solo words here", "it", "one"), (204, "tie tie tie", "en", "s1"), (204, "tie tie tie", "en", "s1"), (204, "tie", "en", "s2")]
    made += [(300, "abc" * 50_000 + " beta" * 300_000, "fr", "s2"), (301, "glued", "en", "a"), (302, "Glued", "en", "b"), (303, "glued", "en", "c")]
    return [(*r, "t", 5, "i") for r in made]


def result(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_against_every_term(spark, monkeypatch):
    made = rows()
    df = spark.createDataFrame(made, SCHEMA).repartition(5)
    for min_docs, top in ((3, 200), (1, 2), (60, 200)):
        assert result(divergence.audit(df, min_docs=min_docs, top=top)) == brute(made, min_docs, top)
    monkeypatch.setattr(divergence, "SLICE", 200)  # many slices a task
    assert result(divergence.audit(df)) == brute(made, 3, 200)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_stay_exact_beyond_64_bits(spark):
    count = 10**13
    got = spark.range(1).select(divergence.share(divergence.F.lit(count), divergence.F.lit(2 * count), divergence.F.lit(7))).first()[0]
    assert got == 1 + 10**9 * (count + 1) // (2 * count + 7)


def test_registered_query(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert result(queries.op13_divergence(spark, "/root/testdata/sf0.001")) == sorted(con.sql(queries.oracle_sql()["op13_divergence"]).fetchall())
