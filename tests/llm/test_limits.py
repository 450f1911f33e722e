"""Past the limits that operators used to have: many sources, many languages, clashing names, long texts."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from fathomline.llm import ann, langid, mixing, packing
from fathomline.llm.queries import tokenizer


def test_packing_of_more_sources_than_queues(spark):
    path = tokenizer("byte_bpe_50k.json")
    rows = [(i, "word " * (i % 9), f"s{i % 37}" if i % 50 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for queues, targets in ((8, {"s1": 0.5, None: 0.1}), (1024, None)):
        pieces = packing.pack(docs, path, window=64, quantum=16, queues=queues, targets=targets).toPandas()
        assert set(pieces.doc_id) == set(range(400))
        for _, p in pieces.sort_values("start").groupby("doc_id"):
            assert (p.start == p.length.cumsum() - p.length).all() and p.length.sum() == p.doc_tokens.iloc[0]
        for _, p in pieces.sort_values("offset").groupby("sequence_id"):
            n = int(p.length.sum())
            assert (p.offset == p.length.cumsum() - p.length).all() and n <= 64 and n & (n - 1) == 0


def test_mixing_twice_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "text " * i, "en", "s", 1.0, "x", 2) for i in range(50)], "doc_id long, text string, lang string, source string, mix_probability double, mix_topic string, mix_lang_key int")
    once = mixing.mix(docs)
    twice = mixing.mix(once)
    assert once.columns == twice.columns == ["doc_id", "text", "lang", "source", "mix_lang_key", *mixing.RESULTS]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and once.where("mix_topic = 'note'").count() == 50


def test_language_id_keeps_every_language(spark):
    rng = np.random.default_rng(0)
    rows = [(1000 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.integers(0, 9)}" for _ in range(30)), f"l{k}") for k in range(40) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs, docs, per_class=4, landmarks=160).join(docs, "doc_id").toPandas()
    assert set(out.lang_pred) == {f"l{k}" for k in range(40)} and (out.lang_pred == out.lang).mean() > 0.95


def test_presence_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(32, 127, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 10, 4000, 4001, 5000, 5000])
    whole = langid.presence(data, offsets)
    for block in (7, 64, 4096):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert (langid.presence(data, offsets) == whole).all()
    assert whole[0].sum() == 0 and whole[3].sum() == 1


def test_nearest_scores_few_pairs_at_once():
    rng = np.random.default_rng(5)
    queries, points, sizes = rng.integers(-3, 4, (2000, 4)).astype(float), rng.integers(-3, 4, (4000, 4)).astype(float), np.full(400, 10)
    visited, first = rng.random((2000, 400)) < 0.7, rng.permutation(4000)
    tracemalloc.start()
    who, row, score = ann._met(queries, visited, points, sizes, first, 21)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # of all leaves' best together: over 400 MB
    for q in range(0, 2000, 97):
        own = np.flatnonzero(np.repeat(visited[q], sizes))
        exact = points[own] @ queries[q]
        best = np.lexsort((first[own], -exact))[:21]
        assert list(row[who == q]) == list(own[best]) and list(score[who == q]) == list(exact[best])


def test_nearest_queries_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 6)))], "vec_id long, embedding array<double>")
    found = lambda: sorted(map(tuple, ann.search(vectors, F.col("vec_id") % 3 == 0).collect()))
    whole = found()
    monkeypatch.setattr(ann, "ASKERS", 70)
    assert found() == whole and len(whole) == 300 * 20
