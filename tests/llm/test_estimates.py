"""Estimators against brute force: the determinant of op4, the recall of op6 on queries that calibrated nothing."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from fathomline.llm import ann, quality


def least_determinant(x, starts=300):
    """(mean, covariance) of the subset with the least determinant that concentration reaches from many random starts."""
    rng, n = np.random.default_rng(0), len(x)
    h, best = int(np.ceil(quality.H * n)), (np.inf, None, None)
    floors = np.diag([s[1] ** 2 for s in quality.STATS])
    for _ in range(starts):
        subset = rng.choice(n, x.shape[1] + 1, replace=False)
        for _ in range(30):
            mean, cov = x[subset].mean(0), np.cov(x[subset].T, bias=True) + floors
            y = x - mean
            again = np.argsort(np.einsum("ij,ij->i", y @ np.linalg.inv(cov), y), kind="stable")[:h]
            if set(again) == set(subset):
                break
            subset = again
        mean, cov = x[subset].mean(0), np.cov(x[subset].T, bias=True)
        if (det := np.linalg.slogdet(cov + floors)[1]) < best[0]:
            best = (det, mean, cov)
    return best


def test_verdicts_equal_those_of_the_least_determinant(spark):
    rng, p = np.random.default_rng(8), len(quality.STATS)
    spread = np.array([s[1] for s in quality.STATS]) * 1000
    x = rng.normal(4000, 1, (400, p)) + rng.normal(0, 3, (400, p)) * spread
    x[:60] += 40 * spread * rng.choice([-1, 1], (60, p))
    x[60:80, 1] += 60 * spread[1]
    x = np.round(x)
    rows = [(i, "en", "s", *map(int, v)) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"x{i} long" for i in range(p)))
    got = {r.doc_id: r.d2 for r in quality.robust_outliers(frame).collect()}
    _, mean, cov = least_determinant(x / 1000)
    consistency = quality.H / quality.chi2_cdf(quality.chi2_quantile(quality.H, p), p + 2)
    y = x / 1000 - mean
    want = np.einsum("ij,ij->i", y @ np.linalg.inv(cov * consistency + np.diag([s[1] ** 2 for s in quality.STATS])), y)
    limit = quality.chi2_quantile(quality.LEVEL, p) * quality.CUTOFF
    assert {i for i, d in got.items() if d > limit} == set(np.flatnonzero(want > limit)) == set(range(80))
    clean = np.array([got[i] for i in range(80, 400)])
    assert np.corrcoef(clean, want[80:])[0, 1] > 0.97 and abs(np.median(clean) / np.median(want[80:]) - 1) < 0.15


def test_far_statistics_are_told_apart(spark):
    docs = spark.createDataFrame([(i, " ".join("w%d" % (i * 7 + k) for k in range(40)), "en", "s") for i in range(200)] + [(1000 + n, ("x" * n + " ") * 3 + "a b c d e f g h", "en", "s") for n in (30, 300, 3000)], "doc_id long, text string, lang string, source string")
    d2 = {r.doc_id: r.d2 for r in quality.quality(docs).where("doc_id >= 1000").collect()}
    assert d2[1030] < d2[1300] < d2[4000]


def test_recall_on_queries_that_calibrated_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "CALIBRATION", 15)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    out = ann.search(table, F.col("vec_id") % 20 == 0).toPandas()
    rows = table.where("embedding is not null").toPandas()
    usable = [(i, np.asarray(v, float)) for i, v in zip(rows.vec_id, rows.embedding) if len(v) == 64 or len(v)]
    size = max(set(len(v) for _, v in usable), key=[len(v) for _, v in usable].count)
    usable = [(i, v) for i, v in usable if len(v) == size and np.isfinite(v).all() and v.any()]
    ids, matrix = np.array([i for i, _ in usable]), np.stack([v for _, v in usable])
    hits = total = 0
    for q, found in out.groupby("query_id"):
        score = matrix @ matrix[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits, total = hits + len(set(ids[order]) & set(found.vec_id)), total + 20
    assert total == 20 * out.query_id.nunique() and hits / total >= 0.9
    assert all(r == list(range(1, 21)) for r in itertools.islice(out.sort_values("rank").groupby("query_id")["rank"].apply(list), 5))
