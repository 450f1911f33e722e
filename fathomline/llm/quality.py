"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Built-in functions only. Texts are measured once (``measure``); each document becomes a short
vector of transformed statistics in fixed point. Per (language, source) the minimum covariance
determinant is found by concentration steps: from each of several deterministic starts, keep the
fraction ``H`` of documents with the smallest distances, take their mean and covariance, repeat.
After ``STEPS`` steps the start whose covariance has the least determinant goes on alone, until no
group's determinant falls any more. A document goes when its squared Mahalanobis distance under
that estimate passes ``CUTOFF`` times the chi-square quantile.

A concentration step is one pass over the small table of vectors: sums by (start, group,
distance class), combined before the shuffle, so a group with a third of all rows costs no more
than any other. The subset is every document up to the distance class that reaches the fraction
``H``; sums of fixed-point integers do not depend on their order, so results repeat exactly.
Covariances of small groups are shrunk towards their language's and have a floor on the diagonal
(``FLOOR``: the spread that each statistic is allowed in any case).

Edge cases: null text has no words and fails the base rule, as does an empty one; null language
or source is a group of its own; equal documents get equal verdicts; a group of one document
falls back on its language, a table of one on the floors; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SPACE = r"[ \t-\r]+"
#: Scale of the fixed-point vectors, and the value from which on they grow with the logarithm: no statistic
#: is cut off, and sums of products stay exact.
SCALE, SOFT = 1000, 20_000
#: Statistics: name, least standard deviation.
STATS = (("length", 0.35), ("word_len", 0.6), ("symbols", 0.06), ("repeats", 0.06), ("dup_lines", 0.06), ("capitals", 0.05))
#: Fraction of a group that the determinant is minimised over; concentration steps of every start; rows of the prior.
H, STEPS, PRIOR = 0.75, 2, 50
#: Fall of a determinant's logarithm that counts as one.
FALL = 1e-3
#: The chi-square level, and the factor that clean but heavy-tailed statistics need.
LEVEL, CUTOFF = 0.9999, 1.6
#: Rows of group estimates up to which they are broadcast: a few MB.
BROADCAST_ROWS = 20_000


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words in 5-word windows that are found twice or more, from the words' hashes."""
    at = lambda a, i: F.get(a, i)
    windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(at(hashes, i + k) for k in range(5))))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j: F.coalesce(at(s, j)["h"] == x["h"], F.lit(False))
            hit = F.transform(s, lambda x, j: F.when(same(x, j + 1) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))), x["i"]))
            return F.array_sort(F.array_compact(hit))

        # ``get`` with the index 0 for j = 0 would compare the row with itself; ``j > 0`` excludes that.
        total = lambda p: F.aggregate(p, F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(5), x - a["last"])).alias("n")))["n"]
        return _let(ordered, lambda s: total(places(s)))

    return F.when(n < 6, 0).otherwise(_let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: bool = False) -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals)."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))

    def of(t: Column) -> Column:
        bare = F.translate(t, " \t\n\x0b\x0c\r", "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
        words = F.filter(F.split(t, SPACE), lambda x: x != "")
        counted = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
        return F.struct(
            F.struct(F.length(bare).cast("long").alias("word_chars"), counted(r"[#*$%&|<>]").alias("n_symbols"), counted("[A-Z]").alias("n_capitals")).alias("chars"),
            _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
            _let(F.transform(words, lambda w: F.xxhash64(w)), lambda x: F.struct(F.size(x).cast("long").alias("n_words"), _repeat_words(x, F.size(x)).cast("long").alias("n_repeat_words"))).alias("words"),
        )

    kept = df.select(df[id_col].cast("long").alias("doc_id"), df[lang_col].cast("string").alias("lang"), df[source_col].cast("string").alias("source"), _let(text, of).alias("s"), *([F.struct(*(df[c] for c in df.columns)).alias("row")] if carry else []))
    names = {"words": ("n_words", "n_repeat_words"), "chars": ("word_chars", "n_symbols", "n_capitals"), "lines": ("n_lines", "n_dup_lines")}
    return kept.select("doc_id", "lang", "source", *(F.col(f"s.{k}.{x}").alias(x) for k, xs in names.items() for x in xs), *(["row"] if carry else []))


def _vector() -> list[Column]:
    c, words, chars = F.col, F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    raw = (F.log1p(c("n_words").cast("double")), c("word_chars") / words, c("n_symbols") / words, c("n_repeat_words") / words, c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), F.sqrt(c("n_capitals") / chars))
    # All are positive or zero.
    return [F.round(F.when(x * SCALE <= SOFT, x * SCALE).otherwise(SOFT * (1 + F.log(x * SCALE / SOFT)))).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def chi2_cdf(x: float, k: float) -> float:
    """Of the chi-square distribution, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 10.0 * k + 500
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


# The estimates are built from SQL text: one call into the JVM an expression, where column objects need one an operator.


def _factor(p: int) -> list[str]:
    """Cholesky factor l of the matrix in columns c, each element by those before it, and ``logdet``."""
    out = []
    for i in range(p):
        for j in range(i + 1):
            rest = " - ".join([f"c{i}_{j}", *(f"l{i}_{k} * l{j}_{k}" for k in range(j))])
            out.append(f"sqrt(greatest({rest}, 1e-9D)) AS l{i}_{j}" if i == j else f"({rest}) / l{j}_{j} AS l{i}_{j}")
    return [*out, f"2 * ({' + '.join(f'ln(l{i}_{i})' for i in range(p))}) AS logdet"]


def _with_distance(rows: DataFrame, p: int) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance of x under columns m and l, which go: forward substitution, a column a term."""
    terms = [f"({' - '.join([f'x{i} / {SCALE}D', f'm{i}', *(f'l{i}_{k} * _y{k}' for k in range(i))])}) / l{i}_{i} AS _y{i}" for i in range(p)]
    gone = {*(f"m{i}" for i in range(p)), *(f"l{i}_{j}" for i in range(p) for j in range(i + 1))}
    return rows.selectExpr("*", *terms).selectExpr(*(f"`{c}`" for c in rows.columns if c not in gone), f"{' + '.join(f'_y{i} * _y{i}' for i in range(p))} AS d2")


def _estimates(sums: DataFrame, p: int, consistency: float) -> DataFrame:
    """(start, lang, source, m*, l*, logdet) from sums n, s*, q*_* by (start, lang, source)."""
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    names = ["n", *(f"s{i}" for i in range(p)), *(f"q{i}_{j}" for i, j in pairs)]
    pool = sums.selectExpr("start", "lang", "source", *(f"CAST({x} AS DOUBLE) AS {x}" for x in names), *(f"CAST(sum({x}) OVER (PARTITION BY start, lang) AS DOUBLE) AS {x}_all" for x in names), f"CAST(n AS DOUBLE) / (n + {PRIOR}) AS mix")
    mean = [f"(s{i} / n * mix + s{i}_all / n_all * (1 - mix)) / {SCALE} AS m{i}" for i in range(p)]
    moment = lambda tail, i, j: f"(q{i}_{j}{tail} / n{tail} - (s{i}{tail} / n{tail}) * (s{j}{tail} / n{tail})) / {SCALE**2}"
    cov = [f"({moment('', i, j)} * mix + {moment('_all', i, j)} * (1 - mix)) * {consistency!r}D + {STATS[i][1] ** 2 if i == j else 0.0!r}D AS c{i}_{j}" for i, j in pairs]
    out = pool.selectExpr("start", "lang", "source", *mean, *cov)
    return out.selectExpr("*", *_factor(p)).drop(*(f"c{i}_{j}" for i, j in pairs))


def _attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Join on null-safe keys; the right side is broadcast while its counted size is small."""
    right = groups.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in groups.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(F.broadcast(right) if size <= BROADCAST_ROWS else right, on).drop(*(f"_{k}" for k in keys))


def robust_outliers(vectors: DataFrame, p: int = len(STATS)) -> DataFrame:
    """``vectors`` (doc_id, lang, source, x*) with ``d2``: the squared distance under its group's estimate."""
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = [F.expr(x) for x in ("count(*) AS n", *(f"sum(x{i}) AS s{i}" for i in range(p)), *(f"sum(CAST(x{i} * x{j} AS DECIMAL(20,0))) AS q{i}_{j}" for i, j in pairs))]
    added = [F.expr(f"sum({c}) AS {c}") for c in ("n", *(f"s{i}" for i in range(p)), *(f"q{i}_{j}" for i, j in pairs))]
    consistency = H / chi2_cdf(chi2_quantile(H, p), p + 2)
    whole, vectors = vectors, vectors.select("doc_id", "lang", "source", *(f"x{i}" for i in range(p)))
    # Starts: all rows; the half with the smaller hashes; the rows near the medians of the group.
    medians = vectors.groupBy("lang", "source").agg(*(F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"c{i}") for i in range(p)))
    medians = materialise(medians)
    groups = medians.count()
    near = sum((F.abs(F.col(f"x{i}") - F.col(f"c{i}")) / (SCALE * STATS[i][1]) for i in range(p)), F.lit(0.0)) <= 2.0 * p
    started = _attach(vectors, medians, ["lang", "source"], groups).withColumn("start", F.explode(F.array_compact(F.array(F.lit(0), F.when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(1)), F.when(near, F.lit(2))))))
    estimate = materialise(_estimates(started.groupBy("start", "lang", "source").agg(*sums), p, 1.0))
    keys = ["start", "lang", "source"]

    def concentrated(starts: list[int], estimate: DataFrame) -> DataFrame:
        """Estimates from the fraction H of each group with the smallest distances under ``estimate``."""
        every = vectors.withColumn("start", F.explode(F.array(*map(F.lit, starts))))
        banded = _with_distance(_attach(every, estimate.drop("logdet"), keys, len(starts) * groups), p).withColumn("band", F.floor(F.log(F.col("d2") + 1e-6) * 32))
        bands = materialise(banded.groupBy(*keys, "band").agg(*sums))
        window = Window.partitionBy(*keys)
        reach = bands.withColumn("before", F.coalesce(F.sum("n").over(window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(window))
        return _estimates(reach.where(F.col("before") < F.col("all") * H).groupBy(*keys).agg(*added), p, consistency)

    for _ in range(STEPS):
        estimate = materialise(concentrated([0, 1, 2], estimate))
    best = Window.partitionBy("lang", "source").orderBy("logdet", "start")
    chosen = materialise(estimate.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn").withColumn("start", F.lit(0)))
    # Each round that goes on has lowered some determinant by ``FALL``, and the floors bound them from below.
    while True:
        both = chosen.withColumn("later", F.lit(0)).unionByName(concentrated([0], chosen).withColumn("later", F.lit(1)))
        least = both.groupBy("lang", "source").agg(F.min_by(F.struct(*both.columns), F.struct(F.col("logdet") + F.col("later") * FALL, "later")).alias("e"))
        chosen = materialise(least.select("e.*"))
        fell = not chosen.where("later = 1").isEmpty()
        chosen = chosen.drop("later")
        if not fell:
            break
    return _with_distance(_attach(whole, chosen.drop("start", "logdet"), ["lang", "source"], groups), p)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: bool = False) -> DataFrame:
    """One row per row of ``df``: the statistics, ``base_failed``, ``d2`` and ``kept``.

    With ``carry`` the whole input row comes along as the struct ``row``; it is written out with
    the statistics, so the texts are neither measured twice nor shuffled.
    """
    p = len(STATS)
    measured = materialise(measure(df, id_col, text_col, lang_col, source_col, carry))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    rows = measured.withColumn("base_failed", failed).select("*", *_vector())
    judged = robust_outliers(rows, p)
    limit = chi2_quantile(LEVEL, p) * CUTOFF
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= limit)).drop(*(f"x{i}" for i in range(p))).withColumnRenamed("doc_id", id_col)
