"""Mixing sources to target weights by iterative proportional fitting.

Built-in functions only. Token weights are summed into cells (source, language, topic); the cell
table is raked to the three sets of marginal targets in turn until they hold; a document then
stays with its cell's calibrated probability, decided by a hash of its id, so a second run or a
retried task takes the same documents.

The cell table has at most sources x languages x topics rows whatever the size of the corpus, so
the raking runs over it in one partition, where no window needs a shuffle. The corpus itself is
read twice and never shuffled: partial sums for the cells, then the join with the cell table,
which is broadcast while its counted rows stay under ``BROADCAST_ROWS``.

Targets are shares per category. Without them, the observed shares to the power ``temper``,
normalised: 1 keeps them, 0 makes all categories equal. Probabilities are scaled to keep
``keep`` of all tokens in expectation, capped at 1.

Edge cases: nulls in source, language or topic are a category of their own; null text has weight
0 and is kept or not by its cell like others; categories missing from given targets have target
0 and go; equal documents differ by their id; a row without an id is not kept; an empty table gives an empty table; columns
of the input that are named like the operator's own results (a second mixing, say) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARGINS = ("source", "lang", "topic")
RESULTS = ("mix_topic", "mix_tokens", "mix_probability", "mix_kept")
BROADCAST_ROWS = 50_000
#: Rounds of raking (three margins each) and of scaling.
ROUNDS, SCALINGS = 10, 8
#: Length classes in characters that serve as topic where documents carry none.
FORMS = ((500, "note"), (4000, "article"), (20000, "report"))


def form(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    out = F.when(n < FORMS[0][0], FORMS[0][1])
    for most, name in FORMS[1:]:
        out = out.when(n < most, name)
    return out.otherwise("book")


def rake(cells: DataFrame, targets: dict[str, dict] | None, temper: dict[str, float], keep: float) -> DataFrame:
    """Cells (source, lang, topic, tokens) with ``probability``."""
    rows = cells.repartition(1)
    whole = Window.partitionBy(F.lit(1))
    over = {m: Window.partitionBy(m) for m in MARGINS}
    rows = rows.withColumn("total", F.sum("tokens").over(whole).cast("double"))
    for m in MARGINS:
        if targets and m in targets:
            pairs = [F.struct(F.lit(k).cast("string").alias("k"), F.lit(float(v)).alias("v")) for k, v in targets[m].items()]
            found = F.filter(F.array(*pairs), lambda x: x["k"].eqNullSafe(F.col(m)))
            share = F.coalesce(F.get(found, 0)["v"], F.lit(0.0))
        else:
            share = F.pow(F.sum("tokens").over(over[m]).cast("double") / F.col("total"), F.lit(float(temper[m])))
        rows = rows.withColumn(f"t_{m}", share)
        # A category's share counts once, however many cells it has.
        once = F.when(F.row_number().over(over[m].orderBy(*(x for x in MARGINS if x != m))) == 1, F.col(f"t_{m}")).otherwise(0.0)
        rows = rows.withColumn("once", once).withColumn(f"t_{m}", F.col(f"t_{m}") / F.sum("once").over(whole) * F.col("total")).drop("once")
    rows = rows.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(ROUNDS):
        for m in MARGINS:
            rows = rows.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col(f"t_{m}"), F.sum("w").over(over[m])), F.lit(0.0)))
    rows = rows.withColumn("f", F.coalesce(F.try_divide(F.col("w"), F.col("tokens").cast("double")), F.lit(1.0))).withColumn("scale", F.lit(float(keep)))
    for _ in range(SCALINGS):
        taken = F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("scale") * F.col("f"))).over(whole)
        rows = rows.withColumn("scale", F.coalesce(F.try_divide(F.col("scale") * keep * F.col("total"), taken), F.col("scale")))
    return rows.select(*MARGINS, F.least(F.lit(1.0), F.col("scale") * F.col("f")).alias("probability"))


def uniform(doc_id: Column, seed: int) -> Column:
    """In [0, 1), from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(
    df: DataFrame,
    targets: dict[str, dict] | None = None,
    temper: dict[str, float] | None = None,
    keep: float = 0.7,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """``df`` with ``mix_topic``, ``mix_tokens``, ``mix_probability`` and ``mix_kept``.

    ``tokens`` defaults to the text's UTF-8 bytes, ``topic`` to its length class.
    """
    temper = {"source": 0.7, "lang": 0.85, "topic": 0.85} | (temper or {})
    topic = topic if topic is not None else form(df[text_col])
    tokens = tokens if tokens is not None else F.octet_length(F.coalesce(df[text_col].cast("string"), F.lit("")))
    kept = [df[c] for c in df.columns if c.lower() not in RESULTS]
    rows = df.select(*kept, topic.alias("mix_topic"), tokens.cast("long").alias("mix_tokens"))
    keys = {"source": rows[source_col].cast("string"), "lang": rows[lang_col].cast("string"), "topic": rows["mix_topic"].cast("string")}
    free = "_" * max((len(c) for c in df.columns), default=0)  # makes names that no column has
    cells = rows.groupBy(*(c.alias(m) for m, c in keys.items())).agg(F.sum("mix_tokens").alias("tokens"))
    raked = rake(cells, targets, temper, keep)
    raked = raked.select(*(F.col(m).alias(f"{m}{free}_key") for m in MARGINS), F.col("probability").alias("mix_probability"))
    if cells.count() <= BROADCAST_ROWS:
        raked = F.broadcast(raked)
    on = F.lit(True)
    for m, c in keys.items():
        on = on & c.eqNullSafe(F.col(f"{m}{free}_key"))
    return rows.join(raked, on).drop(*(f"{m}{free}_key" for m in MARGINS)).withColumn("mix_kept", F.coalesce(uniform(F.col(id_col), seed) < F.col("mix_probability"), F.lit(False)))


def oracle(keep: float = 0.7, seed: int = 1, temper: dict[str, float] | None = None) -> str:
    """DuckDB SQL for (doc_id, topic, n_bytes, probability, kept) over ``documents`` without given targets."""
    temper = {"source": 0.7, "lang": 0.85, "topic": 0.85} | (temper or {})
    forms = " ".join(f"WHEN length(coalesce(text, '')) < {n} THEN '{name}'" for n, name in FORMS)
    steps = [
        f"d AS (SELECT doc_id, source, lang, CASE {forms} ELSE 'book' END AS topic, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents)",
        "c0 AS (SELECT source, lang, topic, sum(n_bytes)::DOUBLE AS tokens, sum(sum(n_bytes)) OVER ()::DOUBLE AS total FROM d GROUP BY ALL)",
    ]
    for m in MARGINS:
        steps.append(f"g_{m} AS (SELECT {m} AS k, pow(sum(tokens) / any_value(total), {temper[m]}::DOUBLE) AS s FROM c0 GROUP BY {m})")
        steps.append(f"t_{m} AS (SELECT k, s / (SELECT sum(s) FROM g_{m}) * (SELECT any_value(total) FROM c0) AS t FROM g_{m})")
    joins = " ".join(f"JOIN t_{m} ON t_{m}.k IS NOT DISTINCT FROM c0.{m}" for m in MARGINS)
    steps.append(f"w0 AS (SELECT c0.*, tokens AS w, {', '.join(f't_{m}.t AS tt_{m}' for m in MARGINS)} FROM c0 {joins})")
    n = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            steps.append(f"w{n + 1} AS (SELECT * REPLACE (coalesce(w * tt_{m} / nullif(sum(w) OVER (PARTITION BY {m}), 0), 0) AS w) FROM w{n})")
            n += 1
    steps.append(f"s0 AS (SELECT source, lang, topic, tokens, total, coalesce(w / nullif(tokens, 0), 1) AS f, {keep}::DOUBLE AS scale FROM w{n})")
    for k in range(SCALINGS):
        steps.append(f"s{k + 1} AS (SELECT * REPLACE (coalesce(scale * {keep}::DOUBLE * total / nullif(sum(tokens * least(1.0::DOUBLE, scale * f)) OVER (), 0), scale) AS scale) FROM s{k})")
    u = f"('0x' || md5('{seed}:' || doc_id)[1:13])::UBIGINT::DOUBLE / {1 << 52}"
    return f"WITH {', '.join(steps)} SELECT d.doc_id, d.topic, d.n_bytes, round(least(1.0::DOUBLE, scale * f), 6) AS probability, {u} < least(1.0::DOUBLE, scale * f) AS kept FROM d JOIN s{SCALINGS} s ON s.source IS NOT DISTINCT FROM d.source AND s.lang IS NOT DISTINCT FROM d.lang AND s.topic IS NOT DISTINCT FROM d.topic"
