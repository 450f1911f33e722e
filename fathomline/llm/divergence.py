"""Divergence of the sources of a language: how far their smoothed term shares lie apart.

A group is a (language, source). A language keeps the terms that stand in at least ``min_docs`` of
its documents; a group's share of a term is smoothed, so it is above zero for terms it never uses,
and the distance of two groups sums over the language's whole vocabulary. That sum is never
walked term by term. Inclusion-exclusion over the groups' supports (the terms they use) splits it:

    sum f(c, d)  =  sum over g's support of f(c, 0)  +  sum over s's support of f(0, d)
                  + sum over both supports of f(c, d) - f(c, 0) - f(0, d) + f(0, 0)
                  + (V - |g's support| - |s's support|) * f(0, 0)

* *One-sided terms* cost the same wherever the count is, so a group's histogram (count, number
  of terms with it) prices them; it has at most about the square root of twice the group's tokens rows.
* *Overlaps* are corrected by joining the sparse postings (language, term, source, count) with
  themselves, each unordered pair once for both directions, summed before they are shuffled.
* *Terms neither uses* cost one constant.

Terms are counted per slice of text in Arrow on the UTF-8 buffer, so what is shuffled is a count a
slice, group and term. Shares and distances are whole numbers; wide products are decimals, and a
sum beyond 64 bits is an error, never a wrong number.

Edge cases: null text, language and source count as empty strings; each row is a document, repeated
ones too; a group without any term is listed; a language without kept terms has distances of 0
and no terms; ties are broken by the item's UTF-8 bytes; very long texts are counted whole, in a slice of
their own; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_slices, utf8_buffers

#: Shares are whole numbers of this unit.
SCALE = 1_000_000_000
#: Bytes of text that are counted together.
SLICE = 8 << 20
#: Shares into which a group's terms are dealt before its top ones are ranked.
SALTS = 16
_COUNTS = "lang string, source string, term string, n long, docs long"


def _term_bytes() -> tuple[np.ndarray, np.ndarray]:
    """(whether a byte belongs to a term, the byte in lower case): ASCII letters and all of other characters."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[65:91] = inside[97:123] = inside[128:] = True
    return inside, lower


_INSIDE, _LOWER = _term_bytes()


def slice_counts(texts: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of a slice, one row a group and term."""
    data, offsets = utf8_buffers(texts)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _INSIDE[data]
    # A term begins and ends at a document's border, too.
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    begins = np.flatnonzero(inside[1:] & (border | ~inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (border | ~inside[1:]))
    if not len(begins):
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    borders = np.append(np.stack([begins, ends], 1).ravel(), ends[-1])
    pieces = pa.LargeStringArray.from_buffers(2 * len(begins), pa.py_buffer(borders), pa.py_buffer(_LOWER[data]))
    coded = pieces.take(pa.array(np.arange(0, 2 * len(begins), 2))).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    row = np.searchsorted(offsets, begins, "right") - 1
    terms = len(coded.dictionary)
    per_doc, n_in_doc = np.unique(row * terms + code, return_counts=True)
    key, back = np.unique(groups[per_doc // terms] * terms + per_doc % terms, return_inverse=True)
    return key // terms, coded.dictionary.take(pa.array(key % terms)), np.bincount(back, n_in_doc).astype(np.int64), np.bincount(back)


def term_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs) summed over ``df``; a group's row of the empty term lists it."""
    clean = [F.coalesce(df[c].cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            pairs = pc.struct_field  # groups of the slice, numbered by their first row
            both = pa.StructArray.from_arrays([part[c].combine_chunks().cast(pa.string()) for c in ("lang", "source")], ["lang", "source"])
            seen: dict[tuple[str, str], int] = {}
            groups = np.fromiter((seen.setdefault(x, len(seen)) for x in zip(pairs(both, 0).to_pylist(), pairs(both, 1).to_pylist())), np.int64, len(part))
            group, term, n, docs = slice_counts(part["text"].combine_chunks(), groups)
            names = list(seen)
            own = np.concatenate([group, np.arange(len(names))])
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([x[0] for x in names], pa.string()).take(pa.array(own)),
                "source": pa.array([x[1] for x in names], pa.string()).take(pa.array(own)),
                "term": pa.concat_arrays([term.cast(pa.string()), pa.array([""] * len(names), pa.string())]),
                "n": pa.array(np.concatenate([n, np.zeros(len(names), np.int64)])),
                "docs": pa.array(np.concatenate([docs, np.zeros(len(names), np.int64)])),
            })

    sliced = df.select(df[text_col].cast("string").alias("text"), *clean).mapInArrow(run, _COUNTS)
    return sliced.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + vocabulary)); null without a vocabulary."""
    wide = "decimal(20,0)"
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast(wide), F.nullif(total + vocabulary, F.lit(0)).cast(wide)) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)² / q); (p - q)² is at most SCALE², so it fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distances to the other sources of its language, all of them, and its ``top`` most over-used terms against the whole language."""
    counts = materialise(term_counts(df, text_col, lang_col, source_col))
    used = counts.where("term <> ''")
    kept = used.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    languages = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    postings = materialise(used.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    supports = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    listed = counts.where("term = ''").select("lang", "source").join(supports, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0)
    zero = share(F.lit(0), F.col("total"), F.col("vocabulary"))
    groups = materialise(listed.withColumn("p0", zero))
    parts = _pairs(postings, groups).unionByName(_terms(postings, groups, top))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return parts.withColumn("rank", F.row_number().over(ranked)).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def _terms(postings: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The group's terms with a share above the language's; only each group's first ``top`` leave their task."""
    rows = postings.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("vocabulary")), share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    over = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    # First within a group's salted shares, so that its last window gets SALTS times ``top`` rows at most, however many tasks there are.
    salt = F.pmod(F.xxhash64("item"), F.lit(SALTS))
    best = lambda rows, *keys: rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))).where(F.col("r") <= top).drop("r")
    return best(best(over.withColumn("salt", salt), "lang", "source", "salt").drop("salt"), "lang", "source").withColumn("part", F.lit("term"))


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """The distance of each group to every other source of its language by inclusion and exclusion."""
    own = groups.select("lang", "source", "total", "vocabulary", "support", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("support").alias("support2"), F.col("p0").alias("q0"))
    both = own.join(other, "lang").where("source <> item")
    neither = both.select("lang", "source", "item", (F.col("vocabulary") - F.col("support") - F.col("support2")).alias("times"), distance(F.col("p0"), F.col("q0")).alias("each"))
    constants = neither.select("lang", "source", "item", F.coalesce(F.col("times") * F.col("each"), F.lit(0)).alias("value"))

    histogram = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(own, ["lang", "source"])
    priced = histogram.select("lang", "source", "p0", "times", share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"))
    sides = priced.join(other, "lang").where("source <> item")
    times, p, q0 = F.col("times"), F.col("p"), F.col("q0")
    one_sided = _both_ways(sides.select("lang", "source", "item", (times * distance(p, q0)).alias("there"), (times * distance(q0, p)).alias("back")))

    shares = postings.join(own, ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"), "p0")
    met = shares.join(shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0")), ["lang", "term"]).where("source < item")
    fix = lambda p, q, p0, q0: distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)
    q, p0 = F.col("q"), F.col("p0")
    overlaps = _both_ways(met.groupBy("lang", "source", "item").agg(F.sum(fix(p, q, p0, q0)).alias("there"), F.sum(fix(q, p, q0, p0)).alias("back")))
    return constants.unionByName(one_sided).unionByName(overlaps).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Rows (source, item, there) and (item, source, back) of every pair."""
    ways = F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    return pairs.select("lang", F.explode(ways).alias("w")).select("lang", "w.*")
