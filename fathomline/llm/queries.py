"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, divergence, fim, html_main, jaccard, langid, mixing, packing, quality, suffix_dedup, token_count, url_filter, warc
from .common import table

URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_bytes"), F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_main.extract_main(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 6).alias("distance2"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = langid.identify(documents, documents.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return back.select(warc.id_of("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", warc.id_of("refers_to").alias("refers_to"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fim.fill_in_middle(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    back = fim.restore(moved, carry=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"])
    return back.select("carried.doc_id", "carried.n", "carried.form", "carried.prefix_chars", "carried.middle_chars", "carried.output_sha256", F.sha2("text", 256).alias("restored_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_packing, op2_mixing, op3_html_extraction, op4_quality, op5_token_counts, op6_nearest, op7_suffix_dedup, op8_url_filter, op9_jaccard_join, op10_language_id, op11_warc, op12_fim, op13_divergence, pipeline)
    return {f.__name__: f for f in ops}


URL_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT page_id, action, rhost || rpath AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS rn
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN f ON f.page_id = u.page_id AND rn = 1
"""


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
 f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1),
 r AS (SELECT q.*, CASE WHEN page_id IS NULL OR page_id > first THEN first END AS refers_to FROM q LEFT JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""

#: Lines of a text are its split parts with their breaks; a cut after k of n lines leaves the first k parts before it.
FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS parts, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 u AS (SELECT *, len(parts) - (CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END) AS n, [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT FOR k IN range(4)] AS r FROM d),
 c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 AS plain FROM u),
 l AS (SELECT *, length(array_to_string(parts[1 : a], chr(10))) + (CASE WHEN a > 0 AND a < len(parts) THEN 1 ELSE 0 END) AS x, length(array_to_string(parts[1 : b], chr(10))) + (CASE WHEN b > 0 AND b < len(parts) THEN 1 ELSE 0 END) AS y FROM c),
 s AS (SELECT *, substr(t, 1, x) AS p, substr(t, x + 1, y - x) AS m, substr(t, y + 1) AS e FROM l)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN x END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN y - x END::BIGINT AS middle_chars,
 sha256(CASE WHEN plain THEN t WHEN r[4] % 100 < 50 THEN '<S>' || e || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || e || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s
"""

#: Every group's share of every kept term, and every pair summed term by term.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term, count(*)::HUGEINT AS ln FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
 l AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS lt FROM k GROUP BY 1),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
 gt AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY 1, 2),
 s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(gt.total, 0) + l.v) AS p, 1 + (1000000000::HUGEINT * (k.ln + 1)) // (l.lt + l.v) AS lp
   FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
 parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - lp) * (p - lp) // lp)::BIGINT FROM s WHERE n > 0 AND p > lp),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.oracle(), "op8_url_filter": URL_SQL, "op11_warc": WARC_SQL, "op12_fim": FIM_SQL, "op13_divergence": DIVERGENCE_SQL}
