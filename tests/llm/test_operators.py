"""The training-data operators against brute force, with nulls, empty and long texts, ties and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import ann, html_main, jaccard, langid, mixing, packing, quality, suffix_dedup, token_count, url_filter
from fathomline.llm.queries import URL_RULES, tokenizer

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, kind string, ids string, row int, part int"


def rows():
    rng = np.random.default_rng(5)
    vocabulary = ["w%d" % i for i in range(300)]
    made = [" ".join(rng.choice(vocabulary, int(rng.integers(20, 200)))) for _ in range(60)]
    made += [made[3], made[3], made[4] + " tail of words", made[5][:150] + " " + made[6][:200]]  # copies and passages
    for k in range(40):  # near copies of many degrees
        t = made[k % 10].split(" ")
        for _ in range(int(rng.integers(0, 12))):
            t[int(rng.integers(0, len(t)))] = "z%d" % rng.integers(0, 50)
        made.append(" ".join(t))
    made += ["", None, "   \n\t", "one", "ONE", "a b c d", "é" * 120 + "x", "<|endoftext|> and <s>", "🙂 ok\x00 nul", "long " * 3000, "a" * 700, "$$$ ### &&&" * 30]
    return [(i, t, ("en", "fr", None)[i % 3], ("a", "b")[i % 7 == 0], None, i, "k", "x", i, 1) for i, t in enumerate(made)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {r[0]: r[1] for r in rows()}


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    pieces = packing.pack(docs, tokenizer("byte_bpe_50k.json"), window=256, quantum=64).toPandas()
    for doc, text in TEXTS.items():
        own = pieces[pieces.doc_id == doc].sort_values("start")
        want = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert b"".join(own.ids) == want and set(own.doc_tokens) == {len(want) // 4}
        assert (own.start == own.length.cumsum() - own.length).all()
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all()
        n = int(s.length.sum())
        assert n <= 256 and n & (n - 1) == 0
    assert packing.pack(empty, tokenizer("byte_bpe_50k.json")).count() == 0


def test_packing_keeps_target_shares(spark):
    rows_ = [(i, "word " * 400, "ab"[i % 2]) for i in range(40)]
    pieces = packing.pack(spark.createDataFrame(rows_, "doc_id long, text string, source string"), tokenizer("byte_bpe_50k.json"), targets={"a": 3.0, "b": 1.0}).toPandas()
    early = pieces[pieces.sequence_id < 5].groupby("source").length.sum()
    assert abs(early["a"] / early.sum() - 0.75) < 0.03


def test_mixing_holds_marginals_and_is_stable(spark, docs, empty):
    from fathomline.llm.mixing import rake

    cells = spark.createDataFrame([("a", "en", "x", 900), ("a", "fr", "x", 50), ("b", "en", "y", 30), ("b", "fr", "x", 20), ("b", "fr", "y", 10)], "source string, lang string, topic string, tokens long")
    out = rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "fr": 0.5}}, {"topic": 1.0}, 0.01).join(cells, ["source", "lang", "topic"]).toPandas()
    kept = out.tokens * out.probability
    assert abs(kept[out.source == "a"].sum() / kept.sum() - 0.5) < 0.05
    one, two = (sorted(r.doc_id for r in mixing.mix(docs).where("mix_kept").collect()) for _ in range(2))
    assert one == two and 0 < len(one) <= len(TEXTS)
    assert mixing.mix(docs).count() == len(TEXTS) and mixing.mix(empty).count() == 0


def test_html_lines_and_differencing(spark):
    page = "<html><head><title>t</title></head><body><nav><a>Menu</a></nav><article><h1>Head &amp; line</h1><p><b>One <i>two</i><br>three<p>Four</article><div class='comments'>reader</div><footer>foot</footer></body></html>"
    plain = lambda own: f"<body><div>Shared banner</div><div>{own}</div><p>Shared end</p></body>"
    data = [(1, "http://h.org/a", page), (2, "http://h.org/b", None), (3, "http://i.org/1", plain("first")), (4, "http://i.org/2", plain("second")), (5, None, "<p>x&nbsp; y</p>"), (6, "bad", "")]
    out = {r.page_id: r for r in html_main.extract_main(spark.createDataFrame(data, "page_id long, url string, html string"), partitions=1).collect()}
    assert out[1].text == "Head & line One two three Four" and out[2].text == "" and out[6].text == ""
    assert out[3].text == "first" and out[4].text == "second" and out[4].n_shared == 2
    assert out[5].text == "x y"
    assert html_main.extract_main(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_common_subsequence_is_longest():
    def length(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, int(rng.integers(0, 15))).tolist(), rng.integers(0, 4, int(rng.integers(0, 15))).tolist()
        found = html_main.common(a, b)
        assert len(found) == length(a, b) and found == sorted(set(found))


def base(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_verdicts(docs, empty):
    out = quality.quality(docs).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        want = base(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert quality.quality(docs, carry=True).select("row.*").columns == docs.columns
    assert quality.quality(empty).count() == 0


def test_robust_outliers_find_planted(spark):
    rng = np.random.default_rng(2)
    names = [s[0] for s in quality.STATS]
    x = rng.normal([5000, 5000, 50, 0, 0, 150], [400, 300, 20, 5, 5, 20], (800, len(names)))
    x[:60, 2] += 2500
    data = [(i, "en", "s", *map(int, v)) for i, v in enumerate(x)]
    frame = spark.createDataFrame(data, "doc_id long, lang string, source string, " + ", ".join(f"x{i} long" for i in range(len(names))))
    limit = quality.chi2_quantile(quality.LEVEL, len(names)) * quality.CUTOFF
    out = {r.doc_id for r in quality.robust_outliers(frame).where(F.col("d2") > limit).collect()}
    assert out == set(range(60))


def test_token_counts_equal_the_library(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    for r in token_count.count_tokens(docs, tokenizer("piece_bpe_32k.model")).collect():
        text = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(model.encode(text))), r.doc_id
    assert token_count.count_tokens(empty, tokenizer("piece_bpe_32k.model")).count() == 0


def test_nearest_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:160] = x[7]  # one very common vector
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    data += [(600, None), (620, [0.0] * 8), (640, [float("nan")] * 8), (660, [1.0]), (680, [None] * 8), (700, [])]
    out = ann.search(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).toPandas()
    assert set(out.query_id) == set(range(0, 600, 20)) and not set(out.vec_id) & {600, 620, 640, 660, 680, 700}
    y, hits = x.astype(np.float64), 0
    for q, g in out.groupby("query_id"):
        score = (y * y[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, score[g.vec_id], rtol=1e-12)
        hits += len(set(best) & set(g.vec_id))
    assert hits >= 0.9 * 20 * out.query_id.nunique()
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n, k in ((1, 2), (2, 2), (10, 1), (50, 2), (400, 3), (900, 256)):
        text = rng.integers(0, k, n).astype(np.uint8)
        raw = text.tobytes()
        assert list(suffix_dedup.suffix_array(text, 256)) == sorted(range(n), key=lambda i: raw[i:])


def test_suffix_dedup_brute_force(docs, empty):
    seen = set()
    want = {}
    for doc in sorted(TEXTS):
        raw = (TEXTS[doc] or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s] += 1
                gone[s + 100] -= 1
            seen.add(raw[s : s + 100])
        mask = np.cumsum(gone)[:-1] > 0
        want[doc] = (len(raw), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~mask].tobytes()).hexdigest())
    out = suffix_dedup.dedup(docs, buckets=5, carry=["lang", "bucket"])
    assert out.select("carried.*").columns == ["lang", "bucket"]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()}
    assert got == want
    assert suffix_dedup.dedup(empty).count() == 0


def test_url_rules(spark):
    data = [(1, "https://A.Example.NET/en/x?q#f"), (2, "http://b.net"), (3, "http://b.net/"), (4, "http://example.com/de/1"), (5, "http://org/fr/"), (6, None), (7, "example.net/en/"), (8, "x://notexample.net/en/"), (9, "http://")]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(data, "page_id long, url string"), URL_RULES).collect()}
    assert out == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("b.net", "", None, "allow"), 3: ("b.net", "/", "net/", "block"), 4: ("example.com", "/de/1", "example.com/de/", "block"),
        5: ("org", "/fr/", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("notexample.net", "/en/", "net/", "block"), 9: ("", "", None, "allow"),
    }
    array = url_filter.DigestArray.of(url_filter.compile_rules([("block", f"h{i}.org", "/") for i in range(500)])[0])
    assert (array.find([b"h7.org\0/", b"h7.org\0/x"]) >= 0).tolist() == [True, False]


def test_jaccard_components_brute_force(docs, empty):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc, text in TEXTS.items():
        w = WORDS.findall((text or "").translate(lower))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    part = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if part[a] < part[b] and (common := len(sets[a] & sets[b])) and 100 * common >= 80 * len(sets[a] | sets[b]):
                    part[b], changed = part[a], True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs, buckets=5).collect()}
    assert got == {d: (len(s), part[d]) for d, s in sets.items()}
    assert jaccard.components(empty).count() == 0


def test_language_held_out(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = langid.identify(docs, docs.where(~held_out), per_class=60).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    test = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]]
    assert (test.lang_pred == test.lang).mean() > 0.98 and out.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, None), (2, "", None), (3, "12 !?", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(odd, docs.where(~held_out), per_class=20).collect()} == {"und"}
    assert langid.identify(empty, empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "some words to read " * 20, "en", "a"), (None, None, None, None), (1, "some words to read " * 20, "en", "a")], "doc_id long, text string, lang string, source string")
    assert packing.pack(docs, tokenizer("byte_bpe_50k.json")).where("doc_id is null").count() >= 2
    assert mixing.mix(docs).count() == 3 and mixing.mix(docs).where("mix_kept and doc_id is null").isEmpty()
    assert quality.quality(docs).count() == 3
    assert token_count.count_tokens(docs, tokenizer("piece_bpe_32k.model")).count() == 3
    assert langid.identify(docs, docs).count() == 3
    assert {(r.doc_id, r.n_bytes == len(r.kept)) for r in suffix_dedup.dedup(docs).collect()} == {(None, True), (1, False)}
    assert [tuple(r) for r in jaccard.components(docs).collect()] == [(1, 4, 1)]
    pages = spark.createDataFrame([(None, "http://a.b/c", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string")
    assert html_main.extract_main(pages).count() == 2 and url_filter.filter_urls(pages, URL_RULES).count() == 2
    vectors = spark.createDataFrame([(None, [1.0]), (0, [1.0]), (20, [2.0])], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.vec_id) for r in ann.search(vectors, F.col("vec_id") % 20 == 0).collect()} == {(0, 20), (20, 0)}


def test_title_block_inside_an_article_stays():
    page = "<header>Site</header><article><div class='entry-header'><h1>T</h1></div><p>x</p><div class='share-bar'>s</div></article>"
    assert [x[1:] for x in html_main.page_lines(page) if x[0] in (html_main.PROSE, html_main.LOOSE)] == ["T", "x"]
