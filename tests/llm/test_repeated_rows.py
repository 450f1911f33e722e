"""Suffix-array dedup of tables whose rows repeat or share an id."""

import corpus_pipeline
import numpy as np
from fathomline.llm import suffix_dedup
from fathomline.llm.common import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(mark, n):
    return " ".join(f"{mark}{i}" for i in range(n))


def test_repeated_rows_and_shared_ids(spark):
    one, two, tail = words("a", 90), words("b", 90), words("c", 40)
    rows = [(1, one), (1, one), (2, two), (2, tail + words("d", 60)), (3, one + tail), (3, one + tail), (4, words("e", 80))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    for parts in (1, 7):
        out = suffix_dedup.dedup(docs.repartition(parts), buckets=3).collect()
        kept = sorted((r.doc_id, bytes(r.kept).decode()) for r in out)
        assert len(kept) == len(rows)
        # Rows of one id and text stay alike; those of one id and two texts don't cut each other.
        assert [k for k in kept if k[0] != 3] == sorted(r for r in rows if r[0] != 3)
        # Document 3 repeats all of 1, and the tail that 2 has; both its rows lose the same.
        three = [t for d, t in kept if d == 3]
        assert three[0] == three[1] and len(three[0]) < 100
    stage = dict(corpus_pipeline.STAGES)["suffix-array dedup"]
    assert {1, 2, 4} <= {r.doc_id for r in materialise(stage(spark, docs, "")).collect()}


def test_long_texts_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, 6000).astype(np.uint8).tobytes()
    texts = [base, base[1000:4000], b"x" * 50 + base[2500:2700] + b"y" * 30, b"", base[:99], base[3500:6000] + base[:100]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    strings = lambda r: sorted((row, s + k, key) for row, s, n, key, *_ in zip(*(x.tolist() for x in r)) for k in range(n))
    whole = strings(suffix_dedup.runs(data, offsets, 100))
    for block in (64, 100, 1000, 5000):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        assert strings(suffix_dedup.runs_in_blocks(data, offsets, 100)) == whole


def test_every_level_is_induced(monkeypatch):
    rng = np.random.default_rng(5)
    words = [rng.integers(97, 101, int(rng.integers(2, 7))).astype(np.uint8).tobytes() for _ in range(3000)]
    raw = b" ".join(words[i] for i in rng.integers(0, 3000, 30000))  # more names than any block sweep would take
    text = np.frombuffer(raw, np.uint8)
    sizes = []
    inner = suffix_dedup._induce_each
    monkeypatch.setattr(suffix_dedup, "_induce_each", lambda t, *a: sizes.append(int(t.max())) or inner(t, *a))
    array = suffix_dedup.suffix_array(text, 256)
    assert max(sizes) > 4096 and sorted(array.tolist()) == list(range(len(raw)))
    assert all(raw[a : a + 400] < raw[b : b + 400] for a, b in zip(array[:-1].tolist(), array[1:].tolist()))


def test_flanks_keep_all_that_repeats(spark):
    """Strings of exactly the length, with the anchor anywhere in them, and near misses, against brute force."""
    rng = np.random.default_rng(11)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    texts = {}
    for i in range(60):
        core = letters(int(rng.choice([98, 99, 100, 101, 130, 180])))
        texts[3 * i], texts[3 * i + 1] = letters(int(rng.integers(0, 150))) + core + letters(int(rng.integers(0, 150))), letters(int(rng.integers(0, 150))) + core + letters(int(rng.integers(0, 150)))
        texts[3 * i + 2] = letters(40) + core[:60] + letters(3) + core[60:]
    seen, want = set(), {}
    for doc in sorted(texts):
        raw, gone = texts[doc], np.zeros(len(texts[doc]), bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(raw[s : s + 100])
        want[doc] = int(gone.sum())
    assert any(want.values())
    docs = spark.createDataFrame([(d, t.decode()) for d, t in texts.items()], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs, buckets=3).collect()} == want
