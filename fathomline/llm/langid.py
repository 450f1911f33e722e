"""Language identification with string kernels.

A text's features are the presence of its byte n-grams of all lengths from 1 to 4 (the blended
spectrum), hashed into ``DIM`` places; the kernel of two texts is the number of places they
share, divided by the geometric mean of their own numbers. Landmark texts give a Nystroem map
of that kernel, on which one ridge regression per language, one versus the rest, is fitted. As
the kernel is linear in presence, landmarks, map and regressions fold into one DIM x languages
matrix, and a batch of texts is scored by a single matrix product.

Only the fit uses a sample, whose bound is ``per_class`` texts of each language (the smallest
hashes of the id, found among the few below a threshold that follows the language's count, so no
task ranks a whole language). The driver holds 4 KB a sample text and 128 KB a landmark, whatever
the size of the tables; both follow the number of languages, of which none is left out. Every text
is predicted from its whole bytes, a long one in blocks.

Edge cases: null text or one without a letter is ``und`` with score 0; without any labelled
training text everything is ``und``; equal texts get equal predictions; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices, utf8_buffers

DIM, ORDERS = 1 << 15, 4
#: Bytes that are worked on at a time.
BLOCK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x DIM) 0/1 matrix of hashed n-grams, upper-case ASCII folded; bytes are worked through in blocks."""
    rows = len(offsets) - 1
    out = np.zeros(rows * DIM, np.uint8)
    for begin in range(0, len(data), BLOCK):
        end = min(len(data), begin + BLOCK)
        part = data[begin : min(len(data), end + ORDERS - 1)]
        text = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint64)
        at = np.arange(begin, end)
        first, last = np.searchsorted(offsets, [begin, end - 1], "right") - 1
        edges = np.clip(offsets[first : last + 2], begin, end)
        own = np.repeat(np.arange(first, last + 1), np.diff(edges))
        left = offsets[own + 1] - at  # bytes up to the text's end
        code = text.copy()
        for n in range(1, ORDERS + 1):
            if n > 1:
                if len(text) < n:
                    break
                code = code[:-1] | text[n - 1 :] << np.uint64(8 * (n - 1))
            m = min(len(code), end - begin)
            place = ((code[:m] + np.uint64(n)) * _MIX[n] >> np.uint64(64 - 15)).astype(np.int64)
            inside = left[:m] >= n
            out[(own[:m] * DIM + place)[inside]] = 1
    return out.reshape(rows, DIM)


def _units(bits: list[bytes]) -> np.ndarray:
    """Presence rows of length 1 from their packed bits."""
    rows = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8)).reshape(len(bits), DIM).astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


def fit(samples: list[bytes], labels: list[str], landmarks: int, ridge: float) -> tuple[list[str], np.ndarray]:
    """(languages, DIM x languages weights) from packed presence rows and their languages."""
    names = sorted(set(labels))
    number = {x: i for i, x in enumerate(names)}
    y = np.array([number[x] for x in labels])
    chosen = np.concatenate([np.flatnonzero(y == c)[: max(1, landmarks // len(names))] for c in range(len(names))])
    marks = _units([samples[i] for i in chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    strong = values > 1e-6 * values.max()
    project = vectors[:, strong] / np.sqrt(values[strong])
    features = np.concatenate([(_units(samples[at : at + 256]) @ marks.T).astype(np.float64) for at in range(0, len(samples), 256)]) @ project
    targets = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (1 / np.bincount(y)[y])[:, None]  # languages count alike
    solved = np.linalg.solve(features.T @ (weight * features) + ridge * np.eye(features.shape[1]), features.T @ (weight * targets))
    return names, (marks.T.astype(np.float64) @ (project @ solved)).astype(np.float32)


def identify(
    df: DataFrame,
    train: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_class: int = 512,
    landmarks: int = 256,
    ridge: float = 1e-3,
) -> DataFrame:
    """(id, lang_pred, score) for every row of ``df``; learnt from the labelled rows of ``train``.

    One pass over ``train``'s ids and languages, one over the chosen texts, one over ``df``.
    ``score`` is the softmax of the regressions' outputs at the predicted language.
    """
    spark = df.sparkSession
    labelled = train.select(train[id_col].cast("long").alias("id"), train[lang_col].cast("string").alias("lang")).where("lang is not null")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    # Three times as many as are wanted lie below the threshold, in expectation.
    below = F.least(F.lit(1.0), F.lit(3.0 * per_class) / F.col("n"))
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / float(1 << 52)
    near = labelled.join(F.broadcast(counts.select(F.col("lang").alias("l"), below.alias("below"))), F.col("lang") == F.col("l")).where(spread < F.col("below"))  # one row a language
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = near.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_class).select("id", "lang").collect()
    names, weights = [], np.zeros((DIM, 0), np.float32)
    if chosen:
        lang_of = {r.id: r.lang for r in chosen}
        picked = spark.createDataFrame([(i,) for i in lang_of if i is not None], "id long")
        texts = train.select(train[id_col].cast("long").alias("id"), train[text_col].cast("string").alias("text")).where("text is not null")

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches, "text", 1 << 20):
                data, offsets = utf8_buffers(part["text"])
                bits = [np.packbits(presence(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))).tobytes() for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), pa.array(bits, pa.binary())], names=["id", "bits"])

        rows = sorted(texts.join(F.broadcast(picked), "id").mapInArrow(features, "id long, bits binary").collect(), key=lambda r: r.id)
        if rows:
            names, weights = fit([bytes(r.bits) for r in rows], [lang_of[r.id] for r in rows], landmarks, ridge)
    model = spark.sparkContext.broadcast((names, weights))
    kept = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = model.value
        for whole in text_slices(batches, "text", 1 << 20):
            for at in range(0, len(whole), 128):
                part = whole.slice(at, 128)
                data, offsets = utf8_buffers(part["text"])
                letters = np.array([bool(_LETTER.search(t)) for t in pc.fill_null(part["text"], "").to_pylist()])
                langs, scores = np.full(len(part), "und", object), np.zeros(len(part))
                if names and letters.any():
                    x = presence(data, offsets).astype(np.float32)
                    raw = (x @ weights).astype(np.float64) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
                    soft = np.exp(2 * (raw - raw.max(1, keepdims=True)))
                    best = raw.argmax(1)
                    langs = np.where(letters, np.array(names, object)[best], "und")
                    scores = np.where(letters, 1 / soft.sum(1), 0.0)
                yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), pa.array(langs.tolist(), pa.string()), pa.array(scores)], schema=schema)

    return kept.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
