"""Fill-in-the-middle transformation: texts cut into prefix, middle and suffix and reordered.

A text is a row of units (lines, words or characters). Two seeded numbers of a row choose two of its
unit borders; what lies between them is the middle. Prefix-suffix-middle puts the middle last,
suffix-prefix-middle the suffix first; the rest stay plain. One kernel cuts all rows of an Arrow
batch at once on its UTF-8 buffer:

1. a table of 256 entries gives each byte its class (line break, white space, continuation byte,
   first byte of a sentinel);
2. a mask over adjacent bytes marks where units begin, and every document's first byte;
3. a cumulative sum of the mask, reset at each document, numbers the units;
4. one ``searchsorted`` over that sum finds the byte of both cuts of every row.

The parts are slices of the same buffer, joined by Arrow. ``restore`` rebuilds each text from its
output and form alone.

Edge cases: null counts as the empty text; empty texts, and texts that hold a sentinel, are plain;
a null id is seeded as an empty one; rows are judged one by one, so repeated rows get equal
results; a very long text is cut whole, in a batch of its own; an empty table gives an empty table;
columns to carry along are named, all others are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, utf8_buffers

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
_BREAK, _SPACE, _CONTINUED, _MARK = 1, 2, 4, 8
_UNITS = ("lines", "words", "chars")
_FORMS = pa.array(["plain", "psm", "spm"])


def classes(sentinels: Sequence[bytes]) -> np.ndarray:
    """Class bits of every byte."""
    table = np.zeros(256, np.uint8)
    table[ord("\n")] |= _BREAK
    table[[9, 10, 11, 12, 13, 32]] |= _SPACE
    table[0x80:0xC0] |= _CONTINUED
    table[[s[0] for s in sentinels]] |= _MARK
    return table


def unit_starts(kinds: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Mask of the bytes at which a unit begins; ``kinds`` are the bytes' classes.

    A line ends after its break; a word ends before the white space that follows it; characters are code points.
    """
    starts = np.zeros(len(kinds), bool)
    if unit == "lines":
        starts[1:] = kinds[:-1] & _BREAK != 0
    elif unit == "words":
        starts[1:] = (kinds[1:] & _SPACE != 0) & (kinds[:-1] & _SPACE == 0)
    else:
        starts[:] = kinds & _CONTINUED == 0
    begins = offsets[:-1]
    starts[begins[begins < offsets[1:]]] = True
    return starts


def cuts(starts: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of units, byte of the earlier cut, byte of the later one) of every row; the cuts are ``first`` and ``second`` modulo units + 1."""
    total = np.cumsum(starts, dtype=np.int32 if len(starts) < 1 << 31 else np.int64)
    upto = np.concatenate([np.zeros(1, np.int64), total])[offsets] if len(total) else np.zeros(len(offsets), np.int64)
    base, units = upto[:-1], np.diff(upto)  # the sum starts anew at each document: its bytes' numbers are total - base
    a, b = first % (units + 1), second % (units + 1)
    picked = np.stack([np.minimum(a, b), np.maximum(a, b)])
    at = np.searchsorted(total, (base + picked + 1).astype(total.dtype), "left")
    return units, *np.where(picked == units, offsets[1:], at)


def marked(data: np.ndarray, kinds: np.ndarray, sentinels: Sequence[bytes]) -> np.ndarray:
    """Positions of every sentinel, (kind, byte) rows in the order of bytes."""
    places, which = [], []
    candidates = np.flatnonzero(kinds & _MARK)
    for k, mark in enumerate(sentinels):
        at = candidates[candidates + len(mark) <= len(data)]
        for n, byte in enumerate(mark):
            at = at[data[at + n] == byte]
        places.append(at)
        which.append(np.full(len(at), k))
    places, which = np.concatenate(places), np.concatenate(which)
    order = np.argsort(places, kind="stable")
    return np.stack([which[order], places[order]])


def _parts(data: np.ndarray, borders: np.ndarray) -> pa.LargeStringArray:
    """The text between each border and the next."""
    return pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(np.ascontiguousarray(borders, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _chars(kinds: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of each span."""
    if not len(kinds) or not len(begins):
        return np.zeros(len(begins), np.int64)
    edges = np.minimum(np.stack([begins, ends], 1).ravel(), len(kinds) - 1)
    sums = np.add.reduceat(kinds & _CONTINUED == 0, edges, dtype=np.int64)[::2]
    # reduceat gives the byte itself for an empty span, and can't name the buffer's end.
    sums = np.where(begins < ends, sums, 0)
    return sums + ((ends == len(kinds)) & (begins < ends) & (begins < len(kinds) - 1)) * int(kinds[-1] & _CONTINUED == 0)


def transform(texts: pa.Array, seeds: Sequence[np.ndarray], unit: str, rate: int, spm: int, sentinels: Sequence[str]) -> dict[str, pa.Array]:
    """The kernel: columns n, form, prefix_chars, middle_chars and output of a batch.

    ``seeds`` are four whole numbers a row: two for the cuts, one each against ``rate`` and ``spm`` percent.
    """
    data, offsets = utf8_buffers(texts)
    marks = [s.encode() for s in sentinels]
    kinds = classes(marks)[data]
    units, low, high = cuts(unit_starts(kinds, offsets, unit), offsets, seeds[0], seeds[1])
    held = marked(data, kinds, marks)
    rows = np.searchsorted(offsets, held[1], "right") - 1
    inside = held[1] + np.array([len(m) for m in marks])[held[0]] <= offsets[rows + 1]
    plain = (offsets[:-1] == offsets[1:]) | (seeds[2] % 100 >= rate)
    plain[rows[inside]] = True
    form = np.where(plain, 0, np.where(seeds[3] % 100 < spm, 2, 1))
    parts = _parts(data, np.append(np.stack([offsets[:-1], low, high], 1).ravel(), offsets[-1]))
    at = np.arange(len(units)) * 3
    prefix, middle, suffix = (parts.take(pa.array(at + k)) for k in range(3))
    p, s, m = (pa.scalar(x, pa.large_string()) for x in sentinels)
    no = pa.scalar("", pa.large_string())
    moved = pc.if_else(pa.array(form == 2), pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, no), pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, no))
    whole = pc.binary_join_element_wise(prefix, middle, suffix, no)
    return {"n": pa.array(units, pa.int64()), "form": _FORMS.take(pa.array(form)), "prefix_chars": pa.array(_chars(kinds, offsets[:-1], low), pa.int64(), mask=plain), "middle_chars": pa.array(_chars(kinds, low, high), pa.int64(), mask=plain), "output": pc.if_else(pa.array(plain), whole, moved)}


def rebuilt(outputs: pa.Array, forms: pa.Array, sentinels: Sequence[str]) -> pa.Array:
    """The texts of a batch of outputs, by the sentinels that moved rows hold once each."""
    data, offsets = utf8_buffers(outputs)
    marks = [s.encode() for s in sentinels]
    plain, spm = pc.equal(forms, "plain").to_numpy(zero_copy_only=False), pc.equal(forms, "spm").to_numpy(zero_copy_only=False)
    kind, place = marked(data, classes(marks)[data], marks)
    rows = np.searchsorted(offsets, place, "right") - 1
    moved = ~plain[rows]
    kind, place, rows = kind[moved], place[moved], rows[moved]
    want = np.where(spm[~plain, None], [1, 0, 2], [0, 1, 2])
    if len(kind) != want.size or (kind.reshape(-1, 3) != want).any() or (rows.reshape(-1, 3) != np.flatnonzero(~plain)[:, None]).any():
        raise ValueError("an output doesn't hold its three sentinels in the order of its form")
    begins = (place + np.array([len(m) for m in marks])[kind]).reshape(-1, 3)
    place = place.reshape(-1, 3)
    ends = np.concatenate([place[:, 1:], offsets[1:][~plain][:, None]], 1)
    # Borders in buffer order: sentinel, part, sentinel, part, sentinel, part; then parts 1, 3 and 5 by form.
    borders = np.append(np.stack([begins, ends], 2).ravel(), 0)
    parts = _parts(data, np.maximum.accumulate(borders))
    at = np.arange(len(begins)) * 6
    first, second, third = (parts.take(pa.array(at + 2 * k)) for k in range(3))
    by_spm = pa.array(spm[~plain])
    prefix, suffix = pc.if_else(by_spm, second, first), pc.if_else(by_spm, first, second)
    texts = pc.binary_join_element_wise(prefix, third, suffix, pa.scalar("", pa.large_string()))
    index = np.where(plain, np.cumsum(plain) - 1 + len(texts), np.cumsum(~plain) - 1)
    kept = pc.fill_null(outputs.cast(pa.large_string()), "").filter(pa.array(plain))
    return pa.concat_arrays([texts, kept]).take(pa.array(index))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "lines", rate: int = 100, spm: int = 50, seed: int = 7, sentinels: Sequence[str] = SENTINELS, carry: Sequence[str] = ()) -> DataFrame:
    """(id, n units, form, prefix_chars, middle_chars, output) of every row, with the columns ``carry`` as a struct ``carried``; one pass, no shuffle.

    ``rate`` percent of the rows are transformed, ``spm`` percent of these to suffix-prefix-middle.
    A row's numbers are the first four groups of eight digits of the SHA-256 of ``seed:id``.
    """
    if unit not in _UNITS or len(set(sentinels)) != 3 or not all(sentinels) or any(a != b and a in b for a in sentinels for b in sentinels):
        raise ValueError("the unit is lines, words or chars, and of the three sentinels none holds another")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(df[id_col].cast("string"), F.lit(""))), 256)
    seeds = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    carried: list[Column] = [F.struct(*(df[c] for c in carry)).alias("carried")] if carry else []
    kept = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"), *seeds, *carried)
    extra = f", carried {dict(kept.dtypes)['carried']}" if carry else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            made = transform(_whole(part["text"]), [part[f"h{k}"].to_numpy() for k in range(4)], unit, rate, spm, sentinels)
            rest = {"carried": _whole(part["carried"])} if carry else {}
            yield pa.RecordBatch.from_pydict({"id": _whole(part["id"]), **made, **rest})

    out = kept.mapInArrow(run, f"id {dict(kept.dtypes)['id']}, n long, form string, prefix_chars long, middle_chars long, output string{extra}")
    return out.withColumnRenamed("id", id_col)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", sentinels: Sequence[str] = SENTINELS, carry: Sequence[str] = ()) -> DataFrame:
    """(text, the columns ``carry`` as a struct ``carried``) of rows that ``fill_in_middle`` made; raises on others."""
    kept = df.select(df[output_col].alias("output"), df[form_col].alias("form"), F.struct(*(df[c] for c in carry), F.lit(0).alias("_")).alias("carried"))
    kind = dict(kept.dtypes)["carried"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "output"):
            yield pa.RecordBatch.from_pydict({"text": rebuilt(_whole(part["output"]), _whole(part["form"]), sentinels), "carried": _whole(part["carried"])})

    return kept.mapInArrow(run, f"text string, carried {kind}")
