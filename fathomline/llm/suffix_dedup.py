"""Removal of repeated 100-byte strings with suffix arrays built by induced sorting.

A byte goes when a 100-byte string that covers it also starts earlier: in a document with a
smaller id, or further up in the same document. Matches never cross documents, and strings are
judged on the input.

1. *Windows.* Every 100-byte string holds ``L - K + 1`` K-byte grams; the one with the smallest
   hash is its anchor, so equal strings have equal anchors, at equal places. Consecutive starts
   with one anchor form a run of about ``(L - K) / 2``; a run's context is the text that its
   strings cover. Runs are keyed by the anchor's hash and carry a 64-bit hash of their context.
2. *Same contexts.* Of runs with the same key and context, all but the earliest are repeats in
   whole (two different contexts around one anchor pass for equal with a chance of 2^-64); that is settled within a slice first, so a passage found in a third of all documents
   reaches a shuffle once a slice, and then within the key's bucket.
3. *Flanks.* An equal string in two contexts of a key has its anchor at the same place, so it
   reaches at least half of the other ``L - K`` bytes to the left of the anchor or to the right. Of
   a key's contexts only those go on whose hash of that many bytes on one side, if they have them,
   is another's as well; a frequent gram with differing surroundings ends here.
4. *Suffix arrays.* A key with several different contexts left needs its texts: their bytes are
   fetched, and each bucket's contexts form one shard text. Its suffix array comes from induced
   sorting at every level (classify suffixes, sort the leftmost-smaller substrings and name them,
   recurse on the names, induce the rest linearly), and common prefixes are computed in permuted (text) order.
   Neighbours in the array that share 100 bytes are equal strings; all but the earliest repeat.
5. *Cut.* Repeats meet their documents by id; overlapping ones merge to spans, which are removed.

What travels is packed arrays of numbers (a few bytes a run) in a fixed number of buckets; texts
are dealt out once, by document. No group is gathered beyond one bucket, and a bucket's size
falls as their number grows with the input.

Edge cases: null text is empty; a very long text is worked through in blocks; texts under 100 bytes can't repeat; equal documents all go but
the one with the smallest id; rows of one id and one text are one document, so they get equal
results and don't repeat each other; rows of one id and different texts are told apart by 32 bits
of their text's hash, which also order them; a row without an id has no place in that order: it is
returned whole and compared with nothing; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, utf8_buffers

K = 24
#: Bytes of text per bucket of documents, and per bucket of runs.
BUCKET_BYTES = 12 << 20
#: Bytes that windows are computed over at a time.
BLOCK = 1 << 20
#: Runs that a task settles among themselves before it sends them: about 16 MB of text.
SLICE_RUNS = 400_000
RUN = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("sig", "<u4"), ("start", "<i4"), ("n", "<i4"), ("home", "<i4"), ("left", "<u4"), ("right", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("sig", "<u4"), ("start", "<i4"), ("n", "<i4")])
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C[3]
    return x ^ (x >> np.uint64(29))


def words8(data: np.ndarray) -> np.ndarray:
    """Little-endian 8-byte word at every place; the last 7 are filled with zeros."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for shift in (1, 2, 4):
        x[:-shift] |= x[shift:] << np.uint64(8 * shift)
    return x[: len(data)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the K bytes from every place that has them."""
    w = words8(data)
    n = len(data) - K + 1
    return _mixed((w[:n] * _C[0]) ^ _mixed(w[8 : 8 + n] * _C[1]) ^ (_mixed(w[16 : 16 + n] + _C[2]) * _C[0]))


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: (row, start in the row, count, key, context hash, left and right flank's hash or 0)."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint32, np.uint32))
    if len(data) < length:
        return none
    if len(data) >= 1 << 23:
        raise ValueError("longer data must come in blocks")
    grams = gram_hashes(data)
    bits = np.uint64(23)  # alike everywhere, so equal strings tie alike
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, done, least = length - K + 1, 1, packed
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        step = width - done
        least = np.minimum(least[:-step], least[step:])
    anchor = (least & low).astype(np.int64)  # of the string that starts at each place
    row = np.searchsorted(offsets, np.arange(len(anchor)), "right") - 1 if len(offsets) < 3 else np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= offsets[1:][row]
    fresh = inside.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(fresh)
    if not len(begin):
        return none
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:] & ~fresh[1:], [False]]))
    count = ends - begin + 1
    # Context hash: the polynomial sum of gram hashes over the covered text, moved to its start.
    n = len(grams)
    base = np.uint64(0x5851F42D4C957F2D)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(grams) * power)])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]))
    last = begin + count - 1 + length - K + 1
    context = _mixed((total[last] - total[begin]) * back[begin]) + count.astype(np.uint64)
    where = anchor[begin]
    half = (length - K + 1) // 2
    left, right = where - begin >= half, begin + count - 1 + length - where - K >= half

    def flank(at: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Hash of the ``half`` bytes from every place: of grams that cover them, two where two grams are long enough."""
        out = np.zeros(len(at), np.uint64)
        at = np.where(there, at, 0)
        for k in [*range(0, half - K, K), half - K] if half > K else [half - K]:
            out = _mixed(out * _C[0] + grams[np.clip(at + k, 0, len(grams) - 1)])
        return np.where(there, np.maximum((out >> np.uint64(32)).astype(np.uint32), 1), 0).astype(np.uint32)

    # The anchor's place in its string is part of the class: equal contexts have it by themselves.
    return row[begin], begin - offsets[row[begin]], count, grams[where], context, flank(where - half, left), flank(where + K, right)


def runs_in_blocks(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``runs`` of data of any size: blocks of starts, each with the bytes that its last strings reach into."""
    found = []
    for begin in range(0, max(1, len(data)), BLOCK):
        end = min(len(data), begin + BLOCK + length - 1)
        first, last = np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, end, "left")
        row, start, *rest = runs(data[begin:end], np.clip(offsets[first : last + 1], begin, end) - begin, length)
        row = row + first
        found.append((row, start + np.maximum(begin - offsets[row], 0), *rest))
    return tuple(np.concatenate(x) for x in zip(*found))


# ---- suffix arrays --------------------------------------------------------------------------


def _starts(text: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])


def _place(sa: np.ndarray, fill: np.ndarray, chars: np.ndarray, suffixes: np.ndarray, up: bool) -> None:
    """Append suffixes to their buckets in order, from the front (up) or from the back."""
    if not len(suffixes):
        return
    order = np.argsort(chars, kind="stable")
    c, s = chars[order], suffixes[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    number = np.arange(len(c)) - np.repeat(first, np.diff(np.concatenate([first, [len(c)]])))
    if up:
        sa[fill[c] + number] = s
    else:
        sa[fill[c] - 1 - number] = s
    counts = np.diff(np.concatenate([first, [len(c)]]))
    fill[c[first]] += counts if up else -counts


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffix array from the given order of leftmost-smaller suffixes: two linear sweeps, bucket by bucket.

    Within a bucket entries are handled in blocks: what a block induces into its own bucket (a
    repeated character) is the next block.
    """
    n, size = len(text), len(starts) - 1
    present = np.flatnonzero(np.diff(starts))
    seeds_by = np.argsort(text[lms], kind="stable")
    seeds, seed_chars = lms[seeds_by], text[lms][seeds_by]
    seed_at = np.searchsorted(seed_chars, np.arange(size + 1))
    sa = np.full(n, -1, np.int64)
    fill = starts[:-1].copy()
    if n and not small[n - 1]:
        _place(sa, fill, text[n - 1 : n], np.array([n - 1]), True)
    for c in present:  # larger suffixes, ascending
        done = starts[c]
        while done < fill[c]:
            block = sa[done : fill[c]]
            done = fill[c]
            before = block[block > 0] - 1
            before = before[~small[before]]
            _place(sa, fill, text[before], before, True)
        block = seeds[seed_at[c] : seed_at[c + 1]]
        before = block[block > 0] - 1
        _place(sa, fill, text[before], before, True)  # what precedes a leftmost-smaller suffix is larger
    large_end = fill.copy()
    fill = starts[1:].copy()
    if n and small[n - 1]:
        _place(sa, fill, text[n - 1 : n], np.array([n - 1]), False)
    for c in present[::-1]:  # smaller suffixes, descending
        done = starts[c + 1]
        while done > fill[c]:
            block = sa[fill[c] : done][::-1]
            done = fill[c]
            before = block[block > 0] - 1
            before = before[small[before]]
            _place(sa, fill, text[before], before, False)
        block = sa[starts[c] : large_end[c]][::-1]
        before = block[block > 0] - 1
        before = before[small[before]]
        _place(sa, fill, text[before], before, False)
    return sa


def _induce_each(text: np.ndarray, small: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The same two sweeps entry by entry, for alphabets whose buckets are too small for blocks."""
    n = len(text)
    chars = text.tolist()
    # Whether the suffix before i exists and is larger, or smaller, than its successor; n stands for an empty place.
    after_large, after_small = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    after_large[1:n], after_small[1:n] = ~small[:-1], small[:-1]
    sa = np.full(n, n, np.int64)
    _place(sa, starts[1:].copy(), text[lms][::-1], lms[::-1], False)
    sa = sa.tolist()
    head, flags = starts[:-1].tolist(), after_large.tobytes()
    if not small[n - 1]:  # the last suffix of the text comes first in its bucket
        c = chars[n - 1]
        sa[head[c]] = n - 1
        head[c] += 1
    for i in sa:  # ascending; the list is read as it is being filled
        if flags[i]:
            i -= 1
            c = chars[i]
            at = head[c]
            sa[at] = i
            head[c] = at + 1
    tail, flags = starts[1:].tolist(), after_small.tobytes()
    if small[n - 1]:
        c = chars[n - 1]
        tail[c] -= 1
        sa[tail[c]] = n - 1
    for i in reversed(sa):  # descending, over the places of the leftmost-smaller ones
        if flags[i]:
            i -= 1
            c = chars[i]
            at = tail[c] - 1
            sa[at] = i
            tail[c] = at
    return np.array(sa, np.int64)


#: Average bucket from which on the block sweeps are the faster ones; both give the same array.
BLOCK_BUCKET = 64


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of an integer text over 0 .. size - 1 by induced sorting at every level; the end is smaller than any symbol."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int64, copy=False)
    # Classify: smaller than the next suffix or not; the last suffix is larger than the end.
    step = np.sign(np.diff(text))
    known = np.flatnonzero(np.concatenate([step != 0, [True]]))
    nxt = known[np.searchsorted(known, np.arange(n))]
    small = np.concatenate([step > 0, [False]])[nxt]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    starts = _starts(text, size)
    induce = _induce if n >= BLOCK_BUCKET * np.count_nonzero(np.diff(starts)) else _induce_each
    if len(lms):
        first = induce(text, small, lms, starts)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = first[is_lms[first]]
        # Name the substrings, each up to and with the next leftmost-smaller place.
        end = np.concatenate([lms[1:] + 1, [n]])
        length_at = np.zeros(n, np.int64)
        length_at[lms] = end - lms
        names = np.zeros(n, np.int64)
        left, right = order[:-1], order[1:]
        same = length_at[left] == length_at[right]
        same[(left == lms[-1]) | (right == lms[-1])] = False
        live, depth = np.flatnonzero(same), 0
        while len(live):
            equal = text[left[live] + depth] == text[right[live] + depth]
            same[live[~equal]] = False
            live = live[equal]
            depth += 1
            live = live[length_at[left[live]] > depth]
        names[order] = np.concatenate([[0], np.cumsum(~same)])
        if names[order[-1]] + 1 < len(lms):
            reduced = names[lms]
            order = lms[suffix_array(reduced, int(reduced.max()) + 1)]
        lms = order
    return induce(text, small, lms, starts)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For every place, the length of the prefix it shares with its predecessor in the array, at most ``most``.

    In text order neighbouring values differ by one at most downwards, so only places whose
    lower bound from the left is under ``most`` are compared, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    w = words8(text)
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for depth in range(0, most, 8):
        a, b = live + depth, before[live] + depth
        fits = (a < n) & (b < n)
        live, a, b = live[fits], a[fits], b[fits]
        x = w[a] ^ w[b]
        low = np.minimum(np.where(x == 0, 8, _zero_bytes(x)), np.minimum(n - a, n - b))
        shared[live] += low
        live = live[low == 8]
        if not len(live):
            break
    return np.minimum(shared, most)


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """Low zero bytes of non-zero words."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += (x & ((np.uint64(1) << np.uint64(8 * k)) - np.uint64(1))) == 0
    return out


def repeats(text: np.ndarray, begins: np.ndarray, counts: np.ndarray, docs: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For contexts joined in ``text`` (context i's starts are at ``begins[i]`` onwards): mask of their
    starts, in order, that are not the earliest of their string."""
    owner = np.repeat(np.arange(len(begins)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = begins[owner] + inner
    sa = suffix_array(text, 256)
    prefix = permuted_prefixes(text, sa, length)
    number = np.full(len(text), -1, np.int64)
    number[place] = np.arange(len(place))
    # Classes: maximal stretches of the array whose neighbours share the whole length.
    group = np.cumsum(prefix[sa] < length)
    kept = number[sa] >= 0
    group, which = group[kept], number[sa][kept]
    order = np.lexsort((starts[owner][which] + inner[which], docs[owner][which], group))
    group, which = group[order], which[order]
    later = np.concatenate([[False], group[1:] == group[:-1]])
    out = np.zeros(len(place), bool)
    out[which[later]] = True
    return out


# ---- the job --------------------------------------------------------------------------------


def _in_order(rows: np.ndarray) -> np.ndarray:
    """Runs sorted by (key, ctx, doc, sig, start), those of repeated rows once."""
    rows = rows[np.lexsort((rows["start"], rows["sig"], rows["doc"], rows["ctx"], rows["key"]))]
    again = np.logical_and.reduce([rows[x][1:] == rows[x][:-1] for x in ("key", "ctx", "doc", "sig", "start")])
    return rows[np.concatenate([[True], ~again])] if len(rows) else rows


def _document(rows: np.ndarray) -> np.ndarray:
    """Numbers of the documents of runs, in the order of (doc, sig)."""
    order = np.lexsort((rows["sig"], rows["doc"]))
    doc, sig = rows["doc"][order], rows["sig"][order]
    out = np.zeros(len(rows), np.int64)
    out[order[1:]] = np.cumsum((doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1]))
    return out


def _later(rows: np.ndarray) -> np.ndarray:
    """Of runs sorted by ``_in_order``: not the first of its key and context."""
    return np.concatenate([[False], (rows["key"][1:] == rows["key"][:-1]) & (rows["ctx"][1:] == rows["ctx"][:-1])]) if len(rows) else np.zeros(0, bool)


def _shared(rows: np.ndarray, flank: str) -> np.ndarray:
    """Which runs have a flank that another run of their key has as well."""
    order = np.lexsort((rows[flank], rows["key"]))
    key, side = rows["key"][order], rows[flank][order]
    same = (key[1:] == key[:-1]) & (side[1:] == side[:-1]) & (side[1:] > 0)
    out = np.zeros(len(rows), bool)
    out[order] = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) if len(rows) else same
    return out


def _home(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(doc.astype(np.uint64) * _C[0] + _C[1]) % np.uint64(buckets)).astype(np.int32)


def _sent(kind: str, rows: np.ndarray, buckets: np.ndarray) -> list[tuple[int, str, bytes]]:
    """One packed message per bucket."""
    order = np.argsort(buckets, kind="stable")
    rows, b = rows[order], buckets[order]
    edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, int)
    return [(int(b[i]), kind, rows[i:j].tobytes()) for i, j in zip(edges, [*edges[1:], len(b)])]


def _spans_of(rows: np.ndarray) -> np.ndarray:
    """Starts that repeat, merged where they follow each other."""
    out = np.zeros(len(rows), SPAN)
    for name in SPAN.names:
        out[name] = rows[name]
    out = out[np.lexsort((out["start"], out["sig"], out["doc"]))]
    if not len(out):
        return out
    fresh = np.concatenate([[True], (out["doc"][1:] != out["doc"][:-1]) | (out["sig"][1:] != out["sig"][:-1]) | (out["start"][1:] != out["start"][:-1] + out["n"][:-1])])
    at = np.flatnonzero(fresh)
    merged = out[at]
    merged["n"] = np.add.reduceat(out["n"], at)
    return merged


def _messages(rows: list[tuple[int, str, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "data"])


def dedup(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, carry: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) for every row, and the columns named in ``carry`` as the struct ``carried``.

    ``spans`` are the removed runs as (start, end) byte places, ``kept`` the remaining bytes. With
    ``whole_characters`` what a cut leaves of a character at its edges goes as well, so ``kept`` is text.
    """
    if length < 3 * K:
        raise ValueError(f"length must be {3 * K} or more")
    carry = carry or []
    extra = [f"carried{i}" for i in range(len(carry))]
    texts = df.select(df[id_col].cast("long").alias("doc"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), *(df[c].alias(x) for c, x in zip(carry, extra)))
    types = "".join(f", {x} {kind}" for x, kind in texts.dtypes[2:])
    texts = texts.withColumn("sig", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    nameless, texts = texts.where("doc is null"), texts.where("doc is not null")
    if buckets is None:
        total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(8, -(-total // BUCKET_BYTES))
    message = "bucket int, kind string, data binary"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])
        held: list[np.ndarray] = []

        def settle() -> Iterator[pa.RecordBatch]:
            found = _in_order(np.concatenate(held))
            held.clear()
            later = _later(found)
            first, spans = found[~later], _spans_of(found[later])
            out = _sent("run", first, (first["key"] % np.uint64(buckets)).astype(np.int32)) + _sent("span", spans, _home(spans["doc"], buckets))
            for at in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 256]), schema)], schema=schema)

        for part in text_slices(batches, "text", 1 << 20):
            data, offsets = utf8_buffers(part["text"])
            row, start, count, key, context, left, right = runs_in_blocks(data, offsets, length)
            found = np.zeros(len(row), RUN)
            found["key"], found["ctx"], found["start"], found["n"] = key, context, start, count
            found["doc"], found["sig"] = part["doc"].to_numpy()[row], part["sig"].to_numpy()[row]
            found["home"], found["left"], found["right"] = _home(found["doc"], buckets), left, right
            held.append(found)
            if sum(map(len, held)) >= SLICE_RUNS:
                yield from settle()
        if held:
            yield from settle()

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        """A bucket of runs: whole repeats as spans, contexts to fetch as requests."""
        out = [(b, "span", d) for b, k, d in frame.itertuples(index=False) if k == "span"]
        blobs = frame["data"][frame["kind"] == "run"]
        if len(blobs):
            found = np.frombuffer(b"".join(blobs), RUN)
            order = np.argsort(found["key"], kind="stable")
            keys = found["key"][order]
            same = keys[1:] == keys[:-1]
            repeated = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            found = _in_order(found[order[repeated]])  # a key that is found once is settled
            later = _later(found)
            spans, first = found[later], found[~later]
            out += _sent("span", _spans_of(spans), _home(_spans_of(spans)["doc"], buckets))
            near = first[_shared(first, "left") | _shared(first, "right")]
            out += _sent("fetch", near, near["home"])
        return _messages(out)

    def fetch(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """A bucket of documents: the bytes of the contexts that are asked for."""
        out = [(b, "span", d) for b, k, d in asked.itertuples(index=False) if k == "span"]
        blobs = asked["data"][asked["kind"] == "fetch"]
        if len(blobs) and len(held):
            wanted = np.frombuffer(b"".join(blobs), RUN)
            wanted = wanted[np.lexsort((wanted["sig"], wanted["doc"]))]
            bytes_of = dict(zip(zip(held["doc"], held["sig"]), held["text"]))
            texts, last, raw = [], None, b""
            for doc, start, n in zip(zip(wanted["doc"].tolist(), wanted["sig"].tolist()), wanted["start"].tolist(), wanted["n"].tolist()):
                if doc != last:
                    last, raw = doc, bytes_of[doc].encode()
                texts.append(raw[start : start + n + length - 1])
            to = (wanted["key"] % np.uint64(buckets)).astype(np.int32)
            for b in np.unique(to):
                rows = np.flatnonzero(to == b)
                mine = wanted[rows]
                out.append((int(b), "text", len(mine).to_bytes(8, "little") + mine.tobytes() + b"".join(texts[i] for i in rows)))
        return _messages(out)

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        """A bucket of contexts: its suffix array gives the repeats among them."""
        out = [(b, "span", d) for b, k, d in frame.itertuples(index=False) if k == "span"]
        metas, texts = [], []
        for blob in frame["data"][frame["kind"] == "text"]:
            n = int.from_bytes(blob[:8], "little")
            metas.append(np.frombuffer(blob, RUN, n, 8))
            at = 8 + n * RUN.itemsize
            for m in (metas[-1]["n"].astype(np.int64) + length - 1).tolist():
                texts.append(blob[at : at + m])
                at += m
        if metas:
            meta = np.concatenate(metas)
            # Keys are independent, so a shard may hold any whole keys.
            order = np.argsort(meta["key"], kind="stable")
            size = np.array([len(t) for t in texts])[order]
            meta, texts = meta[order], [texts[i] for i in order]
            begin, total, keys = 0, np.cumsum(size), meta["key"]
            while begin < len(meta):
                end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + (2 << 20), "right"))
                end = max(begin + 1, min(end, len(meta)))
                while end < len(meta) and keys[end] == keys[end - 1]:
                    end += 1
                part = meta[begin:end]
                text = np.frombuffer(b"".join(texts[begin:end]), np.uint8)
                begins = np.concatenate([[0], np.cumsum(size[begin:end])[:-1]])
                counts = part["n"].astype(np.int64)
                again = repeats(text, begins, counts, _document(part), part["start"], length)
                owner = np.repeat(np.arange(len(part)), counts)[again]
                inner = (np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts))[again]
                spans = np.zeros(len(owner), SPAN)
                spans["doc"], spans["sig"], spans["start"], spans["n"] = part["doc"][owner], part["sig"][owner], part["start"][owner] + inner, 1
                spans = _spans_of(spans)
                out += _sent("span", spans, _home(spans["doc"], buckets))
                begin = end
        return _messages(out)

    def cut(spans: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """A bucket of documents: their repeats merged and removed."""
        rows = np.frombuffer(b"".join(spans["data"]), SPAN)
        rows = rows[np.lexsort((rows["start"], rows["sig"], rows["doc"]))]
        out = []
        for doc, sig, text, *others in held[["doc", "sig", "text", *extra]].itertuples(index=False):
            raw = text.encode()
            a, b = np.searchsorted(rows["doc"], [doc, doc + 1])
            a, b = a + np.searchsorted(rows["sig"][a:b], sig, "left"), a + np.searchsorted(rows["sig"][a:b], sig, "right")
            low = rows["start"][a:b].astype(np.int64)
            high = low + rows["n"][a:b] + length - 1
            merged: list[tuple[int, int]] = []
            if len(low):
                reach = np.maximum.accumulate(high)
                at = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
                merged = list(zip(low[at].tolist(), reach[np.concatenate([at[1:] - 1, [len(low) - 1]])].tolist()))
            edges = [0, *(x for span in merged for x in span), len(raw)]
            parts = [raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)]
            left = sum(map(len, parts))
            if whole_characters and merged:
                parts = [x.decode("utf-8", "ignore").encode() for x in parts]
            kept = b"".join(parts)
            out.append((doc, len(raw), len(raw) - left, [{"start": x, "end": y} for x, y in merged], kept, *others))
        return pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "spans", "kept", *extra])

    held = texts.mapInArrow(_homes(buckets), "doc long, text string, bucket int" + types + ", sig long").repartition(buckets, "bucket")
    found = texts.select("doc", "text", "sig").mapInArrow(find, message).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(match, message)
    fetched = found.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(fetch, message)
    sorted_ = fetched.groupBy("bucket").applyInPandas(sort, message)
    result = sorted_.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(cut, "doc long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary" + types)
    raw = F.encode("text", "UTF-8")
    untouched = nameless.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), raw.alias("kept"), *extra)
    result = result.unionByName(untouched)
    own = [F.col("doc").alias(id_col), "n_bytes", "n_removed", "spans", "kept"]
    return result.select(*own, *([F.struct(*(F.col(x).alias(c) for c, x in zip(carry, extra))).alias("carried")] if carry else []))


def _homes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text").cast(pa.string()), pa.array(_home(batch.column("doc").to_numpy(), buckets)), *batch.columns[2:]], names=["doc", "text", "bucket", *batch.schema.names[2:]])

    return run
