"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of its documents' tokens, in the order of the tokenised table. For each
token dealt, a queue earns credit equal to its target share; a visit serves one quantum and takes
it from the credit, and what is left over or owed - the deficit - stays with the queue. The queue
to visit next is the one whose credit first reaches half a quantum, that is, quantum ``c`` of
source ``j`` has the deadline ``(c + 1/2) / share_j``; ties go to the earlier source. An empty
queue drops out and the others speed up. Windows of 2048 tokens are cut from this one order, so a
deficit is carried from window to window and from partition to partition.

The order has a closed form: the tokens dealt before a deadline are, over the sources, the
smaller of all its tokens and its quanta with an earlier deadline. So each task finds the windows
of its documents by itself from one number a source (all tokens) and one number a source and
partition (tokens in earlier partitions). The hottest source is spread over all tasks like any
other, no queue is ever gathered, and a lost task is simply run again.

1. Tokenise each text once; write ids with their place in (partition, source).
2. Add up tokens by (partition, source): a table of that size, prefix sums by source.
3. Cut every document into pieces; nothing is shuffled when that table is small.

A corpus of more than ``QUEUES`` sources gives its largest ones and those with a target queues of
their own; the others are dealt into a fixed number of joint queues by a checksum of their name,
in which they follow each other, so the closed form stays short and no document is left out.

The last, incomplete window is split into sequences whose lengths are powers of two, so there is
no padding at all.

Edge cases: null text is empty, and an empty document has the end token alone; null source is a
source; equal documents are packed one by one; a text of any length is cut as needed; an empty
table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_slices

#: Rows of the (partition, source) table up to which it is broadcast: about 8 MB.
BROADCAST_ROWS = 100_000
#: Characters from which on ids come as an array, without a list that takes ten times its memory.
LONG_TEXT = 1 << 20
#: Queues: the largest sources and all with a target have their own, and beyond half this number of sources the rest share queues.
QUEUES = 1024


class IdEncoder:
    """Token ids of a ``tokenizers`` file.

    Where the file is a plain byte-level BPE whose ids rise in the order of its merges, its own
    vocabulary serves as ranks for ``tiktoken``, which gives the same ids several times faster and
    needs no cache. Texts with characters on whose class the two libraries' regular expressions
    might differ, or with an added token's string, and all other files, go to ``tokenizers``.
    """

    _loaded: dict[str, "IdEncoder"] = {}
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: ASCII and the Latin, Greek and Cyrillic blocks' letters.
    PLAIN = re.compile(r"[\t\n\r -~\xa1-\xac\xae-ʯΆ-ϿЀ-ҁҊ-ԯ‐-‧€]*+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.fast = self.ranked(spec)

    @classmethod
    def of(cls, path: str) -> "IdEncoder":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def ranked(self, spec: dict):
        """The same vocabulary for ``tiktoken``, if it means the same there."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or model.get("type") != "BPE" or any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        vocabulary = model["vocab"]
        merged = [vocabulary["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            return None
        import tiktoken

        # Byte-level files write printable bytes as themselves and the others from U+0100 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in vocabulary.items() if word not in self.added}
        return tiktoken.Encoding(f"ranks-{len(ranks)}", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def library_ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian ids, ``dtype`` wide."""
        if self.fast is None or self.PLAIN.fullmatch(text) is None or any(x in text for x in self.added):
            return self.library_ids(text)
        if len(text) > LONG_TEXT:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes()
        return np.array(self.fast.encode_ordinary(text), self.dtype).tobytes()


class Deal:
    """The closed form of the dealing order."""

    def __init__(self, tokens: list[int], shares: list[float], quantum: int, window: int):
        self.tokens, self.quantum, self.window = tokens, quantum, window
        self.shares = np.array(shares, np.float64)
        self.total = int(sum(tokens))
        self.full = self.total // window
        rest = self.total - self.full * window
        cuts = [0]
        for bit in range(window.bit_length(), -1, -1):
            if rest >> bit & 1:
                cuts.append(cuts[-1] + (1 << bit))
        self.cuts = np.array(cuts, np.int64)  # of the sequences that share the last window

    def dealt_before(self, source: np.ndarray, quantum_no: np.ndarray) -> np.ndarray:
        """Tokens dealt before that quantum of that source."""
        deadline = (quantum_no + 0.5) / self.shares[source]
        out = np.zeros(len(source), np.int64)
        for i, (all_tokens, share) in enumerate(zip(self.tokens, self.shares)):
            base = np.floor(deadline * share + 0.5).astype(np.int64) - 2
            count = np.maximum(base, 0)
            for k in range(4):  # the exact count by comparing the very same quotients
                c = base + k
                due = (c + 0.5) / share
                count += (c >= 0) & ((due < deadline) | ((due == deadline) & (i < source)))
            out += np.minimum(all_tokens, self.quantum * count)
        return out

    def pieces(self, source: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """For documents at ``begin`` in their queues: (document, start, length, sequence, offset)."""
        q, w = self.quantum, self.window
        first, last = begin // q, (begin + n - 1) // q
        doc, c = _ranges(first, last)
        low, high = np.maximum(begin[doc], c * q), np.minimum(begin[doc] + n[doc], (c + 1) * q)
        rank, length, start = self.dealt_before(source[doc], c) + low - c * q, high - low, low - begin[doc]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (rank[1:] != rank[:-1] + length[:-1])
        at = np.flatnonzero(fresh)
        doc, rank, start = doc[at], rank[at], start[at]
        length = np.add.reduceat(length, at) if len(at) else length
        part, window = _ranges(rank // w, (rank + length - 1) // w)
        low, high = np.maximum(rank[part], window * w), np.minimum(rank[part] + length[part], (window + 1) * w)
        doc, start = doc[part], start[part] + low - rank[part]
        tail = self.cuts[1:-1] + self.full * w
        a, b = np.searchsorted(tail, low, "right"), np.searchsorted(tail, high - 1, "right")
        part, cut = _ranges(a, b)
        edges = np.concatenate([[0], tail, [max(self.total, 1)]])
        lo, hi = np.maximum(low[part], edges[cut]), np.minimum(high[part], edges[cut + 1])
        begins = np.where(lo < self.full * w, lo // w * w, np.maximum(edges[cut], self.full * w))
        return doc[part], start[part] + lo - low[part], hi - lo, np.minimum(lo // w, self.full) + cut, lo - begins


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and value of every integer of each closed range."""
    counts = last - first + 1
    owner = np.repeat(np.arange(len(first)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]


def tokenise(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    kept = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), df[source_col].cast("string").alias("source"))
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("source", pa.string()), ("begin", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part_id = IdEncoder.of(tokenizer_path), TaskContext.get().partitionId()
        end, width = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize
        totals: dict[str | None, int] = {}
        for part in text_slices(batches, "text"):
            sources = part["source"].to_pylist()
            ids = [encoder.encode(t) + end for t in pc.fill_null(part["text"], "").to_pylist()]
            begins, counts = [], []
            for source, x in zip(sources, ids):
                begins.append(totals.get(source, 0))
                counts.append(len(x) // width)
                totals[source] = begins[-1] + counts[-1]
            yield pa.RecordBatch.from_arrays([pa.array([part_id] * len(ids), pa.int32()), part["doc_id"].combine_chunks(), pa.array(sources, pa.string()), pa.array(begins, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return kept.mapInArrow(run, "part int, doc_id long, source string, begin long, n long, ids binary")


def pack(
    df: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    window: int = 2048,
    quantum: int = 256,
    targets: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    queues: int = QUEUES,
) -> DataFrame:
    """Pieces: (id, source, start, length, doc_tokens, sequence_id, offset, ids).

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers. ``targets``
    gives sources their shares of every window (any positive weights; a source that it lacks has
    its share of all tokens); without it, all sources drain together at their natural shares.
    """
    if window & (window - 1) or quantum < 1:
        raise ValueError("window must be a power of two and quantum positive")
    tokens = materialise(tokenise(df, tokenizer_path, end_id, id_col, text_col, source_col))
    sums = tokens.groupBy("part", "source").agg(F.sum("n").alias("n"))
    sources = sums.groupBy("source").agg(F.sum("n").alias("n"))
    targets = targets or {}
    own = None  # names of the sources with their own queue, where not all have one
    if sources.count() > queues:
        largest = sources.orderBy(F.desc("n"), "source").limit(queues // 2).collect()
        own = {r.source for r in largest} | set(targets)
    joint = queues // 2
    queue = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    if own is not None:
        alone = F.coalesce(F.col("source").isin(*(x for x in own if x is not None)), F.lit(None in own))
        queue = F.when(alone, queue).otherwise(F.concat(F.lit("j"), (F.crc32(F.coalesce("source", F.lit(""))) % joint).cast("string")))
    sums = sums.withColumn("queue", queue)
    by_queue = sums.groupBy("queue").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).orderBy("queue").collect()
    names, totals = [r.queue for r in by_queue], [int(r.n) for r in by_queue]
    wanted = {"n" if x is None else "s" + x: v for x, v in targets.items()}
    weights = [wanted.get(x, n / max(1, sum(totals))) for x, n in zip(names, totals)]
    if any(not v > 0 for v in weights):
        raise ValueError("target weights must be positive")
    deal = Deal(totals, weights, quantum, window)
    number = {x: i for i, x in enumerate(names)}
    earlier = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("part").alias("base_part"), F.col("source").alias("base_source"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if sum(r.parts for r in by_queue) <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, (tokens.part == bases.base_part) & tokens.source.eqNullSafe(bases.base_source)).select("doc_id", "source", (F.col("begin") + F.col("base")).alias("begin"), "n", "ids")

    def queue_of(source: str | None) -> int:
        if own is not None and source not in own:
            return number[f"j{zlib.crc32((source or '').encode()) % joint}"]
        return number["n" if source is None else "s" + source]

    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                sources, ids = rows.column("source").to_pylist(), rows.column("ids").to_pylist()
                n = rows.column("n").to_numpy()
                doc, start, length, sequence, offset = deal.pieces(np.array([queue_of(s) for s in sources], np.int64), rows.column("begin").to_numpy(), n)
                wide = [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4").tobytes() for x, k in zip(ids, n)]
                cut = [wide[d][4 * s : 4 * (s + m)] for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist())]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(take), rows.column("source").take(take), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(sequence), pa.array(offset), pa.array(cut, pa.binary())], schema=schema)

    return placed.mapInArrow(run, "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").withColumnRenamed("doc_id", id_col)
