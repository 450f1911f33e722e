"""Token counts by heap-and-linked-list byte-pair merging.

A text's symbols form a doubly linked list; a heap holds every adjacent pair whose join is in
the vocabulary, lowest rank first, leftmost on a tie. Popping merges until none is left: the
count is the initial symbols minus the merges. No identifier is ever made. Characters that the
vocabulary lacks enter as their UTF-8 bytes, which never merge.

The marked white space (U+2581) only starts vocabulary pieces, never follows another character
inside one, so no merge crosses such a place; the text is cut there and counts of its short
segments are remembered, which changes no result.

Edge cases: null counts as the empty text (0 tokens); very long segments are merged whole in
n log n; an empty table gives an empty table; repeated rows count one by one; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import text_slices

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCounter:
    """Counts for a sentencepiece BPE model with byte fallback, identity normaliser and dummy prefix."""

    _loaded: dict[str, "PieceCounter"] = {}
    #: Remembered segments and the longest of them: bounds of the memory of a worker.
    CACHE, CACHED_CHARS = 1 << 18, 48

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in usable}
        single = {p for p in self.rank if len(p) == 1}
        if any(len(p) > 1 and not set(p) <= single for p in self.rank) or any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("the counter needs pieces of known characters with white space in front only")
        self.single = single
        self.seen: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> "PieceCounter":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merge(self, segment: str) -> int:
        """Tokens of one segment."""
        rank, n = self.rank, len(segment)
        symbols = list(segment)
        initial = sum(1 if c in self.single else len(c.encode("utf-8", "surrogatepass")) for c in symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := segment[i : i + 2]) in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, joined = heapq.heappop(heap)
            right = after[left] if symbols[left] else n
            if right >= n or symbols[left] + symbols[right] != joined:
                continue  # one side has been merged meanwhile
            symbols[left], symbols[right] = joined, ""
            after[left] = follow = after[right]
            merges += 1
            if follow < n:
                before[follow] = left
                if (p := joined + symbols[follow]) in rank:
                    heapq.heappush(heap, (rank[p], left, p))
            if (lead := before[left]) >= 0 and (p := symbols[lead] + joined) in rank:
                heapq.heappush(heap, (rank[p], lead, p))
        return initial - merges

    def count(self, text: str) -> int:
        if not text:
            return 0
        seen, total = self.seen, 0
        for segment in _SEGMENT.findall(SPACE + text.replace(" ", SPACE)):
            n = seen.get(segment)
            if n is None:
                n = self.merge(segment)
                if len(segment) <= self.CACHED_CHARS:
                    if len(seen) >= self.CACHE:
                        seen.clear()
                    seen[segment] = n
            total += n
        return total


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; one pass, no shuffle.

    ``model_path`` is a file that every worker can open, like an installed package's.
    """
    kept = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.of(model_path)
        for part in text_slices(batches, "text"):
            texts = pc.fill_null(part["text"], "")
            counts = [counter.count(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), pc.binary_length(texts).combine_chunks().cast(pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], schema=schema)

    return kept.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
