"""URL filter over a sorted array of 64-bit xxhash digests.

``compile_rules`` turns (action, host, path prefix) rules into flat files: sorted digests, then
per digest the place of its full string. Workers hold such a file in memory and map it once, probe
a whole batch of candidate keys with one vectorised binary search, and compare the stored strings,
so a digest collision can't let a wrong rule through. Rules of more than ``SHARD_BYTES`` make
several files by ranges of digests; the table then passes them one after the other, each pass
written out, and keeps the best rule so far.

A url's candidates are the endings of its host with as many labels as some rule has, joined with
the beginnings of its path that are as long as some rule's: their number follows the rules, not
the url.

Edge cases: a null url or one without ``://`` has empty host and path and meets no rule; an
empty table gives an empty table; repeated rows are judged one by one; extra columns of the
input are ignored; the url's text is used whole whatever its length.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bytes of rules that a worker holds at a time.
SHARD_BYTES = 256 << 20
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def compile_rules(rules: Iterable[tuple[str, str, str]], shard_bytes: int = SHARD_BYTES) -> list[bytes]:
    """Digests (sorted), offsets, actions and strings of the rules, ready to be memory-mapped, in one or more shards.

    Layout: count, number of path lengths and of label counts; these lengths and counts; digests; offsets; actions; strings.
    """
    keys = sorted(((xxhash.xxh64_intdigest(f"{h}\0{p}"), f"{h}\0{p}".encode(), a) for a, h, p in rules), key=lambda x: x[:2])
    ends = np.cumsum([17 + len(k[1]) for k in keys]) // shard_bytes if keys else np.zeros(0, int)
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(keys)]
    return [_shard(keys[i:j]) for i, j in zip(cuts, cuts[1:])]


def _shard(keys: list[tuple[int, bytes, str]]) -> bytes:
    parts = [k[1].decode().partition("\0") for k in keys]
    lengths, labels = sorted({len(x[2]) for x in parts}), sorted({x[0].count(".") + 1 for x in parts})
    offsets = np.cumsum([0, *(len(k[1]) for k in keys)]).astype("<u8")
    head = np.array([len(keys), len(lengths), len(labels), *lengths, *labels], "<u8")
    return head.tobytes() + np.array([k[0] for k in keys], "<u8").tobytes() + offsets.tobytes() + bytes(k[2] == "block" for k in keys) + b"".join(k[1] for k in keys)


class DigestArray:
    """A memory-mapped rule file."""

    _open: dict[str, "DigestArray"] = {}

    def __init__(self, file: BinaryIO):
        raw = np.memmap(file, np.uint8, "r")
        count, lengths, labels = (int(x) for x in raw[:24].view("<u8"))
        at = 24 + 8 * (lengths + labels)
        kinds = [int(x) for x in raw[24:at].view("<u8")]
        self.lengths, self.labels = kinds[:lengths], kinds[lengths:]
        self.digests = raw[at : at + 8 * count].view("<u8")
        self.offsets = raw[at + 8 * count : at + 16 * count + 8].view("<u8")
        self.blocks = raw[at + 16 * count + 8 : at + 17 * count + 8]
        self.strings = raw[at + 17 * count + 8 :]

    @classmethod
    def of(cls, blob: bytes) -> "DigestArray":
        name = hashlib.sha256(blob).hexdigest()
        if name not in cls._open:
            with os.fdopen(os.memfd_create("rules"), "w+b") as f:  # a file in memory: no folder is involved
                f.write(blob)
                f.flush()
                cls._open[name] = cls(f)  # the mapping keeps the pages
        return cls._open[name]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key's rule, -1 without one."""
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        low, high = np.searchsorted(self.digests, digests, "left"), np.searchsorted(self.digests, digests, "right")
        found = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero(low < high):
            for k in range(low[i], high[i]):
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == keys[i]:
                    found[i] = k
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str, bool] | None]:
        """(rule's host, rule's path, whether it blocks) of the longest rule that fits each url."""
        keys, owner = [], []
        most = self.labels[-1] if self.labels else 0
        for i, (host, path) in enumerate(zip(hosts, paths)):
            parts = host.rsplit(".", most)
            starts = [path[:n] for n in self.lengths if n <= len(path)]
            for n in self.labels:
                rest = ".".join(parts[len(parts) - n :]) if n <= len(parts) else ""
                if rest:
                    keys += [f"{rest}\0{x}".encode("utf-8", "surrogatepass") for x in starts]
                    owner += [i] * len(starts)
        best: list[tuple[str, str, bool] | None] = [None] * len(hosts)
        found = self.find(keys)
        for at in np.flatnonzero(found >= 0):
            host, _, path = keys[at].decode().partition("\0")
            i = owner[at]
            best[i] = better(best[i], (host, path, bool(self.blocks[found[at]])))
        return best


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """Of two rules (host, path, ...) the longer one, with the longer host on a tie."""
    rank = lambda x: (-1, -1) if x is None else (len(x[0]) + len(x[1]), len(x[0]))
    return b if rank(b) > rank(a) else a


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) for every row; one pass a shard of rules, no shuffle.

    ``rules``: (block or allow, host, path prefix). A rule fits its host and all subdomains when
    the path starts with its prefix. The rule with the longest string wins (the longer host on a
    tie); a url without a rule gets ``default``.
    """
    context = df.sparkSession.sparkContext
    rows = df.select(df[id_col].cast("long").alias("id"), df[url_col].cast("string").alias("url"), F.lit(None).cast("string").alias("rhost"), F.lit(None).cast("string").alias("rpath"), F.lit(None).cast("boolean").alias("blocks"))
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("rhost", pa.string()), ("rpath", pa.string()), ("blocks", pa.bool_())])
    shards = [context.broadcast(x) for x in compile_rules(rules, shard_bytes)]

    def passed(blob):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            array = DigestArray.of(blob.value)
            for batch in batches:
                urls = batch.column("url").to_pylist()
                parts = [split_url(u) for u in urls]
                hosts, paths = [p[0] for p in parts], [p[1] for p in parts]
                before = [None if x[0] is None else x for x in zip(*(batch.column(c).to_pylist() for c in ("rhost", "rpath", "blocks")))]
                best = [better(x, y) or (None, None, None) for x, y in zip(before, array.judge(hosts, paths))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), *(pa.array([x[k] for x in best], schema.field(4 + k).type) for k in range(3))], schema=schema)

        return run

    for n, blob in enumerate(shards):
        rows = (materialise(rows.select("id", "url", "rhost", "rpath", "blocks")) if n else rows).mapInArrow(passed(blob), "id long, url string, host string, path string, rhost string, rpath string, blocks boolean")
    verdict = F.when(F.col("blocks").isNull(), default).when(F.col("blocks"), "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", F.concat("rhost", "rpath").alias("rule"), verdict.alias("verdict"))
