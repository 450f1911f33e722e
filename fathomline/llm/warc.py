"""WARC archives: a deduplicating writer and a splittable reader.

*Writing.* Each row becomes one record, a gzip member of its own (WARC 1.1). Rows with equal payloads of
at least ``least`` bytes share one ``response``, that of the smallest id; the others are ``revisit``
records that refer to it and carry no payload. A task writes files of about ``file_bytes`` under a
temporary name, renames them, and returns a manifest row for each; only files of the written
manifest are ever read, so what a lost or repeated task left behind is harmless.

*Reading.* Files are cut into byte ranges, each read by any task. A task scans its range for the
gzip magic number, and takes a place for the start of a record if a member's header decodes there to a WARC
version line and named fields. From there it goes from member to member, and owns the records that
start inside its range, to their ends, wherever these lie.

Stored bytes can look like a record (an archive inside an archive). ``ranges`` therefore first
asks of every range where its first record starts and where its last one ends, which must fit
together along a file: the first range starts at 0, and each next one where the one before it ended. A
range that doesn't fit is scanned again from there, until all do. Records are only read after that.

Edge cases: a null payload is the empty one; payloads under ``least`` bytes are always responses;
rows that repeat the smallest id of their payload all stay responses, and a null id comes after all
others; a null url has no target field, and control characters and blanks in one are percent-encoded; a very long payload is
one record, held whole in memory; an empty table makes no file and reads back as no row; input columns
but the three named ones are ignored, whatever their names. A damaged record raises an error that
names its file and place.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
#: Bytes of a range, of a read from a file, and the longest header of a record.
RANGE, BLOCK, MOST_HEADER = 8 << 20, 1 << 20, 64 << 10
#: Bytes that are inflated at a time: what lies behind a member is handed back, so little should.
PIECE = 16 << 10
#: Bytes of records in a batch that a task hands on.
BATCH = 8 << 20
#: Fixed value: the profile of records that refer to an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


# ---- writing --------------------------------------------------------------------------------


def record(id_: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member: a response, or with ``refers_to`` a revisit whose HTTP header still tells the payload's length."""
    http = _HTTP.format(len(payload)).encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(id_)), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(head.encode("utf-8", "surrogatepass")) + packed.compress(block) + packed.compress(b"\r\n\r\n") + packed.flush()


def _urn(id_: int | None) -> str:
    return f"<urn:x-id:{'' if id_ is None else id_}>"


class _Files:
    """Archives of one task: written under temporary names, renamed when full."""

    def __init__(self, folder: str, file_bytes: int):
        self.system, self.folder = arrow_fs.FileSystem.from_uri(folder)
        self.file_bytes, self.stream, self.name, self.size, self.records = file_bytes, None, "", 0, 0

    def add(self, member: bytes) -> Iterator[tuple[str, int, int]]:
        if self.stream is None:
            self.system.create_dir(self.folder, recursive=True)
            self.name, self.size, self.records = uuid.uuid4().hex, 0, 0
            self.stream = self.system.open_output_stream(f"{self.folder}/_{self.name}.tmp", compression=None)
        self.stream.write(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.file_bytes:
            yield from self.close()

    def close(self) -> Iterator[tuple[str, int, int]]:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
            self.system.move(f"{self.folder}/_{self.name}.tmp", f"{self.folder}/{self.name}.warc.gz")
            yield f"{self.name}.warc.gz", self.size, self.records


def write(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, file_bytes: int = 256 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``df`` as archives below ``folder`` (default: a new one in the shared folder); their manifest (path, size, records).

    Ids are whole numbers. Digests meet their smallest id as (digest, id) only; the payloads are
    shuffled no more than the join with the digests that occur again needs, and not at all while those are few.
    """
    folder = folder or shared_dir(df.sparkSession)
    payload = F.coalesce(df[payload_col].cast("binary"), F.lit(b""))
    rows = df.select(df[id_col].cast("long").alias("id"), df[url_col].cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    again = rows.where(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("shared")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = materialise(again)
    revisits = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    typed = rows.join(known, rows["digest"] == known["shared"], "left").select("id", "url", "payload", "digest", F.when(revisits, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, file_bytes)
        listed = lambda made: pa.RecordBatch.from_pydict({"path": [f"{folder}/{x[0]}" for x in made], "size": [x[1] for x in made], "records": [x[2] for x in made]})
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to")]
            for k in range(len(batch)):  # one payload at a time
                if made := list(files.add(record(*(c[k].as_py() for c in columns), date))):
                    yield listed(made)
        if made := list(files.close()):
            yield listed(made)

    return materialise(typed.mapInArrow(run, "path string, size long, records long"))


# ---- reading --------------------------------------------------------------------------------


class Source:
    """A file's bytes by place, read in blocks; the last one is kept."""

    def __init__(self, path: str):
        system, at = arrow_fs.FileSystem.from_uri(path)
        self.path, self.file = path, system.open_input_file(at)
        self.size, self.begin, self.held = self.file.size(), 0, b""

    def _load(self, at: int) -> None:
        self.file.seek(at)
        self.begin, self.held = at, self.file.read(BLOCK)

    def piece(self, at: int) -> bytes:
        """Bytes from ``at`` on: some, unless the file has ended."""
        if not self.begin <= at < self.begin + len(self.held):
            self._load(at)
        return self.held[at - self.begin : at - self.begin + PIECE]

    def take(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at`` on, fewer at the file's end."""
        out = b""
        while len(out) < n and (piece := self.piece(at + len(out))):
            out += piece[: n - len(out)]
        return out

    def find(self, at: int, end: int) -> int | None:
        """The first place from ``at`` on, before ``end``, where the magic number stands."""
        end = min(end, self.size)
        while at < end:
            if not self.begin <= at <= self.begin + len(self.held) - len(MAGIC):
                self._load(at)  # also where the number's end may lie in the next block
            place = self.held.find(MAGIC, at - self.begin, end - self.begin + len(MAGIC) - 1)
            if place >= 0:
                return self.begin + place
            at = max(at + 1, self.begin + len(self.held) - len(MAGIC) + 1)
        return None


def _deflated_at(source: Source, at: int) -> int | None:
    """Where the compressed data of the gzip member at ``at`` begin; None without such a member."""
    head = source.take(at, 10)
    if not head.startswith(MAGIC) or len(head) < 10 or head[3] & 0xE0:
        return None
    flags, at = head[3], at + 10
    if flags & 4:
        at += 2 + int.from_bytes(source.take(at, 2), "little")
    for flag in (8, 16):  # name and comment, each up to a zero byte
        while flags & flag and (byte := source.take(at, 1)):
            at += 1
            if byte == b"\0":
                break
    return at + 2 * bool(flags & 2)


def head_at(source: Source, at: int) -> tuple[dict[str, str], int] | None:
    """(named fields in lower case, length of the header) of the record whose member starts at ``at``; None if none does.

    Only as much is inflated as the header takes, and the member's sum is not asked for.
    """
    place, inflate, out, raw = _deflated_at(source, at), zlib.decompressobj(-15), b"", b""
    try:
        while place is not None and len(out) < MOST_HEADER and not inflate.eof:
            if not (raw := inflate.unconsumed_tail) and not (raw := source.piece(place)):
                return None
            place += len(raw) if not inflate.unconsumed_tail else 0
            out += inflate.decompress(raw, 1 << 10)
            if not VERSION.startswith(out[: len(VERSION)]) and not out.startswith(VERSION):
                return None
            if (end := out.find(b"\r\n\r\n")) >= 0:
                lines = out[:end].decode("utf-8", "surrogateescape").split("\r\n")
                fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}
                return (fields, end + 4) if fields.keys() >= {"warc-type", "warc-record-id", "content-length"} and fields["content-length"].isdecimal() else None
    except zlib.error:
        pass
    return None


def member_at(source: Source, at: int, keep: bool) -> tuple[int, bytes]:
    """(place after the member that starts at ``at``, its content if ``keep``); raises ``zlib.error`` if it is damaged."""
    inflate, parts = zlib.decompressobj(31), []
    while not inflate.eof:
        raw = source.piece(at)
        if not raw:
            raise zlib.error("the file ends inside a member")
        part = inflate.decompress(raw)  # checks the member's sum at its end
        at += len(raw) - len(inflate.unused_data)
        if keep:
            parts.append(part)
    return at, b"".join(parts)


def records(source: Source, begin: int, end: int, keep: bool) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(start, place after it, fields, block if ``keep``) of the records that start in a range; what is none in between is skipped."""
    at = begin
    while at < end:
        head = head_at(source, at)
        if head is None:
            if (at := source.find(at + 1, end)) is None:
                return
            continue
        fields, skip = head
        size = int(fields["content-length"])
        try:
            after, content = member_at(source, at, keep)
        except zlib.error as damage:
            if keep:
                raise ValueError(f"{source.path}: the record at byte {at} is damaged: {damage}") from damage
            at += 1  # no record, if the range's true start says so
            continue
        if keep and len(content) < skip + size:
            raise ValueError(f"{source.path}: the record at byte {at} is shorter than its header says")
        yield at, after, fields, content[skip : skip + size]
        at = after


def ranges(manifest: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """(path, start, stop, begin, first, after): byte ranges of the files (path, size) with the true start of the first record in each.

    ``first`` and ``after`` are null for a range in which no record starts.
    """
    cut = manifest.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"), "size")
    todo = cut.select("path", "start", F.least(F.col("start") + range_bytes, "size").alias("stop"), F.col("start").alias("begin"))
    schema = "path string, start long, stop long, begin long, first long, after long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                first = after = None
                for at, after, _, _ in records(Source(row["path"]), row["begin"], row["stop"], False):
                    first = at if first is None else first
                out.append(row | {"first": first, "after": after})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("start", "stop", "begin", "first", "after"))]))

    scan = lambda asked: materialise(_dealt(asked.select("path", "start", "stop", "begin")).mapInArrow(run, schema))
    found = scan(todo)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    while True:  # each time, of every file at least the first range that didn't fit does
        told = found.withColumn("due", F.coalesce(F.max("after").over(before), F.lit(0)))
        wrong = (F.col("begin") != F.col("due")) & (F.coalesce("first", "stop") != F.least("due", "stop"))
        if told.where(wrong).isEmpty():
            return found
        again = scan(told.where(wrong).select("path", "start", "stop", F.col("due").alias("begin")))
        found = materialise(told.where(~wrong).select(*found.columns).unionByName(again))


def _dealt(rows: DataFrame) -> DataFrame:
    """Ranges spread evenly over at least as many tasks as there are cores."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism), "path", "start")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the archives of a folder, whoever made them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", F.col("length").alias("size"))


def read(manifest: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """(path, offset, record_type, record_id, target_uri, refers_to, digest, headers, payload_bytes, payload) of every record of the files (path, size).

    The payload is what follows a response's HTTP header, null for a revisit, whose ``payload_bytes``
    is what its HTTP header says; other types keep their whole block. A response whose payload
    doesn't have the SHA-256 that its header tells raises an error.
    """
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    asked = _dealt(ranges(manifest, range_bytes).where("first is not null").select("path", "start", "first", "stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                source = Source(row["path"])
                for at, _, fields, block in records(source, row["first"], row["stop"], True):
                    held.append(_row(source.path, at, fields, block))
                    size += len(block)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return asked.mapInArrow(run, "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, digest string, headers map<string,string>, payload_bytes long, payload binary")


def _row(path: str, at: int, fields: dict[str, str], block: bytes) -> dict:
    kind, told = fields["warc-type"], fields.get("warc-payload-digest")
    http, gap, body = block.partition(b"\r\n\r\n") if kind in ("response", "revisit") else (b"", b"", block)
    size, digest = len(body), told
    if kind == "revisit":
        length = re.search(rb"(?mi)^content-length:[ \t]*(\d+)", http)
        size, body, digest = int(length[1]) if length else None, None, told and told.removeprefix("sha256:")
    elif told is None or told.startswith("sha256:"):
        digest = hashlib.sha256(body).hexdigest()
        if told and told != f"sha256:{digest}":
            raise ValueError(f"{path}: the payload of the record at byte {at} doesn't have its digest")
    return {"path": path, "offset": at, "record_type": kind, "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "digest": digest, "headers": list(fields.items()), "payload_bytes": size, "payload": body}


def id_of(column: str):
    """The whole number that ``write`` put into a record id; null for others."""
    return F.expr(f"try_cast(nullif(regexp_extract({column}, '^<urn:x-id:([^>]*)>$', 1), '') AS bigint)")
