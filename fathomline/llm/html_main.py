"""Main text of web pages by nearest-URL page differencing.

Each page is parsed into text lines, one a block element, in page order. Pages are ordered by
(host, URL path, id); a page's partner is that of its two neighbours on the same host whose path
shares the longer prefix with its own, the earlier one on a tie. The line sequences of a pair,
whole pages, are aligned by longest common subsequence, and the page's lines in that common part
are template text and go.

Where alignment alone can't tell, marks that the parser leaves on lines settle it:

* running text of the page's article (headings, lines with sentence ends, or long ones, that are
  not mostly links) stays although a neighbour repeats it: stories quote and copy each other. Short
  lines without an end and link lists inside an article go like any other shared line;
* a neighbour that shares all of a page's content is its copy and tells nothing about templates,
  so the other neighbour is taken;
* elements and roles that by their meaning are no main text (nav, footer, aside, form ...) go even
  if the neighbour's differ; so do blocks whose class or id names such a part, unless the
  differencing leaves nothing else: then their running text, shared with nobody, is the text;
* if article lines are left, they are the main text, else all plain lines that are left are.

The order is cut into ranges by exact borders from a pass over ids and URLs only; a range also
gets copies of the pages next to it, so every page meets its true neighbours and the result does
not depend on the number of ranges. A host with a third of all pages is spread over many ranges; a
task holds three pages at a time.

Edge cases: null html is an empty page with empty text; null url is an empty host, which pairs
with no page; equal urls are neighbours by id, then by a checksum of the html; scripts, styles,
comments and markup never give text; unclosed and stray tags are tolerated; pages of any length
are parsed whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_filter import split_url

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that never hold main text.
_DROP = frozenset("nav footer aside form iframe object audio video select option button textarea input datalist dialog menu".split())
#: Elements without lines of text.
_MUTE = frozenset("head title script style noscript template svg math canvas".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of names of a page's frame, of its content, and words that say nothing about either.
_FRAME = frozenset(
    "ad ads adv advert adverts advertising advertisement advertisements sponsor sponsored sponsors promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist discussion disqus replies respond share sharing social related recommended newsletter subscribe "
    "subscription signup login widget widgets skip pagination pager toolbar tags".split()
)
_CONTENT = frozenset("post posts story stories article articles entry entries blog news paragraph lead content body text main".split())
_NEUTRAL = frozenset(
    "wrapper wrap box container list section area block item items inner outer group panel row col column columns top bottom left right bar zone unit slot holder link links side site page global primary secondary mini small large "
    "fixed sticky mobile desktop content body text main title".split()
)
_PARTS = re.compile(r"[a-z]+")
_END = re.compile(r"[.!?\u2026\u3002]")
#: Words from which on a line of an article without a sentence end is running text all the same.
LONG_LINE = 12
#: First characters of stored lines: their marks. White space is folded, so no text begins with one of them.
PLAIN, PROSE, LOOSE, NAMED, FRAME = "\x1b", "\x1c", "\x1d", "\x1e", "\x1f"
#: Pages of a range.
RANGE_PAGES = 3000


def frame_name(names: str, in_article: bool) -> bool:
    """Whether class names and an id say frame: by the last telling word of each, and no name says content."""
    found = False
    for name in names.lower().split():
        words = _PARTS.findall(name.replace("side-bar", "sidebar"))
        telling = [w for w in words if w not in _NEUTRAL] or [w for w in words if w in _CONTENT]
        if in_article and telling[-1:] == ["header"]:
            continue  # an article's title block
        if not telling:
            continue
        if telling[-1] in _CONTENT:
            return False
        found = found or telling[-1] in _FRAME or not _FRAME.isdisjoint(telling)
    return found


class LineParser(HTMLParser):
    """Collects lines of text, each behind its mark."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.held: list[str] = []
        self.linked = self.size = 0  # characters inside links, and all, of the line so far
        self.heading = False
        self.open: list[tuple[str, str, bool, bool]] = []  # tag, mark of its frame or none, in article, mute
        self.at = ("", False, False)
        self.place = ("", False)
        self.links = 0

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.lines.append(self.mark(text) + text)
            self.held = []
        self.linked = self.size = 0

    def mark(self, text: str) -> str:
        frame, article = self.place
        if frame:
            return frame
        if not article:
            return PLAIN
        running = self.heading or _END.search(text) is not None or text.count(" ") >= LONG_LINE
        return PROSE if running and 2 * self.linked <= self.size else LOOSE

    def close_to(self, depth: int) -> None:
        for tag, *_ in self.open[depth:]:
            if tag == "a":
                self.links -= 1
        del self.open[depth:]
        self.at = self.open[-1][1:] if self.open else ("", False, False)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br" or tag not in _INLINE:
            self.flush() if tag != "br" else self.held.append(" ")
        if tag in _VOID:
            return
        if tag not in _INLINE and self.open:
            # A block ends an open paragraph, and with it what is open inside; an item ends its sibling.
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.open[depth][0]
                if name == "p" or name == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    self.close_to(depth)
                    break
                if name not in _INLINE:
                    break
        frame, article, mute = self.at
        mute = mute or tag in _MUTE
        if frame != FRAME:
            found = dict(attrs) if attrs else {}
            role = (found.get("role") or "").lower() if found else ""
            if tag in _DROP or tag == "header" and not article or role in _ROLES or "hidden" in found or (found.get("aria-hidden") or "").lower() == "true":
                frame = FRAME
            elif found and not frame and tag not in ("body", "html", "main") and frame_name(f"{found.get('class') or ''} {found.get('id') or ''}", article):
                frame = NAMED
            article = article or not frame and (tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody")
        self.links += tag == "a"
        self.open.append((tag, frame, article, mute))
        self.at = (frame, article, mute)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self.close_to(depth)
                break

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        frame, article, mute = self.at
        if not mute:
            if (frame, article) != self.place:
                self.flush()
                self.place = (frame, article)
            if not self.held:
                self.heading = any(x[0] in _HEADING for x in self.open[-4:])
            self.held.append(data)
            size = len(data.strip())
            self.size += size
            if self.links > 0:
                self.linked += size


def page_lines(html: str | None) -> list[str]:
    """Lines of a page in order, each behind its mark."""
    parser = LineParser()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.lines


def _row(a: list, places: dict, width: int) -> int:
    """Bit vector whose zero bits among the first j count the common subsequence of a and b[:j]."""
    mask = (1 << width) - 1
    v = mask
    for x in a:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & mask
    return v


def common(a: list, b: list) -> list[int]:
    """Indices of ``a`` in a longest common subsequence with ``b``: bit-parallel rows, split in halves."""
    def solve(a: list, at: list[int], b: list) -> list[int]:
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        out = at[:head]
        a, at, b = a[head:], at[head:], b[head:]
        tail = 0
        while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        end = at[len(at) - tail :]
        a, at, b = a[: len(a) - tail], at[: len(at) - tail], b[: len(b) - tail]
        keep = set(a) & set(b)
        at = [i for x, i in zip(a, at) if x in keep]
        a, b = [x for x in a if x in keep], [x for x in b if x in keep]
        if not a or not b:
            return out + end
        if len(a) == 1:
            return out + at + end
        half, n = len(a) // 2, len(b)
        ahead: dict = {}
        back: dict = {}
        for j, x in enumerate(b):
            ahead[x] = ahead.get(x, 0) | 1 << j
            back[x] = back.get(x, 0) | 1 << (n - 1 - j)
        zeros = lambda v: np.concatenate([[0], np.cumsum(1 - np.unpackbits(np.frombuffer(v.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n].astype(np.int64))])
        k = int(np.argmax(zeros(_row(a[:half], ahead, n)) + zeros(_row(a[half:][::-1], back, n))[::-1]))
        return out + solve(a[:half], at[:half], b[:k]) + solve(a[half:], at[half:], b[k:]) + end

    return solve(a, list(range(len(a))), b)


def own_lines(lines: list[str], partners: list[list[str]]) -> tuple[list[str], int]:
    """(main text lines, number of lines shared with the partner); ``partners`` in the order of preference."""
    texts = [x[1:] for x in lines]
    running = {i for i, x in enumerate(lines) if x[0] == NAMED and _END.search(x) and x.count(" ") >= LONG_LINE}
    content = {i for i, x in enumerate(lines) if x[0] in (PLAIN, PROSE, LOOSE)} | running
    gone: set[int] = set()
    for partner in partners:
        shared = set(common(texts, [x[1:] for x in partner]))
        if not content or not content <= shared:
            gone = shared
            break
    left = [x for i, x in enumerate(lines) if i not in gone or x[0] == PROSE]
    own = [x[1:] for x in left if x[0] in (PROSE, LOOSE)] or [x[1:] for x in left if x[0] == PLAIN]
    if not own and partners:
        own = [texts[i] for i in sorted(running - gone)]
    return own, len(gone)


def _alike(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def extract_main(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", partitions: int | None = None) -> DataFrame:
    """(id, url, text, n_lines, n_shared) of every page: its text, that text's lines, lines shared with its partner."""
    spark = df.sparkSession
    kept = df.select(df[id_col].cast("long").alias("id"), df[url_col].cast("string").alias("url"), df[html_col].cast("string").alias("html"))
    place = lambda url, i: (*split_url(url), i is not None, i or 0)
    key_type = "host string, path string, named boolean, id long"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [place(u, i) for u, i in zip(batch.column("url").to_pylist(), batch.column("id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.bool_(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.bool_(), pa.int64())], names=["host", "path", "named", "id"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = None, None
        for batch in batches:
            if batch.num_rows:
                first = batch.slice(0, 1) if first is None else first
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            yield first
            yield last

    ranges = partitions or max(8, -(-kept.count() // RANGE_PAGES))
    order = ["host", "path", "named", "id"]
    sorted_keys = kept.select("url", "id").mapInArrow(keys, key_type).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # Two rows a range come to the driver; equal keys never lie in two ranges.
    found = sorted(tuple(r) for r in sorted_keys.mapInArrow(ends, key_type).collect())
    borders = spark.sparkContext.broadcast((found[::2], found[1::2]))
    stored = "part int, own boolean, host string, path string, named boolean, id long, sum long, url string, lines array<string>"
    parsed = pa.schema([("part", pa.int32()), ("own", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("named", pa.bool_()), ("id", pa.int64()), ("sum", pa.int64()), ("url", pa.string()), ("lines", pa.list_(pa.string()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = borders.value
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                out = []
                for i, url, html in zip(*(whole.slice(at, 200).column(c).to_pylist() for c in ("id", "url", "html"))):
                    key = place(url, i)
                    part = max(0, bisect_right(firsts, key) - 1)
                    row = (*key[:3], i, zlib.crc32((html or "").encode("utf-8", "surrogatepass")), url, page_lines(html))
                    out.append((part, True, *row))
                    if key[0] and part + 1 < len(firsts) and key == lasts[part] and key[0] == firsts[part + 1][0]:
                        out.append((part + 1, False, *row))
                    if key[0] and part and key == firsts[part] and key[0] == lasts[part - 1][0]:
                        out.append((part - 1, False, *row))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), parsed)], schema=parsed)

    pages = kept.mapInArrow(parse, stored).repartitionById(max(1, len(found) // 2), F.col("part")).sortWithinPartitions("part", *order, "sum")
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_lines", pa.int32()), ("n_shared", pa.int32())])

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for whole in batches:
                for at in range(0, whole.num_rows, 200):
                    yield from whole.slice(at, 200).to_pylist()

        def pairs(a: dict | None, b: dict | None) -> bool:
            return a is not None and b is not None and a["host"] != "" and a["host"] == b["host"] and a["part"] == b["part"]

        def results() -> Iterator[tuple]:
            before, page = None, None
            for after in _closed(rows()):
                if page is not None and page["own"]:
                    near = sorted((-_alike(page["path"], x["path"]), n) for n, x in enumerate((before, after)) if pairs(page, x))
                    own, shared = own_lines(page["lines"], [(before, after)[n]["lines"] for _, n in near])
                    yield page["id"], page["url"], " ".join(own), len(own), shared
                before, page = page, after

        held: list[tuple] = []
        for row in results():
            held.append(row)
            if len(held) == 200:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    out = pages.mapInArrow(difference, "id long, url string, text string, n_lines int, n_shared int")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def _closed(rows: Iterator[dict]) -> Iterator[dict | None]:
    yield from rows
    yield None
