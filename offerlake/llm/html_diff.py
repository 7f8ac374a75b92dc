"""Main text of web pages: structure first, then differencing against the page with the nearest URL.

1. A page is read into visible text lines (blocks), each of which knows whether it is inside article or main, and whether it is
   inside an element that is never main text (menus, forms, adverts and the like, by element, role, class or id).
2. All pages are sorted by host and URL path into ranges, a fixed number for each shuffle partition; each page is paired with that of
   its two nearest neighbours of other html in the host that has the longer common path prefix, also across the bounds of ranges.
   The two pages' lines are aligned by their longest common subsequence, and shared lines are deleted.
3. Lines inside article or main are kept although shared: pages of one host do repeat paragraphs, which are main text all the
   same. If a page has such an element, only its lines are the main text. Where all is shared the partner shows the same, and
   nothing is deleted. Copies of a page aren't its partners: they get the text that the page has alone.
"""

from __future__ import annotations

import html
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, durable, text_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style noscript template nav footer aside button select textarea svg math canvas iframe object dialog menu title xmp noembed noframes".split())
#: What holds no main text either, unless an article or main stands inside: elements, and those named as below.
MAYBE = frozenset(("form",))
MAIN = frozenset(("article", "main"))
#: Words of class, id and role that tell what isn't main text.
NEVER_NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios consent contentinfo cookie cookies "
    "disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice pager pagination popup promo promotion related reply replies "
    "respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that such names are made up with. Inside an article or main a name tells only if it holds nothing else: share-buttons, not share-price.
BESIDE = frozenset("area bar block box buttons container content form inner items left link links list outer panel posts right section slot thread top unit wrap wrapper".split())


class Line(NamedTuple):
    text: str
    main: bool
    never: bool


NO, SOFT, HARD = 0, 1, 2


def _never(name: str, attributes: str, main: bool) -> int:
    """Whether an element with these attributes is never main text: HARD, or SOFT where an article or main inside it still is."""
    found = HARD if name in NEVER else SOFT if name in MAYBE or (name == "header" and not main) else NO
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return HARD
        # An article's own class words say what it is about, not that it isn't one.
        if name not in MAIN and key in ("class", "id", "role"):
            for word in value.split():
                parts = set(filter(None, re.split(r"[^a-z0-9]+", word)))
                if not NEVER_NAMED.isdisjoint(parts) and (not main or parts <= NEVER_NAMED | BESIDE):
                    found = max(found, SOFT)
    return found


def lines_of(page: str | None) -> list[Line]:
    """The visible blocks of a page in order; broken markup is read as browsers do, roughly: an end tag closes what is open inside."""
    out: list[Line] = []
    held: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # element, inside main, inside what is never main
    main, never = False, NO

    def end_block() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append(Line(text, main, never > NO))

    page = page or ""
    at = 0
    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        name = token[2]
        if name is None:
            if page[token.start()] != "<" or token.end() == token.start() + 1:
                held.append(token[0])
            continue
        name = name.lower()
        if token[1]:
            if name == "br":
                held.append(" ")
            if not any(x[0] == name for x in stack):
                continue
            if name not in INLINE:
                end_block()
                while stack.pop()[0] != name:
                    pass
            else:
                # An inline element ends alone; what it was opened around stays open.
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        if stack[i][2] and not (i and stack[i - 1][2]):
                            end_block()
                            del stack[i:]
                        else:
                            del stack[i]
                        break
            main, never = (stack[-1][1], stack[-1][2]) if stack else (False, NO)
            continue
        if name == "br":
            held.append(" ")
        if name in VOID:
            if name == "hr":
                end_block()
            continue
        off = max(never, _never(name, token[3], main))
        if name not in INLINE or (off and not never):
            end_block()
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            stack.pop()
            main, never = (stack[-1][1], stack[-1][2]) if stack else (False, NO)
            off = max(never, _never(name, token[3], main))
        if token[3].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in MAIN and off < HARD:
            main, never = True, NO
        else:
            main, never = main and not off, off
        stack.append((name, main, never))
    end_block()
    return out


def _rows(a: list[int], where: dict[int, int], width: int) -> list[int]:
    """After each item of a, the bits j of b for which b[: j + 1] has no longer common subsequence than b[:j] (Crochemore and others, 2001)."""
    full = (1 << width) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _places(b: list[int]) -> dict[int, int]:
    """For each item of b, the bits of its places."""
    at: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    out = {}
    for x, js in at.items():
        bits = bytearray(len(b) // 8 + 1)
        for j in js:
            bits[j >> 3] |= 1 << (j & 7)
        out[x] = int.from_bytes(bits, "little")
    return out


def _lengths(v: int, width: int) -> list[int]:
    """Lengths of common subsequences with b[:0], b[:1], ... from a row of bits."""
    out = [0]
    for bit in reversed(f"{v:0{width}b}" if width else ""):
        out.append(out[-1] + (bit == "0"))
    return out


#: Bits of alignment rows that are kept at once; larger alignments are halved.
_ROW_BITS = 1 << 28


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of one longest common subsequence of a and b.

    Rows of bits stand for rows of the usual table, so that many repeated lines cost no more than others; alignments that are too
    large for that are halved (Hirschberg, 1975).
    """
    ids: dict[str, int] = {}
    x, y = ([ids.setdefault(t, len(ids)) for t in side] for side in (a, b))
    found: set[int] = set()
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and x[i] == y[j]:
            found.add(i)
            i, j = i + 1, j + 1
        while i < n and j < m and x[n - 1] == y[m - 1]:
            found.add(n - 1)
            n, m = n - 1, m - 1
        if i == n or j == m:
            continue
        if (n - i) * (m - j) > _ROW_BITS and n - i > 1:
            middle = (i + n) // 2
            ahead = _lengths(_rows(x[i:middle], _places(y[j:m]), m - j)[-1], m - j)
            back = _lengths(_rows(x[middle:n][::-1], _places(y[j:m][::-1]), m - j)[-1], m - j)[::-1]
            cut = j + max(range(m - j + 1), key=lambda t: ahead[t] + back[t])
            todo += [(i, middle, j, cut), (middle, n, cut, m)]
            continue
        rows = _rows(x[i:n], _places(y[j:m]), m - j)
        row, column = n - i, m - j
        while row and column:
            bit = 1 << (column - 1)
            if rows[row - 1] & bit:
                column -= 1
            elif row > 1 and not rows[row - 2] & bit:
                row -= 1
            else:
                row, column = row - 1, column - 1
                found.add(i + row)
    return found


def main_text(lines: list[Line], partner: list[Line] | None) -> str:
    """The main text of a page given its partner's lines."""
    rooted = any(x.main and not x.never for x in lines)
    wanted = [i for i, x in enumerate(lines) if not x.never and (x.main or not rooted)]
    shared = common_lines([x.text for x in lines], [x.text for x in partner]) if partner else set()
    kept = [i for i in wanted if lines[i].main or i not in shared]
    return "\n".join(lines[i].text for i in (kept or wanted))


class _Page(NamedTuple):
    host: str
    path: str
    lines: list[Line]


def _differenced(page: _Page, before: _Page | None, after: _Page | None) -> str:
    """The main text of a page, given its neighbours in order: that of the longer common path prefix is its partner, the one before if equally long."""
    near = [len(os.path.commonprefix([page.path, x.path])) if x and x.host == page.host else -1 for x in (before, after)]
    partner = None if max(near) < 0 else before if near[0] >= near[1] else after
    return main_text(page.lines, partner.lines if partner else None)


_OUT = "page_id long, url string, text string, n_chars long"
#: Keys of pages that are sampled to part the order into ranges: a bounded number, whatever the input.
SAMPLED_KEYS = 20_000
#: Ranges for each shuffle partition.
RANGES_PER_PARTITION = 4
#: Bounds of one batch of texts, in rows and characters.
_BATCH_ROWS, _BATCH_CHARS = 1_000, 1 << 22


def _text_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of (page_id, url, text), bounded in rows and characters."""

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        ids, urls, texts = zip(*held, strict=True)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, urls, texts, [len(x) for x in texts]), kinds, strict=True)], names=["page_id", "url", "text", "n_chars"])

    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[2])
        if len(held) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
            yield batch_of(held)
            held, chars = [], 0
    if held:
        yield batch_of(held)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of sorted pages, range by range; pages that only stand by as neighbours give none.

    Copies of a page follow each other and are read once. What is held of them is their ids and urls.
    """

    def rows() -> Iterator[tuple]:
        part = run = before = here = None
        waiting: list[tuple] = []

        def settled(after: _Page | None) -> Iterator[tuple]:
            if waiting:
                text = _differenced(here, before, after)
                yield from ((i, u, text) for i, u in waiting)
                waiting.clear()

        for batch in batches:
            for number, r, own, i, u, h, p, x in zip(*(batch.column(n).to_pylist() for n in ("range", "run", "own", "page_id", "url", "host", "path", "html")), strict=True):
                if (number, r) != (part, run):
                    page = _Page(h, p, lines_of(x))
                    if number == part:
                        yield from settled(page)
                        before = here
                    else:
                        yield from settled(None)
                        before = None
                    part, run, here = number, r, page
                if own:
                    waiting.append((i, u))
        yield from settled(None)

    return _text_batches(rows())


def _beside(ends: list[tuple]) -> list[tuple[str, int]]:
    """(key, range): the pages of other ranges that each range needs as neighbours.

    ends has for each range (range, first run, last run, last key of another run than the last, first key of another run than the
    first, first key, last key). A range needs the nearest page before it that isn't of its first run, and the nearest one
    behind it that isn't of its last run; both may lie several ranges off where a page has many copies.
    """
    out = []
    ends = sorted(ends)
    before: list[tuple[str, str]] = []  # the last page so far, and the last one of another run than that: (run, key)
    for number, first, last, other_last, _, _, last_key in ends:
        out += [(key, number) for run, key in before if run != first][:1]
        if other_last is not None:
            before = [(last, last_key), ("", other_last)]
        elif not before or before[0][0] != last:
            before = [(last, last_key), *before[:1]]
    after: list[tuple[str, str]] = []
    for number, first, last, _, other_first, first_key, _ in reversed(ends):
        out += [(key, number) for run, key in after if run != last][:1]
        if other_first is not None:
            after = [(first, first_key), ("", other_first)]
        elif not after or after[0][0] != first:
            after = [(first, first_key), *after[:1]]
    return out


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    Null and empty html give an empty text. Pages without a host (null or odd URLs) form a host of their own; a page that is alone
    in its host has no partner. Repeated rows are pages each, with the text of a single one: a page of the same URL path and html is
    a copy, never a partner. Other columns are left aside.

    The order of pages is parted into ranges at keys that are sampled once, so that ranges stay the same however often a task is run
    again. Each range also gets its neighbours before and behind it. Keys are written once and read for all that is asked of them.
    """
    spark = pages.sparkSession
    text_batches(spark)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_replace("url", r"(?d)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*", ""), F.lit(""))
    run = F.concat_ws("\u0000", "host", "path", F.coalesce(F.md5("html"), F.lit("")))
    key = F.concat_ws("\u0000", "run", F.coalesce("url", F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    located = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"), path.alias("path")).withColumn("run", run).withColumn("key", key)
    known = durable(located.select("run", "key"), "pages-keys")
    n_pages = known.count()
    share = min(1.0, SAMPLED_KEYS / max(1, n_pages))
    picked = known.where(F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key").distinct()
    keys = sorted(r[0] for r in picked.limit(2 * SAMPLED_KEYS).collect())
    n_ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({keys[i * len(keys) // n_ranges] for i in range(1, n_ranges)}) if keys else []

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, x) for x in k], dtype="int32")

    # Two rows at most for each range, whose keys the driver pairs with the ranges beside.
    dealt = known.withColumn("range", range_of("key"))
    edges = dealt.groupBy("range").agg(F.min(F.struct("key", "run")).alias("a"), F.max(F.struct("key", "run")).alias("z"))
    edges = durable(edges.select("range", F.col("a.run").alias("first"), F.col("z.run").alias("last"), F.col("a.key").alias("first_key"), F.col("z.key").alias("last_key")), "pages-edges")
    other = lambda run: F.when(F.col("run") != F.col(run), F.col("key"))
    inner = dealt.join(F.broadcast(edges), "range").groupBy("range", "first", "last", "first_key", "last_key").agg(F.max(other("last")).alias("other_last"), F.min(other("first")).alias("other_first"))
    beside = _beside([tuple(r) for r in inner.select("range", "first", "last", "other_last", "other_first", "first_key", "last_key").collect()])
    discard(known, edges)
    names = ["page_id", "url", "html", "host", "path", "run", "key"]
    guests = located.join(F.broadcast(spark.createDataFrame(beside, "key string, range int")), "key").dropDuplicates(["key", "range"]).select(*names, "range", F.lit(False).alias("own"))
    rows = located.withColumn("range", range_of("key")).select(*names, "range", F.lit(True).alias("own")).unionByName(guests)
    ordered = rows.repartition("range").sortWithinPartitions("range", "key", "own")
    return ordered.select("range", "run", "own", "page_id", "url", "host", "path", "html").mapInArrow(_texts, _OUT)
