"""Main text of pages by nearest-URL page differencing.

Pages become text lines, one for each block. Pages are sorted by host and path; each is aligned with the page of the nearest other path on
its host by the longest common subsequence of their lines, and shared lines are boilerplate. Lines that the page itself marks as
navigation, adverts, forms and the like go first; lines in the container that it marks as its article are not boilerplate, whoever shares
them.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from os.path import commonprefix
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_batches, materialize, rows_of

#: Elements that hold no main text, elements whose text is not markup, and elements that begin and end a line.
DROP = frozenset("script style noscript template nav aside form button select textarea input iframe object canvas dialog menu footer head title audio video option fieldset".split())
RAW = frozenset("script style noscript template textarea iframe title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the next of their kind closes.
IMPLIED = frozenset("p li dt dd tr td th option".split())
#: A class or id that names another part of a page: words for such parts, with words for places before and for boxes after them.
OTHER = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|primary|secondary|global|sticky|google|user|reader|article|post|entry|js|c|l|o)[-_]?)*"
    r"(?:(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|side-?bar|nav|navbar|navigation|menu\w*|breadcrumbs?|cookies?|consent|gdpr|notice|notification|newsletter|subscri\w*|pop-?up|modal|overlay|"
    r"share|sharing|social|related|recommend\w*|comments?|disqus|repl(?:y|ies)|respond|footer|header|masthead|widget|toolbar|skip|login|search|pagination|pager|copyright|legal|disclaimer)[-_]?)+"
    r"(?:(?:s|box|area|wrap|wrapper|container|bar|block|lists?|inner|outer|section|links?|items?|units?|slot|form|input|button|text|thread|posts?|articles?|stories|content|top|bottom|left|right|main|\d+)[-_]?)*",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
#: Line pairs whose alignment is traced back from whole rows; larger alignments are halved first. It only bounds memory.
TRACED = 1 << 24
#: Pages of a range aimed at, most ranges, and keys sampled for each range's end.
RANGE_PAGES, MAX_RANGES, SAMPLED = 512, 1 << 16, 8

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_INSIDE = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+")
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/<>]+)")
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden|aria-hidden=[\"']?true)(?=$|[\s/=\"'])", re.I)


def _other(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROP or tag == "header" and not in_article:
        return True
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes) if m[1]}
    if _HIDDEN.search(attributes) or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    return found.get("role", "").lower() in ROLES or any(OTHER.fullmatch(x) for x in f"{found.get('class', '')} {found.get('id', '')}".split())


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, '/' or '', name, attributes) of each tag, and of each comment and declaration without a name, in time linear in the
    page: an end that is not found is looked for once. Quotes that are never closed hide no tag; a tag that nothing closes is the rest."""
    at, n, quoted = 0, len(page), True
    while (start := page.find("<", at)) >= 0:
        for mark, close in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if page.startswith(mark, start):
                end = page.find(close, start + len(mark))
                at = n if end < 0 else end + len(close)
                yield start, at, "", "", ""
                break
        else:
            m = _TAG.match(page, start + 1)
            if not m:
                at = start + 1
                continue
            end = _INSIDE.match(page, m.end()).end() if quoted else page.find(">", m.end())
            if quoted and page[end : end + 1] != ">":
                quoted, end = False, page.find(">", m.end())
            at = n if end < 0 else end + 1
            if (skip := (yield start, at, m[1], m[2].lower(), page[m.end() : at - 1])) is not None:
                at = skip
                yield start, at, "", "", ""


def lines_of(page: str) -> list[tuple[str, bool]]:
    """(text, whether it lies in an article or main element) of each block with text outside the parts that DROP and OTHER name."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    article, dropping, depth, at = 0, "", 0, 0

    def end_line() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, article > 0))
            held.clear()

    found = _tags(page)
    for start, end, closing, tag, attributes in found:
        if not dropping:
            held.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag in RAW and not closing:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            found.send(at)
            continue
        if dropping:
            if tag == dropping:
                depth += -1 if closing else 0 if tag in VOID else 1
                if not closing and tag in IMPLIED:
                    depth -= 1
                    if _other(tag, attributes, article > 0):
                        continue
                    dropping = ""
                elif depth <= 0:
                    dropping = ""
                    continue
                else:
                    continue
            elif dropping == "p" and tag in BLOCK:
                dropping = ""
            else:
                continue
        if tag in BLOCK:
            end_line()
        elif tag == "br":
            held.append(" ")
        if closing:
            if tag in ("article", "main"):
                article = max(0, article - 1)
        elif _other(tag, attributes, article > 0):
            if tag not in VOID:
                end_line() if tag in BLOCK else None
                dropping, depth = tag, 1
        elif tag in ("article", "main"):
            article += 1
    if not dropping:
        held.append(page[at:])
    end_line()
    return out


def _rows(a: list, where: dict, full: int) -> Iterator[tuple[int, int]]:
    """(i, row) for each line of ``a`` that is in ``where``: Hyyro's bit-parallel rows, in which bit j is 0 where the longest common
    subsequence of a[:i + 1] and b[:j + 1] is one longer than that with b[:j]. Other lines leave the row as it is."""
    v = full
    for i, x in enumerate(a):
        if x in where:
            u = v & where[x]
            v = ((v + u) | (v - u)) & full
            yield i, v


def _where(b: list) -> dict:
    found: dict = {}
    for j, x in enumerate(b):
        found[x] = found.get(x, 0) | 1 << j
    return found


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with each prefix of ``b``."""
    full = (1 << len(b)) - 1
    row = full
    for _, row in _rows(a, _where(b), full):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common_lines(a: list, b: list) -> set[int]:
    """The lines of ``a``, by number, in a longest common subsequence with ``b``. Large pairs are cut as Hirschberg does: ``a`` in half, and
    ``b`` where the halves' lengths add up to most; so memory grows with the lines, not with their product."""
    found: set[int] = set()
    todo = [(0, a, b)]
    while todo:
        at, a, b = todo.pop()
        low = 0
        while low < min(len(a), len(b)) and a[low] == b[low]:
            low += 1
        high = 0
        while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
            high += 1
        found.update(range(at, at + low), range(at + len(a) - high, at + len(a)))
        at, a, b = at + low, a[low : len(a) - high], b[low : len(b) - high]
        if not a or not b:
            continue
        if len(a) > 1 and len(a) * len(b) > TRACED:
            half = len(a) // 2
            cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
            todo += [(at, a[:half], b[:cut]), (at + half, a[half:], b[cut:])]
            continue
        kept, rows = [], []
        for i, v in _rows(a, _where(b), (1 << len(b)) - 1):
            kept.append(i)
            rows.append(v)
        i, j = len(rows), len(b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not (i and not rows[i - 1] >> (j - 1) & 1):
                    j -= 1
                    found.add(at + kept[i])
    return found


def main_text(lines: list[tuple[str, bool]], neighbour: list[tuple[str, bool]] | None) -> str:
    """The lines in the page's article, or all if it marks none, without those outside an article that the neighbour shares. Two pages
    whose longest shared line is longer than this page's longest line of its own are copies, and copies say nothing about boilerplate."""
    marked = any(inside for _, inside in lines)
    if neighbour:
        shared = common_lines([x for x, _ in lines], [x for x, _ in neighbour])
        longest = lambda on: max((len(x) for k, (x, _) in enumerate(lines) if (k in shared) == on), default=0)
        if longest(True) <= longest(False):
            lines = [x for k, x in enumerate(lines) if x[1] or k not in shared]
    return " ".join(x for x, inside in lines if inside or not marked)


def place(url: str | None) -> tuple[str, str]:
    """Host without www. or m., and path; numbers in the path are padded, so that near ones are neighbours."""
    try:
        parts = urlsplit(url or "")
        host, path = (parts.hostname or ""), parts.path
    except ValueError:
        host, path = "", url or ""
    return re.sub(r"^(?:www|m)\.", "", host.lower()), re.sub(r"\d+", lambda d: d[0].zfill(12), path)


def _key(url: str | None, page_id: int | None) -> tuple:
    """The order of pages: host, path, then (1 between the path's start and end) url and id, null first."""
    return *place(url), 1, url or "", page_id is not None, page_id or 0


class Ranges:
    """Ranges of keys. Sampled keys are their ends, and so are the start and the end of each sampled key's path: a range has whole paths or
    a piece of one path, so a path that a third of all pages have is spread. ``borders`` tells for each range the last page of the path
    before it and the first page of the path after it."""

    def __init__(self, sampled: list[tuple]):
        self.ends = sorted({e for k in sampled for e in ((*k[:2], 0), k, (*k[:2], 2))})
        self.beyond: dict[tuple, list[int]] = {}

    def of(self, key: tuple) -> int:
        return bisect_left(self.ends, key)

    def borders(self, found: dict[int, tuple[tuple, tuple]]) -> None:
        """``found``: the first and the last key of each range that has pages."""
        order = sorted(found)
        for to, side in ((1, 1), (-1, 0)):
            last = None
            for here, there in zip(order[::to], order[::to][1:]):
                if found[here][side][:2] != found[there][1 - side][:2]:
                    last = found[here][side]
                if last and last[0] == found[there][1 - side][0]:
                    self.beyond.setdefault(last, []).append(there)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row.

    Null and empty html give the empty text; a null or broken url has the host ''. Pages are compared with the last page of the path before
    and the first of the path after on the host, whichever path has more in common with theirs (the one before, if both): whatever the
    partitions, the result is the same. Pages of one path, repeated rows among them, have the same neighbour and never delete what they
    share with each other; a page whose host has one path has none. Tags that are never closed and very long pages take time in
    proportion to their length, but for the alignment. Other columns, whatever their names, are left out. An empty table gives none.

    A row is dealt once, as compressed lines, to the range of its key; a page at a range's border goes to the next range too. The driver
    holds at most SAMPLED * MAX_RANGES keys.
    """
    whole = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html")
    keys = whole.select("page_id", "url")
    rows = keys.count()
    parts = min(MAX_RANGES, max(1, rows // RANGE_PAGES))
    share = min(1.0, SAMPLED * parts / max(rows, 1))
    sampled = sorted(_key(u, i) for i, u in (keys.sample(share, 7) if share < 1 else keys).collect()) if parts > 1 else []
    ranges = Ranges(sampled[SAMPLED - 1 :: SAMPLED])
    names = ("host", "path", "side", "url", "known", "id")
    border = pa.schema([("part", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("side", pa.int32()), ("url", pa.string()), ("known", pa.bool_()), ("id", pa.int64())])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for b in batches:
            for i, u in rows_of(b):
                k = _key(u, i)
                first, last = found.get(p := ranges.of(k), (k, k))
                found[p] = min(first, k), max(last, k)
        yield batch_of([(p, *k) for p, two in found.items() for k in two], border)

    if ranges.ends:
        seen = keys.mapInArrow(ends, "part int, host string, path string, side int, url string, known boolean, id bigint")
        two = seen.groupBy("part").agg(F.min(F.struct(*names)).alias("first"), F.max(F.struct(*names)).alias("last")).collect()
        ranges.borders({r.part: (tuple(r.first), tuple(r.last)) for r in two})

    cut = pa.schema([("part", pa.int32()), ("own", pa.bool_()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3).compress
        for b in batches:
            rows = []
            for i, u, h in rows_of(b):
                key = _key(u, i)
                row = (i, u, *key[:2], press(json.dumps(lines_of(h or ""), ensure_ascii=False).encode()))
                rows.append((ranges.of(key), True, *row))
                rows += [(p, False, *row) for p in ranges.beyond.get(key, ())]
            yield batch_of(rows, cut)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor().decompress
        open_lines = lambda row: [tuple(x) for x in json.loads(press(row[6]))]

        def finish(before: tuple | None, group: list, after: tuple | None) -> Iterator[pa.RecordBatch]:
            """The pages of one path, between the last of the path before and the first of the path after."""
            near = [x for x in (before, after) if x and x[4] == group[0][4]]
            best = max(near, key=lambda x: len(commonprefix([x[5], group[0][5]])), default=None)
            other = best and open_lines(best)
            rows, size = [], 0
            for row in group:
                if row[1]:
                    text = main_text(open_lines(row), other)
                    rows.append((row[2], row[3], text, len(text)))
                    size += len(text)
                    if size > 4 << 20:
                        yield batch_of(rows, schema)
                        rows, size = [], 0
            yield batch_of(rows, schema)

        before, group = None, []
        for b in batches:
            for row in rows_of(b):
                if group and row[0] != group[0][0]:
                    yield from finish(before, group, None)
                    before, group = None, []
                elif group and row[4:6] != group[0][4:6]:
                    yield from finish(before, group, row)
                    before, group = group[-1], []
                group.append(row)
        if group:
            yield from finish(before, group, None)

    dealt = map_batches(whole, split, "part int, own boolean, page_id bigint, url string, host string, path string, lines binary")
    n = min(len(ranges.ends) + 1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)
    near = dealt.repartition(n, "part").sortWithinPartitions("part", "host", "path", F.coalesce("url", F.lit("")), "page_id", "own", "lines")
    return map_batches(near, differ, "page_id bigint, url string, text string, n_chars bigint")
