"""Main text of web pages by differencing each page with its nearest neighbours by URL.

A page is cut into lines, one for each block of text, with character references
decoded and white space collapsed. Scripts, styles, comments, templates, fallback
contents of media and what is hidden are no lines. Every page is then compared
with the `neighbours` pages of the nearest paths on the same host: the lines of
both are aligned by their longest common subsequence, and a line that is shared
counts one vote against itself. What the votes mean depends on where the markup
puts the line, which decides alone only where no page can tell:

* a line outside of any mark is deleted if the nearest neighbour shares it, or
  two of the others do (menus may rotate from page to page);
* a line in an element that a partly matching class or id suspects (`content-
  sidebar-wrap`) is deleted if any neighbour shares it;
* a line in an article or main element is deleted only if all of at least four
  neighbours share it, none of them half the same article: passages that some
  articles of a host share are text;
* a line in a navigation, footer, aside, form, page header, an element with the
  role or exactly the class of furniture (comments, ads), or outside of the article
  of a page that marks one, is deleted whether shared or not.

A neighbour that shares nearly all its text is a copy of the page and tells
nothing about furniture, so the next nearest is taken then; but where both pages
have text of their own left over (a few words at least, and most of them other
words), what they share is furniture, however much of it there is. Pages next to
each other with the same lines count as one, and have the same text.

Pages are taken in the order of host, path, url and id, in blocks of neighbours
cut at sampled pages whatever their host, and a block also gets the pages next to
its ends. Where these are too few or all copies, the block is worked through again
with more of them, so a page's neighbours do not depend on the size of its host
or of the table. A task holds the compressed lines of one block.

Defined cases: a null or empty page, or one without text, has an empty text; a
page without a url, or alone on its host, is compared with nothing; pages that
tie in path are ordered by url and id; repeated pages count as one and each has a
row; a page of any length is worked through whole; an empty table gives no rows;
columns besides id, url and html are not looked at, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|select|video|audio|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msubsup msup mtext q rp rt ruby s samp semantics small span strike strong sub sup svg text time tspan tt u var wbr".split()
)
_OUT = frozenset("nav aside footer form button dialog menu fieldset map noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_EXACT = frozenset(
    "ad ads advert adverts advertisement sponsored promo banner cookie cookies cookie-notice consent notice alert nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments comment-list comment-respond respond disqus_thread"
    " share sharing social related recommended newsletter subscribe signup login search popup modal overlay widget pagination pager toolbar skip-link".split()
)
#: Of these, what has no place inside an article either.
_EXACT_INSIDE = frozenset("ad ads advert adverts advertisement sponsored comment comments comment-list comment-respond respond disqus_thread cookie-notice newsletter".split())
_PARTS = frozenset("ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice alert nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments share sharing social related newsletter subscribe widget pagination".split())
_HEADER = frozenset("header site-header page-header siteheader pageheader top-header global-header".split())
_NEVER_OUT = frozenset(("html", "body"))
_COPY = 0.8
_FEW_WORDS = 5
_ALL_OF = 4  # neighbours that it takes at least to delete a line of an article
_POINTS = 20  # intervals of a block
#: What the markup says of a line.
TEXT, PLAIN, SUSPECT, FURNITURE = "tpsf"
_HIDDEN = "-"


def _mark(name: str, attrs: str, around: str, in_form: bool) -> str:
    """The mark of an element's lines, given the mark around it."""
    if name in _NEVER_OUT:
        return around
    named: dict[str, str] = {}
    if attrs and _TELLING.search(attrs):
        for m in _ATTR.finditer(attrs):
            named.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in named.get("style", "").lower().replace(" ", ""):
        return _HIDDEN
    role = named.get("role", "").lower().strip()
    if name in ("article", "main") or role == "main":
        return TEXT if around in (TEXT, PLAIN, SUSPECT) or in_form else around
    if around in (FURNITURE, _HIDDEN):
        return around
    if name in _OUT or role in _ROLES or (name == "header" and around != TEXT):
        return FURNITURE
    tokens = {t for key in ("class", "id") if key in named for t in named[key].lower().split()}
    if tokens & (_EXACT_INSIDE if around == TEXT else _EXACT | _HEADER):
        return FURNITURE
    if around != TEXT and any(part in _PARTS for t in tokens for part in re.split(r"[-_:]+", t)):
        return SUSPECT
    return around


def page_lines(html: str) -> list[tuple[str, str]]:
    """Lines of a page and the mark of each. If the page marks an article, lines outside of it are furniture."""
    lines: list[tuple[str, str]] = []
    stack: list[tuple[str, str, bool]] = []  # name, mark, whether only a form makes it furniture
    mark, in_form = PLAIN, False
    pieces: list[str] = []

    def close_block() -> None:
        if pieces:
            if line := " ".join("".join(pieces).split()):
                lines.append((mark, line))
            pieces.clear()

    def enter(new: str, form: bool) -> None:
        nonlocal mark, in_form
        if new != mark and _HIDDEN not in (new, mark):
            close_block()
        mark, in_form = new, form

    def pop() -> None:
        stack.pop()
        enter(*(stack[-1][1:] if stack else (PLAIN, False)))

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at and mark != _HIDDEN:
            piece = html[at : m.start()]
            pieces.append(entities.unescape(piece) if "&" in piece else piece)
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if name not in _INLINE:
            close_block()
        elif name == "br":
            pieces.append(" ")
        if name in _VOID:
            continue
        if m["end"] or m["end2"]:
            if any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if attrs.endswith("/"):
            continue
        if name == "p" or name == "li":  # a paragraph or item ends where the next one starts
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] not in _INLINE:
                    break
        own = _HIDDEN if name == "head" else _mark(name, attrs, mark, in_form)
        if name in _INLINE and own != mark:  # part of a line: left out of it, or nothing special
            own = _HIDDEN if own in (FURNITURE, _HIDDEN) else mark
        enter(own, own == FURNITURE and (in_form if mark == FURNITURE else name == "form"))
        stack.append((name, mark, in_form))
    if at < len(html) and mark != _HIDDEN:
        pieces.append(entities.unescape(html[at:]))
    close_block()
    if any(m == TEXT for m, _ in lines):
        lines = [(m if m == TEXT else FURNITURE, line) for m, line in lines]
    return lines


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in a of a longest common subsequence of a and b (Hunt and Szymanski)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    places: dict[str, list[int]] = {}
    for j in range(len(b) - end - 1, start - 1, -1):  # later places first
        places.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in range(start, len(a) - end):
        for j in places.get(a[i], ()):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(start), *reversed(middle), *range(len(a) - end, len(a))]


def path_distance(a: str, b: str) -> tuple[int, int]:
    """Smaller for nearer paths: fewer segments in common first, then fewer characters."""
    x, y = a.split("/"), b.split("/")
    segments = next((i for i, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))
    chars = next((i for i, (s, t) in enumerate(zip(a, b)) if s != t), min(len(a), len(b)))
    return -segments, -chars


def _differ_in_text(own: list[str], others: list[str]) -> bool:
    """Whether the lines left over of two pages are texts of their own, not traces or edits of one text."""
    a, b = (Counter(" ".join(x).lower().split()) for x in (own, others))
    return min(a.total(), b.total()) >= _FEW_WORDS and 2 * (a & b).total() <= max(a.total(), b.total())


class Votes:
    """Lines of a page, and which of them its neighbours share. lines: (mark, line)."""

    def __init__(self, lines: list[tuple[str, str]]):
        self.marks, self.lines = [m for m, _ in lines], [x for _, x in lines]
        self.body = frozenset(i for i, m in enumerate(self.marks) if m != FURNITURE)
        self.size = sum(len(self.lines[i]) for i in self.body)
        self.votes, self.first = [0] * len(lines), frozenset()
        self.other_articles, self.article_votes = 0, [0] * len(lines)
        self.neighbours = 0

    def add(self, other: list[tuple[str, str]]) -> bool:
        """Count a neighbour, unless it is a copy."""
        shared = common_lines(self.lines, [x for _, x in other])
        same = sum(len(self.lines[i]) for i in shared if i in self.body)
        if same >= _COPY * self.size:
            gone = set(shared)
            left = Counter(x for m, x in other if m != FURNITURE) - Counter(self.lines[i] for i in shared)
            if not _differ_in_text([self.lines[i] for i in sorted(self.body - gone)], list(left.elements())):
                return False
        if not self.neighbours:
            self.first = frozenset(shared)
        self.neighbours += 1
        other_article = 2 * same < self.size
        self.other_articles += other_article
        for i in shared:
            self.votes[i] += 1
            self.article_votes[i] += other_article
        return True

    def is_text(self, i: int) -> bool:
        mark, votes = self.marks[i], self.votes[i]
        if mark == TEXT:
            return self.other_articles < _ALL_OF or self.article_votes[i] < self.other_articles
        if mark == SUSPECT:
            return not votes
        return mark == PLAIN and i not in self.first and votes < 2

    def result(self) -> tuple[str, int, int]:
        """The text, and the numbers of lines deleted that neighbours share, and that only the markup tells."""
        text = [self.is_text(i) for i in range(len(self.lines))]
        gone = [v for v, t in zip(self.votes, text) if not t]
        return "\n\n".join(x for x, t in zip(self.lines, text) if t), sum(v > 0 for v in gone), sum(v == 0 for v in gone)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over page, url, host, path, html, homes: a row for each block that needs the page, its own first."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        out = []
        for page, url, host, path, html, homes in zip(*(batch.column(i) if i == 4 else batch.column(i).to_pylist() for i in range(6))):
            lines = page_lines(html.as_py() or "")
            packed = pack.compress("\n".join(m + x for m, x in lines).encode("utf-8", "surrogatepass"))
            out += [(block, i == 0, page, url, host, path, packed) for i, block in enumerate(homes)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_PARSED.values())], list(_PARSED))


_PARSED = {"block": pa.int64(), "own": pa.bool_(), "page": pa.int64(), "url": pa.string(), "host": pa.string(), "path": pa.string(), "lines": pa.binary()}
_PARSED_DDL = "block long, own boolean, page long, url string, host string, path string, lines binary"
_FOUND = {"block": pa.int64(), "page": pa.int64(), "url": pa.string(), "text": pa.string(), "n_shared": pa.int64(), "n_marked": pa.int64()}
_FOUND_DDL = "block long, page long, url string, text string, n_shared long, n_marked long"


@lru_cache(64)
def _lines(data: bytes) -> list[tuple[str, str]]:
    text = zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")
    return [(x[0], x[1:]) for x in text.split("\n")] if text else []


def _block_texts(rows: list[dict], first: bool, last: bool, neighbours: int) -> Iterator[tuple[dict, tuple[str | None, int, int]]]:
    """Results of the own pages of a block, None where the pages at hand do not tell. first, last: no page comes before or after them."""

    def side(i: int, step: int, host: str):
        """The pages from place i on; None at the end if more may follow."""
        while 0 <= i < len(rows):
            if rows[i]["host"] != host:
                return
            yield rows[i]
            i += step
        if not (first if i < 0 else last):
            yield None

    def same(i: int, j: int) -> bool:
        return rows[i]["host"] is not None and rows[i]["host"] == rows[j]["host"] and rows[i]["lines"] == rows[j]["lines"]

    def result(i: int) -> tuple[str | None, int, int]:
        row = rows[i]
        votes = Votes(_lines(row["lines"]))
        if row["host"] is None or not votes.size:
            return votes.result()
        start = end = i  # pages with the same lines count as one
        while start and same(start - 1, i):
            start -= 1
        while end + 1 < len(rows) and same(end + 1, i):
            end += 1
        sides = side(start - 1, -1, row["host"]), side(end + 1, 1, row["host"])
        ends = (rows[start]["path"], rows[end]["path"])
        missing = object()
        heads = [next(x, missing) for x in sides]
        while votes.neighbours < neighbours:
            if None in heads:
                return None, 0, 0
            near = [k for k in (0, 1) if heads[k] is not missing]
            if not near:
                break
            k = min(near, key=lambda k: path_distance(ends[k], heads[k]["path"]))
            votes.add(_lines(heads[k]["lines"]))
            heads[k] = next(sides[k], missing)
        return votes.result()

    before = None
    for i, row in enumerate(rows):
        if row["own"]:
            if before is None or before != i - 1 or not same(i - 1, i):
                found = result(i)
            before = i
            yield row, found


def _differ(blocks: int, per: int, halo: int, neighbours: int):
    """Over rows sorted by block and page: rows _FOUND (text null if more neighbours are needed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish() -> pa.RecordBatch:
            block = rows[0]["block"]
            out = [(block, r["page"], r["url"], *x) for r, x in _block_texts(rows, block * per - halo <= 0, (block + 1) * per + halo >= blocks * per, neighbours)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_FOUND.values())], list(_FOUND))

        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["block"] != rows[0]["block"]:
                    yield finish()
                    rows = []
                rows.append(row)
        if rows:
            yield finish()

    return run


def _homes(points: list[tuple], per: int, halo: int, targets: frozenset[int] | None):
    """Adds to page, url, host, path, html the blocks that need the page: its own, then those of which it is at most `halo` intervals of points away."""
    blocks = len(points) // per + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = []
            for page, url, host, path in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if host is None:
                    homes.append([-1 - (page or 0) % 1000] if targets is None else [])
                    continue
                at = bisect_right(points, _key(host, path, url, page))
                own = at // per
                near = range(max(0, (at - halo) // per), min(blocks - 1, (at + halo) // per) + 1)
                # A block that is not the page's own is told apart by its place: the own one comes first.
                homes.append([own, *(b for b in near if b != own)])
            part = pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes, pa.list_(pa.int64()))], [*batch.schema.names, "homes"])
            yield part.filter(pa.array([bool(h) and (targets is None or not targets.isdisjoint(h)) for h in homes], pa.bool_()))

    return run, blocks


def _key(host: str, path: str, url: str, page: int | None) -> tuple:
    return host, path, url, page is not None, page or 0


def extract_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", neighbours: int = 8, block: int = 2000) -> DataFrame:
    """page_id, url, text, n_shared and n_marked (lines deleted that a neighbour shares, and that only markup tells) of every page.

    block: pages that are worked through together, more if there are over 10,000 times as many; no result depends on it.
    """
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    keys = own.where("host is not null").select("host", "path", "url", "page")
    n = keys.count()
    limit = max(block, math.ceil(n / 10_000))
    per = min(_POINTS, limit)
    sampled = keys if n <= limit else keys.where(F.pmod(F.xxhash64("url", "page"), F.lit(max(1, limit // per))) == 0)
    points = sorted({_key(r.host, r.path, r.url, r.page) for r in sampled.toLocalIterator()}) if n > limit else []
    done, targets, halo = [], None, 1
    while True:
        place, blocks = _homes(points, per, halo, targets)
        parsed = own.mapInArrow(lambda batches, place=place: _parse(place(batches)), _PARSED_DDL)
        if targets is not None:
            parsed = parsed.where(F.col("block").isin(sorted(targets)))
        sorted_ = parsed.repartition("block").sortWithinPartitions("block", "host", "path", "url", "page")
        out = materialise(sorted_.mapInArrow(_differ(blocks, per, halo, neighbours), _FOUND_DDL), "htmltext")
        open_ = frozenset(r.block for r in out.where("text is null").select("block").distinct().toLocalIterator())
        done.append(out.where(~F.col("block").isin(sorted(open_))) if open_ else out)
        if not open_:
            break
        targets, halo = open_, 8 * halo  # a run of copies reaches beyond the pages at hand
    found = done[0]
    for x in done[1:]:
        found = found.union(x)
    return found.select(F.col("page").cast(pages.schema[page_id].dataType).alias(page_id), F.col("url").alias(url), "text", "n_shared", "n_marked")
