"""The main text of web pages: landmarks in the markup, and differencing against the page with the nearest URL.

A page is read as lines, one a block. Landmarks settle most lines: an article or main element holds the text; navigation, site
headers, footers, asides, forms, adverts, notices and comments, by tag, role or the words of class and id, do not. On a page
without an article what is left is unsettled: there, lines that the nearest page of the host has too are furniture.

Nearest: the pages of a host that differ in their lines are sorted by URL path; of its two neighbours a page is compared with the
one whose path begins alike for longer. The lines of the two are aligned by a longest common subsequence, and lines in it are
shared. Only hashes of lines travel for that; whole lines only for unsettled pages.
"""

import html as html_module
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import arrow_schema, number, rows, scan, ship
from emberline.operators.lineage import settle

ship(__name__)

# Elements, roles, and words of class names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
FURNITURE = frozenset("nav footer aside form button select dialog menu search head svg canvas audio video object math datalist".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb"
    " breadcrumbs footer cookie cookies consent notice notices notification popup modal overlay newsletter subscribe subscription share"
    " sharing social related recommended comment comments disqus respond login signup signin pager pagination toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond reply".split())
#: Elements that end an open element of the second list when they begin.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "body": ("head",),
}
#: An implied end does not reach beyond these.
WALLS = frozenset("table ul ol dl menu select body html".split())

TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: What begins like markup and does not end like it.
BROKEN = re.compile(r"<!--.*|</?[a-zA-Z!?][^<>]*>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}

OPEN, MAIN, AWAY = 0, 1, 2


def _zone(tag: str, attributes: str, outer: int) -> int:
    """Whether an element's text is the article's (MAIN), furniture (AWAY) or unsettled (OPEN)."""
    if outer == AWAY or tag in FURNITURE or (tag == "header" and outer != MAIN):
        return AWAY
    if not attributes:
        return MAIN if tag in ("article", "main") else outer
    named: dict[str, str] = {}
    if "=" in attributes:
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    role = named.get("role", "").lower()
    if role in FURNITURE_ROLES and not (role == "banner" and outer == MAIN):
        return AWAY
    if tag not in ("html", "body", "main"):
        words = {w.lower() for w in WORD.findall(f"{named.get('class', '')} {named.get('id', '')}")}
        if words & (COMMENT_WORDS if tag == "article" else FURNITURE_WORDS):
            return AWAY
    if tag in ("article", "main") or role == "main" or named.get("itemprop", "").lower() == "articlebody":
        return MAIN
    return outer


def lines(page: str, probe: bool = False) -> tuple[list[tuple[int, str]], bool]:
    """``(zone, text)`` of every block with text, in page order, and whether the page has an article or main element.

    A ``probe`` stops at that element.
    """
    out: list[tuple[int, str]] = []
    pieces: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, at, article = OPEN, 0, False

    def flush() -> None:
        if not pieces:
            return
        for z in (MAIN, OPEN, AWAY) if len({z for z, _ in pieces}) > 1 else {z for z, _ in pieces}:
            text = "".join(p for y, p in pieces if y == z)
            text = " ".join((html_module.unescape(text) if "&" in text else text).split())
            if text:
                out.append((z, text))
        pieces.clear()

    def pop(depth: int) -> None:
        nonlocal zone
        del stack[depth:]
        zone = stack[-1][1] if stack else OPEN

    end = page.rfind(">") + 1
    while at < len(page):
        m = TAG.search(page, at, end) if at < end else None
        text = page[at : m.start() if m else len(page)]
        if text:
            pieces.append((zone, BROKEN.sub("", text) if "<" in text else text))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                pieces.append((zone, m[0][9:-3].replace("&", "&amp;")))
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            pieces.append((zone, " "))
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop(depth)
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            close = RAW_END[tag].search(page, at)
            at = close.end() if close else len(page)
            continue
        closed = ("p", *ENDS.get(tag, ())) if tag in BLOCKS else ENDS.get(tag, ())
        for depth in range(len(stack) - 1, -1, -1) if closed else ():
            if stack[depth][0] in closed:
                pop(depth)
            elif stack[depth][0] in WALLS or (stack[depth][0] in BLOCKS and tag not in ENDS):
                break
        if not m[3].endswith("/") or tag in BLOCKS:
            zone = _zone(tag, m[3], zone)
            article = article or zone == MAIN
            if article and probe:
                return [], True
            stack.append((tag, zone))
    flush()
    return out, article


# ---- alignment ------------------------------------------------------------------------------------------

#: Bits of alignment rows that are kept to walk back; beyond, the texts are halved.
ROW_BITS = 1 << 28


def _rows(x: list, y: list) -> Iterator[int]:
    """Bit rows of the longest common subsequence: bit j is 0 where it grows with ``y[j]``."""
    where: dict = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    yield row
    for v in x:
        both = row & where.get(v, 0)
        row = ((row + both) | (row - both)) & full
        yield row


def _grown(x: list, y: list) -> np.ndarray:
    """Length of the common subsequence of ``x`` with the first 0, 1, 2, ... of ``y``."""
    for row in _rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(y) // 8), "little"), np.uint8), count=len(y), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common(x: list, y: list) -> list[tuple[int, int]]:
    """Places ``(i, j)`` of a longest common subsequence of two lists."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)] + [(len(x) - t, len(y) - t) for t in range(1, tail + 1)]
    both = set(x[head : len(x) - tail]) & set(y[head : len(y) - tail])
    at_x = [i for i in range(head, len(x) - tail) if x[i] in both]
    at_y = [j for j in range(head, len(y) - tail) if y[j] in both]
    out += [(at_x[i], at_y[j]) for i, j in _aligned([x[i] for i in at_x], [y[j] for j in at_y])]
    return sorted(out)


def _aligned(x: list, y: list) -> list[tuple[int, int]]:
    if not x or not y:
        return []
    if len(x) * len(y) > ROW_BITS and len(x) > 1:
        half = len(x) // 2
        split = int(np.argmax(_grown(x[:half], y) + _grown(x[half:][::-1], y[::-1])[::-1]))
        return _aligned(x[:half], y[:split]) + [(i + half, j + split) for i, j in _aligned(x[half:], y[split:])]
    kept = list(_rows(x, y))
    out, i, j = [], len(x), len(y)
    while i and j:
        if kept[i] >> (j - 1) & 1:
            j -= 1
        elif kept[i - 1] >> (j - 1) & 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            i -= 1
    return out


# ---- on tables ------------------------------------------------------------------------------------------

HASHED = "host long, path string, lines array<long>"
SHARED = "host long, lines array<long>, near int, shared array<int>"
DRAFT = "row struct<page_id:long,url:string>, settled boolean, host long, hashes array<long>, lines array<string>, places array<int>"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _hashed(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hosts, paths, pages in rows(batches, "host", "path", "_html"):
            found = [[_hash(t) for _, t in lines(p or "")[0]] for p in pages]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((hosts, paths, found), schema)], schema=schema)

    return run


def _shared(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hosts, pairs in rows(batches, "host", "pages"):
            out: list[tuple] = []
            for host, (one, other) in zip(hosts, pairs):
                near = 0
                for a, b in zip(one["path"], other["path"]):
                    if a != b:
                        break
                    near += 1
                met = common(one["lines"], other["lines"])
                out += [(host, one["lines"], near, [i for i, _ in met]), (host, other["lines"], near, sorted(j for _, j in met))]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return run


def _drafted(schema: pa.Schema, settled_only: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, hosts, pages in rows(batches, "page_id", "url", "host", "_html", size=256):
            out = []
            for page_id, url, host, page in zip(ids, urls, hosts, pages):
                found, article = lines(page or "", probe=not settled_only)
                settled = article or not any(z == OPEN for z, _ in found)
                if settled != settled_only:
                    continue
                zone = MAIN if article else OPEN
                kept = [(t, i) for i, (z, t) in enumerate(found) if z == zone]
                hashes = None if settled else [_hash(t) for _, t in found]
                out.append(({"page_id": page_id, "url": url}, settled, host, hashes, [t for t, _ in kept], [i for _, i in kept]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return run


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """Without scheme, host, query, fragment, a closing slash and the ending of a page's name."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*|[?#].*$", "")
    return F.regexp_replace(rest, r"(?i)(?:/index)?\.(?:html?|php|aspx?)$|/+$", "")


def shared_lines(pages: DataFrame) -> DataFrame:
    """``host, lines, shared``: places of the lines that a page has in common with the nearest page of its host.

    ``pages``: ``host`` (long), ``path``, ``_html``. Pages of a host with the same lines are one; none is its own neighbour.
    """
    hashed = scan(pages.select("host", "path", "_html"), _hashed(arrow_schema(HASHED)), HASHED)
    distinct = hashed.groupBy("host", "lines").agg(F.min("path").alias("path")).withColumn("key", F.xxhash64("lines"))
    placed = number(distinct, "host", ["path", "key"])
    # Page e meets page e + 1, so every page is in two pairs at most.
    pairs = (
        placed.select("host", F.struct("place", "path", "lines").alias("page"), F.explode(F.array(F.col("place") - 1, "place")).alias("_pair"))
        .groupBy("host", "_pair")
        .agg(F.array_sort(F.collect_list("page")).alias("pages"))
        .where(F.size("pages") == 2)
    )
    met = scan(pairs.select("host", "pages"), _shared(arrow_schema(SHARED)), SHARED)
    return met.groupBy("host", "lines").agg(F.max_by("shared", F.struct("near", F.size("shared"), "shared")).alias("shared"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text`` of every row: its article's blocks, one a line.

    A page with an article or main element gives that element's lines without the furniture inside. Any other page gives its
    unsettled lines less those it shares with the nearest page of its host; alone on its host, all of them. White space (any that
    Unicode names) inside a block is one space, character references are decoded, a line break inside a block is white space.
    A NULL or empty page, or one of furniture only, gives an empty text; a NULL URL is a host of its own. Rows stay rows,
    repeated or not, and equal pages get equal texts. Other columns, whatever their names, are not read. A page that is cut off
    is read as far as it goes. Nothing depends on how rows are dealt to tasks.
    """
    named = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.xxhash64(url_host(F.col(f"`{url}`"))).alias("host"),
        url_path(F.col(f"`{url}`")).alias("path"),
        F.col(f"`{html}`").cast("string").alias("_html"),
    )
    schema = arrow_schema(DRAFT)
    drafts = [scan(named.drop("path"), _drafted(schema, settled), DRAFT) for settled in (True, False)]
    shared = settle(shared_lines(named), "shared-lines")
    whole = drafts[0].select("row.*", F.array_join("lines", "\n").alias("text"))
    met = drafts[1].join(shared.select("host", F.col("lines").alias("hashes"), "shared"), ["host", "hashes"], "left")
    place = lambda p: ~F.array_contains(F.coalesce("shared", F.array().cast("array<int>")), p["places"])
    own = F.transform(F.filter(F.arrays_zip("lines", "places"), place), lambda p: p["lines"])
    return whole.unionByName(met.select("row.*", F.array_join(own, "\n").alias("text")))
