"""Main text of web pages: what a page shares with its nearest neighbour by URL is boilerplate.

Pages of a host lie in the order of their paths; each is compared with the
adjacent page whose path starts most alike.  The longest common subsequence of
their lines is taken away, subject to what the markup says for certain: lines
of an article stay though a neighbour has them too, lines of menus, notices and
the like go though no neighbour has them.  Pages of a host with the same lines
are one page, whatever their addresses, and a near copy is no neighbour: what
copies share is their text, not boilerplate.
"""

from __future__ import annotations

import bisect
import hashlib
import html as references
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plotline.llm.arrow import slices
from plotline.llm.runs import piece_number, sorted_pieces
from plotline.session import settle

# HTML's elements by what they mean for a page's text.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "button", "title", "canvas", "audio", "video"}
CONTENT = {"article", "main"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that hold the page or its text: hints on them do not count.
HOLDERS = {"html", "body"} | CONTENT
#: Raw elements in which nothing is markup; the others, left open, end at the next of these blocks.
OPAQUE = {"script", "style", "textarea", "title"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
#: Words of a class, id or role, alone or as its last part, that mark an element as not part of the text.
HINTS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "contentinfo", "cookie", "cookies",
    "disclaimer", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related",
    "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
OPEN, INSIDE, OUTSIDE = "open", "inside", "outside"
#: Share of all lines of two pages, from which on they are near copies; parts into which equal pages are dealt.
COPY, PARTS = 0.8, 32

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""", re.S)
_HINT = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)


def _hinted(attributes: str) -> bool:
    tokens = (token for m in _HINT.finditer(attributes) for value in m.groups() if value for token in value.split())
    return any(part.lower() in HINTS for token in tokens for part in _PART.findall(token)[-1:])


def _closed(page: str, name: str) -> dict[int, int]:
    """Where each closed element of this name starts, and where its end tag stops."""
    found, starts = {}, []
    for tag in re.finditer(rf"<(/?){name}(?=[\s/>])[^>]*>", page, re.I):
        if not tag[1]:
            if not tag[0].endswith("/>"):
                starts.append(tag.start())
        elif starts:
            found[starts.pop()] = tag.end()
    return found


def lines(page: str) -> list[tuple[str, str]]:
    """The page's blocks of text in order, each inside or outside the main text, or open."""
    found, held = [], []
    # Open block elements: name, and the state its end restores.
    stack: list[tuple[str, str]] = []
    state, at = OPEN, 0
    closed: dict[str, dict[int, int]] = {}

    def close() -> None:
        text = " ".join(references.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            found.append((text, state))

    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            held.append(page[at:])
            break
        held.append(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        name = token[2].lower()
        if name in INLINE and not (not token[1] and token[3] and _hinted(token[3])):
            if not (token[1] and any(n == name for n, _ in stack)):
                continue
        if token[1]:
            close()
            if any(n == name for n, _ in stack):
                while True:
                    last, state = stack.pop()
                    if last == name:
                        break
            continue
        close()
        if name in RAW:
            if name in OPAQUE:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif not token[3].endswith("/"):
                if name not in closed:
                    closed[name] = _closed(page, name)
                end = _BLOCK.search(page, at)
                at = closed[name].get(token.start()) or (end.start() if end else len(page))
            continue
        if stack and (stack[-1][0] == "p" and name not in INLINE and name != "br" or name == "li" == stack[-1][0]):
            state = stack.pop()[1]
        if name in VOID:
            continue
        stack.append((name, state))
        if state != OUTSIDE:
            if name in BOILERPLATE or token[3] and name not in HOLDERS and _hinted(token[3]):
                state = OUTSIDE
            elif name in CONTENT:
                state = INSIDE
    close()
    return found


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence (Hunt and Szymanski's method)."""
    start, stop_a, stop_b = 0, len(a), len(b)
    while start < min(stop_a, stop_b) and a[start] == b[start]:
        start += 1
    while min(stop_a, stop_b) > start and a[stop_a - 1] == b[stop_b - 1]:
        stop_a, stop_b = stop_a - 1, stop_b - 1
    where: dict[int, list[int]] = {}
    for j in range(stop_b - 1, start - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in range(start, stop_a):
        for j in where.get(a[i], ()):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(start), *middle[::-1], *range(stop_a, len(a))]


def place(url: str | None) -> tuple[str | None, str]:
    """Host and path of an address; no host for none or a broken one."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or None), parts.path
    except ValueError:
        return None, ""


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def near_copies(a: list[int], b: list[int], shared: int) -> bool:
    return shared >= COPY * (len(a) + len(b) - shared)


def _shared(pages: DataFrame) -> DataFrame:
    """row, shared: which lines of each page with a host its nearest neighbour has too (pages: row, url, html)."""

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            rows = [(*place(u), np.array([line_hash(t) for t, _ in lines(h or "")], np.int64)) for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            hosts, paths, hashes = zip(*rows, strict=True)
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in hashes]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(digests, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["row", "host", "path", "digest", "lines"],
            )

    # Written down, so that each page is parsed once here.
    outlines = settle(pages.mapInArrow(outlined, "row long, host string, path string, digest binary, lines array<long>"))
    dealt = outlines.where("host is not null").withColumn("part", F.pmod("row", F.lit(PARTS)))
    # A group of equal pages of any size is first reduced part by part.
    parts = dealt.groupBy("host", "digest", "part").agg(F.min(F.struct("path", "row")).alias("first"))
    firsts = settle(parts.groupBy("host", "digest").agg(F.min("first").alias("first")).select("host", "digest", "first.row"))
    pieces = sorted_pieces(dealt.join(firsts.select("row"), "row", "left_semi").select("row", "host", "path", "lines"), "host", "path", "row")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first, last = first or batch.slice(0, 1), batch.slice(batch.num_rows - 1)
        for at, batch in ((0, first), (1, last)):
            if batch:
                yield pa.RecordBatch.from_arrays([pa.array([piece_number()]), pa.array([at]), *batch.columns], names=["piece", "at", "row", "host", "path", "lines"])

    # The first and the last page of each piece.
    ends = sorted(map(tuple, pieces.mapInArrow(edges, "piece long, at long, row long, host string, path string, lines array<long>").collect()))
    before = {ends[i + 1][0]: ends[i][2:] for i in range(1, len(ends) - 1, 2)}
    after = {ends[i][0]: ends[i + 1][2:] for i in range(1, len(ends) - 1, 2)}
    beyond = pages.sparkSession.sparkContext.broadcast((before, after))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, (before, after) = piece_number(), beyond.value

        def told(page, *beside):
            # Of two equally near, the page before.
            near = sorted((other for other in beside if other and other[1] == page[1]), key=lambda other: -_alike(page[2], other[2]))
            aligned = ((common(page[3], other[3]), other[3]) for other in near)
            return page[0], next((same for same, other in aligned if not near_copies(page[3], other, len(same))), [])

        def batch(rows):
            ids, shared = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shared, pa.list_(pa.int32()))], names=["row", "shared"])

        page, made = before.get(piece), []
        stream = (tuple(c.values()) for b in batches for c in b.to_pylist())
        current = next(stream, None)
        while current is not None:
            following = next(stream, None)
            made.append(told(current, page, following if following is not None else after.get(piece)))
            page, current = current, following
            if len(made) == 1000:
                yield batch(made)
                made = []
        if made:
            yield batch(made)

    # Equal pages share the same lines; they get them part by part too.
    shared = pieces.mapInArrow(compared, "row long, shared array<int>").join(firsts, "row").drop("row")
    of_parts = parts.select("host", "digest", "part").join(shared, ["host", "digest"])
    return dealt.select("host", "digest", "part", "row").join(of_parts, ["host", "digest", "part"]).select("row", "shared")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, text, n_lines, n_shared, n_restored for every row of ``pages``.

    The text is the main text's blocks joined by blanks, from the whole page;
    null and empty pages, and pages without main text, give "".  Where a page
    has an article or main element, its blocks are the main text; elsewhere
    the blocks that no neighbour shares.  Menus, forms, adverts, comments and
    the like never are.  ``n_shared`` counts the lines the neighbour has too,
    ``n_restored`` those of them that the markup proves to be text.  Pages
    without a host, and those beside near copies only, have no neighbour;
    repeated rows and pages that were read twice are one page, and each gets its
    text; other columns are ignored.
    """
    base = pages.select(F.monotonically_increasing_id().alias("row"), F.col(url).alias("url"), F.col(html).alias("html"), F.col(key).alias("id"))
    shared = _shared(base.select("row", "url", "html"))
    kinds = {c: to_arrow_type(base.schema[c].dataType) for c in ("id", "url")}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            out = []
            for page in part.column(2).to_pylist():
                found = lines(page or "")
                certain = any(state == INSIDE for _, state in found)
                wanted = INSIDE if certain else OPEN
                # Each block at its line's place, so that what is left of the places leads to the blocks.
                out.append((len(found), certain, [n for n, (_, state) in enumerate(found) if state == wanted], [t if state == wanted else None for t, state in found]))
            types = [pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string())]
            made = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(kinds["id"]), part.column(1).cast(kinds["url"]), part.column(3), *made], names=["id", "url", "row", "n_lines", "certain", "at", "blocks"])

    id_kind = base.schema["id"].dataType.simpleString()
    # The blocks that may stay meet what is shared, not the pages with their markup.
    found = base.select("id", "url", "html", "row").mapInArrow(blocks, f"id {id_kind}, url string, row long, n_lines long, certain boolean, at array<int>, blocks array<string>")
    alike = F.coalesce("shared", F.array().cast("array<int>"))
    both = F.size(F.array_intersect("at", alike)).cast("long")
    own = F.transform(F.array_except("at", alike), lambda n: F.get("blocks", n))
    return found.join(shared, "row", "left").select(
        "id", "url", F.array_join(F.when(F.col("certain"), F.col("blocks")).otherwise(own), " ").alias("text"),
        "n_lines", F.size(alike).cast("long").alias("n_shared"), F.when(F.col("certain"), both).otherwise(F.lit(0).cast("long")).alias("n_restored"),
    )
