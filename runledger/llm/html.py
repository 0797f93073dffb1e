"""Main text of web pages, from container paths that the pages of a host agree on."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import columns, written
from runledger.scale import broadcast_if_small

#: Comments, declarations, elements whose content is no markup, and tags; all are matched where a "<" stands.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title|canvas|audio|video)\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I)
#: A tag that the rule above does not take, such as one with an odd quote, ends at the next ">".
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of a page that are never the article.
OUTSIDE = frozenset("nav header footer aside form head menu dialog button".split())
#: A new one of these ends an open one of the named kinds, unless a container stands between.
IMPLIED_END = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPE = frozenset("ul ol dl table div section article main body".split())
#: Words of class names and ids that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions "
    "banner sidebar sidebars rail nav navbar navigation menu menus breadcrumb breadcrumbs crumbs footer foot masthead topbar "
    "toolbar comment comments discussion disqus respond replies reply cookie cookies consent gdpr notice notices alert "
    "notification newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "popup modal overlay widget widgets pagination pager paywall outbrain taboola skip hidden".split())
#: What stands beside an article and may be longer than it.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors comment comments discussion disqus "
    "respond replies reply cookie cookies consent gdpr newsletter".split())
#: A name with one of these says something about the marked part, it is not that part.
QUALIFIERS = frozenset("no not non without with has have hide show open opened closed enabled disabled overflow".split())
#: Never removed for their names.
FRAMES = frozenset("html body main article".split())
#: Share of a page's text from which an element is kept, whatever its name.
MOST, MOST_BESIDE = 0.5, 0.9
LEVELS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements nested deeper than this count as siblings, as browsers take them.
DEPTH = 256


class Paths:
    """Generalised paths of a page as numbers; a path is its parent's number and a name, so that depth costs nothing."""

    def __init__(self):
        self.numbers: dict[tuple[int, str], int] = {}
        self.parents, self.names = [-1], [""]

    def below(self, parent: int, name: str) -> int:
        number = self.numbers.get((parent, name))
        if number is None:
            number = self.numbers[parent, name] = len(self.names)
            self.parents.append(parent)
            self.names.append(name)
        return number

    def up(self, number: int) -> list[int]:
        """The path and all around it, to the root."""
        found = []
        while number >= 0:
            found.append(number)
            number = self.parents[number]
        return found

    def text(self, number: int) -> str:
        return ">".join(self.names[n] for n in reversed(self.up(number)) if n)

    def find(self, path: str) -> int | None:
        number: int | None = 0
        for name in path.split(">") if path else ():
            number = self.numbers.get((number, name))
            if number is None:
                return None
        return number


class Node:
    __slots__ = ("tag", "path", "parent", "mark", "size", "article", "gone")

    def __init__(self, tag: str, path: int, parent: Node | None, mark: float = 0.0):
        self.tag, self.path, self.parent = tag, path, parent
        #: Share of the page's text up to which tag, role, style or names remove the element, and its text.
        self.mark, self.size = mark, 0
        self.article = self if tag in ("article", "main") else parent.article if parent else None
        #: Outermost element around the node that is removed.
        self.gone: Node | None = None


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(text)} if text else {}


def _unwanted(tag: str, attributes: dict[str, str]) -> float:
    """Share of the page's text up to which tag, role and style remove an element; 0 if they do not.

    Wrappers of a whole page are often forms, hidden until a script has run, or called a dialog, and headers may never be
    closed: an element that holds nearly all text is kept whatever it is.
    """
    share = (MOST if tag in ("form", "header", "dialog", "head") else MOST_BESIDE) if tag in OUTSIDE else 0.0
    if attributes:
        if attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in ("banner", "alert", "dialog"):
            share = max(share, MOST)
        if attributes.get("role", "").lower() in ("navigation", "contentinfo", "complementary", "search"):
            share = MOST_BESIDE
        if "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
            share = MOST_BESIDE
    return share


def _mark(tag: str, attributes: dict[str, str]) -> float:
    """Share of the page's text up to which the names remove an element; 0 if they do not."""
    if tag in FRAMES:
        return 0.0
    mark = 0.0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w.lower() for w in LEVELS.split(name) if w}
        if words & MARKS and not words & QUALIFIERS:
            mark = max(mark, MOST_BESIDE if words & BESIDE else MOST)
    return mark


def generalised(tag: str, attributes: dict[str, str]) -> str:
    """Tag and class names with runs of digits replaced, so that numbered siblings have one path."""
    names = sorted({re.sub(r"\d+", "N", c).replace(">", "") for c in attributes.get("class", "").split()})
    return ".".join([tag, *names])


def tokens_of(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, is it an end tag, attributes) of the markup in a page; the tag is None for what has no content.

    Every place is read a bounded number of times, whatever is not closed.
    """
    at, last = 0, page.rfind(">")
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if start > last and not page.startswith("<!--", start):
            return  # no tag ends any more: the rest is text
        m = TOKEN.match(page, start)
        if m:
            yield start, m.end(), m[3] and m[3].lower(), bool(m[2]), m[4] or ""
            at = m.end()
            continue
        m = LOOSE_TAG.match(page, start)
        if m:
            yield start, m.end(), m[2].lower(), bool(m[1]), m[3]
        at = m.end() if m else start + 1


Blocks = list[tuple[Node, str, int]]


def blocks_of(page: str) -> tuple[Blocks, Paths]:
    """Blocks in page order: the innermost open element, the text, and how much of it stands in links; and the paths.

    Elements outside the article have no blocks, unless they hold most of the text.  Unclosed and misplaced tags are
    taken as browsers take them: a block ends an open paragraph, an end tag without a start is ignored.
    """
    paths = Paths()
    root = Node("#", 0, None)
    nodes, stack, found, buffer = [root], [root], [], []
    linked, anchors = 0, 0

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                found.append((stack[-1], text, linked))
            buffer.clear()
        linked = 0

    def close(down_to: int):
        flush()
        del stack[down_to:]

    def open_(tag: str, name: str, mark: float):
        flush()
        if len(stack) > DEPTH:
            stack.pop()
        parent = stack[-1]
        stack.append(Node(tag, paths.below(parent.path, name), parent, mark))
        nodes.append(stack[-1])

    at = 0
    for start, end, tag, is_end, inside in tokens_of(page):
        if start > at:
            text = page[at:start]
            buffer.append(text)
            if anchors:
                linked += len(text.strip())
        at = end
        if tag is None:
            continue
        if tag == "br":
            buffer.append(" ")
        elif is_end:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag in BLOCKS or any(n.tag == tag for n in stack[-3:]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                else:
                    if tag in BLOCKS:
                        flush()
        elif tag == "a":
            anchors += 1
        elif tag in ("option", "optgroup"):
            buffer.append(" ")
        elif tag in BLOCKS or tag == "head" or tag == "button":
            flush()
            if stack[-1].tag == "p":
                close(len(stack) - 1)
            if tag == "body":  # an open head ends here
                for i in range(1, len(stack)):
                    if stack[i].tag == "head":
                        close(i)
                        break
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in IMPLIED_END.get(tag, ()):
                    close(i)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[i].tag in SCOPE:
                    break
            if tag not in VOID and not inside.endswith("/"):
                attributes = _attributes(inside)
                open_(tag, generalised(tag, attributes), max(_unwanted(tag, attributes), _mark(tag, attributes)))
        elif tag not in VOID and inside and not inside.endswith("/"):  # an inline element that may be an advert or hidden
            attributes = _attributes(inside)
            mark = max(_unwanted(tag, attributes), _mark(tag, attributes))
            if mark:
                open_(tag, tag, mark)
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return _without_removed(found, nodes), paths


def _without_removed(found: Blocks, nodes: list[Node]) -> Blocks:
    """The blocks outside elements that are removed, which are those that do not hold most of the page's text.

    A header inside an article keeps its headings.  Nodes are in page order, so a node's parent comes before it.
    """
    for node, text, _ in found:
        node.size += len(text)
    for node in reversed(nodes[1:]):
        node.parent.size += node.size
    total = nodes[0].size
    for node in nodes[1:]:
        node.gone = node.parent.gone or (node if node.mark and node.size <= node.mark * total else None)

    def kept(node: Node) -> bool:
        gone = node.gone
        return gone is None or (gone.tag == "header" and gone.article is not None and node.tag in HEADINGS)

    return [block for block in found if kept(block[0])]


def _holder(node: Node) -> Node:
    """The element to vote for: the nearest article or main around a node, else the node itself."""
    return node.article or node


#: Parts of a list or table, which are no container of an article by themselves.
INNER = frozenset("ul ol dl dir menu table tbody thead tfoot tr caption".split())
#: Share of its pages' article text that a container must cover, and share of text directly in an element that takes it in.
NEARLY_ALL, DIRECT, DIRECT_BODY = 0.9, 0.01, 0.05
#: Paths with less of a page's votes say nothing about what surrounds them there.
NOTABLE = 0.05


def votes(page: str | None) -> list[tuple[str, str, float, float, float, float]]:
    """The page's containers as generalised paths, each with what stands in it and around it.

    Rows are (path, ancestor, share, pages, cover, direct).  A block gives its length outside links to the element around
    it and half of that to the next; what stands in an article or main element counts for that element.  The row whose
    ancestor is the path itself has its share of the page's votes; for paths with a notable share there is a row for each
    ancestor up to the root, whose path is empty, with the shares of the page's unlinked text inside it and directly in
    it, a first heading counting as much as is needed.
    """
    blocks, paths = blocks_of(page or "")
    scores: dict[int, float] = {}
    cover: dict[int, float] = {}
    direct: dict[int, float] = {}
    text_size = 0
    for node, text, linked in blocks:
        weight = max(0, len(text) - 2 * linked)
        outer = node.parent if node.tag in ("p", "pre", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "td") else node
        text_size += weight
        cover[node.path] = cover.get(node.path, 0.0) + weight
        if weight:
            around = outer
            while around.tag in INNER and around.parent is not None:
                around = around.parent
            direct[around.path] = direct.get(around.path, 0.0) + (float("inf") if node.tag == "h1" else weight)
        for share in (1.0, 0.5):
            if outer is None or outer.parent is None:
                break
            holder = _holder(outer)
            scores[holder.path] = scores.get(holder.path, 0.0) + share * weight
            if holder is not outer:
                break
            outer = outer.parent
    total = sum(scores.values())
    if not total:
        return []
    for number in range(len(paths.names) - 1, 0, -1):  # a path's parent has a smaller number
        parent = paths.parents[number]
        cover[parent] = cover.get(parent, 0.0) + cover.get(number, 0.0)
    best = max(scores.values())
    rows = []
    for number, score in scores.items():
        notable = score == best or score >= NOTABLE * total
        path = paths.text(number)
        for ancestor in paths.up(number) if notable else [number]:
            rows.append((path, paths.text(ancestor), score / total if ancestor == number else 0.0, float(notable),
                         cover[ancestor] / text_size, min(1.0, direct.get(ancestor, 0.0) / text_size)))
    return sorted(rows, key=lambda r: (r[0], -len(r[1])))


def climbed(path: str, around: list[tuple[str, float, float, float]]) -> str:
    """The container to take for a winning path, from (ancestor, pages, cover, direct) summed over the pages that have it.

    It is the nearest element that is no part of a list or table and covers nearly all article text, or one further out
    that has a heading or paragraphs of the article directly in it.  An article or main element is taken as it is.
    """
    tag = path.rpartition(">")[2].partition(".")[0]
    if tag in ("article", "main") or not around:
        return path
    up = sorted(around, key=lambda x: -len(x[0]))  # an ancestor's path is a beginning of the path
    chosen = None
    for i, (ancestor, pages, cover, direct) in enumerate(up):
        tag = ancestor.rpartition(">")[2].partition(".")[0]
        if chosen is None and tag not in INNER and cover >= NEARLY_ALL * pages:
            chosen = i
        elif chosen is not None and direct >= (DIRECT_BODY if tag in ("body", "html", "") else DIRECT) * pages:
            chosen = i
    return "" if chosen is None else up[chosen][0]


def extract(page: str | None, path: str | None) -> tuple[str, str | None]:
    """Text of the elements on ``path``, or in the page's own best container if it has none there; and the path taken."""
    blocks, paths = blocks_of(page or "")
    if not blocks:
        return "", None
    inside = _within(blocks, paths, path) if path is not None else []
    if not inside:
        own = votes(page)
        path = max(((p, s) for p, a, s, *_ in own if a == p), key=lambda v: (v[1], v[0]))[0] if own else None
        if path is not None:
            path = climbed(path, [(a, *rest) for p, a, _, *rest in own if p == path])
        inside = _within(blocks, paths, path) if path is not None else [t for _, t, _ in blocks]
    return "\n\n".join(inside), path


def _within(blocks: Blocks, paths: Paths, path: str) -> list[str]:
    """Texts of the blocks inside elements on a path."""
    wanted = paths.find(path)
    if wanted is None:
        return []
    inside = [number == wanted for number in range(len(paths.names))]
    for number in range(1, len(paths.names)):
        inside[number] = inside[number] or inside[paths.parents[number]]
    return [text for node, text, _ in blocks if inside[node.path]]


_VOTE = ["host", "path", "ancestor", "share", "pages", "cover", "direct"]


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(host, *vote) for host, page in columns(batch, "host", "html") for vote in votes(page)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], _VOTE)


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [climbed(path, [(a["ancestor"], a["pages"], a["cover"], a["direct"]) for a in around])
                 for path, around in columns(batch, "path", "around")]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract(page, path) for page, path in columns(batch, "html", "path")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()),
             pa.array([p for _, p in found], pa.string())], ["page_id", "url", "text", "path"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, path (of the container taken).

    First pass: each page's containers are scored and their generalised tag-and-class paths voted on per host; votes are
    summed before they are shuffled.  From the winning path (ties: the first in order) the nearest ancestor is taken that
    covers nearly all unlinked article text of the host's pages with that path.  Second pass: each page is read again
    with its host's container.  The containers are broadcast if measured to be small, else joined by host.

    Null and empty html have an empty text; a null url is a host of its own.  Pages without the winning path use their
    own best.  Rows without a page_id, and rows that repeat one, are extracted each.  Empty tables are fine; further
    columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    summed = written(rows.select("host", "html").mapInArrow(
        _vote, "host string, path string, ancestor string, share double, pages double, cover double, direct double").groupBy(
        "host", "path", "ancestor").agg(*(F.round(F.sum(c), 6).alias(c) for c in ("share", "pages", "cover", "direct"))), "votes")
    best = summed.where("path = ancestor").groupBy("host").agg(F.min_by("path", F.struct(-F.col("share"), "path")).alias("path"))
    around = summed.join(broadcast_if_small(written(best, "best")), ["host", "path"]).groupBy("host", "path").agg(
        F.collect_list(F.when(F.col("pages") > 0, F.struct("ancestor", "pages", "cover", "direct"))).alias("around"))
    winners = written(around.select("host", "path", "around").mapInArrow(_climb, "host string, path string"), "paths")
    kinds = dict(pages.dtypes)
    return rows.join(broadcast_if_small(winners), "host", "left").select("page_id", "url", "html", "path").mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url string, text string, path string")
