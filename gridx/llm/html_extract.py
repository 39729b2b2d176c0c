"""Main text of a web page by tree scoring.

One pass over the markup, in time proportional to its length, keeps a stack of open block elements. Text between
block boundaries is a block. Elements that are never article text (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments), named by tag, role, or a word of their class or id, have no points
and are left out with all they hold. A block of some length passes points to its ancestors, one for itself, one a
comma and up to three for length, times the share of its text outside links; a parent gets all of them, each further
ancestor half as many as the one below. The container of most points is taken; an article or main element around it
takes its place only if it has a fifth of its points. Siblings that score well or hold paragraphs of mostly unlinked
text come along. Where no block has points, the marked article, else the element with most unlinked text, is taken.

Defined results: a null or empty page, or one without blocks, has an empty text; pages of any length are read whole;
unclosed elements end with their parent, unclosed tags at the next >; elements nested deeper than DEPTH become
siblings; repeated rows and null ids are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
CLOSING = {q: re.compile(f"[<{q}]") for q in "\"'"}
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed xmp".split())
SKIP = frozenset("script style noscript template nav footer aside form button select textarea input iframe object embed canvas svg audio video dialog menu head title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr caption ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAF = HEADINGS | frozenset("p pre li dt dd td th blockquote figcaption caption summary legend address".split())
CLOSED_BY = {
    "p": BLOCK - {"option"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
}
BARRIER = frozenset("table ul ol dl article section div main body".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner "
    "sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs footer footnav masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe signup login "
    "comment comments commentlist respond disqus replies reply share sharing social related recommended pagination pager skip widget".split()
)
MARKED = ("article", "main")
#: Open elements at most, as in browsers; an element opened deeper closes the deepest.
DEPTH = 512
#: Share of the best score from which a sibling, or the article around the best container, is taken.
SIBLING = 0.2


class _Node:
    __slots__ = ("tag", "parent", "score", "last", "skip")

    def __init__(self, tag: str, parent: int, skip: bool) -> None:
        self.tag, self.parent, self.skip = tag, parent, skip
        self.score, self.last = 0.0, -1


def _unwanted(tag: str, attrs: str) -> bool:
    if tag in SKIP:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attrs):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if not NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)):
                return True
        elif name == "role":
            if value.strip() in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


def _comment_article(attrs: str) -> bool:
    return any(m[1].lower() in ("class", "id") and not {"comment", "comments", "reply"}.isdisjoint(re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())) for m in ATTRIBUTE.finditer(attrs))


def tokens_of(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind is text, raw, open or close; raw text holds no character references.

    Every place of the page is looked at a bounded number of times. A quoted value after = may hold >, but no <; if a
    tag has no end outside such values, it and all later tags end at the next >. A < that starts no tag is text, and
    so is everything after the last >.
    """
    at, end, quoted, shut = 0, len(page), True, -1
    while at < end:
        low = page.find("<", at)
        if shut < low:
            shut = page.find(">", low)
        if low < 0 or shut < 0:
            yield "text", page[at:] if low < 0 or not page.startswith("<!--", low) else page[at:low], ""
            return
        follow = page[low + 1 : low + 3]
        closing = follow[:1] == "/"
        name = NAME.match(page, low + 1 + closing)
        if name is None and follow[:1] not in ("!", "?"):
            yield "text", page[at : low + 1], ""
            at = low + 1
            continue
        if low > at:
            yield "text", page[at:low], ""
        if name is None:
            if page.startswith("<!--", low):
                stop = page.find("-->", low + 2)
                at = stop + 3 if stop >= 0 else end
            elif page.startswith("<![CDATA[", low):
                stop = page.find("]]>", low)
                yield "raw", page[low + 9 : stop if stop >= 0 else end], ""
                at = stop + 3 if stop >= 0 else end
            else:
                at = shut + 1
            continue
        stop = -1
        if quoted:
            stop = name.end()
            while (mark := STOP.search(page, stop)) is not None and mark[0] != ">":
                stop = mark.end()
                if page[max(name.end(), mark.start() - 16) : mark.start()].rstrip()[-1:] == "=":
                    other = CLOSING[mark[0]].search(page, stop)
                    if other is not None and other[0] == mark[0]:
                        stop = other.end()
            stop = mark.start() if mark is not None else -1
        if stop < 0:
            quoted, stop = False, page.find(">", name.end())
        at = stop + 1
        yield "close" if closing else "open", name[0].lower(), page[name.end() : stop]
        tag = name[0].lower()
        if not closing and tag in RAW:
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = found.end() if found else end


def _parse(page: str) -> tuple[list[_Node], list[tuple[int, str, int]]]:
    """(nodes in page order, blocks: node, text, characters inside links)."""
    nodes = [_Node("html", -1, False)]
    stack = [0]
    blocks: list[tuple[int, str, int]] = []
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((stack[-1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        flush()
        for n in stack[depth:]:
            nodes[n].last = len(nodes) - 1
        del stack[depth:]

    for kind, tag, attrs in tokens_of(page):
        if kind in ("text", "raw"):
            if tag and not nodes[stack[-1]].skip:
                text = html.unescape(tag) if kind == "text" and "&" in tag else tag
                parts.append(text)
                if in_link:
                    linked += len(text.strip())
            continue
        if kind == "close":
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCK or tag in SKIP:
                for depth in range(len(stack) - 1, 0, -1):
                    open_tag = nodes[stack[depth]].tag
                    if open_tag == tag:
                        close(depth)
                        in_link = 0
                        break
                    if tag in LEAF and open_tag in BARRIER:
                        flush()
                        break
                else:
                    flush()
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link += 1
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            continue
        skip = _unwanted(tag, attrs) or (tag == "article" and _comment_article(attrs))
        if tag == "header":
            skip = not any(nodes[n].tag in ("article", "main") for n in stack) or skip
        if tag not in BLOCK and not skip:
            continue
        flush()
        if tag in BLOCK:
            depth = len(stack) - 1
            while depth > 0 and tag in CLOSED_BY.get(nodes[stack[depth]].tag, ()):
                close(depth)
                depth -= 1
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                for d in range(len(stack) - 1, 0, -1):
                    open_tag = nodes[stack[d]].tag
                    if tag in CLOSED_BY.get(open_tag, ()) and open_tag != "p":
                        close(d)
                        break
                    if open_tag in BARRIER:
                        break
            in_link = 0
        if attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if len(stack) > DEPTH:  # as browsers do, deeper elements become siblings
            close(len(stack) - 1)
        nodes.append(_Node(tag, stack[-1], skip or nodes[stack[-1]].skip))
        stack.append(len(nodes) - 1)
    close(0)
    return nodes, blocks


def points_of(text: str, linked: int) -> float:
    """A block's points: one for itself, one a comma, up to three for length, times the share of text outside links."""
    if len(text) < 25:
        return 0.0
    return (1 + text.count(",") + text.count("，") + min(len(text) // 100, 3)) * (len(text) - linked) / len(text)


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    nodes, blocks = _parse(page)
    if not blocks:
        return ""
    plain: dict[int, int] = {}
    for n, text, linked in blocks:
        if nodes[n].tag in HEADINGS:
            continue
        parent = nodes[n].parent if nodes[n].tag in LEAF and nodes[n].parent >= 0 else n
        plain[parent] = plain.get(parent, 0) + len(text) - linked
        share, a, points = 1.0, parent, points_of(text, linked)
        while points and a >= 0 and share > 0.01:
            nodes[a].score += points * share
            share /= 2
            a = nodes[a].parent
    best = max(range(len(nodes)), key=lambda k: (nodes[k].score, nodes[k].tag in MARKED, plain.get(k, 0), -k))
    top = nodes[best].score
    if top:  # the article around the best container, if a good part of the points reached it
        a = best
        while a >= 0 and nodes[a].tag != "article":
            if nodes[a].score >= SIBLING * top and nodes[a].tag == "main":
                best = a
            a = nodes[a].parent
        if a >= 0 and nodes[a].score >= SIBLING * top:
            best = a
    else:  # no block has points
        best = max(range(len(nodes)), key=lambda k: (nodes[k].tag in MARKED and not nodes[k].skip, plain.get(k, 0), -k))
    kept = [0] * (len(nodes) + 1)
    kept[best], kept[nodes[best].last + 1] = 1, -1
    if nodes[best].tag not in MARKED and nodes[best].parent >= 0:
        enough = max(10.0, SIBLING * nodes[best].score)
        total, links = [0] * len(nodes), [0] * len(nodes)
        for n, text, linked in blocks:
            total[n] += len(text)
            links[n] += linked
        for k, x in enumerate(nodes):
            if x.parent == nodes[best].parent and k != best and not x.skip:
                if x.score >= enough or x.tag in ("h1", "h2") or (x.tag in ("p", "blockquote", "pre") and total[k] > 80 and links[k] < 0.25 * total[k]):
                    kept[k] += 1
                    kept[x.last + 1] -= 1
    for k in range(1, len(nodes)):
        kept[k] += kept[k - 1]
    return "\n".join(text for n, text, _ in blocks if kept[n])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
