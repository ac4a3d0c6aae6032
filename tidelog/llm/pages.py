"""Main text of web pages by scoring the element tree.

Each paragraph passes points for its length and commas to its parent, half of them
to its grandparent; a container's points are discounted by the share of its text
that stands in links. The best container is kept, with those of its siblings that
score well themselves or are plain text paragraphs. Elements that never hold
article text (menus, forms, scripts, ...) or whose class or id says so are left out
of the tree.

A page is handled by itself in one map over the rows: no shuffle, memory of one
slice of pages. The parser is a single pass over the markup and follows the usual
repairs: unclosed paragraphs end at the next block, end tags without a start are
ignored. From a tag on whose quotes do not close before the end of the page, tags end
at the first ``>``, and a tag without any is text; so no text is scanned twice.

Within an article a class or id counts if all parts of a name say so
(``comment-list``, not ``cookie-policy-history``). An id that a section took from its
title does not count, unless it names readers' comments. In a ``main`` without an
article, lists that are mostly links go with the heading before them.

Defined results: null or empty html, and pages without any text block, give an
empty string; repeated rows give repeated results; ties go to the container that
starts first; only the named columns are read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import by_batch

_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
# Never article text.
_DROPPED = frozenset("nav header footer aside form button select option input textarea script style noscript template iframe svg canvas object video audio menu dialog title head".split())
_LINKLESS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li td dd dt figcaption".split())
_WORDS = r"(ads?|advert\w*|banner|breadcrumbs?|combx|comments?|commentlist|community|consent|cookies?|disqus|footer|footnav|gdpr|header|masthead|menu|nav(bar|igation)?|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|respond|rss|share|sharing|shoutbox|sidebar|skyscraper|social|sponsor\w*|subscribe|subscription|toolbar|widget|alert|disclaimer|reader-comments?|signup|login)"
_UNLIKELY = re.compile(rf"(?<![a-z]){_WORDS}(?![a-z])")
_UNLIKELY_NAME = re.compile(_WORDS)
# Words that say nothing themselves beside one of the above.
_SHAPES = frozenset(
    "area article bar block bottom box button buttons body card container content count entry feed form group icon icons inline inner item items js "
    "left link links list main message more node outer page panel post posts reader right row section site slot stories thread top unit user users wrap wrapper".split()
)
_READERS = re.compile(r"(?<![a-z])(comments?|commentlist|disqus|replies|respond|shoutbox)(?![a-z])")
_CONTAINERS = frozenset("article blockquote details div section ul ol li dl table p span".split())
_UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
_ARTICLE = frozenset(("article", "main"))
# Markup: comment or declaration, or the beginning of a start or end tag.
_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:-->|$))|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
# Attributes and end of a tag, and what ends one where quotes are broken.
_REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_REST = re.compile(r"([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TITLE = re.compile(r"\s*(?:<!--.*?-->\s*)*<h[1-6][\s>]", re.I | re.S)
_COMMAS = re.compile("[,،、，]")
# Points from which a sibling of the best container is kept, as a share of the best.
SIBLING_SHARE = 0.2
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# An end tag or an implied end does not reach out of these.
_BARRIERS = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())


class Node:
    __slots__ = ("tag", "parent", "dropped", "points", "chars", "linked", "order", "article")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, order: int):
        self.tag, self.parent, self.dropped, self.order = tag, parent, dropped, order
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.article = tag in _ARTICLE or (parent is not None and parent.article)


def _says_so(value: str) -> bool:
    """Whether a name among those of a class or id has only parts that tell of no article text."""
    for name in value.split():
        parts = [part for part in re.split(r"[-_:]+", name) if part]
        if _UNLIKELY_NAME.fullmatch(name) or (
            any(_UNLIKELY_NAME.fullmatch(part) for part in parts)
            and all(part in _SHAPES or part.isdigit() or _UNLIKELY_NAME.fullmatch(part) for part in parts)
        ):
            return True
    return False


def _unlikely(tag: str, attributes: str, article: bool = False, titled: bool = False) -> bool:
    """Whether an element is left out; ``article``: it stands in one, ``titled``: a heading comes first in it."""
    if tag in _DROPPED:
        return True
    if not attributes or tag in ("body", "html", "main") or (tag == "article" and not article):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            if not article and _UNLIKELY.search(value):
                return True
            from_title = name == "id" and titled and not _READERS.search(value)
            if article and tag in _CONTAINERS and not from_title and _says_so(value):
                return True
        if name == "role" and value in _UNLIKELY_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """Text blocks in page order: the element that holds each, its text, and how many of its characters are links."""
    root = Node("", None, False, 0)
    top, order = root, 0
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((top, text, min(links, len(text))))
            parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if top.dropped or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            links += len(text.strip())

    def close(tag: str, reach: bool = False) -> None:
        """Ends the nearest open element of the name, unless a barrier stands between."""
        nonlocal top
        node = top
        while node.parent is not None and node.tag != tag:
            if node.tag in _BARRIERS and not reach:
                return
            node = node.parent
        if node.parent is not None:
            flush()
            top = node.parent

    at, end, rest_of_tag = 0, len(page), _REST
    last = page.rfind(">")
    endless: set[str] = set()
    while at < end:
        found = _MARKUP.search(page, at)
        if found and found[2] is not None and found.end() > last:
            found = None
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        rest = rest_of_tag.match(page, at)
        if not rest:
            rest_of_tag = _PLAIN_REST
            rest = rest_of_tag.match(page, at)
        ending, tag, attributes, at = found[1], found[2].lower(), rest[1], rest.end()
        if tag in _INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                in_link = 0 if ending else 1
            elif not ending and attributes and not top.dropped and _unlikely(tag, attributes, top.article):
                # What an inline notice or advert holds goes as well.
                over = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = over.end() if over else at
                if not over:
                    endless.add(tag)
            continue
        if ending:
            close(tag, tag in _BARRIERS)
            in_link = 0 if tag in _BARRIERS else in_link
            continue
        if tag in _RAW:
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if tag in _CLOSES_P:
            close("p")
        for other in _CLOSES.get(tag, ()):
            close(other)
        flush()
        if tag in _VOID:
            continue
        if tag in ("html", "body") and top.parent is not None:
            continue
        order += 1
        top = Node(tag, top, top.dropped or _unlikely(tag, attributes, top.article, bool(_TITLE.match(page, at))), order)
        in_link = 0
        if attributes.endswith("/") and tag not in _BARRIERS and tag != "p":
            top = top.parent
    flush()
    return out


def _without_link_lists(found: list[tuple[Node, str, int]], best: Node) -> list[tuple[Node, str, int]]:
    """The blocks but those below ``best`` in a container that is mostly links, and the headings right before such blocks."""
    gone = []
    for node, _, _ in found:
        up, listed = node, False
        while up is not None and up is not best:
            listed = listed or (up.tag in _CONTAINERS and up.tag not in ("p", "li") and up.points <= 0 and up.linked * 2 > up.chars)
            up = up.parent
        gone.append(listed and up is best)
    for i in range(len(found) - 2, -1, -1):
        gone[i] = gone[i] or (gone[i + 1] and re.fullmatch("h[1-6]", found[i][0].tag) is not None and found[i][0].parent is not None)
    return [block for block, out in zip(found, gone, strict=True) if not out]


def main_text(page: str | None) -> str:
    """Blocks of the best container and its kept siblings, joined by an empty line."""
    found = blocks(page) if page else []
    if not found:
        return ""
    scored: dict[int, Node] = {}
    for node, text, links in found:
        own = 1 + len(_COMMAS.findall(text)) + min(len(text) / 100, 3.0)
        # The text of a block is in its element and in all around it; points go to the two containers above.
        container = node.parent if node.tag in _LINKLESS and node.parent is not None else node
        if len(text) >= 25 and links * 2 < len(text):
            container.points += own
            scored[container.order] = container
            if container.parent is not None:
                container.parent.points += own / 2
                scored[container.parent.order] = container.parent
        up: Node | None = node
        while up is not None:
            up.chars += len(text)
            up.linked += links
            up = up.parent

    def worth(node: Node) -> float:
        return node.points * (1 - node.linked / max(1, node.chars)) * (1.25 if node.article else 1.0)

    best: Node | None = max(sorted(scored.values(), key=lambda n: n.order), key=worth, default=None)
    if best is None:
        # Short text only: the article element if there is one, else whatever is not mostly links.
        articles = [node for node, _, _ in found if node.article]
        best = articles[0] if articles else None
    if best is not None:
        # The whole of the nearest article element, or of main if there is none.
        while best.tag not in _ARTICLE and best.parent is not None and best.parent.article:
            best = best.parent
        if best.tag == "main":
            found = _without_link_lists(found, best)
    kept = []
    for node, text, links in found:
        up, chosen = node, best is None and links * 2 < len(text)
        while up is not None and not chosen and best is not None:
            if up is best:
                chosen = True
            elif up.parent is best.parent and not best.article and best.parent is not None:
                plain = up.tag in _LINKLESS and links * 4 < len(text) and (len(text) >= 80 or up.tag[0] == "h")
                chosen = plain or (up.points > 0 and worth(up) >= max(10, SIBLING_SHARE * worth(best)))
            up = up.parent
        if chosen:
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, key: str, url: str, markup: str) -> DataFrame:
    """``key``, ``url``, ``text`` and its length ``n_chars`` for every page."""
    types = {name: kind.replace("bigint", "long") for name, kind in pages.dtypes}

    def work(batch: pa.RecordBatch) -> dict:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        return {key: batch.column(0), url: batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return by_batch(pages.select(key, url, markup), f"{key} {types[key]}, {url} {types[url]}, text string, n_chars long", work)
