"""One web page as a flat list of text blocks, each with the containers it stands in."""

from __future__ import annotations

import html
import re
from collections import Counter

# Elements whose content is never text of the page.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "object", "audio", "video", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that hold one run of text; everything else outside INLINE is a container.
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "dt", "dd", "figcaption", "caption", "tr", "address", "summary", "legend"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr",
    "output", "q", "ruby", "rb", "rp", "rt", "rtc", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "td", "th",
    "picture", "map", "slot",
}
# Elements, roles and words in class or id that mark parts which are not the article.
ASIDE_TAGS = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "datalist", "marquee"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
ASIDE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav",
    "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "foot", "header", "masthead", "topbar", "toolbar", "comment",
    "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification",
    "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
    "recommended", "recommendations", "widget", "widgets", "pagination", "pager", "skip", "search", "form", "copyright", "legal", "disclaimer", "tags", "outbrain", "taboola",
}
# Words that always mark a part beside the article; each of the others can also be its topic or the page's layout.
STRICT_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "nav", "navbar", "breadcrumb", "breadcrumbs",
    "comment", "comments", "commentlist", "respond", "replies", "disqus", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "pagination", "pager", "outbrain", "taboola",
}
ARTICLE_TAGS = {"article", "main"}
TITLE_WORDS = {"header", "masthead"}  # inside an article these hold its title
WHOLE_TAGS = {"html", "body", "main", "article"}  # their class and id speak of the page or its topic
MOST = 0.8  # share of the page's unlinked text from which a container is not beside the article, whatever its class
# Beside one of these an aside word speaks of the layout: "content-with-sidebar".
LAYOUT_WORDS = {"with", "has", "no", "without"}
ADDS = 0.05  # share of a container's text that an ancestor has to add to count as more of the article
# An end of these closes what is still open inside them; a start closes an open one of the same set.
_REOPEN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "p": {"p"}}
_CLOSES_P = LEAF | {"div", "article", "section", "main", "ul", "ol", "dl", "table", "blockquote", "figure", "hr", "details"} | ASIDE_TAGS

# A tag without angle brackets in its attributes: what fails is given up at the next bracket, so a page is read in linear time.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>|<!--|<[!?/][^<>]*+>|<(?=[/a-zA-Z!?])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_EDGE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
LONGEST_VALUE = 1 << 20  # a quoted value longer than this was never closed
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


class Element:
    """An open or closed container or leaf: ``path`` is its generalised tag-class path, of ``length`` characters.

    ``doubtful`` is the outermost element around it, or itself, that is an aside by a form tag or a word that may be a topic.
    An element holds its own step of the path only, so that deeply nested pages stay small.
    """

    __slots__ = ("aside", "doubt", "doubtful", "in_article", "leaf", "length", "parent", "step", "tag")

    def __init__(self, tag: str, parent: Element | None, step: str, mark: str, leaf: bool):
        self.tag, self.parent, self.step, self.leaf = tag, parent, step, leaf
        self.length = len(step) + (parent.length if parent is not None else 0)
        self.in_article = tag in ARTICLE_TAGS or (parent is not None and parent.in_article)
        self.doubt = mark == "doubtful"
        self.settle(mark == "aside")

    @property
    def path(self) -> str:
        steps, e = [], self
        while e is not None:
            steps.append(e.step)
            e = e.parent
        return "".join(reversed(steps))

    def settle(self, marked: bool) -> None:
        """Work out ``aside`` and ``doubtful`` from what is outside; ``marked``: an aside without a doubt."""
        outer = self.parent
        self.aside = marked or self.doubt or (outer is not None and outer.aside)
        # An aside beyond doubt, around it or itself, leaves nothing to decide.
        sure = marked or (outer is not None and outer.aside and outer.doubtful is None)
        self.doubtful = None if sure else outer.doubtful if outer is not None and outer.doubtful is not None else self if self.doubt else None


class Block:
    """A run of text with its innermost element and how many of its characters stand in links."""

    __slots__ = ("element", "linked", "links", "text")

    def __init__(self, element: Element, text: str, linked: int, links: int):
        self.element, self.text, self.linked, self.links = element, text, linked, links


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(source)}


def _mark(tag: str, at: dict[str, str], in_article: bool = False) -> str:
    """``aside``, ``doubtful`` or nothing; the header of an article is a part of it."""
    if tag in ("html", "body"):
        return ""
    if (tag in ASIDE_TAGS - {"form"} and not (in_article and tag == "header")) or at.get("role", "").lower() in ASIDE_ROLES or "hidden" in at or at.get("aria-hidden") == "true":
        return "aside"
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", "")):
        return "aside"
    mark = "doubtful" if tag == "form" else ""
    for name in () if tag in WHOLE_TAGS else (at.get("class", "") + " " + at.get("id", "")).split():
        found = {w.lower() for w in _PARTS.findall(name)}
        if in_article:
            found -= TITLE_WORDS
        if found & ASIDE_WORDS and not found & LAYOUT_WORDS:
            if found & STRICT_WORDS:
                return "aside"
            mark = "doubtful"
    return mark


def _step(tag: str, at: dict[str, str]) -> str:
    """Tag and classes with numbers generalised, so that all pages of a template agree."""
    names = sorted({re.sub(r"\d+", "#", c.lower()) for c in at.get("class", "").split()})
    return ".".join([tag, *names])


class _Tags:
    """The tags of a page that the plain pattern does not take: with brackets in their attributes, or cut off."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.quotes = {q: (0, -1) for q in "\"'"}  # a search from the first place gave the second

    def _closing(self, quote: str, at: int) -> int:
        """Where the quote occurs next; each part of the page is searched once."""
        since, found = self.quotes[quote]
        if not since <= at <= found:
            found = self.source.find(quote, at)
            self.quotes[quote] = (at, found if found >= 0 else len(self.source))
        found = self.quotes[quote][1]
        return found if found < self.last else -1

    def end(self, at: int) -> int:
        """Behind the tag that begins at ``at``; its quotes may hold brackets, a quote that is never closed is a plain character."""
        if at > self.last:
            return len(self.source)  # the end of the page cuts it
        first, i = -1, at + 1
        while (m := _EDGE.search(self.source, i)) is not None:
            if m[0] == ">":
                return m.end()
            stop = self._closing(m[0], m.end())
            if first < 0:
                first = self.source.find(">", m.end())
            if stop < 0 or stop - m.end() > LONGEST_VALUE:
                return first + 1
            i = stop + 1
        return first + 1 if first >= 0 else len(self.source)


def blocks(source: str) -> list[Block]:
    """The text blocks of a page in order; unclosed, misnested and cut-off markup is read as a browser would."""
    top = Element("", None, "", "", False)
    found: list[Block] = []
    inner: list[Element] = []  # elements inside doubtful ones, or these themselves, outer ones first
    here, text, linked, links, in_link = top, [], 0, 0, 0
    at, n = 0, len(source)
    tags, opened = _Tags(source), Counter()
    ends: dict[str, bool] = {}

    def end_block() -> None:
        nonlocal text, linked, links
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            found.append(Block(here, joined, min(linked, len(joined)), links))
        text, linked, links = [], 0, 0

    def close(tags: set[str], until: set[str]) -> None:
        """Close the innermost open element among ``tags``, not looking out of one among ``until``."""
        nonlocal here
        if not any(opened[t] for t in tags):
            return
        e = here
        while e is not top and e.tag not in tags and e.tag not in until:
            e = e.parent
        if e is not top and e.tag in tags:
            while here is not e.parent:
                opened[here.tag] -= 1
                here = here.parent

    while at < n:
        m = _TAG.search(source, at)
        run = source[at : m.start() if m else n]
        if run:
            text.append(run)
            if in_link:
                linked += len(run.strip())
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            stop = source.find("-->", at)
            at = stop + 3 if stop >= 0 else n
            continue
        if m[2] is None and m[0] != "<":
            continue
        name, rest = m, m[3]
        if m[2] is None:  # a tag of another form
            at = tags.end(m.start())
            name = _NAME.match(source, m.start(), at)
            if name is None:
                continue
            rest = source[name.end() : at - 1]
            if at == n and source[-1] != ">":
                break
        tag, closing = name[2].lower(), bool(name[1])
        if tag in RAW:
            if not closing and not rest.endswith("/"):
                stop = re.compile(rf"</{tag}\b[^<>]*>", re.IGNORECASE).search(source, at) if ends.get(tag, True) else None
                ends[tag] = stop is not None
                at = stop.end() if stop else n
            text.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
                links += not closing
            elif tag in ("td", "th"):
                text.append(" ")
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            if tag == "hr":
                end_block()
            continue
        end_block()
        in_link = 0
        if closing:
            close({tag}, set())
            continue
        if tag == "body":
            close({"head"}, set())
        if tag in _CLOSES_P:
            close({"p"}, {"div", "article", "section", "td", "li", "blockquote"} - _REOPEN.get(tag, set()))
        if tag in _REOPEN:
            close(_REOPEN[tag], {"ul", "ol", "dl", "table", "div", "article", "section"})
        attributes = _attributes(rest) if rest else {}
        here = Element(tag, here, f">{_step(tag, attributes)}", _mark(tag, attributes, here.in_article), tag in LEAF)
        opened[tag] += 1
        if here.doubtful is not None:
            inner.append(here)
    end_block()
    _cleared(found, inner)
    return found


def _cleared(found: list[Block], inner: list[Element]) -> None:
    """Take a doubtful container for a plain one if it holds ``MOST`` of the unlinked text, again until none does.

    Text right inside a form is its labels and does not count for it.
    """
    while inner:
        plain, held = 0, {}
        for block in found:
            e, size = block.element, len(block.text) - block.linked
            if e.doubtful is not None and (e is not e.doubtful or e.tag != "form"):
                held.setdefault(id(e.doubtful), [e.doubtful, 0])[1] += size
            elif not e.aside:
                plain += size
        most, size = max(held.values(), key=lambda x: x[1], default=(None, 0))
        if size == 0 or size < MOST * (size + plain):
            return
        most.doubt = False
        for e in inner:  # none of them is an aside beyond doubt
            e.settle(False)


def _worth(block: Block) -> float:
    return (len(block.text) - block.linked) * (1 - block.linked / len(block.text))


def containers(found: list[Block]) -> dict[int, tuple[Element, float]]:
    """Score of every container: the unlinked text right inside it, and half of that one level further in."""
    scores: dict[int, list] = {}
    for block in found:
        if block.element.aside:
            continue
        worth = _worth(block)
        e = block.element
        while e.leaf and e.parent is not None:
            e = e.parent
        for share in (1.0, 0.5):
            if e is None:
                break
            scores.setdefault(id(e), [e, 0.0])[1] += worth * share
            e = e.parent
    return {k: (e, s * (1.25 if e.tag in ARTICLE_TAGS else 1.0)) for k, (e, s) in scores.items()}


def widened(found: list[Block], core: Element) -> Element:
    """The highest ancestor of a container that adds text of the article to it.

    An article or main element adds whatever is in it, and nothing outside the first of them does; any
    other ancestor counts if it adds a first heading or ``ADDS`` of the text so far.
    """
    chain, level = [], {}
    e = core
    while e is not None:
        level[id(e)] = len(chain)
        chain.append(e)
        e = None if e.tag in ARTICLE_TAGS else e.parent
    worth, heading = [0.0] * len(chain), [False] * len(chain)
    for block in found:
        if block.element.aside:
            continue
        e, passed = block.element, []
        while e is not None and id(e) not in level:
            passed.append(id(e))
            e = e.parent
        if e is None or level[id(e)] is None:  # outside the article
            level.update(dict.fromkeys(passed))
            continue
        at = level[id(e)]
        level.update(dict.fromkeys(passed, at))
        worth[at] += _worth(block)
        heading[at] |= block.element.tag == "h1"
    kept, have, more, titled = core, worth[0], 0.0, False
    for e, adds, h1 in zip(chain[1:], worth[1:], heading[1:], strict=True):
        more, titled = more + adds, titled or h1
        if more > 0 and (e.tag in ARTICLE_TAGS or titled or more >= ADDS * have):
            kept, have, more, titled = e, have + more, 0.0, False
    return kept


def best(found: list[Block]) -> Element | None:
    """The container with the highest score; the earlier one of equals."""
    most, core = 0.0, None
    for e, score in containers(found).values():
        if score > most:
            most, core = score, e
    return core


def best_path(found: list[Block]) -> str | None:
    """Path of the container with the highest score, widened to all of the article."""
    core = best(found)
    return None if core is None else widened(found, core).path


def _is_menu(block: Block) -> bool:
    return block.links > 0 and block.linked >= 0.9 * len(block.text.replace(" ", ""))


def text_below(found: list[Block], path: str) -> list[str]:
    """Texts of the blocks inside any element with this path, without what is not the article."""
    # Of each element: whether its own path begins the wanted one, and whether it stands inside an element that has it.
    known: dict[int, tuple[bool, bool]] = {}

    def within(e: Element) -> bool:
        above = []
        while e is not None and id(e) not in known:
            above.append(e)
            e = e.parent
        begins, inside = known[id(e)] if e is not None else (True, False)
        for e in reversed(above):
            begins = begins and path.startswith(e.step, e.length - len(e.step))
            inside = inside or (begins and e.length == len(path))
            known[id(e)] = begins, inside
        return inside

    kept = [b for b in found if not b.element.aside and within(b.element)]
    out = []
    for i, block in enumerate(kept):
        # A list item that is one link, beside others of its kind, is a menu.
        if block.element.tag == "li" and _is_menu(block):
            beside = [kept[j] for j in (i - 1, i + 1) if 0 <= j < len(kept)]
            if any(b.element.parent is block.element.parent and _is_menu(b) for b in beside):
                continue
        out.append(block.text)
    return out
