"""One page: HTML to blocks of text with their place in the layout.

A forgiving reader: raw-text elements, comments, missing end tags and truncated
pages are handled as browsers do; what a page's markup says about an element
(tag, role, class and id words) marks menus, headers, footers, sidebars, notices,
adverts, forms and comments.  Marks are evidence: marked blocks are read like all others.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(>|$)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=)|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr "
                  "ul".split())
#: starting one of these ends an open element of the group, up to a container
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
CONTAINERS = frozenset("table ul ol dl select div article section body main".split())
#: elements whose text is no text of the page
NEVER = frozenset("head button select option label svg canvas object audio video map datalist meter progress".split()) | RAW
#: elements that are seldom the article's text: evidence against a slot
OUTSIDE = frozenset("nav footer aside form fieldset menu dialog".split())
#: elements that make a slot; the text of others belongs to the nearest one around them
SECTIONS = frozenset("html body div section article main td th aside nav header footer form fieldset ul ol dl table center blockquote".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: words of a class or id that mark an element outside the article
OUTSIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies "
                          "consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup nav navbar navigation "
                          "menu menus breadcrumb breadcrumbs sidebar sidebars rail aside widget widgets footer footnav masthead topbar toolbar comment "
                          "comments commentlist disqus reply replies respond discussion related recommended recommendations share sharing social "
                          "pagination pager login search skip legal copyright disclaimer".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())


class Block(NamedTuple):
    text: str
    path: str       # tags and classes from the root
    article: bool   # in an article element
    main: bool      # in a main element
    linked: int     # characters within links
    marks: int      # elements around it that the markup puts outside the article


class _Open(NamedTuple):
    tag: str
    path: str
    never: bool
    marks: int
    article: bool
    main: bool
    link: bool


def _open(parent: _Open, tag: str, attributes: str) -> _Open:
    role = klass = ident = item = ""
    hidden = False
    if attributes.strip(" /"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "role":
                role = value.lower().strip()
            elif name == "class":
                klass = value
            elif name == "id":
                ident = value
            elif name == "itemprop":
                item = value.lower()
            elif name == "aria-hidden":
                hidden = value.lower() == "true"
        hidden = hidden or bool(_HIDDEN.search(attributes)) and not klass.lower().startswith("hidden-")
    words = {w.lower() for w in _PARTS.findall(klass + " " + ident)} if klass or ident else frozenset()
    article = parent.article or tag == "article" or item == "articlebody"
    main = parent.main or tag == "main" or role == "main"
    never = parent.never or tag in NEVER or hidden
    outside = tag in OUTSIDE or role in OUTSIDE_ROLES
    if not outside and words:
        if tag == "article":
            outside = bool(words & COMMENT_WORDS)
        elif tag not in ("html", "body", "main"):
            outside = bool(words & OUTSIDE_WORDS) or "header" in words and not article and tag not in ("h1", "h2")
    # a header within an article is its title
    outside = outside or tag == "header" and not parent.article
    # numbers in a class or id tell pages apart, not places
    names = sorted(w for w in words if not w.isdigit())
    step = tag + "." + ".".join(names) if names else tag
    return _Open(tag, f"{parent.path}/{step}", never, parent.marks + outside, article, main, parent.link or tag == "a")


def read_page(html: str | None) -> tuple[list[Block], dict[str, int]]:
    """All blocks in page order, and how often each element path occurs."""
    html = html or ""
    root = _Open("", "", False, 0, False, False, False)
    stack, blocks, paths = [root], [], {}
    #: what is read of the block, by marks: text in a marked element within a line is a block of its own
    text: dict[int, list] = {}
    at, end = 0, len(html)

    def flush() -> None:
        for marks, (place, linked, raw) in text.items():
            joined = " ".join("".join(raw).split())
            if joined:
                blocks.append(Block(joined, place.path, place.article, place.main, linked, marks))
        text.clear()

    def say(raw: str) -> None:
        top = stack[-1]
        if raw and not top.never:
            raw = unescape(raw)
            part = text.get(top.marks)
            if part is None:
                # the block belongs to the nearest element that is not within a line
                place = next((o for o in reversed(stack) if o.tag in BLOCK or o.tag in ("td", "th")), root)
                part = text[top.marks] = [place, 0, []]
            part[2].append(raw)
            if top.link:
                part[1] += len(raw.strip())

    def blank() -> None:
        for part in text.values():
            part[2].append(" ")

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        m = _TOKEN.match(html, lt)
        if m is None:
            say(html[at:lt + 1])
            at = lt + 1
            continue
        say(html[at:lt])
        at = m.end()
        tag = m.group(2)
        if tag is None or not m.group(4):
            continue
        tag = tag.lower()
        if m.group(1):
            if any(o.tag == tag for o in stack[1:]):
                if tag in BLOCK:
                    flush()
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in VOID:
            if tag == "br":
                blank()
            elif tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK or stack[k].tag in ("td", "th", "button"):
                    break
        elif tag in ("td", "th"):
            blank()
        for k in range(len(stack) - 1, 0, -1) if tag in ENDS else ():
            if stack[k].tag in ENDS[tag]:
                del stack[k:]
            elif stack[k].tag in CONTAINERS:
                break
        opened = _open(stack[-1], tag, m.group(3))
        paths[opened.path] = paths.get(opened.path, 0) + 1
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
            continue
        stack.append(opened)
    flush()
    return blocks, paths


def slot_of(path: str, slots) -> str | None:
    """The nearest of ``slots`` at or around a path."""
    while path and path not in slots:
        path = path.rpartition("/")[0]
    return path or None


def kind(article: bool, main: bool) -> int:
    """0 in an article element, 1 in a main element, 2 elsewhere."""
    return 0 if article else 1 if main else 2


def by_markup(blocks: list[Block], drop: set) -> list[str]:
    """Without a template: the unmarked blocks in article elements, else in a main element, else all but ``drop``."""
    blocks = [b for b in blocks if not b.marks]
    for inside in ("article", "main"):
        found = [b.text for b in blocks if getattr(b, inside)]
        if found:
            return found
    return [b.text for b in blocks if (b.path, b.text) not in drop]


def main_blocks(blocks: list[Block], drop: set, slots: dict | set = frozenset()) -> list[str]:
    """The article's blocks: those in the slots that the host's template has chosen (``slots``: by path, the marks up to which
    blocks of each kind are text, -1 for none) but its fixed texts (``drop``: (path, text)).  Without a template, or on a page
    with none of the slots, the markup decides."""
    if slots:
        found = []
        for b in blocks:
            at = slot_of(b.path, slots)
            if at is not None and b.marks <= slots[at][kind(b.article, b.main)] and (b.path, b.text) not in drop:
                found.append(b.text)
        if found:
            return found
    return by_markup(blocks, drop)
