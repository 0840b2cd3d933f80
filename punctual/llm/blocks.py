"""Leaf blocks of an HTML page: runs of text between block-level tags, with what stands above them."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)
      |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>
      |<[!?/][^>]*>""",
    re.S | re.X,
)
#: Their content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video title select textarea".split())
_SILENT_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in SILENT}
#: Silent elements that can hold one of their own name, and those of them that '/>' ends.
_NESTED = frozenset("template svg math object canvas audio video".split())
_FOREIGN = frozenset("svg math".split())
_NESTED_TAG = {
    name: re.compile(rf"""<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\b|<(?P<end>/?){name}(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", re.S | re.I)
    for name in _NESTED
}
#: What can stand in a head; the first other tag and the first text end it.
_IN_HEAD = frozenset("head title meta link base basefont bgsound script style noscript noframes template".split())
_NOFRAMES_END = re.compile(r"</noframes\b[^>]*>", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split()
)
#: An opening tag of the first kind closes open ones of the second, up to the nearest of the third.
_P_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_HOLDS_P = frozenset("article aside blockquote body button dd details div fieldset figcaption figure footer form header li main nav section table td th".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

#: What an ancestor's tag or naming says; a block has the union over its ancestors.
ARTICLE, BOILER, POSITIVE, NEGATIVE, COMMENTS, LIST, TABLE, HEADING, PARAGRAPH, QUOTE, NAVIGATION, FORM, ASIDE, EDGE = (1 << i for i in range(14))
_TAG_FLAGS = {
    "article": ARTICLE, "main": ARTICLE,
    "nav": BOILER | NAVIGATION, "menu": BOILER | NAVIGATION, "footer": BOILER | EDGE, "header": BOILER | EDGE, "aside": BOILER | ASIDE,
    "dialog": BOILER | ASIDE, "form": BOILER | FORM, "button": BOILER | FORM, "fieldset": BOILER | FORM,
    "ul": LIST, "ol": LIST, "dl": LIST, "table": TABLE, "p": PARAGRAPH, "blockquote": QUOTE, "pre": QUOTE, "figure": QUOTE,
    **{f"h{i}": HEADING for i in range(1, 7)},
}
_NEGATIVE = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"side-?bar|side|widget|rail|related|recommended|share|sharing|social|nav(?:bar|igation)?|menu|bread-?crumbs?|foot(?:er)?|head(?:er)?|masthead|top-?bar|"
    r"subscribe|newsletter|sign-?up|log-?in|search|pager|pagination|copyright|legal|disclaimer|hidden|toolbar|tags?|author-bio|byline|complementary|contentinfo)(?:[^a-z]|$)"
)
_COMMENTS = re.compile(r"(?:^|[^a-z])(?:comments?|commentlist|reply|replies|respond|disqus|discussion|reviews?)(?:[^a-z]|$)")
_POSITIVE = re.compile(r"(?:^|[^a-z])(?:article(?:body)?|content|post|entry|story|main|prose|body-?text)(?:[^a-z]|$)")


class Block(NamedTuple):
    text: str
    flags: int
    link_share: float
    tag: str


def _named(rest: str) -> int:
    """Flags from an element's class, id, role and the like."""
    flags = 0
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), re.sub(r"([a-z])([A-Z])", r"\1-\2", value.strip("\"'")).lower().replace("_", "-")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            flags |= NEGATIVE
        elif name == "style":
            flags |= NEGATIVE if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else 0
        elif name != "aria-hidden":
            if _COMMENTS.search(value):
                flags |= COMMENTS
            if _NEGATIVE.search(value):
                flags |= NEGATIVE
            elif _POSITIVE.search(value):
                flags |= POSITIVE
    return flags


def _nested_ends(page: str, name: str) -> dict[int, int]:
    """Where the element of each opening tag of ``name`` ends; those without an end tag are left out."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    for found in _NESTED_TAG[name].finditer(page):
        if found["end"] is None:
            continue
        if not found["end"]:
            if not (name in _FOREIGN and found[0].endswith("/>")):
                opened.append(found.start())
        elif opened:
            ends[opened.pop()] = found.end()
    return ends


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order; white space inside a block is one space, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = links = 0
    nested: dict[str, dict[int, int]] = {}
    unended: set[str] = set()
    in_head = False

    def silent_end(name: str, start: int, at: int) -> int:
        """Where the silent element ends whose tag stands from ``start`` to ``at``: there, if it has no end tag and is no script or style."""
        if name in _FOREIGN and page[at - 2] == "/":
            return at
        if name in _NESTED:
            if name not in nested:
                nested[name] = _nested_ends(page, name)
            return nested[name].get(start, at)
        over = None if name in unended else (_SILENT_END[name] if name in SILENT else _NOFRAMES_END).search(page, at)
        if over:
            return over.end()
        unended.add(name)
        return len(page) if name in ("script", "style") else at

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                flags = stack[-1][1] if stack else 0
                tag = next((t for t, _ in reversed(stack) if t not in INLINE), "")
                out.append(Block(text, flags, min(linked / max(len(text), 1), 1.0), tag))
            parts.clear()
        linked = 0

    def pop_to(index: int) -> None:
        nonlocal links
        for tag, _ in stack[index:]:
            links -= tag == "a"
        del stack[index:]

    at = 0
    while at < len(page):
        found = TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            in_head = in_head and text.isspace()
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not found:
            break
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            if found[0].startswith("</"):
                close_block()
            continue
        ends = bool(found["end"] or found["end2"])
        in_head = not (ends and name == "head") and (in_head or not ends and name == "head") and name in _IN_HEAD
        if not ends and (name in SILENT or in_head and name == "noframes"):
            at = silent_end(name, found.start(), at)
            parts.append(" ")
            continue
        if name == "head":
            close_block()
            continue
        if name == "br" or (name in VOID and name in INLINE):
            parts.append(" ")
            continue
        if name not in INLINE:
            close_block()
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
            continue
        if name in VOID:
            continue
        closed, holders = IMPLIED.get(name, (set(), set()))
        if name in _P_ENDS:
            closed, holders = {"p"} if name not in ("h1", "h2", "h3", "h4", "h5", "h6") else {"p", "h1", "h2", "h3", "h4", "h5", "h6"}, _HOLDS_P
        if closed:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closed:
                    pop_to(i)
                    break
                if stack[i][0] in holders:
                    break
        if found[0].endswith("/>") and name not in INLINE and name not in _TAG_FLAGS:
            continue
        above = stack[-1][1] if stack else 0
        own = _TAG_FLAGS.get(name, 0)
        rest = found["rest"] or found["rest2"] or ""
        flags = above | own | (_named(rest) if "=" in rest or "hidden" in rest.lower() else 0)
        stack.append((name, flags))
        links += name == "a"
    close_block()
    return out
