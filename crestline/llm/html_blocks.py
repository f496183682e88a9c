"""Blocks of text in a page, with the place of each: in a main element, in an article, or in neither.

Left out are elements that the HTML standard sets apart from the content (nav, aside, footer, form, dialog, menu, a header
outside of article and main, landmark roles, hidden ones, and an article within an article, which stands for a reader's comment), and
those with a class or id all of whose parts are words for such elements (`ad`, `cookie-notice`, `comment-list`).
A word among others (`share-price`, `form-of-address`) sets nothing apart.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Fixed values of HTML: element names and what they mean here.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg math iframe object canvas audio video textarea select title".split())
DROPPED = set("nav aside footer form button dialog menu head".split())
SCOPES = set("article aside body blockquote div dd dl fieldset figure footer form header html li main nav ol section table tbody td th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"tr", "thead"}}
#: Words of class names and ids for what is not the article.
MARKS = set("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promotions cookie cookies consent gdpr notice notices alert disclaimer sidebar menu nav navbar navigation topnav breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond replies share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar pagination pager search".split())
#: Words that may stand beside these.
BESIDE = set("area banner bar block blocks body bottom box button buttons container content form global group icons inner item items left link links list main module outer page panel post posts primary right row secondary section side site sticky thread title top unit wrap wrapper".split())
#: Class names of a page's head, which count outside of article and main.
HEADS = set("header topbar site-header page-header".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Block(NamedTuple):
    """place: -1 in an element that is set apart, 0 outside of main and article, else 1 in a main element plus twice the number of the article in the page, from 1;
    linked: characters within links."""

    text: str
    place: int
    linked: int


class Open(NamedTuple):
    name: str
    dropped: bool
    place: int
    link: bool


def attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def marked(name: str, own: dict[str, str], place: int) -> bool:
    """Whether class, id, role or a hidden state set an element at a place apart from the article."""
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True
    if own.get("role", "").lower() in ROLES:
        return True
    if name in ("html", "body", "main"):
        return False
    for token in f"{own.get('class', '')} {own.get('id', '')}".split():
        parts = {p.lower() for p in PART.findall(token) if len(p) > 1 and not p.isdigit()}
        if (parts & MARKS and parts <= MARKS | BESIDE) or (not place and token.lower() in HEADS):
            return True
    return False


def blocks(page: str, apart: bool = False) -> list[Block]:
    """Text blocks in page order; what lies in a dropped element is left out, or has place -1 if apart is asked for."""
    found: list[Block] = []
    stack = [Open("", False, 0, False)]
    text: list[str] = []
    beside: list[str] = []
    linked = beside_linked = 0
    at = articles = 0

    def flush() -> None:
        nonlocal linked, beside_linked
        for parts, place, links in ((text, stack[-1].place, linked), (beside, -1, beside_linked)):
            joined = " ".join("".join(parts).split())
            if joined:
                found.append(Block(joined, place, links))
            parts.clear()
        linked = beside_linked = 0

    def close(names: set[str], within: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in within:
                return

    def add(part: str) -> None:
        nonlocal linked, beside_linked
        if part and (apart or not stack[-1].dropped):
            part = html.unescape(part)
            (beside if stack[-1].dropped else text).append(part)
            links = len(part.strip()) if stack[-1].link else 0
            if stack[-1].dropped:
                beside_linked += links
            else:
                linked += links

    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            (beside if stack[-1].dropped else text).append(" ")
        if m[1]:
            if any(o.name == name for o in stack):
                close({name}, set())
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            close({"p"}, SCOPES)
        if name in CLOSES:
            close(CLOSES[name], {"ul", "ol", "dl", "table", "select", "menu"})
        top = stack[-1]
        own = attributes(m[3]) if m[3].strip() else {}
        dropped = top.dropped or name in DROPPED or (bool(own) and marked(name, own, top.place)) or (name == "header" and not top.place) or (name == "article" and top.place > 1)
        place = top.place
        if name == "article" and not dropped:
            articles += 1
            place += 2 * articles
        elif name == "main" or own.get("role") == "main":
            place |= 1
        stack.append(Open(name, dropped, place, top.link or name == "a"))
    add(page[at:])
    flush()
    return found
