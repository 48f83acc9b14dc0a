"""A small HTML reader: the text blocks of a page with their place in the DOM.

Lenient like a browser where it matters for text: comments, raw-text elements,
implied end tags, unclosed and stray tags, tags cut off by the end of the page.

A branch is none of the article when its tag, role, whole class or id says so,
unless an article or main element is inside it; a form that the whole page is
in (it holds an article, main or h1, or most of the text) says nothing.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field
from hashlib import blake2b

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^>"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: A start tag closes an open element of these kinds, up to a border.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Never read as text, whatever is inside.
_MUTE_TAGS = frozenset("button select textarea script style noscript template iframe svg canvas object head title xmp noembed noframes input".split())
_OUT_TAGS = frozenset("nav footer aside form dialog menu".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Classes and ids, whole, that mark a branch as none of the article.
_OUT_NAMES = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments commentlist disqus reply replies respond login search searchbox pagination pager widget widgets toolbar skip".split()
)
_HEADER_NAMES = {"header", "topbar", "pageheader", "top-bar", *(f"{a}-header" for a in "site main top global masthead".split())}
for _first, _second in (
    ("site main top primary secondary global mobile side left right header footer", "nav navbar navigation menu sidebar"),
    ("site page main global", "footer"),
    ("footer", "links widgets area bottom bar menu"),
    ("nav navbar menu breadcrumb", "bar links list items wrapper container menu trail"),
    ("ad ads advert adverts advertisement google sponsored sponsor promo", "ad ads banner slot unit box block container wrapper label links content"),
    ("banner", "ad ads"),
    ("cookie cookies gdpr consent privacy", "notice banner bar consent popup modal overlay message policy warning law"),
    ("newsletter subscribe subscription signup email", "signup form box banner popup subscribe widget block"),
    ("social share sharing", "share sharing links icons buttons bar media tools widget"),
    ("related recommended", "posts articles stories links news topics reading products pages"),
    ("comment comments reply", "list section area form thread respond box count wrapper"),
    ("login search", "form box bar widget modal"),
    ("modal popup", "dialog overlay content window"),
    ("widget", "area"),
    ("skip", "link links nav"),
):
    _OUT_NAMES |= {f"{a}-{b}" for a in _first.split() for b in _second.split() if a != b}
_NUMBERED = re.compile(r"(?:-\d+(?:-?x-?\d+)?)+$")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


def hash64(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@dataclass
class Block:
    path: int  # of the element that holds it
    parent: int  # of that element's parent
    text: str
    in_article: bool
    in_main: bool
    marked: bool = False  # in a branch that is marked as none of the article, but has one inside


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    styles: dict[int, str] = field(default_factory=dict)  # element path -> the tags of its children

    def article(self) -> list[Block]:
        """The blocks of the article element(s), else of the main element, else all; boilerplate branches are not among them.

        Article elements in marked branches only may be teasers: they are the article if they have half of the text.
        """
        for part in ([b for b in self.blocks if b.in_article and not b.marked], [b for b in self.blocks if b.in_main]):
            if part:
                return part
        part = [b for b in self.blocks if b.in_article]
        return part if 2 * sum(len(b.text) for b in part) >= sum(len(b.text) for b in self.blocks) else self.blocks


class _Marked:
    """A branch that is marked as none of the article."""

    __slots__ = ("above", "drop", "has_h1", "holds", "may_be_page", "size")

    def __init__(self, above: _Marked | None, may_be_page: bool):
        self.above, self.may_be_page = above, may_be_page
        self.holds, self.has_h1, self.drop, self.size = False, False, False, 0

    def has_article(self) -> None:
        at: _Marked | None = self
        while at is not None and not at.holds:
            at.holds, at = True, at.above


class _Open:
    __slots__ = ("apart", "children", "in_article", "in_main", "marked", "mute", "path", "tag")

    def __init__(self, tag, path, mute, marked, in_article, in_main, apart):
        self.tag, self.path, self.mute, self.marked, self.in_article, self.in_main = tag, path, mute, marked, in_article, in_main
        self.apart = apart  # its text is none of the text around it
        self.children: list[str] = []


def _name(token: str) -> str:
    """A class or id in lower case, its words joined by hyphens, without the numbers at its end."""
    return _NUMBERED.sub("", "-".join(w.lower() for w in _WORD.findall(token)))


def _is_out(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in ("body", "html"):
        return False
    if tag in _OUT_TAGS or tag == "header" and not in_article:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _OUT_ROLES:
        return True
    if "style" in attrs and re.search(r"display\s*:\s*none", attrs["style"], re.I):
        return True
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if not names.strip() or tag == "main":
        return False
    names = {_name(t) for t in names.split()}
    return not names.isdisjoint(_OUT_NAMES) or not in_article and not names.isdisjoint(_HEADER_NAMES)


_paths: dict[tuple[int, str], int] = {}


def _path(parent: int, sign: str) -> int:
    key = (parent, sign)
    got = _paths.get(key)
    if got is None:
        if len(_paths) > 100_000:
            _paths.clear()
        got = _paths[key] = hash64(str(parent), sign)
    return got


def read_page(html: str) -> Page:
    page = Page()
    stack = [_Open("", 0, False, None, False, False, True)]
    text: list[str] = []
    branches: list[_Marked] = []
    places: list[_Marked | None] = []  # of the blocks

    def end_block() -> None:
        if text:
            said = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if said:
                k = len(stack) - 1
                while k and stack[k].tag not in _BLOCK:
                    k -= 1
                top = stack[k]
                page.blocks.append(Block(top.path, stack[k - 1].path if k else 0, said, top.in_article, top.in_main))
                places.append(stack[-1].marked)

    def close_to(k: int) -> None:
        """Close the elements from place ``k`` of the stack on."""
        if any(e.apart for e in stack[k:]):
            end_block()
        for e in stack[k:]:
            if not e.mute and e.children:
                page.styles[e.path] = " ".join(e.children)
        del stack[k:]

    at = 0
    n = len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            if not stack[-1].mute:
                text.append(html[at:])
            break
        if m.start() > at and not stack[-1].mute:
            text.append(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            k = len(stack) - 1
            while k and stack[k].tag != tag and (tag in _BLOCK or stack[k].tag not in _BLOCK):
                k -= 1
            if k and stack[k].tag == tag:
                close_to(k)
            continue
        if at == n and html[-1] != ">":  # the page ends inside the tag
            break
        if tag in _BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close_to(k)
                    break
                if stack[k].tag in ("button", "table", "td", "th", "article", "section", "div", "li", "body"):
                    break
        if tag in _CLOSES:
            kinds, border = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in border:
                    break
                if stack[k].tag in kinds:
                    close_to(k)
                    if tag not in ("tr", "td", "th") or tag == "tr" and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                        break
        top = stack[-1]
        if tag in _BLOCK:
            end_block()
        elif tag in ("br", "td", "th", "img", "wbr") and not top.mute:
            text.append(" " if tag != "wbr" else "")
        attrs = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(m.group(3))} if "=" in m.group(3) or "hidden" in m.group(3) else {}
        mute = top.mute or tag in _MUTE_TAGS
        out = not mute and _is_out(tag, attrs, top.in_article)
        if out and tag not in _BLOCK and tag not in ("td", "th") and "-" not in tag:  # inside a line there is no article
            mute, out = True, False
        if not top.mute and tag in _BLOCK and (not top.children or top.children[-1] != tag):
            top.children.append(tag)
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else n
            continue
        if m.group(3).endswith("/") and tag in ("svg", "path"):
            continue
        is_main = tag == "main" or attrs.get("role") == "main"
        marked = top.marked
        if out:
            end_block()
            marked = _Marked(top.marked, tag == "form" and not top.in_article and not top.in_main)
            branches.append(marked)
        inside = top.in_article or top.in_main
        if marked is not None and not mute:
            if (tag == "article" and not (out and inside)) or is_main:
                marked.has_article()
            elif tag == "h1" and marked.may_be_page:
                marked.has_h1 = True
        in_article = top.in_article or tag == "article" and not (out and inside)
        stack.append(_Open(tag, _path(top.path, f"{tag}.{attrs.get('class', '')}"), mute, marked, in_article, top.in_main or is_main, out or tag in _BLOCK))
    end_block()
    close_to(1)
    if branches:
        _judge(page, branches, places)
    return page


def _judge(page: Page, branches: list[_Marked], places: list[_Marked | None]) -> None:
    """Drop the blocks of marked branches without an article; branches come before those inside them."""
    for x in branches:
        x.drop = x.above is not None and x.above.drop or not x.holds and not x.may_be_page
    total = 0
    for b, x in zip(page.blocks, places):
        if x is None:
            total += len(b.text)
        elif not x.drop:
            x.size += len(b.text)
    for x in reversed(branches):
        if x.above is not None:
            x.above.size += x.size
        else:
            total += x.size
    says = {}  # branch -> is there a mark that counts
    for x in branches:
        page_wide = x.may_be_page and (x.holds or x.has_h1 or 2 * x.size > total)
        x.drop = x.above is not None and x.above.drop or not x.holds and not page_wide
        says[x] = not page_wide or x.above is not None and says[x.above]
    for b, x in zip(page.blocks, places):
        b.marked = x is not None and says[x]
    page.blocks = [b for b, x in zip(page.blocks, places) if x is None or not x.drop]
