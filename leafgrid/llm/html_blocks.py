"""Leaf blocks of a page: runs of text between block tags, with their ancestors.

Blocks share the nodes above them, and a page is read in one pass forward, so that the time
and memory of a page grow with its size alone, however its tags nest or miss their ends.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Tags that begin and end a block of text. Fixed values.
BLOCK = frozenset((
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
))
#: Tags whose content is no text of the page: code, what is not shown, fields of forms. Fixed values.
UNSEEN = frozenset(("script", "style", "template", "noscript", "iframe", "textarea", "title"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Opening one of these closes an open one of the same row, up to a tag of SCOPE; others close an open paragraph.
CLOSES = {
    "li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPE = frozenset(("div", "section", "article", "ul", "ol", "table", "dl", "form", "aside", "main"))

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


class Node:
    """An open tag with the names of its class, id and role, and the node it is in."""

    __slots__ = ("tag", "names", "above", "depth")

    def __init__(self, tag: str, names: tuple[str, ...], above: Node | None) -> None:
        self.tag, self.names, self.above, self.depth = tag, names, above, above.depth + 1 if above else 0


@dataclass
class Block:
    """Text with white space made single, the node it is in, and characters in links."""

    text: str
    node: Node | None
    in_links: int

    def path(self) -> list[Node]:
        """The nodes above, outermost first."""
        out, at = [], self.node
        while at:
            out.append(at)
            at = at.above
        return out[::-1]

    @property
    def tags(self) -> tuple[str, ...]:
        return tuple(n.tag for n in self.path())

    @property
    def last(self) -> str:
        return self.node.tag if self.node else ""


def _names(attributes: str) -> tuple[str, ...]:
    found: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        found += _NAME.findall((m[2] or m[3] or m[4] or "").lower())
    return tuple(found)


def _tag_end(page: str, at: int) -> int:
    """Where a tag ends whose name ends at ``at``; a quoted value may hold a ``>``, an open quote is none."""
    pos = at
    while True:
        x = _STOP.search(page, pos)
        if x is None:
            return len(page)
        if x[0] == ">":
            return x.end()
        close = page.find(x[0][-1], x.end())
        if close < 0:
            end = page.find(">", x.end())
            return end + 1 if end >= 0 else len(page)
        pos = close + 1


class _Stack:
    """Open tags, with counts of them all and since the last tag of SCOPE, so that what is not open is not looked for."""

    def __init__(self) -> None:
        self.top: Node | None = None
        self.open: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.top = Node(tag, names, self.top)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in SCOPE:
            self.scopes.append({})
        else:
            self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.top.tag
        self.open[tag] -= 1
        if tag in SCOPE:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        self.top = self.top.above
        return tag

    def close(self, tag: str) -> bool:
        """An end tag: closes the innermost open one and all in it."""
        if not self.open.get(tag):
            return False
        while self.pop() != tag:
            pass
        return True

    def make_room(self, tag: str) -> None:
        """What opening a tag closes."""
        shut = CLOSES.get(tag, ("p",))
        if any(self.scopes[-1].get(t) for t in shut):
            while self.pop() not in shut:
                pass


def blocks(page: str | None) -> list[Block]:
    """The non-empty blocks of a page in order; a broken page gives what can be read of it."""
    page = page or ""
    out: list[Block] = []
    stack = _Stack()
    held: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                inside = " ".join(html.unescape(" ".join(linked)).split())
                out.append(Block(text, stack.top, len(inside)))
        held, linked = [], []

    def say(text: str) -> None:
        if text:
            held.append(text)
            if in_link:
                linked.append(text)

    def after(mark: str, at: int) -> int:
        end = page.find(mark, at)
        return end + len(mark) if end >= 0 else len(page)

    at = 0
    while True:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        say(page[at:begin])
        m = _TAG.match(page, begin)
        if m is None:
            if page.startswith("<!--", begin):
                at = after("-->", begin + 4)
            elif page.startswith("<![CDATA[", begin):
                at = after("]]>", begin)
            elif page[begin + 1 : begin + 2] in ("!", "?", "/"):
                at = after(">", begin)
            else:
                say("<")
                at = begin + 1
            continue
        at = _tag_end(page, m.end())
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag == "a":
                in_link = False
            if tag in BLOCK:
                flush()
                if stack.close(tag):
                    in_link = False
            continue
        if tag in UNSEEN:
            if tag in ("title", "textarea") or page[at - 2 : at] != "/>":
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            say(" ")
        elif tag == "a":
            in_link = True
        elif tag in BLOCK:
            flush()
            in_link = False
            stack.make_room(tag)
            if tag not in VOID:
                stack.push(tag, _names(page[m.end() : at]))
    flush()
    return out
