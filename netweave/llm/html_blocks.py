"""Leaf blocks of HTML pages: text between block-level tags, with the tag path.

A small scanner, lenient as browsers are: unknown and unclosed tags, missing
ends, cut-off pages and bare text all give blocks; nothing raises.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[a-zA-Z/!?][^>]*+\Z",
    re.S,
)
_NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is not text of the page, that have no content, that are boxes of their own. Any other
#: element, of whatever name, stays inside a line of text.
RAW = {"script", "style", "noscript", "template", "title", "iframe", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BOXES = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "col", "colgroup", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "hr", "html", "input", "label", "legend", "li", "listing", "main", "menu", "nav", "ol", "optgroup", "option", "p", "plaintext",
    "pre", "search", "section", "select", "summary", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "ul", "video", "xmp",
}
#: An element that starts closes these where they are open and nearest.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "select", "blockquote"}
WHITE = " \t\n\f\r"
_IN_HEAD = {"meta", "link", "base"} | RAW


class Block:
    """A leaf block: text, path tokens, characters in links, element."""

    __slots__ = ("linked", "path", "tag", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int, tag: str):
        self.text, self.path, self.linked, self.tag = text, path, linked, tag


def _names(attributes: str) -> list[str]:
    out = []
    for found in _NAME.finditer(attributes):
        out += [t.lower() for t in _TOKEN.findall(found[1] or found[2] or found[3] or "") if len(t) > 1]
    return out


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    #: How many open elements have a name, and a path token, in the order of the stack; the open boxes.
    opened, tokens, boxes = Counter(), {}, []
    held: list[str] = []
    linked = 0
    at, head = 0, False

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text and not head:
                out.append(Block(text, tuple(tokens), min(linked, len(text)), boxes[-1] if boxes else "body"))
            held.clear()
        linked = 0

    def start(name: str, attributes: str) -> None:
        own = (f"<{name}>", *(_names(attributes) if attributes else ()))
        stack.append((name, own))
        opened[name] += 1
        for token in own:
            tokens[token] = tokens.get(token, 0) + 1
        if name in BOXES:
            boxes.append(name)

    def close(upto: int) -> None:
        while len(stack) > upto:
            name, own = stack.pop()
            opened[name] -= 1
            for token in own:
                tokens[token] -= 1
                if not tokens[token]:
                    del tokens[token]
            if name in BOXES:
                boxes.pop()

    size = len(html)
    while at < size:
        found = _TAG.search(html, at)
        end = found.start() if found else size
        if end > at:
            piece = html[at:end]
            if head and piece.strip(WHITE):
                head = False  # text ends it, as in browsers
            held.append(piece)
            linked += len(piece) if opened["a"] else 0
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if name in BOXES:
            flush()
        if name in ("br", "img", "wbr"):
            held.append(" " if name != "wbr" else "")
            continue
        if closing:
            if name == "head":
                head = False
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name == "head":
            head = True
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = stop.end() if stop else size
            continue
        if head and name not in _IN_HEAD and name != "html":
            flush()
            head = False
        if name in ("html", "body") or name in VOID:
            continue
        if name in BOXES and (opened["p"] or any(opened[t] for t in _CLOSES.get(name, ()))):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in _CLOSES.get(name, ()):
                    close(i)
                    if name not in _CLOSES:
                        break
                elif stack[i][0] in _SCOPE:
                    break
        if not attributes.endswith("/"):
            start(name, attributes)
    flush()
    return out
