"""Token stream of an HTML page: opening and closing tags with implied ends, and text."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Fixed lists of HTML: elements whose content is no markup, without content, and inside a line of text.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
# More elements that may stand inside a paragraph.
PHRASING = {"script", "style", "noscript", "template", "button", "select", "option", "input", "textarea", "iframe", "object", "svg", "canvas", "audio", "video", "map"}
# An opening tag of the value closes an open element of the key, unless one of STOP is between them.
CLOSED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "thead", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}
STOP = {"ul", "ol", "dl", "table", "select", "article", "section", "main", "aside", "nav", "div", "body", "html", "blockquote", "form"}


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}


def stream(page: str):
    """("open", tag, attributes), ("close", tag), ("text", raw text), ("break",); every open has its close."""
    stack: list[str] = []
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            yield "text", m["text"], None
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "br":
                yield "break", None, None
            elif tag in stack:
                while True:
                    top = stack.pop()
                    yield "close", top, None
                    if top == tag:
                        break
            continue
        if tag == "br":
            yield "break", None, None
            continue
        rest = m["rest"] if m["rest"] is not None else m["rest2"]
        if tag in VOID:
            if tag not in INLINE:
                yield "open", tag, {}
                yield "close", tag, None
            continue
        # implied ends
        if tag not in INLINE and tag not in PHRASING and "p" in stack:
            k = len(stack) - 1
            while k >= 0 and stack[k] in INLINE:
                k -= 1
            if k >= 0 and stack[k] == "p":
                while True:
                    top = stack.pop()
                    yield "close", top, None
                    if top == "p":
                        break
        k = len(stack) - 1
        while k >= 0 and stack[k] not in STOP and tag not in CLOSED_BY.get(stack[k], ()):
            k -= 1
        if k >= 0 and tag in CLOSED_BY.get(stack[k], ()):
            while len(stack) > k:
                yield "close", stack.pop(), None
        yield "open", tag, attributes(rest) if rest.strip(" /\n\t\r") else {}
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else n
            yield "close", tag, None
            at = stop if not end else (page.find(">", end.end()) + 1 or n)
            continue
        stack.append(tag)
    while stack:
        yield "close", stack.pop(), None
